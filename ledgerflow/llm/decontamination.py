"""Benchmark decontamination by pigeonhole edit matching over words.

An item of m words may differ from a passage by ``budget(m)`` word edits. Cut into one
piece more than that, at least one piece is intact in any such passage. Every text is
searched for the pieces (hashes of word n-grams), and around each hit Myers' bit-parallel
algorithm gives the least edit distance of the whole item to a passage of the text.

Items come in blocks of bounded size; each block's pieces are broadcast and all rows
run by it, so a benchmark of any size works and the documents aren't shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENS = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
CACHED = 200_000
MATCHES = "array<struct<item_id:long,distance:int,start:int,end:int>>"


def tokens(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return TOKENS.findall((text or "").lower())


def budget(m: int, similarity: float) -> int:
    """Word edits that keep an item of m words at ``similarity`` or more."""
    return int(m * (1 - similarity) + 1e-9)


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k + 1 near-equal pieces of m words (k < m)."""
    cuts = [m * i // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def least_distance(pattern: list[str], passage: list[str]) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``passage``, and that part's end (the first such).

    Myers (1999), with words as symbols and integers of any width as bit vectors.
    """
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        masks[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (m, 0)
    for j, w in enumerate(passage):
        eq = masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += (ph & top > 0) - (mh & top > 0)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


class Hashes(dict):
    """64-bit hashes of words, kept for a bounded number."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def gram_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    out = h[: len(h) - length + 1].copy()
    for i in range(1, length):
        out = out * BASE + h[i : len(h) - length + 1 + i]
    return out


class Index:
    """The pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        self.items, self.where = [], defaultdict(list)
        words = Hashes()
        by_length = defaultdict(set)
        for item_id, text in items:
            w = tokens(text)
            if not w:
                continue
            k = budget(len(w), similarity)
            h = np.array([words[x] for x in w], dtype=np.uint64)
            for start, length in pieces(len(w), k):
                g = int(gram_hashes(h[start : start + length], length)[0])
                self.where[length, g].append((len(self.items), start))
                by_length[length].add(g)
            self.items.append((item_id, w, k))
        self.by_length = {n: np.array(sorted(g), dtype=np.uint64) for n, g in by_length.items()}

    def find(self, text: str | None, words: Hashes) -> list[dict]:
        """The items found in a text, each with its least distance and that passage's word offsets."""
        w = tokens(text)
        if not w:
            return []
        h = np.fromiter((words[x] for x in w), dtype=np.uint64, count=len(w))
        hits = defaultdict(set)
        for length, known in self.by_length.items():
            if len(w) < length:
                continue
            g = gram_hashes(h, length)
            at = np.minimum(np.searchsorted(known, g), len(known) - 1)
            for p in np.flatnonzero(known[at] == g):
                for item, start in self.where[length, int(g[p])]:
                    hits[item].add(int(p) - start)
        out = []
        for item, starts in hits.items():
            item_id, pattern, k = self.items[item]
            m, best = len(pattern), None
            lo = hi = None
            spans = []
            for s in sorted(starts):
                a, b = max(0, s - k), min(len(w), s + m + k)
                if lo is not None and a <= hi:
                    hi = max(hi, b)
                else:
                    if lo is not None:
                        spans.append((lo, hi))
                    lo, hi = a, b
            spans.append((lo, hi))
            for a, b in spans:
                d, end = least_distance(pattern, w[a:b])
                if d <= k and (best is None or d < best[0]):
                    _, length = least_distance(pattern[::-1], w[a : a + end][::-1])
                    best = (d, a + end - length, a + end)
            if best:
                out.append({"item_id": item_id, "distance": best[0], "start": best[1], "end": best[2]})
        return sorted(out, key=lambda r: (r["item_id"] is None, r["item_id"]))


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of about ``block_bytes`` of text, one at a time."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    total = items.agg(F.sum(size.cast("long"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    if n == 1:
        yield [(r[0], r[1]) for r in items.select(item_id, text).collect()]
        return
    hashed = items.select(item_id, text, F.pmod(F.xxhash64(item_id, text), F.lit(n)).alias("_lf_block"))
    for b in range(n):
        yield [(r[0], r[1]) for r in hashed.filter(F.col("_lf_block") == b).select(item_id, text).collect()]


def add_matches(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = 0.8, block_bytes: int = 4 << 20, carry_text: bool = True) -> DataFrame:
    """Adds ``matches``: the items of which a text holds a passage, an array of structs.

    Each has item_id, distance (word edits), and start and end (words of the text, by
    ``tokens``) of the nearest passage, for distances of at most (1 - similarity) of the item's
    words. Null or empty texts match nothing; items without words are left out; items of
    up to four words must occur unchanged; repeated rows are matched each; repeated items are
    reported each. Empty tables give no rows, or no matches. An input column ``matches``
    is replaced.
    """
    df = df.drop("matches")
    sc = df.sparkSession.sparkContext
    out = df.withColumn("matches", F.array().cast(MATCHES))
    for block in item_blocks(items, item_id, item_text, block_bytes):
        shared = sc.broadcast(Index(block, similarity))
        schema = out.schema

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, words = shared.value, Hashes()
            for b in batches:
                names = b.schema.names
                found = [a + index.find(t, words) for a, t in zip(b.column("matches").to_pylist(), b.column(text).to_pylist(), strict=True)]
                k = names.index("matches")
                columns = [pa.array(found, c.type) if i == k else c for i, c in enumerate(b.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        out = out.mapInArrow(run, T.StructType(schema.fields))
    return out if carry_text else out.drop(text)
