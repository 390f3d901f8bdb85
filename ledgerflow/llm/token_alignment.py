"""Alignment of two tokenizers by an inverted index of token pairs.

Both tokenizers cut space + text; where they end a token at the same byte, the two tokens are linked and a
group ends. Every task indexes its documents in blocks: for each linked pair a compressed bitmap of the
block's documents (an array of places, or bits where that is shorter), and bitmaps of the same
kind for the binary digits of how often beyond once a document holds the pair. The blocks of a pair, which hold
different documents, are ORed by laying them side by side: popcounts give its documents, and weighted by digit
its links. The index then takes each pair's count back to the documents in its postings, in buckets of B ids.

Neither tokenizer joins anything across the start of white space, so a text is encoded in units that begin
there, each distinct one once in a worker's bounded cache.
"""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .token_counts import byte_letters

#: White space in whose middle one of the tokenizers may stay in a token, and the sign that the other has for a space.
ODD = "".join(map(chr, (0x0B, 0x0C, 0x0D, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x2581)))
UNITS = re.compile("[ \n\t]+[^ \n\t]*")
ODD_TEXT = re.compile(f"[{ODD}]")
ODD_UNITS = re.compile(f"[ \n\t]+(?:[^ \n\t]+|(?<=[{ODD}])[ \n\t]+)*")
#: Units handled at once, bytes of cached units, links and documents of a block.
SLICE, CACHE, LINKS, DOCS = 100_000, 120_000_000, 4_000_000, 65_536
B_BITS = np.uint64(24)


class Pair(NamedTuple):
    """Two tokenizers; of each the bytes of its tokens and their number, by id; and all that can stand in a text of groups: each id with what follows it."""

    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    a_size: np.ndarray
    b_size: np.ndarray
    signs: list[str]


@lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Pair:
    """The two libraries' tokenizers, if neither joins anything across the start of white space."""
    import sentencepiece
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(a_path, encoding="utf-8") as f:
        steps = json.load(f)["pre_tokenizer"] or {}
    if steps.get("type") != "ByteLevel" or not steps.get("use_regex", True) or steps.get("add_prefix_space"):
        raise ValueError(f"{a_path} isn't a plain byte-level tokenizer")
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    back = {c: b for b, c in byte_letters().items()}
    named = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in a.get_vocab().items()}
    a_bytes = [named.get(i, b"") for i in range(max(named) + 1)]
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    if len(b.encode("\n")) != 2 or any(re.search("[^▁][▁ \n\t]|\n.", p) for p in pieces):
        raise ValueError(f"{b_path} has tokens across the start of white space")
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    signs = [f"{i}{x}" for i in range(len(a_bytes)) for x in ",|"] + [f"{i}{x}" for i in range(len(b_bytes)) for x in ",;\n"]
    size = lambda tokens: np.array([len(t) for t in tokens], np.int64)
    return Pair(a, b, a_bytes, b_bytes, size(a_bytes), size(b_bytes), signs)


def broken(pair: Pair, raw: list[bytes], a_ids: list[list[int]], b_ids: list[list[int]]) -> np.ndarray:
    """Which units a tokenizer doesn't give back byte for byte."""
    whole = b"".join(raw)
    if all(b"".join([tokens[i] for ids in every for i in ids]) == whole for tokens, every in ((pair.a_bytes, a_ids), (pair.b_bytes, b_ids))):
        size = np.array([len(r) for r in raw])
        return np.any([size != np.array([sum(map(len, map(tokens.__getitem__, ids))) for ids in every]) for tokens, every in ((pair.a_bytes, a_ids), (pair.b_bytes, b_ids))], axis=0)
    back = lambda tokens, ids: b"".join([tokens[i] for i in ids])
    return np.array([back(pair.a_bytes, x) != r or back(pair.b_bytes, y) != r for r, x, y in zip(raw, a_ids, b_ids, strict=True)])


def aligned(pair: Pair, raw: list[bytes], a_ids: list[list[int]], b_ids: list[list[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The groups of each unit as text, all links in order, and how many are each unit's; the units are given back by both tokenizers."""
    flat = lambda every: np.fromiter((i for ids in every for i in ids), np.int64)
    a, b = flat(a_ids), flat(b_ids)
    a_end, b_end, unit_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b]), np.cumsum([len(r) for r in raw])
    cut = np.intersect1d(a_end, b_end, assume_unique=True)
    links = b[np.searchsorted(b_end, cut)] << int(B_BITS) | a[np.searchsorted(a_end, cut)]
    count = np.bincount(np.searchsorted(unit_end, cut), minlength=len(raw))
    # Every token with its sign: what follows it says whether its side of the group, the group or the unit goes on.
    a_group, b_group = np.searchsorted(cut, a_end), np.searchsorted(cut, b_end)
    last = unit_end[np.searchsorted(unit_end, b_end)] == b_end
    sign = np.concatenate([a * 2 + (cut[a_group] == a_end), len(pair.a_bytes) * 2 + b * 3 + (cut[b_group] == b_end) + last])
    order = np.argsort(np.concatenate([a_group * 2, b_group * 2 + 1]), kind="stable")
    text = "".join(map(pair.signs.__getitem__, sign[order].tolist()))
    return text.split("\n")[:-1], links, count


class Units:
    """What is known of the units met so far, by number; forgotten when it grows beyond ``CACHE``."""

    def __init__(self, a_path: str, b_path: str):
        self.pair = tokenizers(a_path, b_path)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.held, self.links, self.rows = 0, [np.zeros(0, np.uint64)], [np.zeros((0, 4), np.int64)]

    def learn(self, units: list[str]) -> None:
        new = [u for u in dict.fromkeys(units) if u not in self.number]
        if not new:
            return
        a_ids = [x.ids for x in self.pair.a.encode_batch_fast(new, add_special_tokens=False)]
        b_ids = [x[2:] for x in self.pair.b.encode(["\n" + u for u in new], num_threads=1)]
        raw = [u.encode() for u in new]
        bad = broken(self.pair, raw, a_ids, b_ids)
        if bad.any():
            raw, a_ids, b_ids = ([x for x, b in zip(xs, bad, strict=True) if not b] for xs in (raw, a_ids, b_ids))
        texts, links, own = aligned(self.pair, raw, a_ids, b_ids)
        rows = np.zeros((len(new), 4), np.int64)
        rows[:, 3] = bad
        rows[~bad, :3] = np.stack([[len(x) for x in a_ids], [len(x) for x in b_ids], own], axis=1)
        given = iter(texts)
        groups = ["" if b else next(given) for b in bad.tolist()] if bad.any() else texts
        self.number.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
        self.groups += groups
        self.held += 200 * len(new) + 4 * sum(map(len, new)) + sum(map(len, groups)) + 16 * len(links)
        self.links.append(links.astype(np.uint64))
        self.rows.append(rows)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All links in order of units, where each unit's begin, and (tokens of A, of B, links, broken) of each unit."""
        self.links, self.rows = [np.concatenate(self.links)], [np.concatenate(self.rows)]
        return self.links[0], np.concatenate([[0], np.cumsum(self.rows[0][:, 2])]), self.rows[0]


def units_of(text: str) -> Iterator[list[str]]:
    """The units of space + text, ``SLICE`` at once."""
    every = (ODD_UNITS if ODD_TEXT.search(text) else UNITS).finditer(f" {text}")
    if len(text) < 2 * SLICE:
        yield [m[0] for m in every] if ODD_TEXT.search(text) else UNITS.findall(f" {text}")
        return
    while part := [m[0] for m in islice(every, SLICE)]:
        yield part


def layer(key: np.ndarray, documents: int) -> tuple[np.ndarray, ...]:
    """The bitmaps of sorted keys (pair, place): pairs, whether each is bits, places and their number of those that aren't, bits of the others."""
    pair, place = key >> np.uint64(16), (key & np.uint64(0xFFFF)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(key)))
    dense = size * 16 > documents
    mask = np.repeat(dense, size)
    bits = np.zeros((np.count_nonzero(dense), documents), bool)
    bits[np.repeat(np.arange(len(bits)), size[dense]), place[mask]] = True
    return pair[at], dense, place[~mask].astype(np.uint16), size[~dense].astype(np.int32), np.packbits(bits, axis=1)


def postings(key: np.ndarray, times: np.ndarray, documents: int) -> bytes:
    """The bitmap of who holds each pair, then one for each binary digit of how often beyond once."""
    more = times - 1
    layers = [layer(key, documents)] + [layer(key[more >> p & 1 == 1], documents) for p in range(int(more.max()).bit_length() if len(more) else 0)]
    body = pickle.dumps((documents, layers), protocol=5)
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def opened(data: bytes) -> tuple[int, list[tuple[np.ndarray, ...]]]:
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True))


def popcounts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, the documents of each, and its links."""
    _, layers = opened(data)
    pairs, total = layers[0][0], []
    links = np.zeros(len(pairs), np.int64)
    for k, (pair, dense, _, size, bits) in enumerate(layers):
        n = np.zeros(len(pair), np.int64)
        n[~dense], n[dense] = size, np.bitwise_count(bits).sum(axis=1)
        links[np.searchsorted(pairs, pair)] += n << max(k - 1, 0)
        total.append(n)
    return pairs, total[0], links


def returned(data: bytes, pairs: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Columns of ``scores`` (rows as ``pairs``, sorted) added up for each document over its links."""
    documents, layers = opened(data)
    out = np.zeros((documents, scores.shape[1]), np.int64)
    for k, (pair, dense, place, size, bits) in enumerate(layers):
        own = scores[np.searchsorted(pairs, pair)] << max(k - 1, 0)
        np.add.at(out, place.astype(np.int64), np.repeat(own[~dense], size, axis=0))
        for s, row in zip(own[dense], bits, strict=True):
            out[np.flatnonzero(np.unpackbits(row, count=documents))] += s
    return out


def folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their numbers."""
    key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(key) else n


class Block:
    """Documents of a task, and the links of those that count: by place, pair and number."""

    def __init__(self) -> None:
        self.documents, self.raw, self.size, self.parts = 0, [], 0, []

    def fold(self) -> None:
        if self.raw:
            key = np.sort(np.concatenate(self.raw))
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            self.parts.append((key[at], np.diff(np.append(at, len(key)))))
            self.raw, self.size = [], 0

    def rows(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, postings) of the block; a bucket has all pairs of a B id."""
        self.fold()
        if not self.parts:
            return
        key, times = folded(self.parts) if len(self.parts) > 1 else self.parts[0]
        bucket = bucket_of(key >> np.uint64(16), buckets)
        order = np.argsort(bucket, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
        for k in range(buckets):
            at = order[ends[k] : ends[k + 1]]
            if len(at):
                yield k, postings(key[at], times[at], self.documents)


def bucket_of(pair: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((pair >> B_BITS) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets


RESULTS = ("n_a", "n_b", "n_groups", "n_links")


def index_batches(batches: Iterator[pa.RecordBatch], names: list[str], a_path: str, b_path: str, buckets: int, number: int) -> Iterator[pa.RecordBatch]:
    """A task's documents (columns ``names`` and ``_lf_text``) as rows of two kinds; its blocks count from ``number``."""
    known, block = Units(a_path, b_path), Block()
    types: dict[str, pa.DataType] = {}

    def measured(texts: list[list[str]]) -> list[tuple[np.ndarray, str, np.ndarray]]:
        """(tokens of A, of B, groups, broken), groups as text and links of each list of units."""
        if known.held > CACHE:
            known.forget()
        known.learn([u for units in texts for u in units])
        links, begin, rows = known.tables()
        out, get = [], known.number.__getitem__
        ids = np.fromiter((n for units in texts for n in map(get, units)), np.int64)
        size = rows[ids, 2]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = links[np.repeat(begin[ids] - ends[:-1], size) + np.arange(ends[-1])]
        sums, at = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(rows[ids], axis=0)]), 0
        for units in texts:
            to = at + len(units)
            out.append((sums[to] - sums[at], ";".join([known.groups[n] for n in ids[at:to].tolist()]), flat[ends[at] : ends[to]]))
            at = to
        return out

    def taken(sums: np.ndarray, digest, links: list[np.ndarray]) -> tuple:
        """A finished document's row; its links go to the block."""
        place = block.documents
        block.documents += 1
        if sums[3]:
            return 0, 0, 0, 0, "", number, place
        for x in links:
            block.raw.append(x << np.uint64(16) | np.uint64(place))
            block.size += len(x)
            if block.size > LINKS:
                block.fold()
        return int(sums[0]), int(sums[1]), int(sums[2]), int(sums[2]), digest.hexdigest(), number, place

    def documents(part: pa.RecordBatch, done: list[tuple]) -> pa.RecordBatch:
        own = [pa.array([d[k] for d in done], t) for k, t in enumerate(types[c] for c in (*RESULTS, "groups_sha256", "_lf_block", "_lf_place"))]
        return pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *own, pa.nulls(len(done), pa.int64()), pa.nulls(len(done), pa.binary())], names=list(types))

    def closed() -> pa.RecordBatch | None:
        made = list(block.rows(buckets))
        own = {"_lf_block": [number] * len(made), "_lf_bucket": [k for k, _ in made], "_lf_postings": [p for _, p in made]}
        return pa.RecordBatch.from_arrays([pa.array(own.get(n, [None] * len(made)), t) for n, t in types.items()], names=list(types)) if made else None

    for b in batches:
        long = dict.fromkeys([*RESULTS, "groups_sha256", "_lf_block", "_lf_place", "_lf_bucket"], pa.int64())
        types = {n: b.schema.field(n).type for n in names} | long | {"groups_sha256": pa.string(), "_lf_postings": pa.binary()}
        done: list[tuple] = []
        texts = b.column("_lf_text").to_pylist()
        start = i = 0
        while i < len(texts):
            if len(texts[i] or "") >= 2 * SLICE:
                sums, digest, links = np.zeros(4, np.int64), hashlib.sha256(), []
                for k, units in enumerate(units_of(texts[i])):
                    own, groups, codes = measured([units])[0]
                    digest.update((";" * (k > 0) + groups).encode())
                    sums = sums + own
                    links.append(codes)
                done.append(taken(sums, digest, links))
                i += 1
            else:
                some, total = [], 0
                while i < len(texts) and total < 8 * SLICE and len(some) < SLICE // 4 and len(texts[i] or "") < 2 * SLICE:
                    some.append(next(units_of(texts[i])) if texts[i] else [])
                    total += len(texts[i] or "")
                    i += 1
                for units, (own, groups, codes) in zip(some, measured(some), strict=True):
                    done.append(taken(own, hashlib.sha256(groups.encode()), [codes]) if units else taken(np.ones(4), None, []))
            full = block.documents > DOCS - SLICE // 4 or block.size > LINKS or block.parts
            if full or i == len(texts):
                yield documents(b.slice(start, len(done)), done)
                start, done = start + len(done), []
            if full:
                if (made := closed()) is not None:
                    yield made
                block, number = Block(), number + 1
    if block.documents and (made := closed()) is not None:
        yield made


def index_documents(df: DataFrame, text: str, a_path: str, b_path: str, buckets: int, carry_text: bool) -> DataFrame:
    """Rows of two kinds: a document with its block, place and own results, and (block, bucket, postings)."""
    fields = [T.StructField(f.name, f.dataType, True) for f in df.schema.fields if carry_text or f.name != text]
    names = [f.name for f in fields]
    added = [T.StructField(c, T.LongType()) for c in RESULTS] + [T.StructField("groups_sha256", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("_lf_block", "_lf_place", "_lf_bucket")), T.StructField("_lf_postings", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return index_batches(batches, names, a_path, b_path, buckets, TaskContext.get().partitionId() << 32)

    return df.select(*names, F.col(text).alias("_lf_text")).mapInArrow(run, T.StructType([*fields, *added]))


def pair_counts(index: DataFrame) -> DataFrame:
    """(bucket, pair, a, b, documents, links, best): of every pair linked anywhere; best says that no pair of its B id has more links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pair, documents, links = popcounts(data)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket] * len(pair), pa.int64()), "pair": pa.array(pair.astype(np.int64)), "documents": pa.array(documents), "links": pa.array(links)})

    every = index.filter("_lf_bucket is not null").select("_lf_bucket", "_lf_postings").mapInArrow(run, "bucket long, pair long, documents long, links long")
    summed = every.groupBy("bucket", "pair").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links"))
    bits = int(B_BITS)
    summed = written(summed.select("bucket", "pair", F.col("pair").bitwiseAND((1 << bits) - 1).alias("a"), F.shiftright("pair", bits).alias("b"), "documents", "links"))
    most = summed.groupBy("b").agg(F.max("links").alias("_lf_most"))
    return summed.join(most, "b").select("bucket", "pair", "a", "b", "documents", "links", (F.col("links") == F.col("_lf_most")).alias("best"))


def add_alignment(df: DataFrame, a_path: str, b_path: str, text: str = "text", carry_text: bool = True) -> DataFrame:
    """Adds what two tokenizers make of each text: n_a, n_b, n_groups, n_links, n_best, count_sum long and groups_sha256 string.

    A is a byte-level BPE file, B a sentencepiece model; both files are on every worker. n_best counts the links
    whose pair no other of the same B id exceeds anywhere, count_sum adds the pairs' numbers of links. Texts that are null, empty or
    not given back byte for byte by a tokenizer have zeros and an empty digest. Repeated rows count each; a text of
    any length is encoded whole, in units; an empty table gives an empty one; input columns with the results' names are replaced.
    A task holds the links of one block (``LINKS``, or one document's distinct pairs), a bounded cache, and the counts of one bucket.
    """
    out = (*RESULTS, "n_best", "count_sum", "groups_sha256")
    df = df.select([c for c in df.columns if c not in out])
    spark = df.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = written(index_documents(df, text, a_path, b_path, buckets, carry_text), "zstd")
    return scored(index, written(pair_counts(index)))


def scored(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """The documents of an index with the counts of their pairs, which go back along the postings."""
    scores = pairs.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("pair", "links", F.col("best").cast("long").alias("best")))).alias("scores"))
    held = index.filter("_lf_bucket is not null").select("_lf_block", F.col("_lf_bucket").alias("bucket"), "_lf_postings")

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                s = b.column("scores").slice(k, 1).flatten()
                pair, links, best = (s.field(n).to_numpy().astype(np.int64) for n in ("pair", "links", "best"))
                sums = returned(b.column("_lf_postings")[k].as_py(), pair.astype(np.uint64), np.stack([best, links], axis=1))
                raw = sums.astype("<i8").tobytes()
                yield pa.RecordBatch.from_pydict({"_lf_block": b.column("_lf_block").slice(k, 1), "sums": pa.array([len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)], pa.binary())})

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = 0
        for data in rows.column("sums").to_pylist():
            total = total + np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd"), "<i8").reshape(-1, 2)
        n = len(total)
        return pa.table({"_lf_block": pa.array([key[0].as_py()] * n, pa.int64()), "_lf_place": pa.array(np.arange(n)), "n_best": pa.array(np.ascontiguousarray(total[:, 0])), "count_sum": pa.array(np.ascontiguousarray(total[:, 1]))})

    parts = held.join(scores, "bucket").select("_lf_block", "_lf_postings", "scores").mapInArrow(give, "_lf_block long, sums binary")
    sums = parts.groupBy("_lf_block").applyInArrow(add, "_lf_block long, _lf_place long, n_best long, count_sum long")
    docs = index.filter("_lf_bucket is null").drop("_lf_bucket", "_lf_postings")
    zero: Column = F.lit(0).cast("long")
    return docs.join(sums, ["_lf_block", "_lf_place"], "left").withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")}).drop("_lf_block", "_lf_place")
