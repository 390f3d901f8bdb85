"""Language identification by prediction by partial matching.

For every language a context tree of bytes up to ``ORDER`` deep is counted from labelled texts and then
frozen. The code length of a byte follows from the deepest context that the tree holds: its share there, or
an escape to the next shorter context, in which the bytes that the longer one knows are excluded (escape
method C), down to equal shares of the bytes that are left. A text's language is the one that codes it in
the fewest bits. Lengths are in 1/65536 bit and added as integers, so sums don't depend on order.

With frozen counts the length of a byte depends on the ``ORDER`` bytes before it alone. So the lengths of all
runs of ``ORDER`` + 1 bytes that any language knows are in one hash table of whole columns, and only other runs
walk down the trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = 4
BIT = 65536
#: Positions scored at once.
CHUNK = 1 << 19
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The run of ``ORDER`` + 1 bytes that ends at each byte of the texts, and where each text begins; a text follows ``ORDER`` spaces."""
    pad = b" " * ORDER
    data = LOWER[np.frombuffer(pad + pad.join(texts), np.uint8)].astype(np.uint64)
    size = np.array([len(t) for t in texts], np.int64)
    n = len(data) - ORDER
    run = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        run = run << np.uint64(8) | data[k : n + k]
    ends = np.cumsum(size + ORDER) - ORDER
    own = np.ones(n, bool)
    for e in ends[:-1]:
        own[e : e + ORDER] = False
    return run[own], np.concatenate([[0], np.cumsum(size)])


class Tree(NamedTuple):
    """One language's contexts of ``k`` bytes for each k: bytes after them (``gram``: context and byte) with counts ``n``, and of each
    context the sum of counts, the number of different bytes, and the sum of counts that those bytes have in the context without its first byte."""

    gram: list[np.ndarray]
    n: list[np.ndarray]
    context: list[np.ndarray]
    total: list[np.ndarray]
    kinds: list[np.ndarray]
    below: list[np.ndarray]


def tree_of(gram: np.ndarray, n: np.ndarray) -> Tree:
    """The frozen counts of one language from its runs of ``ORDER`` + 1 bytes."""
    grams, counts, contexts, totals, kinds, belows = [], [], [], [], [], []
    for k in range(ORDER + 1):
        g, place = np.unique(gram & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        c = np.zeros(len(g), np.int64)
        np.add.at(c, place, n)
        context, at = np.unique(g >> np.uint64(8), return_inverse=True)
        shorter = counts[k - 1][np.searchsorted(grams[k - 1], g & np.uint64((1 << 8 * k) - 1))] if k else np.zeros(len(g))
        grams.append(g)
        counts.append(c)
        contexts.append(context)
        totals.append(np.bincount(at, weights=c, minlength=len(context)))
        kinds.append(np.bincount(at, minlength=len(context)))
        belows.append(np.bincount(at, weights=shorter, minlength=len(context)))
    return Tree(grams, counts, contexts, totals, kinds, belows)


def found(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def code_lengths(tree: Tree, run: np.ndarray) -> np.ndarray:
    """The length of the last byte of each run after the bytes before it."""
    bits = np.zeros(len(run))
    left, gone, gone_kinds = np.ones(len(run), bool), np.zeros(len(run)), np.zeros(len(run))
    for k in range(ORDER, -1, -1):
        gram = run & np.uint64((1 << 8 * (k + 1)) - 1)
        c, known = found(tree.context[k], gram >> np.uint64(8))
        g, seen = found(tree.gram[k], gram)
        kinds = tree.kinds[k][c] - gone_kinds
        whole = tree.total[k][c] - gone + kinds
        hit = left & seen
        bits[hit] += np.log2(whole[hit] / tree.n[k][g[hit]])
        escape = left & ~seen & known & (kinds > 0)
        bits[escape] += np.log2(whole[escape] / kinds[escape])
        left &= ~seen
        gone = np.where(known, tree.below[k][c], 0.0)
        gone_kinds = np.where(known, tree.kinds[k][c], 0)
    bits[left] += np.log2(256 - gone_kinds[left])
    return np.rint(bits * BIT).astype(np.int64)


class Model:
    """Frozen trees of all languages, and the lengths of all runs that one of them knows."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], texts: dict[str, int]):
        self.langs = sorted(counts)
        self.trees = [tree_of(*counts[x]) for x in self.langs]
        share = np.array([texts[x] for x in self.langs], float)
        self.prior = np.rint(-np.log2(share / share.sum()) * BIT).astype(np.int64) if len(share) else np.zeros(0, np.int64)
        known = np.unique(np.concatenate([t.gram[ORDER] for t in self.trees])) if self.trees else np.zeros(0, np.uint64)
        self.lengths = [code_lengths(t, known).astype(np.int32) for t in self.trees]
        self.shift = np.uint64(64 - max(4, int(4 * len(known)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.known = known
        slot, todo = self.slot(known), np.arange(len(known))
        while len(todo):
            free = self.slots[slot[todo]] < 0
            self.slots[slot[todo[free]]] = todo[free]  # of several for one slot the last stays
            todo = todo[self.slots[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) % len(self.slots)

    def slot(self, run: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (run * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def places(self, run: np.ndarray) -> np.ndarray:
        """The place of each run among the known ones, -1 for others."""
        slot = self.slot(run)
        at = self.slots[slot]
        todo = np.flatnonzero((at >= 0) & (self.known[at] != run))
        while len(todo):
            slot[todo] = (slot[todo] + 1) % len(self.slots)
            at[todo] = self.slots[slot[todo]]
            todo = todo[(at[todo] >= 0) & (self.known[at[todo]] != run[todo])]
        return at

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths, a row for each text and a column for each language."""
        sums = np.zeros((len(texts), len(self.langs)), np.int64)
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            for a in range(0, len(t), CHUNK):
                seen = min(a, ORDER)  # bytes of the part before, which a long text's next part follows
                held.append((i, seen, t[a - seen : a + CHUNK]))
                size += len(held[-1][2])
                if size >= CHUNK:
                    self.add(sums, held)
                    held, size = [], 0
        self.add(sums, held)
        return sums

    def add(self, sums: np.ndarray, held: list[tuple[int, int, bytes]]) -> None:
        """Adds the lengths of parts (text, bytes already coded, bytes) to their texts' sums."""
        if not held or not self.langs:
            return
        run, begin = runs_of([part for _, _, part in held])
        at = self.places(run)
        miss = np.flatnonzero(at < 0)
        odd, place = np.unique(run[miss], return_inverse=True)
        owner, first = np.array([i for i, _, _ in held]), begin[:-1] + np.array([seen for _, seen, _ in held])
        for k, tree in enumerate(self.trees):
            bits = self.lengths[k][at].astype(np.int64)
            bits[miss] = code_lengths(tree, odd)[place]
            total = np.concatenate([[0], np.cumsum(bits)])
            np.add.at(sums[:, k], owner, total[begin[1:]] - total[first])

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        """The language of each text and its share of the belief, from code lengths and how frequent languages are."""
        bits = self.texts(texts) + self.prior
        best = bits.argmin(axis=1)
        over = (bits - bits.min(axis=1, keepdims=True)) / BIT
        return [self.langs[i] for i in best], (1 / np.exp2(-over).sum(axis=1)).tolist()


def learn(labelled: DataFrame, sample_bytes: int) -> Model:
    """The model of rows (lang, text, row hash): all of a language with up to ``sample_bytes`` of text, of others that many by row hash."""
    sizes = labelled.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("n"))
    total = {r.lang: (r["size"], r["n"]) for r in sizes.collect()}
    share = F.lit(0)
    if total:
        share = F.map_from_arrays(F.array(*map(F.lit, total)), F.array(*[F.lit(int(min(1.0, sample_bytes / max(size, 1)) * (1 << 30))) for size, _ in total.values()]))[F.col("lang")]
    chosen = labelled.filter(F.shiftrightunsigned("row", 34) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                gram, n = np.unique(runs_of(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(gram), pa.string()), "gram": pa.array(gram.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    counts = chosen.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, n = counts["lang"].to_pandas().to_numpy(), counts["gram"].to_numpy().astype(np.uint64), counts["n"].to_numpy()
    return Model({x: (gram[lang == x], n[lang == x]) for x in sorted(set(lang))}, {x: n for x, (_, n) in total.items()})


def add_language(df: DataFrame, train: Column, lang: str = "lang", text: str = "text", sample_bytes: int = 4_000_000, carry_text: bool = True) -> DataFrame:
    """Adds ``lang_pred`` string and ``score`` double, the share of the belief in it, from the whole text alone.

    It learns from rows of ``train`` with a language and a text that holds a letter. The trees are fitted on about ``sample_bytes``
    of text a language, chosen by a hash of the whole row; every text is scored. A text that is null or has no letter is
    ``und`` with score 0, and so are all texts if nothing can be learned. Equal texts get equal results; of equal code
    lengths the language first in order is taken. A long text is coded in parts with the bytes before them in
    view, so no cut changes a length. An empty table gives an empty one; input columns with the results' names are replaced.
    """
    seen = df.select([c for c in df.columns if c not in ("lang_pred", "score")])
    learned = F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & F.coalesce(train, F.lit(False))
    model = learn(seen.filter(learned).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(*seen.columns).alias("row")), sample_bytes)
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in seen.schema.fields if carry_text or f.name != text]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            texts = [t or b"" for t in b.column("_lf_text").cast(pa.binary()).to_pylist()]
            pred, score = own.predict(texts) if own.langs and texts else ([None] * len(texts), [0.0] * len(texts))
            ok = [bool(t) and x is not None for t, x in zip(texts, pred, strict=True)]
            columns = [*(b.column(n) for n in names), pa.array([x if k else "und" for x, k in zip(pred, ok, strict=True)], pa.string()), pa.array([x if k else 0.0 for x, k in zip(score, ok, strict=True)], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score"])

    scored = F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("_lf_text")
    return seen.select(*names, scored).mapInArrow(run, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
