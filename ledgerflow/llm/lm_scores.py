"""Scores of texts under a class-based bigram model (Brown et al., 1992).

log P(text) = sum over tokens of log10 P(class | previous class) + log10 P(word | class),
one end token a text included. Every training word gets its class by exchange, and every word counts as a
neighbour by its class:

- Word counts of all training texts come from Spark (map-side combined, shuffled by
  word) and may be of any size. The ``hot_words`` most frequent are broadcast; the
  others meet the texts that hold them, and their classes, in joins.
- Start: the ``window`` most frequent words are clustered exactly, one at a time, on the table of their bigrams;
  the other broadcast words join the class that is likeliest beside those; a rarer word starts in
  the class of most broadcast words with its ending.
- Sweeps over all training texts: half of the broadcast words at a time move to the class in which the bigrams of
  classes, of all tokens, are likeliest given the classes of their neighbours. A sweep counts the classes
  to either side of each word in tasks and adds them up by blocks of words.
- The rarer words then choose among classes alike, from their neighbours shuffled by word, their classes are
  joined to the texts, and the broadcast words are swept again.
- A class is chosen beforehand as often as it has words: without that, words seen once or twice fit their own bigrams,
  and texts that weren't learnt from score worse.
- After each of these steps the likelihood of the class bigrams, and of the words' classes under that prior, is counted anew
  over all training texts. A step that lowers it is taken back, so it never falls. The number of sweeps is a setting.
- Class bigrams of
  all training texts give the transitions. They are mixed with the classes' frequencies: words that were seen
  once chose their classes by the very bigrams that are counted, so the share of tokens that are new words (by
  Good and Turing that of words seen once) weighs the latter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: In the code of a rare word in a text: no training text holds it, and its low bits are the slot of its ending.
UNSEEN = 1 << 16
#: What each pair of classes counts before any is seen, where words choose among classes.
ALPHA = 0.5
#: Slots for endings of words.
ENDINGS = 1 << 16
#: Broadcast words whose counts beside them are one row of an exchange.
COUNTED = 1024
#: Distinct words that a task adds up before it hands their counts on.
DISTINCT = 500_000


@dataclass(frozen=True)
class Settings:
    """Bounds of what is broadcast or gathered: hot_words entries, twice ``classes`` counts for half of them, and (window + 2) squared cells.

    ``classes`` (255 at most) includes one of its own for the end of a text. ``first_sweeps`` and ``last_sweeps``:
    sweeps of half of the words each, before and after the rarer words choose.
    """

    hot_words: int = 100_000
    window: int = 1000
    classes: int = 48
    first_sweeps: int = 4
    last_sweeps: int = 4

    @property
    def end(self) -> int:
        return self.classes - 1

    @property
    def other(self) -> int:
        """At the start: any word beyond the window."""
        return self.classes

    @property
    def neighbours(self) -> int:
        return self.classes + 1


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def numbers(w: list[bytes], ids: dict[bytes, int]) -> np.ndarray:
    """Ranks of words; the number of ranks for any other word."""
    return np.fromiter(map(ids.get, w, repeat(len(ids))), dtype=np.int64, count=len(w))


def word_counts(train: DataFrame, text: str) -> DataFrame:
    """(word, n) of all texts; each task adds up ``DISTINCT`` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                found.update(tokens(t))
                if len(found) >= DISTINCT:
                    yield rows()
                    found.clear()
        yield rows()

    return train.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def joined(ids: pa.Array, end: int) -> np.ndarray:
    """The tokens of all texts of a batch one after the other, an end before the first: each text stands between two ends."""
    return np.concatenate([np.array([end], dtype=np.int32), np.frombuffer(b"".join(ids.to_pylist()), dtype=np.int32)])


def window_bigrams(train: DataFrame, n: int, h: int) -> np.ndarray:
    """Counts of neighbours over all texts: the window's ``n`` words by rank, then the end (before and after each text), then any other word."""
    size = n + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, table = np.full(h + 2, n + 1, dtype=np.int64), np.zeros(size * size, dtype=np.int64)
        unit[:n] = np.arange(n)
        unit[h + 1] = n
        for b in batches:
            u = unit[joined(b.column(0), h + 1)]
            np.add.at(table, u[:-1] * size + u[1:], np.int64(1))
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cells), "n": pa.array(table[cells])})

    found = train.select("_lf_lm.ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * size, dtype=np.int64)
    table[found["cell"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(size, size)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int, own: int = 1) -> np.ndarray:
    """The class of each unit; the last ``own`` units have the last classes for themselves.

    The most frequent units begin a class each and the others join one in the order of
    frequency; ends when no unit moves. Ties go to the lower class.
    """
    n, k = len(pairs), classes - own
    m = pairs.astype(np.float64)
    freq = m.sum(axis=0)
    cls = np.full(n, -1, dtype=np.int64)
    order = np.argsort(-freq[: n - own], kind="stable")
    order = order[freq[order] > 0]
    cls[n - own :] = np.arange(k, classes)
    cls[order[:k]] = np.arange(min(k, len(order)))
    one = np.zeros((n, classes))
    one[np.flatnonzero(cls >= 0), cls[cls >= 0]] = 1
    right, left = m @ one, m.T @ one  # of each unit: counts with the classes after and before it
    c = one.T @ right
    moved = True
    while moved:
        moved = False
        for u in order:
            a, mine = cls[u], m[u, u]
            r, lf = right[u].copy(), left[u].copy()
            if a >= 0:
                r[a] -= mine
                lf[a] -= mine
                c[a, :] -= r
                c[:, a] -= lf
                c[a, a] -= mine
            f = xlogx(c)
            gain = (xlogx(c + r) - f).sum(axis=1) + (xlogx(c.T + lf) - f.T).sum(axis=1)
            d = np.diagonal(c)
            gain += xlogx(d + r + lf + mine) + xlogx(d) - xlogx(d + r) - xlogx(d + lf)
            rows, cols = c.sum(axis=1) + lf, c.sum(axis=0) + r  # whatever the class of u, its neighbours occur as often
            gain -= xlogx(rows + r.sum() + mine) - xlogx(rows) + xlogx(cols + lf.sum() + mine) - xlogx(cols)
            gain[k:] = -np.inf
            b = int(np.argmax(gain))
            if a >= 0 and gain[b] <= gain[a] + 1e-6:
                b = a
            c[b, :] += r
            c[:, b] += lf
            c[b, b] += mine
            if b != a:
                moved = True
                cls[u] = b
                if a >= 0:
                    right[:, a] -= m[:, u]
                    left[:, a] -= m[u, :]
                right[:, b] += m[:, u]
                left[:, b] += m[u, :]
    return np.maximum(cls, 0)


@dataclass
class Choice:
    """What a word gains in each class from its neighbours, given the bigrams ``c`` of classes, and beforehand."""

    before: np.ndarray
    after: np.ndarray
    each: np.ndarray
    prior: np.ndarray

    @staticmethod
    def of(c: np.ndarray, kinds: np.ndarray) -> Choice:
        """``kinds``: number of words of each class that can be chosen."""
        c, words = c + ALPHA, len(kinds)
        return Choice(np.log(c[:, :words]), np.log(c[:words].T), np.log(c.sum(axis=0)[:words]) + np.log(c.sum(axis=1)[:words]), np.log(kinds + ALPHA))

    def best(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The class of each word from the counts of classes to its left and right; ties to the lower class."""
        return (left @ self.before + right @ self.after - left.sum(axis=1, keepdims=True) * self.each + self.prior).argmax(axis=1)

    def codes(self) -> np.ndarray:
        """The gain of one occurrence between each pair of classes, the left one first."""
        return (self.before[:, None, :] + self.after[None, :, :] - self.each).reshape(-1, len(self.each))


def likelihood(c: np.ndarray, kinds: np.ndarray) -> float:
    """Of class bigrams, but for what no class changes (the entropy of single words); and of the classes of words, given their sizes."""
    return float(xlogx(c).sum() - xlogx(c.sum(axis=0)).sum() - xlogx(c.sum(axis=1)).sum() + xlogx(kinds).sum() - xlogx(kinds.sum()))


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def start_classes(top: list[bytes], cls: np.ndarray, classes: int) -> np.ndarray:
    """By slot of endings the class of most broadcast words; the largest class where none ends so."""
    found = np.zeros((ENDINGS, classes), dtype=np.int32)
    np.add.at(found, (np.fromiter(map(ending, top), dtype=np.int64, count=len(top)), cls), 1)
    return np.where(found.any(axis=1), found.argmax(axis=1), found.sum(axis=0).argmax()).astype(np.uint8)


def slot_of(word: str) -> Column:
    """``ending`` as a column."""
    return F.crc32(F.substring(F.col(word).cast("binary"), -3, 3)) % ENDINGS


def start_sizes(counts: DataFrame, top: list[bytes], starts: np.ndarray, classes: int) -> np.ndarray:
    """By class the number of words of ``counts`` that start in it and aren't broadcast."""
    found = counts.groupBy(slot_of("word").alias("slot")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    sizes = -np.bincount(starts[[ending(w) for w in top]], minlength=classes)
    np.add.at(sizes, starts[found["slot"].to_numpy()], found["n"].to_numpy())
    return sizes


Rare = Callable[[pa.Array], np.ndarray]


def by_ending(starts: np.ndarray) -> Rare:
    """Classes of rare words from their endings: of lists of words, or of the slots that ``encoded`` made of them."""

    def run(held: pa.Array) -> np.ndarray:
        if pa.types.is_list(held.type):
            return starts[np.fromiter((ending(w.encode()) for w in held.flatten().to_pylist()), dtype=np.int64)]
        return starts[np.frombuffer(b"".join(held.to_pylist()), dtype=np.uint16)]

    return run


def joined_classes(shift: int, endings: np.ndarray) -> Rare:
    """Classes of rare words as the join has put them: the chosen ones (shift 0), or those of the start (8); of unseen words by ``endings``."""

    def run(held: pa.Array) -> np.ndarray:
        r = held.flatten().to_numpy()
        return np.where(r & UNSEEN, endings[r % ENDINGS], r >> shift & 255)

    return run


def all_classes(ids: pa.Array, rare: pa.Array, cls: np.ndarray, rare_of: Rare) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and classes of all tokens of a batch, an end before the first. ``cls``: by rank, then any rare word's, then the end's."""
    i = joined(ids, len(cls) - 1)
    c = cls[i]
    c[i == len(cls) - 2] = rare_of(rare)  # in the order of their places
    return i, c


def near_words(texts: DataFrame, cls: np.ndarray, rare_of: Rare, k: int, part: int | None) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Over (ids, rare) of all training texts: bigrams of classes; and by blocks of broadcast words of odd or even rank
    their ranks, and counts of the ``k`` classes to the left and right (of none where ``part`` is null).

    The counts reach the driver compressed, and one block of them at a time is unpacked.
    """
    h = len(cls) - 2

    n = 0 if part is None else (h + 1 - part) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, pairs = np.zeros((n, 2 * k), dtype=np.int32), np.zeros(k * k, dtype=np.int64)
        cells, one = near.reshape(-1), np.int32(1)  # a number of another type than the cells' is added ten times as slowly
        for b in batches:
            i, c = all_classes(b.column(0), b.column(1), cls, rare_of)
            c = c.astype(np.int64)
            pairs += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
            if n:
                at = np.flatnonzero((i < h) & (i & 1 == part))
                row = i[at].astype(np.int64) // 2 * (2 * k)
                np.add.at(cells, row + c[at - 1], one)
                np.add.at(cells, row + k + c[at + 1], one)
        yield pa.RecordBatch.from_pydict({"block": pa.array([-1], pa.int32()), "counts": pa.array([packed(pairs)], pa.binary())})
        for block in range(-(-n // COUNTED)):
            some = near[block * COUNTED : (block + 1) * COUNTED]
            if some.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([packed(some)], pa.binary())})

    def cells_of(block: int) -> int:
        return k * k if block < 0 else min(COUNTED, n - block * COUNTED) * 2 * k

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                one = unpacked(x, np.int64 if i < 0 else np.int32, cells_of(i))
                if i in found:
                    found[i] += one
                else:
                    found[i] = one.astype(np.int64)
        for i, x in found.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "counts": pa.array([packed(x)], pa.binary())})

    schema = "block int, counts binary"
    got = texts.mapInArrow(run, schema).repartition("block").mapInArrow(summed, schema).toArrow()
    counts = dict(zip(got["block"].to_pylist(), got["counts"], strict=True))
    pairs = unpacked(counts.pop(-1), np.int64, k * k).reshape(k, k) if counts else np.zeros((k, k), dtype=np.int64)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for block in sorted(counts):
            near = unpacked(counts[block], np.int64, cells_of(block)).reshape(-1, 2 * k).astype(np.float64)
            used = np.flatnonzero(near.any(axis=1))
            yield 2 * (block * COUNTED + used) + part, near[used, :k], near[used, k:]

    return pairs, blocks()


def packed(counts: np.ndarray) -> bytes:
    """Most counts of a block are zero or small."""
    return pa.compress(counts.tobytes(), codec="zstd", asbytes=True)


def unpacked(counts: pa.Scalar, kind: type, cells: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(counts.as_buffer(), decompressed_size=cells * np.dtype(kind).itemsize, codec="zstd"), dtype=kind)


def class_counts(texts: DataFrame, cls: np.ndarray, rare_of: Rare, k: int, part: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``near_words`` with all blocks in one."""
    pairs, blocks = near_words(texts, cls, rare_of, k, part)
    none = (np.empty(0, dtype=np.int64), np.empty((0, k)), np.empty((0, k)))
    return pairs, *map(np.concatenate, zip(none, *blocks, strict=True))


def swept(texts: DataFrame, cls: np.ndarray, rare_of: Rare, sizes: np.ndarray, sweeps: int, settings: Settings, trace: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """The classes of the broadcast words, and the bigrams of all classes, after ``sweeps`` sweeps or when no word of either half moves.

    ``sizes``: number of the other words by class.
    ``trace`` gets the likelihood after each; the sweep that lowers it is taken back, and is the last.
    """
    k, h = settings.classes, len(cls) - 2
    old, old_pairs, still = None, None, 0
    for s in range(sweeps + 1):
        pairs, near = near_words(texts, cls, rare_of, k, s % 2 if s < sweeps else None)
        kinds = sizes + np.bincount(cls[:h], minlength=settings.end)
        value = likelihood(pairs, kinds)
        if old is not None and value < trace[-1]:
            return old, old_pairs
        trace.append(value)
        if s == sweeps or still == 2:
            break
        old, old_pairs = cls, pairs
        cls, choice = cls.copy(), Choice.of(pairs, kinds)
        for ids, left, right in near:
            cls[ids] = choice.best(left, right)
        still = still + 1 if np.array_equal(cls, old) else 0
    return cls, pairs


def rare_choices(texts: DataFrame, cls: np.ndarray, starts: np.ndarray, pairs: np.ndarray, kinds: np.ndarray, settings: Settings) -> DataFrame:
    """(word, seen, start, cls) of each rare word of (ids, slots, word) or (ids, word), as a written table: its class at the start, and the likeliest one among its neighbours' classes."""
    k, h, rare_of = settings.classes, len(cls) - 2, by_ending(starts)
    choice = Choice.of(pairs, kinds)
    gain = choice.codes()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, c = all_classes(b.column(0), b.column(1), cls, rare_of)
            at = np.flatnonzero(i == h)
            yield pa.RecordBatch.from_arrays([b.columns[-1].flatten(), pa.array(c[at - 1].astype(np.int32) * k + c[at + 1])], names=["word", "code"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1000):  # bounds the memory: a word has at most so many codes
                part = b.slice(a, 1000)
                ends = np.concatenate([[0], np.cumsum(part.column(1).value_lengths().to_numpy())])
                n = part.column(2).flatten().to_numpy()
                best = (np.add.reduceat(gain[part.column(1).flatten().to_numpy()] * n[:, None], ends[:-1], axis=0) + choice.prior).argmax(axis=1)
                start = starts[part.column(3).to_numpy()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.add.reduceat(n, ends[:-1])), pa.array(start, pa.int32()), pa.array(best, pa.int32())], names=["word", "seen", "start", "cls"])

    # Rare words have no hot key: none has more rows than the least frequent of the broadcast ones.
    found = texts.mapInArrow(near, "word string, code int").repartition("word").groupBy("word", "code").agg(F.count(F.lit(1)).alias("n"))
    found = found.groupBy("word").agg(F.collect_list(F.struct("code", "n")).alias("all"))  # at most classes ** 2 codes a word
    return written(found.select("word", "all.code", "all.n", slot_of("word")).mapInArrow(choose, "word string, seen long, start int, cls int"), release=True)


@dataclass
class Model:
    """What scoring needs on every worker; ``cls`` by rank, then two more; ``endings`` the classes of unseen words; ``emit`` holds log10 denominators by class; ``trace`` the likelihoods on the way."""

    settings: Settings
    top: list[bytes]
    counts: np.ndarray
    cls: np.ndarray
    endings: np.ndarray
    shift: int
    total: int
    distinct: int
    ends: int
    once: int
    trace: list[float]
    move: np.ndarray | None = None
    emit: np.ndarray | None = None


def first_classes(train: DataFrame, h: int, settings: Settings) -> np.ndarray:
    """Classes of broadcast words by rank, from exchange of the window's words and the others' neighbours among them; then two more entries."""
    n, p = min(settings.window, h), settings.neighbours
    pairs = window_bigrams(train, n, h)
    one = exchange(pairs, p, own=2)
    cls = np.full(h + 2, settings.other, dtype=np.uint8)
    cls[:n], cls[h + 1] = one[:n], settings.end
    if h > n:
        flat = np.eye(p, dtype=np.int64)[one]
        choice = Choice.of(flat.T @ pairs @ flat, np.bincount(one[:n], minlength=settings.end))
        found = cls.copy()
        for part in (0, 1):
            for ids, left, right in near_words(train.select("_lf_lm.ids", "_lf_lm.slots"), cls, lambda rare: settings.other, p, part)[1]:
                found[ids] = np.where(ids < n, cls[ids], choice.best(left, right))
        cls = found
    cls[h] = 0
    return cls


def encoded(df: DataFrame, text: str, hot: pa.Table, ends: int) -> DataFrame:
    """Adds ``_lf_lm``: token and known counts, the sum of the log counts, the tokens' ranks as 32-bit numbers, the rare words' slots of endings as 16-bit ones, and the rare words with their places.

    After the ranks of the broadcast words come that of any rare word and that of the end, which closes each text.
    """
    shared = df.sparkSession.sparkContext.broadcast((hot["word"].to_pylist(), hot["n"].to_numpy()))
    schema = "n_tokens long, n_known long, logs double, ids binary, slots binary, rare array<struct<at:int,word:string>>"
    kind = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("ids", pa.binary()), ("slots", pa.binary()), ("rare", pa.list_(pa.struct([("at", pa.int32()), ("word", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, counts = shared.value
        ranks, h = {w.encode(): i for i, w in enumerate(top)}, len(top)
        logs = np.concatenate([np.log10(counts + 0.5), [0.0, np.log10(ends + 0.5)]])
        for b in batches:
            n_tokens, n_known, sums, ids, slots, at, rare, cuts = [], [], [], [], [], [np.empty(0, dtype=np.int64)], [], [0]
            for t in b.column(text).to_pylist():
                w = tokens(t)
                i = np.append(numbers(w, ranks), h + 1)
                k = np.flatnonzero(i == h)
                n_tokens.append(len(i))
                n_known.append(len(w) - len(k) + (ends > 0))
                sums.append(float(logs[i].sum()))
                ids.append(i.astype(np.int32).tobytes())
                at.append(k)
                held = [w[x] for x in k.tolist()]
                slots.append(np.fromiter(map(ending, held), dtype=np.uint16, count=len(held)).tobytes())
                rare += held
                cuts.append(len(rare))
            places = pa.StructArray.from_arrays([pa.array(np.concatenate(at), pa.int32()), pa.array(rare, pa.binary()).cast(pa.string())], names=["at", "word"])
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), places)
            made = pa.StructArray.from_arrays([pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), pa.array(ids, pa.binary()), pa.array(slots, pa.binary()), lists], names=[f.name for f in kind])
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, "_lf_lm"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("_lf_lm", T.StructType.fromDDL(schema))]))


RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def fitted(df: DataFrame, train: Column, text: str, settings: Settings, carry_text: bool) -> tuple[Model, DataFrame, DataFrame]:
    """The whole model, the rare words' (word, seen, cls), and ``df`` with the classes of its texts, as a written table."""
    counts = written(word_counts(df.filter(train), text), release=True)
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = df.filter(train).count()
    hot = counts.orderBy(F.desc("n"), "word").limit(settings.hot_words).toArrow()
    texts = encoded(df.withColumn("_lf_train", F.coalesce(train, F.lit(False))), text, hot, ends)
    texts = written((texts if carry_text else texts.drop(text)).withColumn("_lf_row", F.monotonically_increasing_id()), "zstd")
    trace: list[float] = []
    top, hot_n = [w.encode() for w in hot["word"].to_pylist()], hot["n"].to_numpy()
    learnt = texts.filter("_lf_train")
    cls = first_classes(learnt, len(top), settings)
    starts = start_classes(top, cls[: len(top)], settings.end)
    plain = learnt.select("_lf_lm.ids", "_lf_lm.slots")
    sizes = start_sizes(counts, top, starts, settings.end)
    cls, pairs = swept(plain, cls, by_ending(starts), sizes, settings.first_sweeps, settings, trace)
    own = np.bincount(cls[: len(top)], minlength=settings.end)
    lexicon = rare_choices(learnt.select("_lf_lm.ids", "_lf_lm.slots", F.col("_lf_lm.rare.word")), cls, starts, pairs, own + sizes, settings)
    code = F.col("at").cast("long") * (2 * UNSEEN) + F.coalesce(F.col("start") * 256 + F.col("cls"), slot_of("word") + UNSEEN)
    sums = (
        texts.select("_lf_row", F.inline("_lf_lm.rare"))
        .join(lexicon, "word", "left")
        .groupBy("_lf_row")  # of one text
        .agg(F.count("seen").alias("_lf_known"), F.sum(F.log10(F.coalesce("seen", F.lit(0)) + F.lit(0.5))).alias("_lf_logs"), F.sort_array(F.collect_list(code)).alias("_lf_rare"))
    )
    texts = texts.withColumn("_lf_lm", F.col("_lf_lm").dropFields("rare", "slots"))
    texts = written(texts.join(sums, "_lf_row", "left").drop("_lf_row"), "zstd", release=True)
    plain = texts.filter("_lf_train").select("_lf_lm.ids", "_lf_rare")
    chosen, _ = near_words(plain, cls, joined_classes(0, starts), settings.classes, None)
    new_sizes, once = np.zeros_like(sizes), np.zeros((2, settings.classes), dtype=np.int64)
    for r in lexicon.groupBy("start", "cls").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seen") == 1).alias("once")).collect():
        new_sizes[r.cls] += r.n
        once[0, r.cls] += r.once
        once[1, r.start] += r.once
    shift = 0
    if likelihood(chosen, own + new_sizes) < trace[-1]:
        shift, new_sizes, once[0] = 8, sizes, once[1]
    cls, c = swept(plain, cls, joined_classes(shift, starts), new_sizes, settings.last_sweeps, settings, trace)
    lexicon = lexicon.select("word", "seen", F.col("start" if shift else "cls").alias("cls"))
    own = cls[: len(top)]
    kinds = np.append(new_sizes, 0) + np.bincount(own, minlength=settings.classes)
    once = once[0] + np.bincount(own[hot_n == 1], minlength=settings.classes)
    kinds[settings.end] = 1 if ends else 0
    model = Model(settings, top, hot_n, cls, start_classes(top, own, settings.end), shift, int(n_words) + ends, int(distinct) + (ends > 0), ends, int(once.sum()), trace)
    share = (c + 0.5) / (c.sum(axis=1, keepdims=True) + 0.5 * settings.classes)
    single = (c.sum(axis=0) + 0.5) / (c.sum() + 0.5 * settings.classes)
    new = model.once / max(1, model.total)
    model.move = np.log10((1 - new) * share + new * single)
    model.emit = np.log10(c.sum(axis=0) + 0.5 * (kinds + 1))
    return model, lexicon, texts


def lm_scores(df: DataFrame, train: Column, text: str = "text", settings: Settings | None = None, carry_text: bool = True) -> DataFrame:
    """Adds ``n_tokens``, ``n_known``, ``train_tokens`` long, ``base_score`` and ``score`` double.

    ``train``: true for the rows to learn from. ``base_score`` is the smoothed unigram
    log10 probability of the text, ``score`` the class model's; perplexity is
    ``10 ** (-score / n_tokens)``. Words that no training text holds have the class of most
    frequent words with their last three bytes. A null text is empty: its end token alone is scored.
    Repeated rows are scored each, and learnt from each. With no training rows all words
    are unknown. An empty table gives an empty one; input columns with the names of
    results are replaced.
    """
    settings = settings or Settings()
    df = df.drop(*RESULTS)
    columns = df.columns if carry_text else [c for c in df.columns if c != text]
    model, _, texts = fitted(df, train, text, settings, carry_text)
    shared = df.sparkSession.sparkContext.broadcast((model.move, model.emit, model.cls, model.shift, model.endings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move, emit, cls, shift, endings = shared.value
        for b in batches:
            _, c = all_classes(b.column("_lf_ids"), b.column("_lf_rare"), cls, joined_classes(shift, endings))
            starts = 1 + np.concatenate([[0], np.cumsum(b.column("n_tokens").to_numpy())])[:-1]
            out = np.add.reduceat(move[c[:-1], c[1:]] - emit[c[1:]], starts - 1) if len(starts) else []
            kept = [k for k, name in enumerate(b.schema.names) if name not in ("_lf_ids", "_lf_rare")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(out, pa.float64())], names=[*(b.schema.names[k] for k in kept), "_lf_score"])

    texts = texts.select(
        *columns,
        F.col("_lf_lm.n_tokens").alias("n_tokens"),
        (F.col("_lf_lm.n_known") + F.coalesce("_lf_known", F.lit(0))).alias("n_known"),
        (F.col("_lf_lm.logs") + F.coalesce("_lf_logs", F.lit(0.0))).alias("_lf_logs"),
        F.col("_lf_lm.ids").alias("_lf_ids"),
        "_lf_rare",
    )
    fields = [f for f in texts.schema.fields if f.name not in ("_lf_ids", "_lf_rare")]
    out = texts.mapInArrow(run, T.StructType([*fields, T.StructField("_lf_score", T.DoubleType())]))
    all_words = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    return out.select(
        *columns,
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("_lf_logs") - F.col("n_tokens") * F.lit(all_words)).alias("base_score"),
        (F.col("_lf_logs") + F.col("_lf_score")).alias("score"),
    )
