"""Collocations mined from weighted acyclic automata of n-gram counts.

Every task cuts its texts into shards, sorts a shard's one- to three-word phrases and builds count
transducers from them, one for each range of prefixes: states are frozen in the order of the sorted
phrases and equal ones (the same count, the same continuations with the same counts) become one.
Transducers of a prefix range meet in one task, which unions them, sums their weights, and keeps the
paths that are frequent enough. Phrases of that union are the candidates. Their parts begin with other
words, so the distinct parts are sent to their own prefix range and looked up by composing a transducer
of them with the range's counts.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: What ends a piece and what stands between words (fixed values).
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
SHARD = 16_000_000
LABEL = np.uint64(21)
MASK = np.uint64((1 << 21) - 1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.zeros(256, np.uint8)
KIND[list(GAPS)] = 1
KIND[list(ENDS)] = 2


class Automaton(NamedTuple):
    """Counts of phrases over sorted ``words``; arcs are in the order of their labels.

    From the start lead arcs ``one`` with counts ``n1`` (single words), and by ``first`` and ``second``
    arcs to the states ``target``. State s has count ``weight[s]`` and the arcs ``third`` with
    counts ``n3`` from ``begin[s]`` to ``begin[s + 1]``.
    """

    words: list[bytes]
    one: np.ndarray
    n1: np.ndarray
    first: np.ndarray
    second: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    begin: np.ndarray
    third: np.ndarray
    n3: np.ndarray


class Grams(NamedTuple):
    """Sorted phrases as arrays: single words, pairs, and triples by the place of their first pair."""

    one: np.ndarray
    n1: np.ndarray
    first: np.ndarray
    second: np.ndarray
    n2: np.ndarray
    pair: np.ndarray
    third: np.ndarray
    n3: np.ndarray


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def automaton(words: list[bytes], g: Grams) -> Automaton:
    """The transducer of sorted phrases in which equal states after two words are one."""
    n = len(g.first)
    size = np.bincount(g.pair, minlength=n)
    begin, own = starts_of(size), np.arange(n)
    with np.errstate(over="ignore"):
        arcs = (g.third.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + g.n3.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        arcs ^= arcs >> np.uint64(29)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(arcs, dtype=np.uint64)])
        digest = (sums[begin[1:]] - sums[begin[:-1]]) * np.uint64(0x165667B19E3779F9) + g.n2.astype(np.uint64) * np.uint64(0x27D4EB2F165667C5) + size.astype(np.uint64)
    order = np.argsort(digest, kind="stable")
    new = np.concatenate([[True], digest[order][1:] != digest[order][:-1]]) if n else np.zeros(0, bool)
    like = np.empty(n, np.int64)
    like[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1] if n else order
    # Equal digests are only a guess: states that differ from the one they would join stay apart.
    same = (g.n2 == g.n2[like]) & (size == size[like])
    if len(g.pair):
        other = np.minimum(begin[like[g.pair]] + np.arange(len(g.pair)) - begin[g.pair], len(g.pair) - 1)
        same[g.pair[(g.third != g.third[other]) | (g.n3 != g.n3[other])]] = False
    like = np.where(same, like, own)
    keep = like == own
    state = np.cumsum(keep) - 1
    arcs = keep[g.pair]
    return Automaton(words, g.one, g.n1, g.first, g.second, state[like], g.n2[keep], starts_of(size[keep]), g.third[arcs], g.n3[arcs])


def grams_of(a: Automaton) -> Grams:
    """All paths of a transducer."""
    size = np.diff(a.begin)[a.target]
    at = starts_of(size)
    pair = np.repeat(np.arange(len(a.first)), size)
    arc = a.begin[a.target][pair] + np.arange(len(pair)) - at[pair]
    return Grams(a.one, a.n1, a.first, a.second, a.weight[a.target], pair, a.third[arc], a.n3[arc])


def packed(a: Automaton) -> bytes:
    narrow = lambda x: x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
    at = np.flatnonzero(np.diff(a.first, prepend=-1))
    runs = np.diff(np.append(at, len(a.first)))
    arrays = [narrow(x) for x in (np.diff(a.one, prepend=0), a.n1, a.first[at], runs, a.second, a.target, a.weight, np.diff(a.begin), a.third, a.n3)]
    body = pickle.dumps((b" ".join(a.words), arrays), protocol=5)
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def unpacked(data: bytes) -> Automaton:
    body = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    words, (one, n1, first, runs, second, target, weight, size, third, n3) = pickle.loads(body)
    wide = lambda x: x.astype(np.int64)
    return Automaton(words.split(b" ") if words else [], np.cumsum(wide(one)), wide(n1), np.repeat(wide(first), runs), wide(second), wide(target), wide(weight), starts_of(size), wide(third), wide(n3))


def union(parts: list[Automaton]) -> tuple[list[bytes], Grams]:
    """The paths of several transducers, weights of equal ones added."""
    every = pa.chunked_array([pa.array(p.words, pa.binary()) for p in parts]).unique()
    every = every.take(pc.sort_indices(every))
    flat: dict[str, list[np.ndarray]] = {k: [] for k in Grams._fields}
    pairs = 0
    for p in parts:
        place = pc.index_in(pa.array(p.words, pa.binary()), value_set=every).to_numpy(zero_copy_only=False).astype(np.int64)
        g = grams_of(p)
        for k, x in zip(Grams._fields, g, strict=True):
            flat[k].append(place[x] if k in ("one", "first", "second", "third") else x + pairs if k == "pair" else x)
        pairs += len(g.first)
    f = Grams(*(np.concatenate(flat[k]) for k in Grams._fields))
    one, n1, _ = summed(f.one, f.n1)
    code, n2, place = summed(f.first << 32 | f.second, f.n2)
    code3, n3, _ = summed(place[f.pair] << 32 | f.third, f.n3)
    return every.to_pylist(), Grams(one, n1, code >> 32, code & 0xFFFFFFFF, n2, code3 >> 32, code3 & 0xFFFFFFFF, n3)


def summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes in order, the sums of their n, and the place of each input among them."""
    order = np.argsort(code, kind="stable")
    new = np.diff(code[order], prepend=-1) != 0
    place = np.empty(len(code), np.int64)
    place[order] = np.cumsum(new) - 1
    return code[order][new], np.add.reduceat(n[order], np.flatnonzero(new)) if len(code) else n, place


def frequent(g: Grams, least: int) -> Grams:
    """The phrases that occur ``least`` times or more; all parts of such a phrase are among them."""
    one, two, three = g.n1 >= least, g.n2 >= least, g.n3 >= least
    place = np.cumsum(two) - 1
    return Grams(g.one[one], g.n1[one], g.first[two], g.second[two], g.n2[two], place[g.pair[three]], g.third[three], g.n3[three])


def cut(words: list[bytes], g: Grams, bounds: list[tuple[bytes, bytes]]) -> Iterator[tuple[int, Automaton]]:
    """A transducer for each prefix range that has phrases; range k holds those from bound k - 1 (first words) up to bound k."""
    code = g.first << 32 | g.second
    ones, twos = [0], [0]
    for x, y in bounds:
        i = bisect_left(words, x)
        here = i < len(words) and words[i] == x
        j = bisect_left(words, y) if here else 0
        ones.append(int(np.searchsorted(g.one, i + (here and y > b""))))
        twos.append(int(np.searchsorted(code, i << 32 | j)))
    ones.append(len(g.one))
    twos.append(len(g.first))
    threes = starts_of(np.bincount(g.pair, minlength=len(g.first)))[twos]
    for k in range(len(bounds) + 1):
        a, b, c = slice(ones[k], ones[k + 1]), slice(twos[k], twos[k + 1]), slice(threes[k], threes[k + 1])
        if a.start < a.stop or b.start < b.stop:
            used = np.zeros(len(words), bool)
            for labels in (g.one[a], g.first[b], g.second[b], g.third[c]):
                used[labels] = True
            own = np.cumsum(used) - 1
            named = [words[i] for i in np.flatnonzero(used)]
            yield k, automaton(named, Grams(own[g.one[a]], g.n1[a], own[g.first[b]], own[g.second[b]], g.n2[b], g.pair[c] - b.start, own[g.third[c]], g.n3[c]))


def words_of(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of a text and the number of each one's piece."""
    data = np.frombuffer(text, np.uint8)
    kind = KIND[data]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = np.flatnonzero(first)
    piece = np.cumsum(kind == 2, dtype=np.int32)[at]
    offsets = np.append(np.cumsum(inside, dtype=np.int32)[at] - 1, np.count_nonzero(inside)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]])]), piece


def counted(text: bytes) -> Iterator[tuple[list[bytes], Grams]]:
    """The words and sorted phrases of one shard; a shard with too many words for a label is halved at a piece."""
    words, piece = words_of(text)
    coded = words.dictionary_encode()
    n = len(coded.dictionary)
    if n >= 1 << int(LABEL):
        half = piece_end(text, len(text) // 2)
        yield from counted(text[:half])
        yield from counted(text[half:])
        return
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(n, np.uint64)
    rank[order] = np.arange(n, dtype=np.uint64)
    w = rank[coded.indices.to_numpy()]
    two = piece[1:] == piece[:-1]
    pairs, n2 = runs(((w[:-1] << LABEL) | w[1:])[two])
    three = piece[2:] == piece[:-2]
    triples, n3 = runs(((w[:-2] << LABEL | w[1:-1]) << LABEL | w[2:])[three])
    i64 = lambda x: x.astype(np.int64)
    g = Grams(np.arange(n), np.bincount(i64(w), minlength=n), i64(pairs >> LABEL), i64(pairs & MASK), n2, np.searchsorted(pairs, triples >> LABEL), i64(triples & MASK), n3)
    yield coded.dictionary.take(pa.array(order)).to_pylist(), g


def runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[at], np.diff(np.append(at, len(codes)))


def piece_end(text: bytes, at: int) -> int:
    """The place after the last end of a piece before ``at``, or after the first one from there on; the text's end if there is none."""
    found = max(text.rfind(e, 0, at) for e in (ENDS[i : i + 1] for i in range(len(ENDS))))
    if found < 0:
        later = [i for i in (text.find(ENDS[i : i + 1], at) for i in range(len(ENDS))) if i >= 0]
        found = min(later, default=len(text) - 1)
    return found + 1


def shards(batches: Iterator[pa.RecordBatch], size: int = SHARD) -> Iterator[tuple[str, bytes]]:
    """(language, text) of columns lang and text: texts of a language joined up to ``size`` bytes, longer ones cut between pieces."""
    held: dict[str, list[bytes]] = {}
    total: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            while text:
                end = len(text) if len(text) <= size else piece_end(text, size)
                held.setdefault(lang, []).append(text[:end])
                total[lang] = total.get(lang, 0) + end
                text = text[end:]
                if total[lang] >= size or sum(total.values()) >= 3 * size:
                    largest = max(total, key=total.__getitem__)
                    del total[largest]
                    yield largest, b"\n".join(held.pop(largest))
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def prefix_bounds(docs: DataFrame, ranges: int, sample_bytes: int = 32_000_000) -> list[tuple[str, bytes, bytes]]:
    """Where the prefix ranges begin: (language, first word, second word), ``ranges`` - 1 at most.

    As for any sort of a distributed table they come from a bounded sample of rows, and decide only how phrases are
    dealt out, not what is counted.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in shards(batches, 2_000_000):
            for words, g in counted(text):
                load = np.cumsum(1 + np.bincount(g.pair, minlength=len(g.first)))
                at = np.flatnonzero(np.diff(load // 64, prepend=0))
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "first": [words[i] for i in g.first[at]], "second": [words[i] for i in g.second[at]]}, pa.schema({"lang": pa.string(), "first": pa.binary(), "second": pa.binary()}))

    share = min(1.0, sample_bytes / max(total, 1))
    rows = sorted((r.lang, bytes(r.first), bytes(r.second)) for r in docs.sample(share, 7).mapInArrow(run, "lang string, first binary, second binary").collect())
    return sorted({rows[len(rows) * k // ranges] for k in range(1, ranges)}) if rows else []


def bounds_of(bounds: list[tuple[str, bytes, bytes]], lang: str) -> tuple[int, list[tuple[bytes, bytes]]]:
    """The first range with phrases of a language, and the bounds within it."""
    low, high = bisect_left(bounds, (lang,)), bisect_left(bounds, (lang + "\0",))
    return low, [(x, y) for _, x, y in bounds[low:high]]


def count_automata(docs: DataFrame, bounds: list[tuple[str, bytes, bytes]], least: int) -> DataFrame:
    """(part int, lang, n long, automaton): the union of each prefix range, pruned to ``least``; n is its number of words, rare ones too."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in shards(batches):
            low, own = bounds_of(bounds, lang)
            for words, g in counted(text):
                for k, a in cut(words, g, own):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([low + k], pa.int32()), "lang": [lang], "automaton": pa.array([packed(a)], pa.binary())})

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        words, g = union([unpacked(x) for x in rows.column("automaton").to_pylist()])
        few = frequent(g, least)
        used = np.zeros(len(words), bool)
        for labels in (few.one, few.first, few.second, few.third):
            used[labels] = True
        own = np.cumsum(used) - 1
        a = automaton([words[i] for i in np.flatnonzero(used)], few._replace(one=own[few.one], first=own[few.first], second=own[few.second], third=own[few.third]))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "lang": [key[1].as_py()], "n": pa.array([int(g.n1.sum())], pa.int64()), "automaton": pa.array([packed(a)], pa.binary())})

    blocks = docs.mapInArrow(build, "part int, lang string, automaton binary")
    return blocks.groupBy("part", "lang").applyInArrow(merge, "part int, lang string, n long, automaton binary")


def candidates(automata: DataFrame) -> DataFrame:
    """(lang, words array<string>, a long): the phrases of two and three words of the pruned transducers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = unpacked(data)
                g, w = grams_of(m), [x.decode() for x in m.words]
                two = [[w[i], w[j]] for i, j in zip(g.first, g.second, strict=True)]
                three = [[*two[p], w[k]] for p, k in zip(g.pair, g.third, strict=True)]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * (len(two) + len(three)), pa.string()), "words": pa.array(two + three, pa.list_(pa.string())), "a": pa.array([*g.n2.tolist(), *g.n3.tolist()], pa.int64())})

    return automata.select("lang", "automaton").mapInArrow(run, "lang string, words array<string>, a long")


def composed(counts: Automaton, asked: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """The counts of the single words and of the pairs that ``asked`` accepts; all have to be paths of ``counts``."""
    place = np.array([bisect_left(counts.words, w) for w in asked.words], np.int64)
    one = counts.n1[np.searchsorted(counts.one, place[asked.one])]
    arcs = counts.first << 32 | counts.second
    two = counts.weight[counts.target[np.searchsorted(arcs, place[asked.first] << 32 | place[asked.second])]]
    return one, two


def part_counts(automata: DataFrame, asked: DataFrame, bounds: list[tuple[str, bytes, bytes]]) -> DataFrame:
    """(lang, phrase, f long) of distinct phrases (lang, phrase) of one or two words, each looked up in its own prefix range."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, phrases = b.column(0).to_pylist(), b.column(1).to_pylist()
            keys = [(lang, *(p.encode().split(b" ") + [b""])[:2]) for lang, p in zip(langs, phrases, strict=True)]
            yield pa.RecordBatch.from_pydict({"part": pa.array([bisect_right(bounds, k) for k in keys], pa.int32()), "lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.string())})

    def look(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        phrases = sorted((tuple(p.encode().split(b" ")) for p in right.column("phrase").to_pylist()))
        words = sorted({w for p in phrases for w in p})
        at = {w: i for i, w in enumerate(words)}
        ints = lambda x: np.array(x, np.int64)
        single, pairs = [p for p in phrases if len(p) == 1], [p for p in phrases if len(p) == 2]
        none = ints([])
        asked = automaton(words, Grams(ints([at[p[0]] for p in single]), np.ones(len(single), np.int64), ints([at[p[0]] for p in pairs]), ints([at[p[1]] for p in pairs]), np.ones(len(pairs), np.int64), none, none, none))
        f = np.concatenate(composed(unpacked(left.column("automaton")[0].as_py()), asked)) if phrases else none
        return pa.table({"lang": pa.array([key[1].as_py()] * len(f), pa.string()), "phrase": pa.array([b" ".join(p).decode() for p in single + pairs], pa.string()), "f": pa.array(f, pa.int64())})

    routed = asked.mapInArrow(route, "part int, lang string, phrase string")
    return automata.select("part", "lang", "automaton").groupBy("part", "lang").cogroup(routed.groupBy("part", "lang")).applyInArrow(look, "lang string, phrase string, f long")


def joined_words(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, cover: int = 50, range_bytes: int = 8_000_000) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): phrases of two and three words that occur ``least`` times or more in a language.

    Words are lower-cased by A-Z; phrases don't cross the ends of pieces. a counts the phrase, l and r its parts at the
    cut with the lowest floor(1000000 a a / (l r)) (the first of several), n all words of the language. A phrase inside a
    longer one that occurs ``cover`` percent as often or more is left out. A null language is ``und``; null and
    empty texts have no words; repeated rows count each; very long texts are cut between pieces; an empty
    table gives none; other columns, whatever their names, aren't read.

    A task holds a shard of ``SHARD`` bytes of text, or one prefix range, whose size is
    ``range_bytes`` of text (in 2**18 ranges at most).
    """
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("length(text) > 0")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // range_bytes, 1 << 18))
    bounds = prefix_bounds(docs, ranges)
    automata = written(count_automata(docs, bounds, least))
    found = written(candidates(automata).withColumn("phrase", F.array_join("words", " ")))
    # A phrase of two words inside one of three: the most frequent longer one decides.
    longer = found.filter("size(words) = 3").select("lang", "a", F.explode(F.array(joined_words(F.col("words"), 1, 2), joined_words(F.col("words"), 2, 2))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = found.join(most, ["lang", "phrase"], "left").filter(F.coalesce(F.col("most") * 100 < F.col("a") * cover, F.lit(True)))
    k = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = kept.select("lang", "phrase", "words", "a", k).select("lang", "phrase", "a", "k", joined_words(F.col("words"), 1, F.col("k")).alias("head"), joined_words(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    asked = cuts.select("lang", F.explode(F.array("head", "rest")).alias("phrase")).distinct()
    parts = written(part_counts(automata, asked, bounds))
    heads = parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    big = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", big("a") * big("a") * F.lit(1_000_000).cast("decimal(7,0)"), big("l") * big("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b"))
    totals = automata.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "phrase", "b.a", "b.l", "b.r", "n", "b.score")


def top_collocations(df: DataFrame, k: int = 2000, **options) -> DataFrame:
    """Adds ``rank`` long from 1: the first ``k`` of each language by score and count, highest first, then phrase by its bytes."""
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return collocations(df, **options).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
