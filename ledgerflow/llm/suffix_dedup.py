"""Repeated passages by a sparse suffix array.

1. Suffixes are kept at content-selected places only: of every run of ``window`` neighbouring
   word ``gram``-grams, the one with the least hash (a minimiser). Any passage of ``least`` =
   window + gram - 1 words holds one, and equal passages hold the same one. About
   two in (window + 1) suffixes stay.
2. The kept suffixes are sorted over the whole cluster by the 128-bit hash of their first gram and their
   context (``reach`` = window - 1 words before it, as many after it). Neighbours with equal contexts are copies of each other
   and repeat as far as the context goes. Neighbours with equal grams and other
   contexts go on; a third of all documents may share them.
3. Those suffixes are sorted by their words to the right, and once more by their words to the left;
   in either order the longest match of a suffix is with a neighbour. Common prefixes give how far the match
   extends to the right and to the left; ``least`` words or more are a repeat.
4. A place whose farthest extensions to both sides, with different partners, would allow more repeats than
   its neighbours show is compared in full: by the words of each such run.
5. The matches of a document are joined into maximal spans, however long.

Ties are sorted by document and place, so a passage that a third of all documents hold is
spread over many tasks; the edges of the partitions are compared too. Nothing is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import words, written

CACHED = 200_000
#: Odd multipliers of the rolling hashes of grams and of contexts.
BASE = 0x9E3779B97F4A7C15
OTHER = 0xD6E8FEB86659FD93
SPANS = "array<struct<start:int,end:int>>"
#: Rows a sorted partition should have at most.
PART = 2_000_000


class Hashes(dict):
    """64-bit hashes of words, kept for a bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_hashes(text: str | None, seen: Hashes) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    w = (text or "").encode().split()
    return np.fromiter(map(seen.__getitem__, w), dtype=np.uint64, count=len(w))


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n + 1, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """A hash of the words of each span, by differences of prefix sums modulo 2 ** 64."""
    n = len(h)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * powers(base, n)[:n], dtype=np.uint64)])
    return mixed((sums[end] - sums[start]) * powers(pow(base, -1, 1 << 64), n)[start])


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words."""
    start = np.arange(max(0, len(h) - length + 1))
    return span_hashes(h, start, start + length)


def anchors(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the minimisers: the first least hash of each ``window`` neighbours."""
    if len(grams) < window:
        return np.empty(0, dtype=np.int64)
    v = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(v.argmin(axis=1) + np.arange(len(v)))


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.astype(np.uint64).view(np.int64))


def emit_anchors(df: DataFrame, text: str, least: int, gram: int) -> DataFrame:
    """(gram, context, row, at): the kept suffixes of every document, with hashes of their first words and of their context."""
    reach = least - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, none = Hashes(), np.empty(0, dtype=np.uint64)
        for b in batches:
            texts, places, grams, contexts = b.column(1).to_pylist(), [], [none], [none]
            for t in texts:
                h = word_hashes(t, seen)
                g = run_hashes(h, gram)
                at = anchors(g, reach + 1)
                start, end = np.maximum(at - reach, 0), np.minimum(at + least, len(h))
                shape = (at - start + (end - at) * (reach + 1)).astype(np.uint64)
                places.append(at)
                grams.append(g[at])
                contexts.append(mixed(span_hashes(h, start, end, OTHER) + shape * np.uint64(BASE)))
            rows = np.repeat(b.column(0).to_numpy(), [len(p) for p in places])
            at = np.concatenate([*places, np.empty(0, dtype=np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([signed(np.concatenate(grams)), signed(np.concatenate(contexts)), pa.array(rows, pa.int64()), pa.array(at)], names=["gram", "context", "row", "at"])

    return df.select("_lf_row", text).mapInArrow(run, "gram long, context long, row long, at int")


def emit_suffixes(df: DataFrame, text: str, least: int, gram: int) -> DataFrame:
    """(gram, gram2, right, left, row, at) of the places ``_lf_at``: two hashes of the first gram, the words that follow it, and those before it, backwards.

    Every word is followed by a space, so equal words at the begin are an equal prefix.
    """
    reach = least - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Hashes()
        spaced = lambda w: b"".join([x + b" " for x in w])
        for b in batches:
            out: list[tuple] = []
            grams = [[np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.uint64)]]
            for row, places, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = t.encode().split()
                h = np.fromiter(map(seen.__getitem__, w), dtype=np.uint64, count=len(w))
                at = np.array(places, dtype=np.int64)
                for g, base in zip(grams, (BASE, OTHER), strict=True):
                    g.append(span_hashes(h, at, at + gram, base))
                out += [(spaced(w[p + gram : p + least]).decode(), spaced(w[max(0, p - reach) : p][::-1]).decode(), row, p) for p in places]
            right, left, rows, at = ([x[k] for x in out] for k in range(4))
            columns = [*(signed(np.concatenate(g)) for g in grams), pa.array(right, pa.string()), pa.array(left, pa.string()), pa.array(rows, pa.int64()), pa.array(at, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "gram2", "right", "left", "row", "at"])

    return df.select("_lf_row", "_lf_at", text).mapInArrow(run, "gram long, gram2 long, right string, left string, row long, at int")


def over_neighbours(rows: DataFrame, order: list[str], judge: Callable[[pa.Table], list], results: T.StructType, parts: int) -> DataFrame:
    """What ``judge`` finds in neighbouring rows when all ``rows`` are sorted by ``order`` over the cluster.

    ``judge`` gets consecutive rows and returns the columns of ``results``. Each task
    passes on its first and last row besides; those, two a partition, are judged in their own order.
    """
    names = results.names
    edge = rows.schema.names
    schema = T.StructType([*results.fields, *(T.StructField(f"edge_{f.name}", f.dataType) for f in rows.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kinds, n_rows = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            kinds, n_rows = t.schema, n_rows + b.num_rows
            if held is None:
                yield passed(t.slice(0, 1), kinds)
            else:
                t = pa.concat_tables([held, t])
            found = judge(t)
            n = len(found[0])
            if n:
                empty = [pa.nulls(n, f.type) for f in kinds]
                yield pa.RecordBatch.from_arrays([*found, *empty], names=schema.names)
            held = t.slice(t.num_rows - 1, 1)
        if n_rows > 1:  # a single row is its partition's first already, and no neighbour of itself
            yield passed(held, kinds)

    def passed(one: pa.Table, kinds: pa.Schema) -> pa.RecordBatch:
        values = [one.column(k).combine_chunks() for k in range(one.num_columns)]
        return pa.RecordBatch.from_arrays([*(pa.nulls(1, pa_type(f)) for f in results.fields), *values], names=schema.names)

    found = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema))
    edges = found.filter("edge_row is not null").select(*[F.col(f"edge_{c}").alias(c) for c in edge])
    edges = edges.repartition(1).sortWithinPartitions(*order).mapInArrow(run, schema)
    return found.select(names).filter("row is not null").union(edges.select(names).filter("row is not null"))


def pa_type(field: T.StructField) -> pa.DataType:
    return {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.BooleanType(): pa.bool_()}[field.dataType]


def equal_contexts(t: pa.Table) -> list:
    """(row, at, copy, more) of rows beside one with the same gram: a copy of the whole context, or another context."""
    gram, context, row, at = (t.column(k).to_numpy() for k in range(4))
    near = gram[1:] == gram[:-1]
    same = near & (context[1:] == context[:-1])
    copy, more = np.zeros(len(gram), dtype=bool), np.zeros(len(gram), dtype=bool)
    copy[1:] |= same
    copy[:-1] |= same
    more[1:] |= near & ~same
    more[:-1] |= near & ~same
    k = np.flatnonzero(copy | more)
    return [pa.array(row[k]), pa.array(at[k]), pa.array(copy[k]), pa.array(more[k])]


def common(a: str, b: str) -> int:
    """The number of equal words that two texts of spaced words begin with."""
    n = 0
    for x, y in zip(a.split(" ")[:-1], b.split(" ")[:-1], strict=False):
        if x != y:
            break
        n += 1
    return n


def common_words(gram: int) -> Callable[[pa.Table], list]:
    """(row, at, before, after) of both rows of each pair of neighbours with the same gram: the words they have in common on either side of ``at``."""

    def judge(t: pa.Table) -> list:
        g, g2 = t.column(0).to_numpy(), t.column(1).to_numpy()
        k = np.flatnonzero((g[1:] == g[:-1]) & (g2[1:] == g2[:-1]))
        row, at = t.column(4).to_numpy(), t.column(5).to_numpy()
        sides = []
        for column in (3, 2):
            c = t.column(column).take(pa.array(np.concatenate([k, k + 1]))).to_pylist()
            sides.append(np.array([common(x, y) for x, y in zip(c[: len(k)], c[len(k) :], strict=True)], dtype=np.int32))
        both = np.concatenate([k, k + 1])
        return [pa.array(row[both]), pa.array(at[both]), pa.array(np.tile(sides[0], 2)), pa.array(np.tile(sides[1], 2) + np.int32(gram))]

    return judge


def open_runs(suffixes: DataFrame, matches: DataFrame, least: int, gram: int) -> DataFrame:
    """(row, start, end) of runs that neighbours in neither order show.

    ``matches``: (row, at, before, after). The run that begins ``k`` words before a place is open if the place
    has some partner with k equal words before it and some with least - k equal words from it on, but
    no neighbour with both. All places with the gram of an open one are compared by
    the words of such runs.
    """
    by = matches.groupBy("row", "at").agg(F.max("before").alias("before"), F.max("after").alias("after"), F.collect_set(F.struct("before", "after")).alias("seen"))
    first = F.greatest(F.lit(least) - F.col("after"), F.lit(0))
    k = F.when(first <= F.col("before"), F.sequence(first, F.col("before"))).otherwise(F.array().cast("array<int>"))
    by = by.withColumn("k", k)
    unseen = F.exists("k", lambda x: ~F.exists("seen", lambda m: (m["before"] >= x) & (m["after"] >= F.lit(least) - x)))
    by = written(by.withColumn("open", unseen).filter("size(k) > 0").select("row", "at", "k", "open"))
    grams = suffixes.join(by.filter("open").select("row", "at"), ["row", "at"]).select("gram", "gram2").distinct()
    runs = suffixes.join(grams, ["gram", "gram2"]).join(by.select("row", "at", "k"), ["row", "at"]).withColumn("k", F.explode("k"))
    words_of = lambda side, n: F.when(n > 0, F.call_function("substring_index", F.col(side), F.lit(" "), n)).otherwise(F.lit(""))
    runs = runs.select("row", "at", "gram", "gram2", "k", words_of("left", F.col("k")).alias("before"), words_of("right", F.lit(least - gram) - F.col("k")).alias("after"))
    key = ["gram", "gram2", "k", "before", "after"]
    twice = runs.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    start = F.col("at") - F.col("k")
    return runs.join(twice, key, "left_semi").select("row", start.alias("start"), (start + least).alias("end"))


def join_spans(found: DataFrame) -> DataFrame:
    """(row, spans) of (row, found): spans that touch become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for pairs in b.column(1).to_pylist():
                x = np.unique(np.array([(p["start"], p["end"]) for p in pairs], dtype=np.int64), axis=0)
                top = np.maximum.accumulate(x[:, 1])
                new = np.flatnonzero(x[1:, 0] > top[:-1]) + 1
                begin, end = x[np.concatenate([[0], new]), 0], top[np.concatenate([new - 1, [len(x) - 1]])]
                out.append([{"start": int(s), "end": int(e)} for s, e in zip(begin, end, strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["row", "spans"])

    return found.mapInArrow(run, f"row long, spans {SPANS}")


def repeated_spans(df: DataFrame, text: str = "text", least: int = 51, gram: int = 31, partitions: int | None = None, carry_text: bool = True) -> DataFrame:
    """Adds ``n_words``, ``repeated_words`` int and ``spans``, an array of (start, end) word offsets.

    The spans cover exactly the words that lie in some run of ``least`` words which occurs twice or
    more in the table, in other documents or the same; touching spans are one.
    Words are ``[^\x20\x09-\x0D]+`` of the whole text. Null, empty and shorter texts have none;
    repeated rows repeat each other; an empty table gives an empty one; input columns with
    the names of results are replaced. ``partitions`` fixes the number of sorted
    partitions, which otherwise grows with the rows.
    """
    df = df.drop("n_words", "repeated_words", "spans")
    spark = df.sparkSession
    reach = least - gram
    docs = written(df.withColumn("n_words", F.size(words(F.col(text)))).withColumn("_lf_row", F.monotonically_increasing_id()))

    def parts(rows: DataFrame) -> int:
        return partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART))

    kept = written(emit_anchors(docs, text, least, gram))
    beside = written(over_neighbours(kept, ["gram", "context", "row", "at"], equal_contexts, T.StructType.fromDDL("row long, at int, copy boolean, more boolean"), parts(kept)))
    copies = beside.filter("copy").select("row", (F.col("at") - reach).alias("start"), (F.col("at") + least).alias("end"))
    places = beside.filter("more").groupBy(F.col("row").alias("_lf_row")).agg(F.collect_set("at").alias("_lf_at"))  # of one document
    suffixes = written(emit_suffixes(docs.select("_lf_row", text).join(places, "_lf_row"), text, least, gram))
    n = parts(suffixes)
    pair = T.StructType.fromDDL("row long, at int, before int, after int")
    orders = (["gram", "gram2", "right", "left", "row", "at"], ["gram", "gram2", "left", "right", "row", "at"])
    right, left = (over_neighbours(suffixes, order, common_words(gram), pair, n) for order in orders)
    matches = written(right.union(left))
    direct = matches.filter(F.col("before") + F.col("after") >= least).select("row", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end"))
    found = copies.union(direct).union(open_runs(suffixes, matches, least, gram))
    found = found.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("found"))  # of one document
    out = docs if carry_text else docs.drop(text)
    out = out.join(join_spans(found).withColumnRenamed("row", "_lf_row"), "_lf_row", "left")
    within = F.transform("spans", lambda s: F.struct(F.greatest(s["start"], F.lit(0)).alias("start"), F.least(s["end"], F.col("n_words")).alias("end")))
    out = out.withColumn("spans", F.coalesce(within, F.array().cast(SPANS)))
    return out.withColumn("repeated_words", F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])).drop("_lf_row")
