"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, ``-ln(u) / quality weight``; within a source
the documents with the smallest keys come first, and a prefix sum of their words fills
the source's budget. A source whose target exceeds its size first takes complete
epochs; the rest is selected by key.

The order within a source is found without sorting it: keys fall into ranges of equal ratio
(``steps`` an octave), the words of the ranges are summed (map-side first), and the range in which the
budget ends is cut into ``steps`` parts and summed once more. Only the part in which it ends is
sorted by a window. An exponential key divided by any weight has at most 1 / e of a source in a
range of ratio e, so a range holds one part in 3,900 of a source's documents and a part of it one in
four million, whatever the weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words, written

#: A document's quality weight falls with these characters per word.
MARKS = "#*$%&|<>!"
RESULTS = ("size", "source_size", "target", "copies", "taken")


def quality_weight(text: Column, size: Column) -> Column:
    """``n / (n + 5 s)`` for n words and s marks; 1 for a text without words."""
    t = F.coalesce(text, F.lit(""))
    marks = F.length(t) - F.length(F.translate(t, MARKS, ""))
    return F.when(size > 0, size / (size + marks * 5)).otherwise(F.lit(1.0))


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (_lf_source, source_size): adds ``target``.

    Sources in code-point order (null last) get the weights in turn and share ``share``
    of all words; targets stop at ``most`` times their source, and the excess goes to the
    others by weight. In the order of cap over weight the capped sources come
    first, so the level at which the others stand follows from prefix sums.
    One row a source: the only single-partition step, and it has no texts.
    """
    each = F.array(*[F.lit(float(x)) for x in weights])
    place = F.row_number().over(Window.orderBy(F.col("_lf_source").asc_nulls_last()))
    s = sizes.withColumn("w", F.get(each, (place - 1) % len(weights))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    whole = Window.partitionBy(F.lit(0))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("_lf_source").asc_nulls_last())
    s = s.withColumn("pos", F.row_number().over(order)).withColumn("all", F.sum("source_size").over(whole) * share)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("pos", "level"))).over(whole)
    s = s.withColumn("at", first)
    target = F.when(F.col("at").isNull() | (F.col("pos") < F.col("at.pos")), F.col("cap")).otherwise(F.col("at.level") * F.col("w"))
    return s.select("_lf_source", "source_size", target.alias("target"))


def edge(sums: DataFrame, goals: DataFrame, range_: str) -> DataFrame:
    """``goals`` with the first range (``range_`` of ``sums``: _lf_source, range, n) in which a source's ``_lf_left`` ends, and the words before it as ``_lf_start``; null if it ends in none."""
    by = Window.partitionBy("_lf_source").orderBy(range_).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("end", F.sum("n").over(by)).alias("s")
    found = goals.alias("g").join(ends, F.col("s._lf_source").eqNullSafe(F.col("g._lf_source")), "left")
    end = F.col("_lf_start") + F.col("end")
    at = F.min(F.when(end > F.col("_lf_left"), F.struct(F.col(f"s.{range_}").alias("range"), (end - F.col("n")).alias("start"))))
    kept = [c for c in goals.columns if c not in ("_lf_source", "_lf_start")]
    out = found.groupBy(F.col("g._lf_source").alias("_lf_source")).agg(at.alias("_lf_edge"), *[F.first(f"g.{c}").alias(c) for c in kept])
    return out.select("_lf_source", *kept, F.col("_lf_edge.range").alias(range_), F.col("_lf_edge.start").alias("_lf_start"))


def mix_sources(
    df: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    steps: int = 1024,
    carry_text: bool = True,
) -> DataFrame:
    """Adds ``size`` (words), ``source_size``, ``target``, ``copies`` int and ``taken`` (copies * size).

    A document in the middle of whose words the budget ends or later counts as
    outside, so a source misses its target by half a document at most. A null text
    has no words. Null sources are one source; repeated rows are documents of their own
    (with equal keys). An empty table gives an empty one. Input columns with the names
    of results are replaced. ``copies`` never exceeds ``most`` rounded up; texts without
    words are taken as often as their source's complete epochs, and once more before the edge.
    """
    df = df.drop(*[c for c in RESULTS if c not in (text, source, doc_id)])
    size = F.size(words(F.col(text))).cast("long")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    w = df.withColumn("size", size).withColumn("_lf_h", digest).withColumn("_lf_w", quality_weight(F.col(text), F.col("size")))
    u = (F.conv(F.substring("_lf_h", 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 48))
    w = w.withColumn("_lf_key", -F.log(u) / F.col("_lf_w"))
    place = F.log2("_lf_key") * steps
    w = w.withColumn("_lf_b", F.floor(place)).withColumn("_lf_c", F.floor((place - F.floor(place)) * steps).cast("int")).drop("_lf_w")
    w = written(w if carry_text else w.drop(text))
    sums = w.groupBy(F.col(source).alias("_lf_source"), "_lf_b").agg(F.sum("size").alias("n"))
    goals = targets(sums.groupBy("_lf_source").agg(F.sum("n").alias("source_size")), weights, share, most)
    goals = goals.withColumn("_lf_full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
    goals = written(goals.withColumn("_lf_left", F.col("target") - F.col("_lf_full") * F.col("source_size")))
    # One row a source, written so that its size is known before the joins are planned.
    edges = written(edge(sums, goals.withColumn("_lf_start", F.lit(0).cast("long")), "_lf_b"))
    parts = w.join(edges.select("_lf_source", F.col("_lf_b").alias("_lf_at")), F.col(source).eqNullSafe(F.col("_lf_source")) & (F.col("_lf_b") == F.col("_lf_at")))
    parts = parts.groupBy("_lf_source", "_lf_c").agg(F.sum("size").alias("n"))
    plan = written(edge(parts, edges, "_lf_c").select("_lf_source", "source_size", "target", "_lf_full", "_lf_left", "_lf_start", F.col("_lf_b").alias("_lf_at"), F.col("_lf_c").alias("_lf_in")))
    w = w.join(plan, F.col(source).eqNullSafe(F.col("_lf_source"))).drop("_lf_source")
    ends = (F.col("_lf_b") == F.col("_lf_at")) & (F.col("_lf_c") == F.col("_lf_in"))
    first = F.col("_lf_at").isNull() | (F.col("_lf_b") < F.col("_lf_at")) | (F.col("_lf_b") == F.col("_lf_at")) & (F.col("_lf_c") < F.col("_lf_in"))
    sure = w.filter(~F.coalesce(ends, F.lit(False))).withColumn("_lf_more", first)
    order = Window.partitionBy(source).orderBy("_lf_key", "_lf_h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("_lf_start") + F.sum("size").over(order) - F.col("size") / 2
    close = w.filter(ends).withColumn("_lf_more", middle <= F.col("_lf_left"))
    return (
        sure.unionByName(close)
        .withColumn("copies", F.col("_lf_full") + (F.col("_lf_more") & (F.col("_lf_left") > 0)).cast("int"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_lf_h", "_lf_key", "_lf_b", "_lf_c", "_lf_at", "_lf_in", "_lf_start", "_lf_full", "_lf_left", "_lf_more")
    )
