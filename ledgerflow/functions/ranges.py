"""The row before each row, also where one statement or file has more rows than a task should hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, value: Column, by: tuple[str, ...], order: tuple[str, ...], name: str, filled: bool = False, range_rows: int | None = None) -> DataFrame:
    """Adds ``name``: a struct with ``v``, the ``value`` of the row before by ``order``; null for a first row.

    With ``filled`` it is the last row before that has a value. Without ``range_rows`` a window holds all rows of ``by``. With it
    windows hold that many numbers of the first column of ``order``, and a range's first rows get the last
    value of the ranges before it: one row a range is exchanged.
    """
    cell, there = F.struct(value.alias("v")), value.isNotNull() if filled else F.lit(True)
    part = F.coalesce(F.floor(F.col(order[0]) / F.lit(range_rows)), F.lit(-1)) if range_rows else F.lit(0)
    w = df.withColumn("_lf_part", part.cast("long")).withColumn("_lf_cell", F.when(there, cell))
    inside = Window.partitionBy(*by, "_lf_part").orderBy(*order)
    own = F.last("_lf_cell", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)) if filled else F.lag("_lf_cell").over(inside)
    if not range_rows:
        return w.withColumn(name, own).drop("_lf_part", "_lf_cell")
    ends = w.groupBy(*by, "_lf_part").agg(F.max_by("_lf_cell", F.when(F.col("_lf_cell").isNotNull(), F.struct(*order))).alias("_lf_end"))
    before = Window.partitionBy(*by).orderBy("_lf_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_lf_carried", F.last("_lf_end", ignorenulls=True).over(before)).drop("_lf_end")
    ends = ends.select([F.col(c).alias(f"_lf_key{k}") for k, c in enumerate((*by, "_lf_part"))] + ["_lf_carried"])
    on = F.lit(True)
    for k, c in enumerate((*by, "_lf_part")):
        on = on & F.col(c).eqNullSafe(F.col(f"_lf_key{k}"))
    joined = w.withColumn("_lf_own", own).join(ends, on)
    return joined.withColumn(name, F.coalesce("_lf_own", "_lf_carried")).drop("_lf_own", "_lf_carried", "_lf_part", "_lf_cell", *[f"_lf_key{k}" for k in range(len(by) + 1)])
