"""Sharding by a Feistel permutation of global row numbers.

Rows get gapless global numbers, a keyed Feistel network with cycle walking
permutes ``[0, n)``, and the permuted number gives shard (remainder) and slot
(quotient). Knowing n, the key and a row's number, anybody can compute its place.
Law: ``rows`` (shard sizes differ by one at most).

Only DataFrame functions. One shuffle, on the leading digits of an MD5, so no
source or key can be hot; the only broadcast is a table of ``16**digits`` counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_digest

PRIME = 2147483647
#: Keys of the rounds: multiplier, first and second addend.
ROUNDS = ((1103515245, 12345, 69069), (1664525, 1013904223, 40692), (134775813, 907633385, 48271), (22695477, 523124669, 16807), (1140671485, 12820163, 39373))


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def squared(t: Column, plus: Column) -> Column:
    return (t * t + plus) % F.lit(PRIME)


def permute(x: Column, side: Column, seed: int) -> Column:
    """One pass of the network over ``[0, side * side)``.

    The round function squares twice modulo a prime, within 64 bits.
    """
    long = lambda v: F.lit(v).cast("long")
    keys = F.array(*[F.struct(long(a).alias("a"), long((b + seed) % PRIME).alias("b"), long(c).alias("c")) for a, b, c in ROUNDS])

    def one(h: Column, key: Column) -> Column:
        t = (h["right"] * key["a"] + key["b"]) % F.lit(PRIME)
        value = squared(squared(t, key["c"]), key["b"])
        return F.struct(h["right"].alias("left"), ((h["left"] + value) % side).alias("right"))

    return F.aggregate(keys, F.struct(div(x, side).alias("left"), (x % side).alias("right")), one, lambda h: h["left"] * side + h["right"])


def number_rows(df: DataFrame, keys: Sequence[Column], digits: int = 3) -> DataFrame:
    """Adds ``row_no`` (0 to n-1, gapless) and ``row_count`` (n).

    Rows are numbered in the order of an MD5 of ``keys``: a count for each leading
    ``digits`` of it gives the offsets (at most ``16**digits`` rows), a window
    within each gives the rest. Rows with equal keys get neighbouring numbers.
    """
    w = df.withColumn("_lf_h", row_digest(keys)).withColumn("_lf_b", F.substring("_lf_h", 1, digits))
    counts = w.groupBy("_lf_b").agg(F.count(F.lit(1)).alias("_lf_n"))
    offsets = counts.select(
        "_lf_b",
        (F.sum("_lf_n").over(Window.orderBy("_lf_b")) - F.col("_lf_n")).alias("_lf_off"),
        F.sum("_lf_n").over(Window.partitionBy(F.lit(0))).alias("row_count"),
    )
    within = F.row_number().over(Window.partitionBy("_lf_b").orderBy("_lf_h"))
    return (
        w.withColumn("_lf_r", within.cast("long"))
        .join(F.broadcast(offsets), "_lf_b")
        .withColumn("row_no", F.col("_lf_off") + F.col("_lf_r") - 1)
        .drop("_lf_b", "_lf_h", "_lf_r", "_lf_off")
    )


def shard_rows(df: DataFrame, keys: Sequence[Column], n_shards: int = 8, seed: int = 42, digits: int = 3) -> DataFrame:
    """Adds ``shard`` int (0 to n_shards-1) and ``slot`` long (gapless from 0).

    Nulls in ``keys`` are a value of their own; rows with equal keys (repeated
    rows) get places of their own; an empty table gives an empty one. Input columns
    named ``shard``, ``slot``, ``row_no`` or ``row_count`` are replaced. Groups of
    equal texts aren't held together: the law is equal row counts.
    """
    w = number_rows(df.drop("shard", "slot", "row_no", "row_count"), keys, digits)
    side = F.ceil(F.sqrt("row_count")).cast("long")
    w = w.withColumn("_lf_side", side)
    side, n = F.col("_lf_side"), F.col("row_count")
    w = w.withColumn("_lf_p", permute(F.col("row_no"), side, seed))
    # side * side - n numbers lie outside [0, n), so a walk ends after as many steps at
    # most; about 2 in side rows walk at all, which keeps the whole linear in n.
    walk = F.aggregate(
        F.sequence(F.lit(0).cast("long"), side * side - n),
        F.col("_lf_p"),
        lambda p, _: F.when(p < n, p).otherwise(permute(p, side, seed)),
    )
    place = F.when(F.col("_lf_p") < n, F.col("_lf_p")).otherwise(walk)
    return (
        w.withColumn("_lf_q", place)
        .withColumn("shard", (F.col("_lf_q") % n_shards).cast("int"))
        .withColumn("slot", div(F.col("_lf_q"), F.lit(n_shards)))
        .drop("_lf_p", "_lf_q", "_lf_side", "row_count")
    )
