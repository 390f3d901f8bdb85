"""Candidates for similar texts by prefix filters, in place of comparing everything with everything.

A text is a set of elements: its letters, each with how many of it came before, or its tokens. Two sets with t
elements in common or more must share one among the first n - t + 1 of n, if both are in one order; rare
elements first makes such matches few. A sequence ratio 2 M / (a + b) of at least r needs
M >= r a / (2 - r) letters in common, a share of tokens of at least r needs r n tokens.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scalars import token_overlap
from .staging import staged


def letters(text: Column) -> Column:
    """Every letter of a text with its number among equal ones, so that sets have what multisets have in common."""
    # The sorted letters are the variable of an outer step, so they are made once a text and not once a letter.
    ordered = F.array(F.array_sort(F.array_remove(F.split(text, ""), "")))
    number = lambda o, c, i: F.concat(F.lit("l"), c, (i - F.array_position(o, c)).cast("string"))
    return F.get(F.transform(ordered, lambda o: F.transform(o, lambda c, i: number(o, c, i))), 0)


def tokens(text: Column) -> Column:
    return F.transform(F.array_distinct(F.array_remove(F.split(text, " "), "")), lambda w: F.concat(F.lit("t"), w))


def distinct_spread(rows: DataFrame) -> DataFrame:
    """Distinct rows over all cores: few bytes would else be one task, but texts cost far more time than bytes."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *rows.columns).distinct()


def first_elements(texts: DataFrame, threshold: float, with_tokens: bool) -> DataFrame:
    """(text, keys) of each different text: the elements of which texts with a score of ``threshold`` or more share one.

    Elements are in the order of their number of texts, rarest first.
    """
    every = F.concat(letters(F.col("text")), tokens(F.col("text"))) if with_tokens else letters(F.col("text"))
    split = staged(distinct_spread(texts.select("text")).select("text", F.explode(every).alias("e")))
    ranked = split.join(split.groupBy("e").agg(F.count(F.lit(1)).alias("n")), "e")
    sets = ranked.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("es"))
    names = F.transform("es", lambda x: x["e"])

    def first(kind: str, share: float) -> Column:
        own = F.filter(names, lambda e: F.substring(e, 1, 1) == kind)
        return F.slice(own, 1, (F.size(own) - F.ceil(F.size(own) * share - 1e-9) + 1).cast("int"))

    keys = first("l", threshold / (2 - threshold))
    return sets.select("text", F.concat(keys, first("t", threshold)).alias("keys") if with_tokens else keys.alias("keys"))


def share_first(a: Column, b: Column, key: Column) -> Column:
    """Whether ``key`` is the first that two lists of keys have in common: true for one of a pair's matches."""
    return F.get(F.array_intersect(a, b), 0) == key


def ratio_from(threshold: float):
    """The sequence ratio of two texts where it reaches ``threshold``, else 0; equal letters bound it from above.

    Where one text is part of the other, it is the longest match, and no letter is left on its side. That holds for second
    texts of less than 200 letters: in longer ones ``SequenceMatcher`` passes over frequent letters.
    """

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> float:
            if not x or not y:
                return 0.0
            if len(y) < 200 and (x in y or y in x):
                r = 2.0 * min(len(x), len(y)) / (len(x) + len(y))
                return r if r >= threshold else 0.0
            m = SequenceMatcher(None, x, y)
            return m.ratio() if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold else 0.0

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return score


def may_reach(a: Column, b: Column, threshold: float) -> Column:
    """Whether the letters of two texts allow a sequence ratio of ``threshold``; plain columns, so few pairs go on to the ratio."""
    need = (F.length(a) + F.length(b)) * (threshold / 2) - 1e-9
    return (F.least(F.length(a), F.length(b)) >= need) & (F.size(F.array_intersect(letters(a), letters(b))) >= need)


def name_scores(pairs: DataFrame, threshold: float) -> DataFrame:
    """Adds ``score`` to pairs of normal forms (a, b) where it reaches ``threshold``: the greater of token share and sequence ratio.

    Pairs come from a table: a filter over ``distinct`` would move before it and look at every repeated pair.
    """
    shared, can = token_overlap(F.col("a"), F.col("b")), may_reach(F.col("a"), F.col("b"), threshold)
    some = staged(pairs.withColumn("shared", shared).withColumn("can", can).filter((F.col("shared") >= threshold) | F.col("can")))
    score = ratio_from(threshold)("a", "b")
    return some.withColumn("score", F.greatest("shared", score)).filter(F.col("score") >= threshold).drop("shared", "can")
