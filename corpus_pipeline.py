"""A corpus through five of the operators of ``ledgerflow.llm``, each stage written and read again.

Documents have the columns doc_id, text, lang and source, in any order, and may have any others: a
stage carries those in one struct, so none is mistaken for a column of an operator. Nulls may
stand in any column, a text may be empty or very long, rows may repeat, and an empty table gives
an empty one; what each stage does with them is said there.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import decontamination, mixing, quality_rules, sharding, simhash
from ledgerflow.llm.common import read_table, written


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
OWN = ("doc_id", "text", "lang", "source")
CARRIED = "_lf_carried"


def carrying(*added: str) -> Callable[[Stage], Stage]:
    """A stage whose result has the columns of its input, then ``added`` (input columns of these names give way)."""

    def wrap(stage: Stage) -> Stage:
        @functools.wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            names = [c for c in docs.columns if c not in added]
            others = [F.col(f"`{c.replace('`', '``')}`") for c in names if c not in OWN]
            packed = docs.select(*OWN, F.struct(*others).alias(CARRIED)) if others else docs.select(*OWN)
            out = stage(spark, packed, sf_dir)
            return out.select(*[F.col(c) if c in OWN else F.col(CARRIED).getField(c).alias(c) for c in names], *added)

        return run

    return wrap


@carrying()
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts have no words and go; rows that repeat are judged alike."""
    return quality_rules.quality_rules(docs).filter("kept")


@carrying()
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id, null ids last. Texts without words are one class."""
    return simhash.near_duplicates(docs).filter("representative")


@carrying()
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Null and empty texts hold none; an empty benchmark takes nothing out."""
    items = read_table(spark, sf_dir, "benchmark")
    return decontamination.add_matches(docs, items).filter("size(matches) = 0")


@carrying()
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; sources weigh 3, 1, 2, repeating. Null sources are one source, the last."""
    return mixing.mix_sources(docs).filter("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies"))))


@carrying("row_no", "shard", "slot")
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its number, shard and slot. Rows that repeat get places of their own."""
    keys = [F.col("doc_id"), F.length("text"), F.crc32(F.col("text").cast("binary"))]
    return sharding.shard_rows(docs, keys, n_shards=8)


STAGES = [("quality rules", rules), ("near duplicates", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shards)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
