"""A stored ledger that later work changes in place: statements read again, corrected or cancelled.

The store is partitioned by a bucket of the statement. A change reads and overwrites the buckets of its
statements only; the new rows are staged first, and as whole statements are replaced, a change that failed
half-way can be run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import staged
from . import review


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("statement_id"), F.lit(buckets)).cast("int")


def write_store(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """Stores a ledger anew."""
    rows.withColumn("bucket", bucket(buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def replace_statements(spark: SparkSession, path: str, statements: DataFrame, rows: DataFrame, buckets: int = 64) -> None:
    """Puts ``rows`` in the place of all rows of ``statements`` (statement_id); statements without rows are gone after it.

    Rows of other statements are left out. On the driver are the numbers of the touched buckets.
    """
    ids = staged(statements.select("statement_id").distinct())
    touched = [r.bucket for r in ids.select(bucket(buckets).alias("bucket")).distinct().collect()]
    if not touched:
        return
    held = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
    new = rows.join(ids, "statement_id", "left_semi").withColumn("bucket", bucket(buckets))
    kept = staged(held.join(ids, "statement_id", "left_anti").unionByName(new.select(held.columns)))
    kept.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    left = {r.bucket for r in kept.select("bucket").distinct().collect()}
    for k in set(touched) - left:  # an overwrite by partition leaves those alone that get no rows
        kept.filter("false").drop("bucket").write.mode("overwrite").parquet(f"{path}/bucket={k}")


def correct_store(spark: SparkSession, path: str, corrections: DataFrame, buckets: int = 64) -> None:
    """Applies corrections (transaction_id, field, value, user_id, ts) to a stored ledger."""
    rows = read_store(spark, path)
    fixed = corrections.select(F.col("transaction_id").alias("id")).distinct()
    ids = staged(rows.join(fixed, "id", "left_semi").select("statement_id").distinct())
    own = staged(rows.join(ids, "statement_id", "left_semi"))
    replace_statements(spark, path, ids, review.apply_corrections(own, corrections).select(own.columns), buckets)


def drop_cancelled(spark: SparkSession, path: str, statements: DataFrame, buckets: int = 64) -> None:
    """Takes the rows of cancelled statements (id, extraction_status) out of a stored ledger."""
    gone = statements.filter("extraction_status = 'cancelled'").select(F.col("id").alias("statement_id"))
    replace_statements(spark, path, gone, read_store(spark, path).filter("false"), buckets)
