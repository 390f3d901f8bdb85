"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, set for checkpoints too; see ``shared_folder``."""
    found = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: With it a query's shuffle files go when the query ends, not when the driver happens to collect its garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, compression: str = "snappy", release: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage, survives the loss of executors, and lets several
    later jobs read one computation. The folder is the cluster's checkpoint
    folder, which its owner cleans. ``release``: the shuffle files of the write go
    with it, where several such writes would else need the disk of all their exchanges at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerflow-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, None)
    if release:
        spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if release:
            spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null.

    Java's ``\\s`` is exactly space and ``\\t\\n\\x0B\\f\\r``.
    """
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def row_digest(cols: Sequence[Column]) -> Column:
    """An MD5 of the given values; nulls differ from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols]
    return F.md5(F.concat_ws("|", *parts))
