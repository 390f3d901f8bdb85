"""Results that several later steps read, written once to the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where none is set a single machine gets a temporary one, which goes when Python ends; a cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="ledgerflow-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    The lineage ends here, so steps after it have small plans and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = new_folder(spark, "staged")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def growing(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: the join sorts and merges, so no side is gathered at the driver.

    The planner knows a staged table by the bytes of its files, which dictionaries make far smaller than its
    rows, and takes rows from ``explode`` for one each; either way it may broadcast millions.
    """
    return df.hint("merge")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds ``name``: the ``value`` of each row, computed once.

    The planner copies the expression of a plain column into filters and into later columns that use it; it
    doesn't copy it out of ``explode``.
    """
    return df.withColumn(name, F.explode(F.array(value)))
