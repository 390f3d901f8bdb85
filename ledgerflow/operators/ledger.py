"""Selections, pages and totals of transactions, statements and activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions.staging import new_folder


def holds(col: str, text: str) -> Column:
    return F.coalesce(F.lower(col).contains(text.lower()), F.lit(False))


def filter_transactions(txns: DataFrame, q: str = "", mode: str = "", direction: str = "", from_date: str | None = None, to_date: str | None = None) -> DataFrame:
    """Transactions by text (narration or counterparty), mode, direction (debit or credit) and dates; blank filters nothing."""
    out = txns
    if q:
        out = out.filter(holds("narration_raw", q) | holds("counterparty_name", q))
    if mode:
        out = out.filter(F.col("txn_mode") == mode)
    if direction in ("debit", "credit"):
        out = out.filter(F.col(direction) > 0)
    if from_date:
        out = out.filter(F.col("txn_date") >= F.lit(from_date).cast("date"))
    if to_date:
        out = out.filter(F.col("txn_date") <= F.lit(to_date).cast("date"))
    return out.orderBy("source_row", "id")


def search_ledger(txns: DataFrame, statements: list[int] | None = None, mode: str = "", balance_type: str = "", q: str = "") -> DataFrame:
    """A slice of the whole ledger; ``q`` is looked for in narration, reference and counterparty."""
    out = txns
    if statements:
        out = out.filter(F.col("statement_id").isin(statements))
    if mode:
        out = out.filter(F.col("txn_mode") == mode)
    if balance_type:
        out = out.filter(F.col("balance_type") == balance_type)
    if q:
        out = out.filter(holds("narration_raw", q) | holds("reference", q) | holds("counterparty_name", q))
    return out


def statement_summary(txns: DataFrame) -> DataFrame:
    """By statement: sums of debits and credits (0 for none), first and last date, over all its rows."""
    zero = F.lit(0).cast(s.MONEY)
    total = lambda c: F.coalesce(F.sum(c), zero).cast(s.MONEY)
    return txns.groupBy("statement_id").agg(total("debit").alias("total_debit"), total("credit").alias("total_credit"), F.min("txn_date").alias("first_date"), F.max("txn_date").alias("last_date"))


def portfolio_counts(accounts: DataFrame, statements: DataFrame, txns: DataFrame) -> DataFrame:
    """One row: accounts, statements, transactions, flagged transactions, and whether an extraction is active."""
    active = F.coalesce(F.bool_or(F.col("extraction_status").isin("pending", "processing")), F.lit(False))
    a = accounts.agg(F.count(F.lit(1)).alias("accounts"))
    b = statements.agg(F.count(F.lit(1)).alias("statements"), active.alias("any_active"))
    c = txns.agg(F.count(F.lit(1)).alias("transactions"), F.count_if(F.coalesce("quality_flag", F.lit("")) != "").alias("flagged"))
    one = F.lit(1).alias("_lf_one")  # each side is one row
    return a.select("*", one).join(b.select("*", one), "_lf_one").join(c.select("*", one), "_lf_one").drop("_lf_one")


def filter_audit_log(log: DataFrame, action: str = "", user: str = "") -> DataFrame:
    out = log
    if action:
        out = out.filter(F.col("action") == action)
    if user:
        out = out.filter(holds("user_email_snapshot", user))
    return out.orderBy(F.desc("timestamp"))


def stale_extractions(statements: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Extractions pending or processing for over ``minutes`` fail, with a note; ``now`` is given."""
    old = F.col("extraction_status").isin("pending", "processing") & (F.col("uploaded_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    note = F.concat_ws(" ", F.nullif(F.col("notes"), F.lit("")), F.lit(f"Marked failed: no result within {minutes} minutes."))
    return statements.withColumns({"notes": F.when(old, note).otherwise(F.col("notes")), "extraction_status": F.when(old, "failed").otherwise(F.col("extraction_status"))})


def page(df: DataFrame, order: list[Column | str], size: int, number: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows; a number beyond the last gives the last page."""
    last = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(number, 1), last) - 1) * size).limit(size)


def review_queue_page(unidentified: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """Transactions without a beneficiary, largest debits, then credits, first."""
    return page(unidentified, [F.desc("debit"), F.desc("credit"), F.asc("id")], size, number)


def latest_statements(statements: DataFrame, k: int = 10) -> DataFrame:
    return statements.orderBy(F.desc("uploaded_at"), F.desc("id")).limit(k)


def recent_activity(log: DataFrame, k: int = 5) -> DataFrame:
    """The newest ``k`` log rows of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("timestamp"), F.desc("id"))
    return log.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def page_index(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` stored in ranges of ``order`` (``_lf_range``), from which any page is read without sorting the whole."""
    path = new_folder(df.sparkSession, "pages")
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = df.repartitionByRange(n, *order).withColumn("_lf_range", F.spark_partition_id())
    ranged.write.partitionBy("_lf_range").parquet(path)
    return spark.read.schema(ranged.schema).parquet(path)


def page_of(index: DataFrame, order: list[Column], size: int, number: int = 1) -> DataFrame:
    """The rows of one page, in order; a number beyond the last page gives the last one, one below 1 the first.

    A plan without an action: counts of the ranges tell which of them hold the page, only those are read, and a task sorts one range.
    """
    counts = index.groupBy("_lf_range").agg(F.count(F.lit(1)).alias("_lf_n"))
    every, before = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("_lf_range").rowsBetween(Window.unboundedPreceding, -1)
    last = F.ceil(F.sum("_lf_n").over(every) / size)
    low = (F.greatest(F.least(F.lit(number).cast("long"), last), F.lit(1)) - 1) * size
    placed = counts.withColumn("_lf_low", low).withColumn("_lf_before", F.coalesce(F.sum("_lf_n").over(before), F.lit(0)))
    # A row a range at most, so small whatever the table.
    wanted = placed.filter((F.col("_lf_before") < F.col("_lf_low") + size) & (F.col("_lf_before") + F.col("_lf_n") > F.col("_lf_low"))).drop("_lf_n")
    rows = index.join(F.broadcast(wanted), "_lf_range")
    place = F.col("_lf_before") + F.row_number().over(Window.partitionBy("_lf_range").orderBy(*order))
    rows = rows.withColumn("_lf_place", place).filter((F.col("_lf_place") > F.col("_lf_low")) & (F.col("_lf_place") <= F.col("_lf_low") + size))
    return rows.orderBy("_lf_place").select([c for c in index.columns if c != "_lf_range"])
