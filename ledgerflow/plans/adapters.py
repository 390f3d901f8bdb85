"""A ledger, its parties and its raw files, derived by Spark from order tables.

The same derivation in SQL (``LEDGER_SQL``) lets any result be checked by another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as s

LEDGER_SQL = """
narrated AS (
  SELECT o_orderkey AS k, o_custkey AS statement_id, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS amt, o_orderstatus AS st,
    (CASE WHEN o_orderkey % 52 = 39 THEN 'REVERSAL ' ELSE '' END) || CASE o_orderkey % 16
      WHEN 0 THEN 'NEFT-' || upper(p_name) || ' TRADERS PVT LTD'
      WHEN 1 THEN 'NEFT-OW/SAA' || o_orderkey || '/' || upper(p_name) || ' SERVICES'
      WHEN 2 THEN 'RTGS-' || upper(p_name) || ' HOMES LTD'
      WHEN 3 THEN 'IMPS/' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '/' || upper(p_name) || '/MOB'
      WHEN 4 THEN 'UPI/PAYMENT TO ' || upper(p_name)
      WHEN 5 THEN 'CASH DEPOSIT' WHEN 6 THEN '' WHEN 7 THEN 'ABC' WHEN 8 THEN 'TRANSFER'
      WHEN 9 THEN '1234567' || o_orderkey
      WHEN 10 THEN 'NEFT-RETURN-' || upper(p_name)
      WHEN 11 THEN 'HDFC0000123/' || upper(p_name) || ' BANK'
      WHEN 12 THEN 'BY ORDER OF ' || upper(p_name) || ' INDUSTRIES'
      WHEN 13 THEN 'CHQ PAID ' || o_orderkey
      WHEN 14 THEN 'CREDIT BY ' || upper(p_name) || ' AND SONS'
      ELSE p_name || ' - MINISTRY OF ' || upper(p_name) END AS narration
  FROM orders JOIN part ON p_partkey = o_orderkey % 200),
priced AS (
  SELECT *, CASE WHEN k % 59 = 0 THEN NULL WHEN st = 'F' OR k % 89 = 0 THEN CASE WHEN k % 101 = 0 THEN -amt ELSE amt END END AS dr,
    CASE WHEN k % 59 = 0 THEN NULL WHEN st <> 'F' THEN amt END AS cr FROM narrated),
entries AS (
  SELECT k, k * 10 AS id, statement_id, d, narration, dr, cr, CASE WHEN k % 3 <> 0 THEN '' ELSE 'REF' || (k % 50) END AS reference FROM priced
  UNION ALL
  SELECT k, k * 10 + 1, statement_id, d + CAST(CASE k % 52 WHEN 26 THEN 2 WHEN 39 THEN 1 ELSE 0 END AS INTEGER), CASE WHEN k % 52 = 26 THEN narration || 'X' ELSE narration END,
    CASE WHEN k % 52 = 39 THEN cr ELSE dr END, CASE WHEN k % 52 = 39 THEN dr ELSE cr END,
    CASE WHEN k % 52 = 13 THEN 'DUP' || k WHEN k % 3 <> 0 THEN '' ELSE 'REF' || (k % 50) END
  FROM priced WHERE k % 13 = 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY d, id) AS source_row FROM entries),
ledger AS (
  SELECT id, statement_id, CASE WHEN k % 61 = 0 THEN NULL ELSE d END AS txn_date, narration AS narration_raw, dr AS debit, cr AS credit,
    CAST(100000 + sum(coalesce(cr, 0) - coalesce(dr, 0)) OVER (PARTITION BY statement_id ORDER BY source_row) + CASE WHEN k % 97 = 0 THEN 7 ELSE 0 END AS DECIMAL(18,2)) AS balance,
    reference, CAST(source_row AS BIGINT) AS source_row FROM ordered)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narration(k: Column, name: Column) -> Column:
    up, key = F.upper(name), k.cast("string")
    texts = [
        F.concat(F.lit("NEFT-"), up, F.lit(" TRADERS PVT LTD")),
        F.concat(F.lit("NEFT-OW/SAA"), key, F.lit("/"), up, F.lit(" SERVICES")),
        F.concat(F.lit("RTGS-"), up, F.lit(" HOMES LTD")),
        F.concat(F.lit("IMPS/"), F.lpad(key, 12, "0"), F.lit("/"), up, F.lit("/MOB")),
        F.concat(F.lit("UPI/PAYMENT TO "), up),
        F.lit("CASH DEPOSIT"),
        F.lit(""),
        F.lit("ABC"),
        F.lit("TRANSFER"),
        F.concat(F.lit("1234567"), key),
        F.concat(F.lit("NEFT-RETURN-"), up),
        F.concat(F.lit("HDFC0000123/"), up, F.lit(" BANK")),
        F.concat(F.lit("BY ORDER OF "), up, F.lit(" INDUSTRIES")),
        F.concat(F.lit("CHQ PAID "), key),
        F.concat(F.lit("CREDIT BY "), up, F.lit(" AND SONS")),
        F.concat(name, F.lit(" - MINISTRY OF "), up),
    ]
    chosen = F.coalesce(*[F.when(k % 16 == n, t) for n, t in enumerate(texts)])
    return F.concat(F.when(k % 52 == 39, "REVERSAL ").otherwise(""), chosen)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with one statement a customer; see ``LEDGER_SQL``."""
    k = F.col("o_orderkey")
    # Remainders by 200 are fewer than 400 parts; without this filter all parts of a large table are gathered at the driver.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name").filter("p_partkey between -199 and 199")
    w = table(spark, sf_dir, "orders").join(F.broadcast(parts), F.col("p_partkey") == k % 200)
    amount, fail = F.col("o_totalprice").cast(s.MONEY), F.col("o_orderstatus") == "F"
    none = F.lit(None).cast(s.MONEY)
    w = w.select(
        k.alias("k"),
        F.col("o_custkey").alias("statement_id"),
        F.col("o_orderdate").cast("date").alias("d"),
        narration(k, F.col("p_name")).alias("narration_raw"),
        F.when(k % 59 == 0, none).when(fail | (k % 89 == 0), F.when(k % 101 == 0, -amount).otherwise(amount)).alias("debit"),
        F.when(k % 59 == 0, none).when(~fail, amount).alias("credit"),
        F.when(k % 3 != 0, "").otherwise(F.concat(F.lit("REF"), (k % 50).cast("string"))).alias("reference"),
    )
    kind = F.col("k") % 52
    again = w.filter("k % 13 = 0").select(
        "k",
        (F.col("k") * 10 + 1).alias("id"),
        "statement_id",
        F.date_add("d", F.when(kind == 26, 2).when(kind == 39, 1).otherwise(0)).alias("d"),
        F.when(kind == 26, F.concat("narration_raw", F.lit("X"))).otherwise(F.col("narration_raw")).alias("narration_raw"),
        F.when(kind == 39, F.col("credit")).otherwise(F.col("debit")).alias("debit"),
        F.when(kind == 39, F.col("debit")).otherwise(F.col("credit")).alias("credit"),
        F.when(kind == 13, F.concat(F.lit("DUP"), F.col("k").cast("string"))).otherwise(F.col("reference")).alias("reference"),
    )
    w = w.withColumn("id", F.col("k") * 10).unionByName(again)
    order = Window.partitionBy("statement_id").orderBy("d", "id")
    zero = F.lit(0).cast(s.MONEY)
    w = w.withColumn("source_row", F.row_number().over(order))
    moved = F.sum(F.coalesce("credit", zero) - F.coalesce("debit", zero)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    text = F.col("narration_raw")
    return w.select(
        "id",
        "statement_id",
        F.when(F.col("k") % 61 != 0, F.col("d")).alias("txn_date"),
        "narration_raw",
        "debit",
        "credit",
        (moved + 100000 + F.when(F.col("k") % 97 == 0, 7).otherwise(0)).cast(s.MONEY).alias("balance"),
        F.lit("Cr").alias("balance_type"),
        "reference",
        s.extract_mode(text).alias("txn_mode"),
        s.extract_counterparty(text).alias("counterparty_name"),
        "source_row",
        s.quality_flag(F.lit(""), text).alias("quality_flag"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account a customer, of the engagement of its nation."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("engagement_id"), F.col("c_name").alias("cd_name"), F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("account_number"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement an account; status and upload time by its number."""
    n = F.col("c_custkey")
    status = F.when(n % 17 == 0, "processing").when(n % 19 == 0, "pending").when(n % 23 == 0, "cancelled").otherwise("completed")
    return table(spark, sf_dir, "customer").select(
        n.alias("id"), n.alias("account_id"), F.timestamp_seconds(F.lit(1704067200) + (n * 37) % 86400).alias("uploaded_at"), status.alias("extraction_status"), F.lit("").alias("notes"), F.lit(0).alias("rows_extracted")
    )


def engagement_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User u has the engagements with the same remainder by 5."""
    n = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select((n % 5).alias("user_id"), n.alias("engagement_id"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "user_id", F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("user_email_snapshot"), F.col("event_type").alias("action"), F.col("props").alias("detail"), F.col("ts").alias("timestamp")
    )


def fixed_width_line() -> Column:
    """A transaction as a line of a fixed-width report."""
    right = lambda c, n: F.lpad(F.coalesce(F.format_number(F.col(c).cast("decimal(18,2)"), 2), F.lit("")), n, " ")
    day = F.coalesce(F.date_format("txn_date", "dd-MM-yyyy"), F.lit(" " * 10))
    return F.concat(
        F.lit(" "), day, F.lit("  "), day, F.rpad("reference", 16, " "), F.rpad(F.substring("narration_raw", 1, 58), 58, " "),
        right("debit", 15), right("credit", 21), right("balance", 20), F.col("balance_type"), F.lit(" "), F.lit("USER000001"),
    )


def fixed_width_lines(txns: DataFrame) -> DataFrame:
    """(file_id, line_no, text): the ledger as a fixed-width report, one file a statement."""
    return txns.select(F.col("statement_id").cast("string").alias("file_id"), F.col("source_row").alias("line_no"), fixed_width_line().alias("text"))


def whole_files(lines: DataFrame, header: str = "GL. Date   Value Date") -> DataFrame:
    """(file_id, lines) of (file_id, line_no, text), a header line first."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("file_id").agg(F.concat(F.array(F.lit(header)), F.transform(rows, lambda x: x["text"])).alias("lines"))
