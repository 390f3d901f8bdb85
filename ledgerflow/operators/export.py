"""Exports: the cleaned ledger, the counterparty ledger and reconciled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as s
from .review import attach_issues
from .validation import exportable

# Fixed values.
TYPE_LABELS = {"COMPANY": "Company", "INDIVIDUAL": "Individual", "BANK": "Bank", "GOVERNMENT": "Government", "UNKNOWN": "Unknown"}
METHOD_LABELS = {"RULE_BASED": "Rule-Based", "LLM": "LLM", "ANALYST": "Analyst"}


def labels(column: str, names: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(F.col(column) == k, F.lit(v)) for k, v in names.items()], F.col(column))


def cleaned_ledger(txns: DataFrame, issues: DataFrame) -> DataFrame:
    """Transactions of exportable statements with their issues; zero and null amounts are blank."""
    open_ = exportable(txns.select("statement_id").distinct(), issues).filter("exportable").select("statement_id")
    blank = lambda c: F.nullif(F.col(c), F.lit(0).cast(s.MONEY)).alias(c)
    out = attach_issues(txns.join(open_, "statement_id", "left_semi"), issues)
    return out.select("statement_id", "source_row", "id", "txn_date", "narration_raw", blank("debit"), blank("credit"), "balance", "reference", "txn_mode", "counterparty_name", "status", "issue_codes", "issue_messages")


def write_cleaned(txns: DataFrame, issues: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Writes the cleaned ledger by statement, each in row order; statements with an open required issue are held back."""
    out = cleaned_ledger(txns, issues).repartition("statement_id").sortWithinPartitions("statement_id", "source_row", "id")
    out.write.mode("overwrite").partitionBy("statement_id").format(fmt).option("header", True).save(path)


def counterparty_export(ledger: DataFrame) -> DataFrame:
    """The twelve columns of the counterparty export."""
    have = lambda c, default: F.col(c) if c in ledger.columns else F.lit(default)
    double = lambda c: F.col(c).cast("double")
    return ledger.select(
        "statement_id",
        F.col("counterparty").alias("beneficiary_name"),
        labels("beneficiary_type", TYPE_LABELS).alias("type"),
        labels("identification_method", METHOD_LABELS).alias("identification_method"),
        double("highest_confidence").alias("confidence"),
        double("total_debit").alias("total_debit"),
        double("total_credit").alias("total_credit"),
        double("net_position").alias("net_position"),
        "transaction_count",
        F.col("first_transaction_date").alias("first_date"),
        F.col("last_transaction_date").alias("last_date"),
        F.when(F.coalesce(have("above_aggregate_threshold", True), F.lit(True)), "Yes").otherwise("No").alias("above_threshold"),
        F.coalesce(have("reviewed_by", None).cast("string"), F.lit("")).alias("reviewed_by"),
    )


def write_counterparty_ledger(ledger: DataFrame, path: str, fmt: str = "csv") -> None:
    """Writes the export, each statement's largest debits first."""
    out = counterparty_export(ledger).repartition("statement_id").sortWithinPartitions("statement_id", F.desc("total_debit"), "beneficiary_name")
    out.write.mode("overwrite").format(fmt).option("header", True).save(path)


def write_reconciled(reconciled: DataFrame, page_texts: DataFrame, path: str) -> None:
    """Writes reconciled rows as CSV and the pages' raw text, both in page order within a file."""
    reconciled.repartition("file_id").sortWithinPartitions("file_id", "page", "top").write.mode("overwrite").option("header", True).csv(f"{path}/transactions")
    page_texts.repartition("file_id").sortWithinPartitions("file_id", "page_no").write.mode("overwrite").parquet(f"{path}/raw_text")
