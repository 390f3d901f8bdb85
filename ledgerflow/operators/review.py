"""Who may see what, and the analyst's decisions as joins: issues, corrections, assignments, approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s


def visible_statements(statements: DataFrame, accounts: DataFrame, assignments: DataFrame, user_id: int, admin: bool = False) -> DataFrame:
    """Statements a user may see: all for an admin, else those of engagements assigned to the user."""
    if admin:
        return statements
    own = assignments.filter(F.col("user_id") == user_id).select("engagement_id")
    seen = accounts.join(own, "engagement_id", "left_semi").select(F.col("id").alias("account_id"))
    return statements.join(seen, "account_id", "left_semi")


def unidentified(txns: DataFrame, identifications: DataFrame) -> DataFrame:
    """Transactions without an identification."""
    done = identifications.select(F.col("transaction_id").alias("id"))
    return txns.join(done, "id", "left_anti")


def filter_issues(issues: DataFrame, severity: str = "", resolution: str = "") -> DataFrame:
    """Unresolved issues of a severity; ``resolution``: required, optional or '' (both)."""
    out = issues.filter(~F.col("resolved"))
    if severity:
        out = out.filter(F.col("severity") == severity)
    if resolution in ("required", "optional"):
        out = out.filter(F.col("resolution_required") == F.lit(resolution == "required"))
    return out


def attach_issues(txns: DataFrame, issues: DataFrame, messages: bool = True) -> DataFrame:
    """Adds ``status`` (Flagged or Clean), ``issue_codes`` and ``issue_messages`` of all issues, resolved or not, in the order of their codes and ids.

    Without ``messages`` the codes alone are added, which needs no other column of the issues than their transaction's id.
    """
    row = F.struct("code", "issue_id", "message") if messages else F.struct("code")
    by = issues.filter("transaction_id is not null").groupBy(F.col("transaction_id").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("l"))
    texts = {"issue_codes": ("code", ", ")} | ({"issue_messages": ("message", "; ")} if messages else {})
    by = by.select("id", *[F.array_join(F.col(f"l.{c}"), between).alias(name) for name, (c, between) in texts.items()])
    out = txns.join(by, "id", "left")
    return out.withColumn("status", F.when(F.col("issue_codes").isNull(), "Clean").otherwise("Flagged")).fillna("", list(texts))


def issues_by_transaction(issues: DataFrame, txns: DataFrame) -> DataFrame:
    """Unresolved issues with their transaction's ``source_row``; those of a whole statement have none."""
    rows = txns.select(F.col("id").alias("transaction_id"), "source_row")
    return issues.filter(~F.col("resolved")).join(rows, "transaction_id", "left").withColumn("statement_level", F.col("transaction_id").isNull())


def latest(df: DataFrame, keys: list[str], at: str = "ts") -> DataFrame:
    """The last row of each key; ties by the whole row."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(F.hash(*df.columns)))
    return df.withColumn("_lf_n", F.row_number().over(w)).filter("_lf_n = 1").drop("_lf_n")


def resolve_issues(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """Marks decided issues (issue_id, action, user_id, ts) resolved; the last decision holds."""
    d = latest(decisions, ["issue_id"]).select("issue_id", F.col("action").alias("analyst_action"), F.col("user_id").alias("analyst_user_id"), F.col("ts").alias("resolved_at"))
    out = issues.drop("analyst_action", "analyst_user_id", "resolved_at").join(d, "issue_id", "left")
    return out.withColumn("resolved", F.col("resolved") | F.col("analyst_action").isNotNull())


def apply_corrections(txns: DataFrame, corrections: DataFrame) -> DataFrame:
    """Overrides narration and debit by the last correction (transaction_id, field, value, user_id, ts); a blank debit is null."""
    last = latest(corrections.filter(F.col("field").isin("narration", "debit")), ["transaction_id", "field"])
    by = last.groupBy(F.col("transaction_id").alias("id")).agg(F.max(F.when(F.col("field") == "narration", F.struct("value"))).alias("_lf_n"), F.max(F.when(F.col("field") == "debit", F.struct("value"))).alias("_lf_d"))
    out = txns.join(by, "id", "left")
    debit = F.when(F.col("_lf_d").isNotNull(), s.parse_amount(F.col("_lf_d.value"))).otherwise(F.col("debit"))
    narration = F.when(F.col("_lf_n").isNotNull(), F.coalesce("_lf_n.value", F.lit(""))).otherwise(F.col("narration_raw"))
    return out.withColumns({"debit": debit, "narration_raw": narration}).drop("_lf_n", "_lf_d")


def correction_log(txns: DataFrame, corrections: DataFrame) -> DataFrame:
    """Every correction with the value before it: the one it replaced, at first the transaction's own."""
    base = txns.select(F.col("id").alias("transaction_id"), F.col("narration_raw").alias("_lf_n"), F.col("debit").cast("string").alias("_lf_d"))
    w = Window.partitionBy("transaction_id", "field").orderBy("ts", "value")
    own = F.when(F.col("field") == "debit", F.col("_lf_d")).otherwise(F.col("_lf_n"))
    before = F.when(F.row_number().over(w) == 1, own).otherwise(F.lag("value").over(w))
    out = corrections.filter(F.col("field").isin("narration", "debit")).join(base, "transaction_id")
    return out.select("transaction_id", "field", before.alias("original_value"), F.col("value").alias("corrected_value"), F.col("user_id").alias("corrected_by_user_id"), F.col("ts").alias("timestamp"))


def apply_analyst_assignments(assigned: DataFrame, assignments: DataFrame) -> DataFrame:
    """Transactions (with ``counterparty``) under the analyst's names (statement_id, transaction_id, beneficiary_name, beneficiary_type, ts).

    The last assignment of a transaction holds. A name that the statement's ledger has keeps its
    type and confidence; the transaction is of layer 3 with confidence 1.
    """
    a = latest(assignments, ["transaction_id"]).select(F.col("transaction_id").alias("id"), F.upper(s.strip(F.col("beneficiary_name"))).alias("_lf_name"), F.upper("beneficiary_type").alias("_lf_type"))
    known = assigned.filter("counterparty is not null").groupBy("statement_id", F.col("counterparty").alias("_lf_name")).agg(F.min_by("beneficiary_type", "id").alias("_lf_known"))
    out = assigned.join(a, "id", "left").join(known, ["statement_id", "_lf_name"], "left")
    mine = F.col("_lf_name").isNotNull()
    return out.withColumns(
        {
            "counterparty": F.when(mine, F.col("_lf_name")).otherwise(F.col("counterparty")),
            "beneficiary_type": F.when(mine, F.coalesce("_lf_known", "_lf_type")).otherwise(F.col("beneficiary_type")),
            "confidence": F.when(mine, 1.0).otherwise(F.col("confidence")),
            "layer": F.when(mine, "LAYER_3").otherwise(F.col("layer")),
        }
    ).drop("_lf_name", "_lf_type", "_lf_known")


def approve_counterparties(ledger: DataFrame, audit: DataFrame, approvals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ledger and audit with approvals (statement_id, counterparty_name, notes, user_id, ts): reviewed, and all identifications confirmed."""
    a = latest(approvals, ["statement_id", "counterparty_name"]).select("statement_id", F.col("counterparty_name").alias("counterparty"), F.col("notes").alias("analyst_notes"), F.col("user_id").alias("reviewed_by"), F.col("ts").alias("reviewed_at"))
    marked = ledger.drop("analyst_notes", "reviewed_by", "reviewed_at").join(a, ["statement_id", "counterparty"], "left")
    ok = a.select("statement_id", "counterparty", F.col("reviewed_at").alias("confirmed_at"))
    confirmed = audit.drop("confirmed_at").join(ok, ["statement_id", "counterparty"], "left")
    return marked, confirmed.withColumn("analyst_confirmed", F.col("analyst_confirmed") | F.col("confirmed_at").isNotNull())


def drop_cancelled_partials(statements: DataFrame, txns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements and transactions without the rows of cancelled statements, which get a note of how many went."""
    cancelled = statements.filter("extraction_status = 'cancelled'").select(F.col("id").alias("statement_id"))
    gone = txns.join(cancelled, "statement_id", "left_semi").groupBy(F.col("statement_id").alias("id")).agg(F.count(F.lit(1)).alias("_lf_gone"))
    out = statements.join(gone, "id", "left")
    n: Column = F.coalesce("_lf_gone", F.lit(0))
    is_cancelled = F.col("extraction_status") == "cancelled"
    note = F.format_string("Cancelled by user. %d partial rows deleted.", n)
    out = out.withColumns({"notes": F.when(is_cancelled, note).otherwise(F.col("notes")), "rows_extracted": F.when(is_cancelled, 0).otherwise(F.col("rows_extracted"))}).drop("_lf_gone")
    return out, txns.join(cancelled, "statement_id", "left_anti")
