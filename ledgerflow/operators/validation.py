"""Checks of a ledger: issues, their counts, and the reliability rating of statements.

Every check gives rows of the issues schema, with an id derived from what it is about,
so a rerun gives the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions.staging import once, staged
from . import duplicates as d
from .balance import check_balance, statement_order

# Fixed values.
GENERIC_NARRATIONS = ("TRANSFER", "BY ORDER", "CREDIT", "DEBIT", "PAYMENT", "MISC", "OTHERS", "CLEARANCE", "CASH")
LARGE_AMOUNT = "2500000"
COLUMNS = ("issue_id", "statement_id", "transaction_id", "severity", "code", "message", "resolution_required", "suggested_action", "resolved")


def issue(df: DataFrame, code: Column | str, severity: Column | str, message: Column, required: Column | bool = False, transaction: str | None = "id", other: Column | None = None) -> DataFrame:
    """Rows of the issues schema; ``other`` tells apart issues of one code and transaction."""
    col = lambda x: F.lit(x) if isinstance(x, (str, bool)) else x
    txn = F.col(transaction).cast("long") if transaction else F.lit(None).cast("long")
    parts = [F.coalesce(x.cast("string"), F.lit("-")) for x in (F.col("statement_id"), col(code), txn, other if other is not None else F.lit(""))]
    return df.select(
        F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16).alias("issue_id"),
        F.col("statement_id").cast("long").alias("statement_id"),
        txn.alias("transaction_id"),
        col(severity).alias("severity"),
        col(code).alias("code"),
        message.alias("message"),
        col(required).alias("resolution_required"),
        F.lit("").alias("suggested_action"),
        F.lit(False).alias("resolved"),
    )


def check_rows(txns: DataFrame) -> DataFrame:
    """BAL_MISMATCH, NEGATIVE_AMOUNT and BOTH_DEBIT_CREDIT of every row but a statement's first."""
    w = check_balance(txns).withColumn("_lf_no", F.row_number().over(statement_order())).filter("_lf_no > 1")
    text = F.format_string("Balance mismatch: expected %s, got %s (variance: %s)", F.col("expected_balance").cast("string"), F.coalesce(F.col("balance").cast("string"), F.lit("0")), F.col("variance").cast("string"))
    kinds = F.array(
        F.when(~F.col("balance_ok"), F.struct(F.lit("BAL_MISMATCH").alias("code"), F.lit("HIGH").alias("severity"), text.alias("message"), F.lit(False).alias("required"))),
        F.when((F.col("debit") < 0) | (F.col("credit") < 0), F.struct(F.lit("NEGATIVE_AMOUNT").alias("code"), F.lit("CRITICAL").alias("severity"), F.lit("Negative amount detected").alias("message"), F.lit(True).alias("required"))),
        F.when((F.col("debit") > 0) & (F.col("credit") > 0), F.struct(F.lit("BOTH_DEBIT_CREDIT").alias("code"), F.lit("HIGH").alias("severity"), F.lit("Both debit and credit are non-zero").alias("message"), F.lit(False).alias("required"))),
    )
    w = w.withColumn("k", F.explode(F.array_compact(kinds)))
    return issue(w, F.col("k.code"), F.col("k.severity"), F.col("k.message"), F.col("k.required"))


def distinct_dates(txns: DataFrame) -> DataFrame:
    return txns.filter("txn_date is not null").select("statement_id", "txn_date").distinct()


def date_gaps(txns: DataFrame, most: int = 7) -> DataFrame:
    """(statement_id, start, end, gap_days, working_days) of neighbouring dates over ``most`` working days apart."""
    # Of the rows of one date the last alone has a later one after it.
    w = txns.filter("txn_date is not null").select("statement_id", "txn_date").withColumn("end", F.lead("txn_date").over(Window.partitionBy("statement_id").orderBy("txn_date"))).filter("end > txn_date")
    w = w.withColumn("working_days", s.working_days(F.col("txn_date"), F.col("end"))).filter(F.col("working_days") > most)
    return w.select("statement_id", F.col("txn_date").alias("start"), "end", F.datediff("end", "txn_date").alias("gap_days"), "working_days")


def check_date_gaps(txns: DataFrame, most: int = 7) -> DataFrame:
    g = date_gaps(txns, most)
    text = F.format_string("Date gap: %d days (%d working days) between %s and %s", "gap_days", "working_days", F.col("start").cast("string"), F.col("end").cast("string"))
    return issue(g, "DATE_GAP", "HIGH", text, transaction=None, other=F.col("start"))


def check_duplicates(txns: DataFrame, codes: tuple[str, ...] | None = None) -> DataFrame:
    """Reversals, exact, probable and near duplicates; the issue is the earlier row's and names the later one.

    With ``codes`` only these kinds are looked for: near duplicates are found in steps of their own, which a filter on the result wouldn't save.
    """
    rows = staged(d.compared(d.prepared(txns)))

    def of(pairs: DataFrame, code: str, severity: str, text: str, required: bool = False) -> DataFrame:
        p = pairs.select(F.col("i_statement_id").alias("statement_id"), F.col("i_id").alias("id"), "j_id", "j_source_row")
        return issue(p, code, severity, F.format_string(text, "j_source_row"), required, other=F.col("j_id"))

    kinds = {
        "REVERSAL_PAIR": lambda c: of(d.reversal_pairs(rows), c, "INFO", "Reversal pair with row %d"),
        "EXACT_DUPLICATE": lambda c: of(d.exact_duplicates(rows), c, "HIGH", "Exact duplicate of row %d"),
        "PROBABLE_DUPLICATE": lambda c: of(d.probable_duplicate_pairs(rows), c, "HIGH", "Probable duplicate of row %d", True),
        "NEAR_DUPLICATE": lambda c: of(d.near_duplicate_pairs(rows), c, "MEDIUM", "Near-duplicate of row %d"),
    }
    first, *more = [find(code) for code, find in kinds.items() if codes is None or code in codes]
    for other in more:
        first = first.unionByName(other)
    return first


def check_narrations(txns: DataFrame) -> DataFrame:
    """BLANK, SHORT, GENERIC or NUMERIC_ONLY narrations, the first that holds."""
    w = once(txns, "_lf_text", s.strip(F.coalesce("narration_raw", F.lit(""))))
    n = F.col("_lf_text")
    clean = s.clean_narration(n)
    code = (
        F.when(n == "", "BLANK_NARRATION")
        .when(F.length(n) < 5, "SHORT_NARRATION")
        .when(F.upper(clean).isin(*GENERIC_NARRATIONS), "GENERIC_NARRATION")
        .when(s.is_numeric_narration(n), "NUMERIC_ONLY_NARRATION")
    )
    # The code alone is decided for every row; what an issue says is made for those that have one.
    w = once(w, "_lf_code", code).filter("_lf_code is not null")
    is_ = lambda *codes: F.col("_lf_code").isin(*codes)
    large = s.amount_or_zero(F.col("debit"), F.col("credit")) >= F.lit(LARGE_AMOUNT).cast(s.MONEY)
    severity = F.when(is_("SHORT_NARRATION", "NUMERIC_ONLY_NARRATION"), "MEDIUM").when(large, "CRITICAL").otherwise("HIGH")
    quoted = lambda text, of: F.concat(F.lit(f'{text}: "'), of, F.lit('"'))
    message = (
        F.when(is_("BLANK_NARRATION"), "Blank narration")
        .when(is_("SHORT_NARRATION"), quoted("Narration too short", n))
        .when(is_("GENERIC_NARRATION"), quoted("Generic narration", clean))
        .otherwise(quoted("Numeric-only narration", n))
    )
    return issue(w, F.col("_lf_code"), severity, message, is_("BLANK_NARRATION") & large)


def run_all_checks(txns: DataFrame) -> DataFrame:
    """The issues of all checks."""
    return check_rows(txns).unionByName(check_date_gaps(txns)).unionByName(check_duplicates(txns)).unionByName(check_narrations(txns))


def issue_counts(issues: DataFrame) -> DataFrame:
    """By statement: unresolved issues, and those of each grave severity."""
    open_ = ~F.col("resolved")
    count = lambda sev: F.count_if(open_ & (F.col("severity") == sev)).alias(sev.lower())
    return issues.groupBy("statement_id").agg(F.count_if(open_).alias("unresolved"), count("CRITICAL"), count("HIGH"), count("MEDIUM"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """By statement: counts by severity (any other counts as info) and a map from code to count."""
    by_code = issues.groupBy("statement_id", "code").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("severity") == v).alias(v.lower()) for v in ("CRITICAL", "HIGH", "MEDIUM")]
    )
    codes = F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("by_code")
    out = by_code.groupBy("statement_id").agg(F.sum("n").alias("total"), *[F.sum(v).alias(v) for v in ("critical", "high", "medium")], codes)
    return out.withColumn("info", F.col("total") - F.col("critical") - F.col("high") - F.col("medium"))


def reliability_rating(statements: DataFrame, issues: DataFrame, reviewed: Column | None = None) -> DataFrame:
    """Adds the issue counts and ``rating`` to statements (statement_id): CLEAN, ACCEPTABLE, QUALIFIED or UNRELIABLE.

    ``reviewed`` tells whether an analyst has reviewed a statement; by default none has.
    """
    out = statements.join(issue_counts(issues), "statement_id", "left").fillna(0, ["unresolved", "critical", "high", "medium"])
    seen = F.lit(False) if reviewed is None else F.coalesce(reviewed, F.lit(False))
    rating = (
        F.when(F.col("critical") + F.col("high") + F.col("medium") == 0, "CLEAN")
        .when(F.col("critical") + F.col("high") == 0, "ACCEPTABLE")
        .when((F.col("critical") == 0) | seen, "QUALIFIED")
        .otherwise("UNRELIABLE")
    )
    return out.withColumn("rating", rating)


def exportable(statements: DataFrame, issues: DataFrame) -> DataFrame:
    """Adds ``exportable``: no unresolved issue whose resolution is required."""
    held = issues.filter(~F.col("resolved") & F.col("resolution_required")).select("statement_id").distinct().withColumn("_lf_held", F.lit(True))
    return statements.join(held, "statement_id", "left").withColumn("exportable", F.col("_lf_held").isNull()).drop("_lf_held")


def approve_validation(statements: DataFrame, approvals: DataFrame) -> DataFrame:
    """Sets the reviewer of approved statements (statement_id, user_id, ts if there is one); UNRELIABLE becomes QUALIFIED.

    Of several approvals the latest counts; a statement without one keeps the reviewer it has.
    """
    last = F.max_by("user_id", "ts") if "ts" in approvals.columns else F.max("user_id")
    out = statements.join(approvals.groupBy("statement_id").agg(last.alias("_lf_user")), "statement_id", "left")
    out = out.withColumn("rating", F.when(F.col("_lf_user").isNotNull() & (F.col("rating") == "UNRELIABLE"), "QUALIFIED").otherwise(F.col("rating")))
    before = [F.col("validation_reviewed_by")] if "validation_reviewed_by" in statements.columns else []
    return out.withColumn("validation_reviewed_by", F.coalesce("_lf_user", *before)).drop("_lf_user")


def validation_state(statements: DataFrame, issues: DataFrame) -> DataFrame:
    """Adds ``fully_validated`` and ``has_unresolved_critical`` to rated statements."""
    crit = issues.groupBy("statement_id").agg(F.bool_or(~F.col("resolved") & (F.col("severity") == "CRITICAL")).alias("has_unresolved_critical"))
    out = statements.join(crit, "statement_id", "left").fillna(False, ["has_unresolved_critical"])
    return out.withColumn("fully_validated", F.col("rating").isin("CLEAN", "QUALIFIED", "ACCEPTABLE"))
