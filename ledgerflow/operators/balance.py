"""Running balances: reconciliation of rows and statements, and corrections from the balance.

Windows are by statement, file or page in (source_row, id) order, or by ranges of it where one has too many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions.ranges import with_previous

ORDER = ("source_row", "id")


def zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0).cast(s.MONEY))


def statement_order() -> Window:
    return Window.partitionBy("statement_id").orderBy(*ORDER)


def check_balance(txns: DataFrame, tolerance: float = 1.00, range_rows: int | None = None) -> DataFrame:
    """Adds ``expected_balance``, ``variance`` and ``balance_ok``; a statement's first row has none and is ok.

    ``range_rows``: so many rows of a statement are in one task at most (``with_previous``).
    """
    w = with_previous(txns, F.col("balance"), ("statement_id",), ORDER, "_lf_before", range_rows=range_rows)
    expected = F.when(F.col("_lf_before").isNotNull(), zero(F.col("_lf_before.v")) + zero("credit") - zero("debit"))
    out = w.withColumn("expected_balance", expected.cast(s.MONEY)).drop("_lf_before").withColumn("variance", F.abs(F.col("expected_balance") - zero("balance")).cast(s.MONEY))
    return out.withColumn("balance_ok", F.coalesce(F.col("variance") <= F.lit(str(tolerance)).cast(s.MONEY), F.lit(True)))


def statement_balance_variance(txns: DataFrame, tolerance: float = 1.00) -> DataFrame:
    """By statement: opening and closing balance, the variance, and a note where it exceeds ``tolerance``.

    The opening balance stands after the first row, whose amounts are in the sums all the same.
    """
    at = F.struct(*ORDER)
    out = txns.groupBy("statement_id").agg(
        F.min_by(zero("balance"), at).alias("opening_balance"),
        F.max_by(zero("balance"), at).alias("closing_balance"),
        zero(F.sum("debit")).cast(s.MONEY).alias("total_debit"),
        zero(F.sum("credit")).cast(s.MONEY).alias("total_credit"),
    )
    variance = F.abs(F.col("opening_balance") + F.col("total_credit") - F.col("total_debit") - F.col("closing_balance")).cast(s.MONEY)
    out = out.withColumn("balance_variance", variance)
    note = F.concat(F.lit("Statement-level balance variance: "), F.col("balance_variance").cast("string"))
    return out.withColumn("note", F.when(F.col("balance_variance") > F.lit(str(tolerance)).cast(s.MONEY), note))


def signed_balance(balance: Column, kind: Column) -> Column:
    return F.when(F.upper(kind) == "DR", -balance).otherwise(balance)


def balance_suspect(lines: DataFrame) -> DataFrame:
    """Adds ``balance_diff``, ``balance_suspect`` and ``quality_flag`` to dated OCR lines of a page.

    A row is suspect if its balance moved by other than 85 to 115 % of its amount.
    """
    w = Window.partitionBy("file_id", "page_no").orderBy("line_no")
    diff = F.when(F.col("txn_amount").isNotNull(), F.abs(F.col("balance") - F.lag("balance").over(w)))
    out = lines.withColumn("balance_diff", diff)
    share = F.col("balance_diff") / F.nullif(F.col("txn_amount"), F.lit(0.0))
    bad = (F.col("balance_diff") > 0) & (F.col("txn_amount") > 0) & ~share.between(0.85, 1.15)
    out = out.withColumn("balance_suspect", F.coalesce(bad, F.lit(False)))
    flag = F.concat(F.lit("OCR_NEEDS_REVIEW"), F.when(F.col("date_carried"), "_DATE_CARRIED").otherwise(""), F.when(F.col("balance_suspect"), "_BALANCE_SUSPECT").otherwise(""))
    return out.withColumn("quality_flag", flag)


def correct_from_balance(rows: DataFrame, by: tuple[str, ...] = ("file_id", "page_no"), order: tuple[str, ...] = ("source_row",), range_rows: int | None = None) -> DataFrame:
    """Puts debits and credits right by the change of the signed balance; adds ``correction``.

    ``correction``: '' (none), col_swapped, col_swapped_sign, debit_ocr_corrected,
    credit_ocr_corrected, debit_filled_from_balance or credit_filled_from_balance.
    """
    rows = rows.withColumn("_lf_signed", signed_balance(F.col("balance"), F.col("balance_type")))
    rows = with_previous(rows, F.col("_lf_signed"), by, order, "_lf_before", range_rows=range_rows)
    rows = rows.withColumn("_lf_diff", F.col("_lf_signed") - F.col("_lf_before.v")).drop("_lf_before")
    d, c, diff = F.col("debit"), F.col("credit"), F.col("_lf_diff")
    e = F.abs(diff)

    def close(p: Column) -> Column:
        return p.isNotNull() & (e > 0) & ((F.abs(p - e) <= 50) | (F.abs(p - e) <= e * F.lit(0.01).cast("decimal(3,2)")))

    def far(p: Column) -> Column:
        wide = F.abs(p - e) > e * F.lit("0.015").cast("decimal(4,3)")
        return p.isNotNull() & (e > 0) & wide & F.when(e < 5000, F.abs(p - e) > 5).otherwise(F.abs(p - e) > 500)

    def rule(own: Column, other: Column, own_name: str) -> Column:
        return (
            F.when(close(own), "")
            .when(close(other), "col_swapped")
            .when(other.isNotNull() & own.isNull(), "col_swapped_sign")
            .when(far(own), f"{own_name}_ocr_corrected")
            .when(own.isNull() & other.isNull(), f"{own_name}_filled_from_balance")
            .otherwise("")
        )

    rows = rows.withColumn("correction", F.when(diff < 0, rule(d, c, "debit")).when(diff > 0, rule(c, d, "credit")).otherwise(""))
    k, down = F.col("correction"), diff < 0
    by_balance = k.endswith("_ocr_corrected") | k.endswith("_from_balance")
    swapped = k.startswith("col_swapped")
    none = F.lit(None).cast(s.MONEY)
    debit = F.when(down & swapped, c).when(down & by_balance, e).when(~down & swapped, none).otherwise(d)
    credit = F.when(down & swapped, none).when(~down & (k == "col_swapped"), d).when(~down & (by_balance | swapped), e).otherwise(c)
    return rows.withColumns({"debit": debit.cast(s.MONEY), "credit": credit.cast(s.MONEY)}).drop("_lf_signed", "_lf_diff")


def reconcile_running_balance(rows: DataFrame, tolerance: float = 0.05, range_pages: int | None = None) -> DataFrame:
    """Debit, credit and ``check`` of read rows (file_id, page, top, amount, balance texts, dr_cr) from the balance.

    check: no_amount, first, ok, CHECK (the change differs from the amount) or zero_delta,
    against the last row of the file that had both; '' can't occur.
    """
    plain = lambda c: F.regexp_replace(c, ",", "").try_cast(s.MONEY)
    amount, balance = plain("amount"), plain("balance")
    known = F.col("dr_cr").isNotNull() & (F.col("dr_cr") != "")
    w = rows.withColumns({"_lf_amount": amount, "_lf_balance": balance})
    signed = F.when(known, F.when(F.col("dr_cr") == "CR", F.col("_lf_balance")).otherwise(-F.col("_lf_balance")))
    w = w.withColumn("_lf_valid", F.when(F.col("_lf_amount").isNotNull(), signed))
    w = with_previous(w, F.col("_lf_valid"), ("file_id",), ("page", "top"), "_lf_before", filled=True, range_rows=range_pages)
    w = w.withColumn("_lf_prev", F.col("_lf_before.v"))
    delta = F.col("_lf_valid") - F.col("_lf_prev")
    check = (
        F.when(F.col("_lf_valid").isNull(), "no_amount")
        .when(F.col("_lf_prev").isNull(), "first")
        .when(delta == 0, "zero_delta")
        .when(F.abs(F.abs(delta) - F.col("_lf_amount")) <= F.lit(str(tolerance)).cast(s.MONEY), "ok")
        .otherwise("CHECK")
    )
    two = lambda c: F.coalesce(c.cast(s.MONEY).cast("string"), F.lit(""))
    return w.select(
        "file_id",
        "page",
        "top",
        "date",
        "ref_num",
        "particulars",
        two(F.when(delta < 0, -delta)).alias("debit"),
        two(F.when(delta > 0, delta)).alias("credit"),
        two(F.col("_lf_balance")).alias("balance"),
        F.coalesce("dr_cr", F.lit("")).alias("dr_cr"),
        two(F.col("_lf_amount")).alias("ocr_amount"),
        check.alias("check"),
        "confidence",
    )


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    """By file: rows, how many are ok, how many need a check."""
    return reconciled.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("check") == "ok").alias("ok"), F.count_if(F.col("check") == "CHECK").alias("to_check"))
