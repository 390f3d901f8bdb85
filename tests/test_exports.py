"""Exports are written whole, in order, and held back where they have to be."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerflow.operators import balance, beneficiary, counterparties, export, ocr, validation
from ledgerflow.sources import files

COLS = "id long, statement_id long, txn_date date, narration_raw string, debit decimal(18,2), credit decimal(18,2), balance decimal(18,2), reference string, source_row int"


def ledger(spark):
    day = dt.date(2024, 1, 1)
    rows = [(k, 1, day, f"NEFT-ALPHA {'STEEL' if k % 2 else 'CRANES'} LTD" if k > 1 else "OMEGA CARRIERS", D(k), D(0), D(100 - k), f"R{k}", k) for k in range(1, 6)]
    rows += [(11, 2, day, "BETA CO", D(1), None, D(5), "", 1), (12, 2, day, "BETA CO TWO", D(-1), None, D(6), "", 2)]
    return spark.createDataFrame(rows, COLS).withColumns({"txn_mode": F.lit("NEFT"), "counterparty_name": F.lit("")})


def test_cleaned_ledger(spark, tmp_path):
    t = ledger(spark)
    issues = validation.run_all_checks(t)
    export.write_cleaned(t, issues, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.statement_id for r in got.collect()} == {1}  # statement 2 has a negative amount to resolve
    assert got.count() == 5 and got.filter("credit is not null").count() == 0
    assert {r.status for r in got.filter("id > 1").collect()} == {"Flagged"} and got.filter("id = 1").first().issue_codes == ""


def test_counterparty_ledger(spark, tmp_path):
    n = beneficiary.extract_beneficiary(ledger(spark)).withColumn("counterparty", F.col("beneficiary_name"))
    export.write_counterparty_ledger(counterparties.build_ledger(n), str(tmp_path / "out"))
    got = spark.read.csv(str(tmp_path / "out"), header=True)
    assert len(got.columns) == 13 and got.count() == 5
    assert {r.type for r in got.filter("statement_id = '1'").collect()} == {"Company", "Individual"}


def test_reconciled_and_pages(spark, tmp_path):
    rows = [("f", p, 10, "", "", "", "10.00", f"{100 + 10 * p}.00", "CR", 90.0) for p in (1, 2)]
    df = spark.createDataFrame(rows, "file_id string, page int, top int, date string, ref_num string, particulars string, amount string, balance string, dr_cr string, confidence double")
    lines = spark.createDataFrame([("f", 1, 2, "b"), ("f", 1, 1, "a"), ("f", 2, 1, "c")], "file_id string, page_no int, line_no int, text string")
    export.write_reconciled(balance.reconcile_running_balance(df), ocr.page_texts(lines), str(tmp_path / "out"))
    assert [r.check for r in spark.read.csv(str(tmp_path / "out/transactions"), header=True).orderBy("page").collect()] == ["first", "ok"]
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out/raw_text")).orderBy("page_no").collect()] == ["a\nb", "c"]


def test_stored_rows_have_no_null_texts(spark, tmp_path):
    (tmp_path / "a.rpt").write_text("01/04/2023 | X | 5 | - | 7\n")
    rows = files.parse_rpt(files.read_text_files(spark, str(tmp_path / "a.rpt")))
    for _ in range(2):
        files.store_transactions(rows, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 2 and got[0].reference == "" and got[0].quality_flag == "LOW_NARRATION"
    lines = files.read_rpt_lines(spark, str(tmp_path / "a.rpt")).collect()
    assert [(r.line_no, r.text) for r in lines][0] == (1, "01/04/2023 | X | 5 | - | 7")
