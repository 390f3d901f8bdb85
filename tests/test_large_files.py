"""Files with headers of their own, and files read in byte ranges, give what each file read whole gives."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions.staging import once
from ledgerflow.sources import files


def test_each_csv_file_has_its_own_header(spark, tmp_path):
    texts = {
        "a.csv": 'Date,Narration,Withdrawal Amt.,Deposit Amt.,Closing Balance,Chq No\n01/04/2023,"NEFT, ""A"" B",50000.00,,"2,50,000.00",R1\nbad,RTGS,0.00,3.00,1.00,\n',
        "b.csv": "Running_Balance,Posting Date,Txn Date,DR,CR,Remarks\n10.00,01/01/2020,02/01/2020,5,,one\n11.00,,,,1,\n",
        "c.csv": "Description,Extra\nonly text,x,beyond\n\n",
        "d.csv": "DATE,DETAILS\n",
        "e.csv": "",
        "f.csv": 'x,y\n1,"line\nfeed"\n',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {(r.file_id.rsplit("/", 1)[1], r.source_row): (r.txn_date, r.narration_raw, r.debit, r.credit, r.balance, r.reference) for r in files.read_csv_statement(spark, str(tmp_path)).collect()}
    day = dt.date
    assert got == {
        ("a.csv", 2): (day(2023, 4, 1), 'NEFT, "A" B', D("50000.00"), None, D("250000.00"), "R1"),
        ("a.csv", 3): (None, "RTGS", None, D("3.00"), D("1.00"), ""),
        ("b.csv", 2): (day(2020, 1, 2), "one", D("5.00"), None, D("10.00"), ""),
        ("b.csv", 3): (None, "", None, D("1.00"), D("11.00"), ""),
        ("c.csv", 2): (None, "only text", None, None, None, ""),
        ("f.csv", 2): (None, "", None, None, None, ""),
    }


def report(rnd, n):
    def line(k):
        if k % 9 == 0:
            return rnd.choice(["", "GL. Date   Value Date", "Page Total 12", "é" * 5])
        day = f"{rnd.randint(1, 28):02d}-03-2019"
        return f" {day}  {day}{f'REF{k}':<16}{f'NEFT-ALPHA {k}':<58}{rnd.choice(['', '1,000.50']):>15}{rnd.choice(['', '5.00']):>21}{f'{k}.25':>20}Cr USER000001"

    return [line(k) for k in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_files_in_ranges_equal_whole_files(spark, tmp_path, end):
    rnd = random.Random(3)
    texts = {
        "fixed.rpt": end.join(report(rnd, 700)) + end,
        "pipe.rpt": end.join(["Date | Text | D | C | B"] + [f"{k % 28 + 1:02d}/04/2023 | PAY {k} | 5.00 | - | {k}.00Cr | R" for k in range(400)]),
        "plain.rpt": end.join(f"{k % 28 + 1:02d}/04/2023   PAY {k}   5.00" if k % 3 else f"text {k}" for k in range(300)),
        "tab.rpt": "01/04/2023\tUPI PAY\t5\t\t10",
        "none.rpt": "",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    small.conf.set("spark.sql.files.openCostInBytes", "1k")
    lines = files.read_lines(small, str(tmp_path))
    parts = {r.file_id.rsplit("/", 1)[1]: r.n for r in lines.groupBy("file_id").agg(F.countDistinct("part").alias("n")).collect()}
    assert parts["fixed.rpt"] >= 10 and parts["pipe.rpt"] > 1
    numbered = [(r.file_id.rsplit("/", 1)[1], r._lf_p, r.text) for r in lines.collect()]
    assert sorted(numbered) == sorted((name, k, x) for name, text in texts.items() for k, x in enumerate(text.splitlines()))
    columns = ("file_id", "source_row", "txn_date", "narration_raw", "debit", "credit", "balance", "balance_type", "reference", "txn_mode", "bank_json_data")
    rows = lambda d: sorted(map(str, d.select(*columns).collect()))
    got, want = files.parse_report_files(small, str(tmp_path)), files.parse_rpt(files.read_text_files(spark, str(tmp_path)))
    assert rows(got) == rows(want) and want.count() > 1100


def test_value_used_twice_is_computed_once(spark):
    df = once(spark.range(3), "x", F.sha1(F.col("id").cast("string"))).filter("x <> ''").select(F.upper("x").alias("a"), F.length("x").alias("b"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("sha1") == 1 and df.count() == 3


def test_lines_are_numbered_without_moving_them(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {k}\n" for k in range(50)))
    small = spark.newSession()
    small.conf.set("spark.sql.files.maxPartitionBytes", "64")
    small.conf.set("spark.sql.files.openCostInBytes", "1")
    small.conf.set("spark.sql.files.maxPartitionNum", 2)
    lines = files.read_lines(small, str(tmp_path))
    assert "Window" not in lines._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["_lf_p"], r["text"]) for r in lines.collect())
    assert got == [(k, f"line {k}") for k in range(50)] and lines.select("part").distinct().count() > 4
