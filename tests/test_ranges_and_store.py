"""Windows in ranges against whole windows, and stored ledgers against full rewrites."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerflow.functions.ranges import with_previous
from ledgerflow.operators import balance, ledger, review, store, validation


@pytest.mark.parametrize("range_rows", [1, 7, 1000])
@pytest.mark.parametrize("filled", [False, True])
def test_previous_in_ranges(spark, range_rows, filled):
    """Gaps between numbers, ties, nulls and a statement without a number."""
    rnd = random.Random(range_rows)
    rows = [(k, rnd.choice([1, 1, 1, 2, None]), rnd.choice([None, *range(60), 90, 91, 300]), rnd.choice([None, None, k])) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, st long, no int, v long").repartition(3)
    w = Window.partitionBy("st").orderBy("no", "id")
    want = F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if filled else F.lag("v").over(w)
    got = with_previous(df, F.col("v"), ("st",), ("no", "id"), "p", filled=filled, range_rows=range_rows)
    assert got.columns == ["id", "st", "no", "v", "p"]
    assert sorted(map(str, got.select("id", "p.v").collect())) == sorted(map(str, df.select("id", want.alias("v")).collect()))
    if not filled:
        first = got.filter("p is null").count()
        assert first == df.select("st").distinct().count()


def test_no_window_holds_a_statement(spark):
    t = spark.range(1000).selectExpr("id", "1L AS statement_id", "cast(id AS int) AS source_row", "cast(0 AS decimal(18,2)) AS debit", "cast(1 AS decimal(18,2)) AS credit", "cast(id + if(id = 500, 7, 0) AS decimal(18,2)) AS balance")
    got = balance.check_balance(t, range_rows=100)
    assert sorted(r.id for r in got.filter("not balance_ok").collect()) == [500, 501]
    assert "statement_id#" in got._jdf.queryExecution().executedPlan().toString() and "_lf_part" in got._jdf.queryExecution().executedPlan().toString()


ROWS = "id long, statement_id long, narration_raw string, debit decimal(18,2), extra string"


def test_store_equals_a_full_rewrite(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(st * 10 + k, st, f"row {k}", D(k), "x") for st in range(30) for k in range(4)]
    df = spark.createDataFrame(rows, ROWS)
    store.write_store(df, path, 4)
    again = spark.createDataFrame([(50, 5, "again", D(7), "y"), (999, 77, "not asked for", None, "y")], ROWS)
    for _ in range(2):  # a change that is run again changes nothing
        store.replace_statements(spark, path, spark.createDataFrame([(5,), (6,), (5,)], "statement_id long"), again, 4)
    fix = spark.createDataFrame([(71, "narration", "new", 1, dt.datetime(2024, 1, 1)), (71, "debit", "", 1, dt.datetime(2024, 1, 2)), (5000, "narration", "nobody", 1, dt.datetime(2024, 1, 1))], "transaction_id long, field string, value string, user_id long, ts timestamp")
    store.correct_store(spark, path, fix, 4)
    store.drop_cancelled(spark, path, spark.createDataFrame([(9, "cancelled"), (10, "completed")], "id long, extraction_status string"), 4)
    want = review.apply_corrections(df.filter("statement_id not in (5, 6, 9)").union(again.filter("statement_id = 5")), fix).select(df.columns)
    assert sorted(map(str, store.read_store(spark, path).select(df.columns).collect())) == sorted(map(str, want.collect()))
    # A bucket that loses all its statements is empty afterwards.
    store.drop_cancelled(spark, path, spark.range(30).selectExpr("id", "'cancelled' AS extraction_status"), 4)
    assert store.read_store(spark, path).count() == 0
    store.replace_statements(spark, path, df.filter("false"), df, 4)
    assert store.read_store(spark, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 10, 95])
def test_pages_of_an_index(spark, n):
    rnd = random.Random(n)
    rows = [(k, rnd.choice([None, *range(5)])) for k in range(n)]
    df = spark.createDataFrame(rows, "id long, x int")
    order = [F.desc_nulls_last("x"), F.asc("id")]
    index = ledger.page_index(df, order)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for number in (-3, 1, 2, 10, 10**12):
        last = max(1, -(-n // 10))
        lo = (min(max(number, 1), last) - 1) * 10
        assert list(map(tuple, ledger.page_of(index, order, 10, number).collect())) == want[lo : lo + 10]


def test_the_latest_approval_counts(spark):
    statements = spark.createDataFrame([(1, "UNRELIABLE", None), (2, "UNRELIABLE", 8), (3, "CLEAN", 8)], "statement_id long, rating string, validation_reviewed_by long")
    day = lambda n: dt.datetime(2024, 1, n)
    approvals = spark.createDataFrame([(1, 7, day(2)), (1, 9, day(1)), (3, 5, day(1)), (4, 5, day(1))], "statement_id long, user_id long, ts timestamp")
    got = sorted(map(tuple, validation.approve_validation(statements, approvals).select("statement_id", "rating", "validation_reviewed_by").collect()))
    assert got == [(1, "QUALIFIED", 7), (2, "UNRELIABLE", 8), (3, "CLEAN", 5)]
