"""Rows that no rule can meet take no part in the search for duplicates, and none that one can meet is left out."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import scalars
from ledgerflow.operators import duplicates, validation

from .test_ledger import loop_duplicates, make

FIRST = dt.date(1970, 1, 1)
FINDERS = {"REVERSAL_PAIR": "reversal_pairs", "EXACT_DUPLICATE": "exact_duplicates", "PROBABLE_DUPLICATE": "probable_duplicate_pairs", "NEAR_DUPLICATE": "near_duplicate_pairs"}


def row(k, day, text, debit=None, credit=None, reference="", statement=1):
    return (k, statement, None if day is None else FIRST + dt.timedelta(day), text, debit, credit, D(100), reference, k + 1)


def border_rows(seed):
    """Few rows on either side of the ends of blocks, before 1970 too, and some without a date."""
    rnd = random.Random(seed)
    size = duplicates.BLOCK_DAYS
    rows = []
    for k in range(120):
        day = rnd.choice([-size, 0, size, 70 * size, 70 * size + 100]) + rnd.randint(-8, 8)
        debit, credit = rnd.choice([(D(5), None), (None, D(5)), (D(5), D(5)), (None, None)])
        text = rnd.choice(["Alpha Traders invoice 1", "ALPHA TRADERS INVOICE 2", "REVERSAL ALPHA TRADERS", "NEFT/ALPHA  TRADERS", "ALPHA TRADERS", ""])
        rows.append(row(k, rnd.choice([day] * 9 + [None]), text, debit, credit, rnd.choice(["", "R1"]), rnd.choice([1, 2, 3])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_across_the_ends_of_blocks(spark, seed):
    rows = border_rows(seed)
    want = sum((loop_duplicates([r for r in rows if r[1] == st]) for st in (1, 2, 3)), Counter())
    p = duplicates.compared(duplicates.prepared(make(spark, rows).repartition(3)))
    got = Counter((kind, r.i_id, r.j_id) for kind, f in FINDERS.items() for r in getattr(duplicates, f)(p).select("i_id", "j_id").collect())
    assert got == want and {kind for kind, *_ in want} >= set(FINDERS) - {"PROBABLE_DUPLICATE"}


def test_lonely_rows_are_not_compared(spark):
    far = [row(k, 20 + 9 * k, "ALPHA TRADERS", D(5), reference=str(k)) for k in range(20)]  # one block, 9 days apart
    near = [row(100, 2 + 300, "BETA HOMES", D(5)), row(101, 5 + 300, "BETA HOMES", D(6)), row(102, None, "GAMMA", D(5)), row(103, None, "GAMMA", D(5))]
    p = duplicates.prepared(make(spark, far + near))
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(duplicates.near_in_time(p, 3)) == {100, 101}
    assert ids(duplicates.with_peers(p)) == {102, 103}
    assert ids(duplicates.compared(p)) == {100, 101, 102, 103}


def test_prepared_rows_are_exchanged_and_sorted_once(spark):
    p = duplicates.prepared(make(spark, border_rows(3)))
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1 and plan.count("Window ") == 3


def test_clean_narrations_without_a_prefix(spark):
    texts = ["a  b\tc ", "xneft/y", "bY oRdEr of  Z", "BENEFT/ING", "CRNEFT/EDIT bY X", None, "", " TOWARDS"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", scalars.clean_narration(F.col("t")).alias("c")).orderBy("k").select("c").collect()]
    assert got == ["a b c", "xy", "Z", "", "X", "", "", ""]


def test_gaps_of_repeated_dates(spark):
    rows = [row(k, d, "ALPHA", D(k)) for k, d in enumerate([0, 0, 1, 30, 30, 30, 31, None, 60])]
    got = {(r.start, r.end) for r in validation.date_gaps(make(spark, rows)).collect()}
    assert got == {(FIRST + dt.timedelta(a), FIRST + dt.timedelta(b)) for a, b in ((1, 30), (31, 60))}
    assert validation.date_gaps(make(spark, rows)).count() == 2


def test_narration_issues_and_their_messages(spark):
    large = D(validation.LARGE_AMOUNT)
    rows = [row(0, 0, " ", large), row(1, 0, "", D(1)), row(2, 0, " ABC ", large), row(3, 0, "TRANSFER", None, large), row(4, 0, "upi/ cash", D(0), D(1)), row(5, 0, "12 345", large), row(6, 0, "ALPHA TRADERS", large), row(7, 0, None, None)]
    got = {(r.transaction_id, r.code, r.severity, r.message, r.resolution_required) for r in validation.check_narrations(make(spark, rows)).collect()}
    assert got == {
        (0, "BLANK_NARRATION", "CRITICAL", "Blank narration", True),
        (1, "BLANK_NARRATION", "HIGH", "Blank narration", False),
        (2, "SHORT_NARRATION", "MEDIUM", 'Narration too short: "ABC"', False),
        (3, "GENERIC_NARRATION", "CRITICAL", 'Generic narration: "TRANSFER"', False),
        (4, "GENERIC_NARRATION", "HIGH", 'Generic narration: "cash"', False),
        (5, "NUMERIC_ONLY_NARRATION", "MEDIUM", 'Numeric-only narration: "12 345"', False),
        (7, "BLANK_NARRATION", "HIGH", "Blank narration", False),
    }
