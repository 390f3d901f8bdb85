"""Joins of tables that grow with the input: none of their sides is broadcast, and few or many rows meet alike."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal
from difflib import SequenceMatcher

import pytest

from ledgerflow.operators import counterparties, duplicates, validation

from .test_ledger import loop_duplicates, make

THRESHOLD = 0.82


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def names():
    rnd = random.Random(5)
    words = ["ALPHA", "ALPHB", "BETA", "TRADERS", "TRADER", "HOMES", "SONS"]
    drawn = {(st, " ".join(rnd.choices(words, k=rnd.randint(1, 3)))) for st, n in ((1, 60), (2, 6), (3, 1)) for _ in range(n)}
    return [(st, name, k) for k, (st, name) in enumerate(sorted(drawn))]


@pytest.fixture(scope="module")
def heads(spark, names):
    return spark.createDataFrame(names, "statement_id long, norm string, first_id long")


def alike(names):
    def score(a, b):
        s, t = set(a.split()), set(b.split())
        return max(SequenceMatcher(None, a, b).ratio(), len(s & t) / max(len(s), len(t)))

    pairs = ((st, i, j, score(b, a)) for st, a, i in names for su, b, j in names if st == su and i < j)
    return Counter(p for p in pairs if p[3] >= THRESHOLD)


@pytest.mark.parametrize("few", [0, 10, 1000])
def test_names_of_large_and_small_statements_meet(heads, names, few):
    got = counterparties.similar_names(heads, THRESHOLD, few=few)
    assert Counter(map(tuple, got.collect())) == alike(names) and alike(names)


def test_names_are_not_broadcast(heads, spark):
    found = counterparties.similar_names(heads, THRESHOLD)
    assert "Broadcast" not in plan(found)
    merged = counterparties.merge_counterparties(heads.withColumnRenamed("norm", "beneficiary_name"), THRESHOLD)
    assert "Broadcast" not in plan(merged)
    assert "Broadcast" not in plan(counterparties.assign_counterparties(heads.withColumnRenamed("norm", "beneficiary_name"), merged))


def ledger_rows():
    """A dense statement and two sparse ones; narrations differ in a letter or two."""
    rnd = random.Random(3)
    texts = ["ALPHA TRADERS INVOICE 1", "ALPHA TRADERS INVOICE 2", "ALPHA TRADER INVOICE 2X", "BETA HOMES", "REVERSAL BETA HOMES"]
    rows = []
    for st, n, days in ((1, 70, 9), (2, 20, 60), (3, 1, 1)):
        for k in range(n):
            amount = Decimal(rnd.choice([5, 7]))
            debit, credit = (amount, None) if rnd.random() < 0.7 else (None, amount)
            rows.append((st * 1000 + k, st, dt.date(2024, 1, 1) + dt.timedelta(rnd.randrange(days)), rnd.choice(texts), debit, credit, Decimal(100), rnd.choice(["", "R"]), k + 1))
    return rows


@pytest.mark.parametrize("few", [0, 8, 1000])
def test_near_duplicates_of_dense_and_sparse_statements(spark, few):
    rows = ledger_rows()
    want = sum((Counter({p: n for p, n in loop_duplicates([r for r in rows if r[1] == st]).items() if p[0] == "NEAR_DUPLICATE"}) for st in (1, 2, 3)), Counter())
    pairs = duplicates.near_duplicate_pairs(duplicates.prepared(make(spark, rows)), few=few)
    assert Counter(("NEAR_DUPLICATE", r.i_id, r.j_id) for r in pairs.select("i_id", "j_id").collect()) == want and want
    assert "Broadcast" not in plan(pairs)


def test_only_duplicates_asked_for_are_looked_for(spark, monkeypatch):
    rows = make(spark, ledger_rows())
    want = Counter(map(tuple, validation.check_duplicates(rows).filter("code = 'REVERSAL_PAIR'").collect()))
    monkeypatch.setattr(duplicates, "near_duplicate_pairs", None)
    assert Counter(map(tuple, validation.check_duplicates(rows, ("REVERSAL_PAIR",)).collect())) == want and want
