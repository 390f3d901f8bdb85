"""Queries over all issues, near duplicates among them, against loops over a small ledger."""

import datetime as dt
from collections import Counter
from decimal import Decimal

import pytest

from ledgerflow.plans import catalog

from .test_ledger import loop_duplicates, make

D = Decimal
NEAR = [(1, "ALPHA TRADERS INVOICE 100200"), (2, "ALPHA TRADERS INVOICE 100201"), (3, "GAMMA CRANES OF THE NORTH")]
SETS = {1: NEAR, 2: [(1, "ALPHA TRADERS INVOICE"), (2, "BETA WORKS AND SONS")], 3: [*NEAR, (3, "GAMMA CRANES OF THE NORTH")]}
#: Balances, dates and narrations are in order, so all issues are duplicates.
ROWS = []
for st, rows in SETS.items():
    balance = D(1000)
    for k, (day, text) in enumerate(rows):
        balance -= D(10) if k else 0
        ROWS.append((st * 100 + k, st, dt.date(2024, 1, day), text, D(10), None, balance, "R" if k > 1 else "", k + 1))
SEVERITY = {"NEAR_DUPLICATE": "MEDIUM", "EXACT_DUPLICATE": "HIGH"}
ISSUES = [(st, i, code) for st in SETS for code, i, _ in loop_duplicates([r for r in ROWS if r[1] == st]).elements()]


@pytest.fixture
def run(spark, monkeypatch):
    monkeypatch.setattr(catalog.adapters, "ledger", lambda *_: make(spark, ROWS).selectExpr("*", "'' AS txn_mode", "'' AS counterparty_name"))
    return lambda name, *cols: Counter(tuple(r) for r in catalog.QUERIES[name](spark, "").select(*cols).collect())


def test_fixture_has_near_duplicates():
    assert Counter(ISSUES) == Counter([(1, 100, "NEAR_DUPLICATE"), (3, 300, "NEAR_DUPLICATE"), (3, 302, "EXACT_DUPLICATE")])


def test_counts_and_ratings(run):
    of = lambda st, sev: sum(SEVERITY[c] == sev for s, _, c in ISSUES if s == st)
    counts = {st: (of(st, "HIGH") + of(st, "MEDIUM"), of(st, "HIGH"), of(st, "MEDIUM")) for st in SETS}
    rating = {st: "QUALIFIED" if h else "ACCEPTABLE" if m else "CLEAN" for st, (_, h, m) in counts.items()}
    found = {st: c for st, c in counts.items() if c[0]}
    assert run("a5_issue_counts", "statement_id", "unresolved", "high", "medium") == Counter((st, *c) for st, c in found.items())
    by_code = {st: ",".join(f"{c}={n}" for c, n in sorted(Counter(c for s, _, c in ISSUES if s == st).items())) for st in found}
    assert run("a6_issue_summary", "statement_id", "total", "by_code") == Counter((st, found[st][0], by_code[st]) for st in found)
    assert run("v11_reliability_rating", "statement_id", "unresolved", "rating") == Counter((st, counts[st][0], rating[st]) for st in SETS)
    assert run("v13_approve_validation", "statement_id", "rating") == Counter(rating.items())
    assert run("v12_exportable", "statement_id", "exportable") == Counter((st, True) for st in SETS)
    assert run("v14_validation_state", "statement_id", "fully_validated") == Counter((st, True) for st in SETS)
    even = {st: sum(i % 2 == 0 for s, i, _ in ISSUES if s == st) for st in found}
    assert run("j10_resolve_issues", "statement_id", "unresolved", "resolved") == Counter((st, found[st][0] - even[st], even[st]) for st in found)
    assert not run("p3_filter_issues", "transaction_id")


def test_rows_are_flagged(run):
    flagged = {i for _, i, _ in ISSUES}
    codes = {i: ", ".join(sorted(c for _, k, c in ISSUES if k == i)) for i in flagged}
    assert run("j3_attach_issues", "id", "status", "issue_codes") == Counter((r[0], "Flagged" if r[0] in flagged else "Clean", codes.get(r[0], "")) for r in ROWS)
    assert run("j13_issues_by_transaction", "statement_id", "transaction_id", "code") == Counter(ISSUES)
    assert run("s8_cleaned_ledger", "id", "flagged") == Counter((r[0], r[0] in flagged) for r in ROWS)


def test_ratio_in_sql():
    """The recursive SQL gives the library's sequence ratio of any two texts."""
    import random

    import duckdb

    from ledgerflow.functions.helpers import ratio

    rnd = random.Random(5)
    text = lambda: "".join(rnd.choice("ab c1") for _ in range(rnd.randint(1, 24)))
    pairs = {(text(), text()) for _ in range(200)} | {(x, x[:5] + "z" + x[6:]) for x in (text() for _ in range(100))}
    pairs = [p for p in pairs if p[0] != p[1]]
    con = duckdb.connect()
    con.execute("CREATE TABLE alike (a VARCHAR, b VARCHAR)")
    con.executemany("INSERT INTO alike VALUES (?, ?)", pairs)
    got = {(a, b): r for a, b, r in con.execute("WITH RECURSIVE " + catalog.RATIO_SQL.rstrip().rstrip(",") + " SELECT a, b, similarity FROM ratios").fetchall()}
    assert got == {(a, b): ratio(a, b) for a, b in pairs}
