"""Queries over issues write only what they read of them; ratios of texts that hold each other are those of the matcher."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerflow.functions import scalars as s
from ledgerflow.functions.similar import ratio_from
from ledgerflow.operators import review
from ledgerflow.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = ("j3_attach_issues", "a6_issue_summary", "v11_reliability_rating", "v12_exportable", "p3_filter_issues")


def test_queries_over_issues_write_neither_ids_nor_messages(spark, monkeypatch):
    class Written(Exception):
        pass

    def staged(df):
        if "severity" in df.columns or "code" in df.columns or "resolved" in df.columns:
            raise Written(*df.columns)
        return df

    monkeypatch.setattr(catalog, "staged", staged)
    monkeypatch.setattr("ledgerflow.operators.validation.staged", lambda df: df)
    monkeypatch.setattr("ledgerflow.operators.duplicates.near_duplicate_pairs", lambda rows: catalog.duplicates.probable_duplicate_pairs(rows))
    for name in QUERIES:
        with pytest.raises(Written) as found:
            catalog.queries()[name](spark, SF)
        assert not {"issue_id", "message", "suggested_action"} & set(found.value.args)
        assert len(found.value.args) <= 6


def test_ratio_of_texts_that_hold_each_other(spark):
    long = "ab cd ef gh " * 20
    texts = ["a", "PAYMENT TO X", "PAYMENT TO XX", "AYMENT TO X", "aba", "ababa", long, long + "x", long[1:], long[:199], long[:198], "é1", "é1é"]
    rows = [(a, b) for a in texts for b in texts]
    for threshold in (0.5, 0.9):
        got = spark.createDataFrame(rows, "a string, b string").select("a", "b", ratio_from(threshold)("a", "b").alias("r")).collect()
        for r in got:
            true = SequenceMatcher(None, r.a, r.b).ratio()
            assert r.r == (true if true >= threshold else 0.0) or (r.r == 0.0 and true < threshold)


def test_prefixes_in_any_case_are_cleaned(spark):
    rows = [("by order of X",), ("TRANSFER TO  Y",), ("ſneft/z",), ("towardſ q",), ("beıng Q",), ("TRANUPI/SFER",), ("NEFT-RETURN",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string").coalesce(1).select(s.clean_narration(F.col("n"))).collect()]
    assert got == ["X", "Y", "ſz", "towardſ q", "beıng Q", "TRANSFER", "NEFT-RETURN", "", ""]


def test_codes_are_attached_with_or_without_messages(spark):
    issues = spark.createDataFrame([(1, "B", "i2", "two"), (1, "A", "i3", "three"), (1, "B", "i1", "one"), (None, "C", "i4", "")], "transaction_id long, code string, issue_id string, message string")
    txns = spark.createDataFrame([(1,), (2,)], "id long")
    full = {r.id: r for r in review.attach_issues(txns, issues).collect()}
    assert (full[1].issue_codes, full[1].issue_messages, full[1].status) == ("A, B, B", "three; one; two", "Flagged")
    assert (full[2].issue_codes, full[2].issue_messages, full[2].status) == ("", "", "Clean")
    plain = review.attach_issues(txns, issues.select("transaction_id", "code"), messages=False)
    assert {r.id: (r.issue_codes, r.status) for r in plain.collect()} == {1: ("A, B, B", "Flagged"), 2: ("", "Clean")}
