"""Names merged into counterparties, and the counterparty ledger.

Merging depends on the order of names: each joins the most similar one before it that leads. Which names
can be similar at all comes from prefix filters, and who leads is decided in rounds of joins, so no task
holds a statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions.similar import distinct_spread, first_elements, name_scores, share_first
from ..functions.staging import growing, staged


def distinct_names(named: DataFrame) -> DataFrame:
    """(statement_id, beneficiary_name, first_id, beneficiary_type, layer, confidence) of distinct names; all from their first transaction, the confidence the highest."""
    first = lambda c: F.min_by(c, "id").alias(c)
    return (
        named.filter("beneficiary_name is not null")
        .groupBy("statement_id", "beneficiary_name")
        .agg(F.min("id").alias("first_id"), first("beneficiary_type"), first("layer"), F.max("confidence").alias("confidence"))
    )


def similar_names(heads: DataFrame, threshold: float, few: int = 64) -> DataFrame:
    """(statement_id, i, j, score): pairs of a statement's names (norm, first_id) with a score of ``threshold`` or more, i before j.

    Names of a statement with at most ``few`` of them are all paired, those of the others meet under each rare element.
    """
    keys = first_elements(heads.select(F.col("norm").alias("text")), threshold, with_tokens=True).withColumnRenamed("text", "norm")
    keyed = staged(growing(heads.select("statement_id", "norm", "first_id")).join(keys, "norm"))
    many = keyed.groupBy("statement_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > few).select("statement_id")
    side = lambda d, p, *by: growing(d.select(*by, F.col("norm").alias(f"{p}_norm"), F.col("first_id").alias(p), F.col("keys").alias(f"{p}_keys")))

    def met(d: DataFrame, *by: str) -> DataFrame:
        return side(d, "i", *by).join(side(d, "j", *by), list(by)).filter(F.col("i") < F.col("j"))

    own, shared = F.col("i_keys"), F.col("j_keys")
    close = met(keyed.join(many, "statement_id", "left_anti"), "statement_id").filter(F.arrays_overlap(own, shared))
    far = met(keyed.join(many, "statement_id", "left_semi").withColumn("key", F.explode("keys")), "statement_id", "key").filter(share_first(own, shared, F.col("key")))
    pair = ("statement_id", "i", "j", F.col("j_norm").alias("a"), F.col("i_norm").alias("b"))
    pairs = staged(close.select(*pair).unionByName(far.select(*pair)))
    scored = name_scores(staged(distinct_spread(pairs.select("a", "b"))), threshold)
    return growing(pairs).join(scored, ["a", "b"]).select("statement_id", "i", "j", "score")


def followers(edges: DataFrame) -> DataFrame:
    """(statement_id, j) of the names that don't lead: those with a leading name among the similar ones before them.

    In rounds: a name before which no undecided similar one is left leads, and those similar to it follow; both leave.
    """
    left, found = edges.select("statement_id", "i", "j"), []
    while True:
        after = left.select("statement_id", F.col("j").alias("i")).distinct()
        heads = growing(left.select("statement_id", "i").distinct()).join(after, ["statement_id", "i"], "left_anti")
        follow = staged(growing(left).join(heads, ["statement_id", "i"], "left_semi").select("statement_id", "j").distinct())
        found.append(follow)
        if follow.isEmpty():
            break
        left = staged(left.join(growing(follow), ["statement_id", "j"], "left_anti").join(growing(follow.withColumnRenamed("j", "i")), ["statement_id", "i"], "left_anti"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def merge_counterparties(names: DataFrame, threshold: float = 0.82) -> DataFrame:
    """(statement_id, beneficiary_name, counterparty): the counterparty of each distinct name.

    Names come in the order of their first transaction. An equal normal form is the same
    counterparty; else the most similar leading name before it (the first of several), if it reaches
    ``threshold``; else the name leads.
    """
    w = staged(names.select("statement_id", "beneficiary_name", "first_id", s.normalize_for_matching(F.col("beneficiary_name")).alias("norm")))
    # Names of equal normal form always share a counterparty: only the first of them is compared.
    heads = staged(w.groupBy("statement_id", "norm").agg(F.min_by("beneficiary_name", "first_id").alias("name"), F.min("first_id").alias("first_id")))
    edges = staged(similar_names(heads, threshold))
    follow = staged(followers(edges))
    led = edges.join(growing(follow), ["statement_id", "j"], "left_semi").join(growing(follow.withColumnRenamed("j", "i")), ["statement_id", "i"], "left_anti")
    best = led.groupBy("statement_id", F.col("j").alias("first_id")).agg(F.max(F.struct("score", -F.col("i")))["col2"].alias("lead"))
    leads = heads.select("statement_id", (-F.col("first_id")).alias("lead"), F.col("name").alias("leader"))
    found = growing(heads).join(best.join(growing(leads), ["statement_id", "lead"]), ["statement_id", "first_id"], "left").select("statement_id", "norm", F.coalesce("leader", "name").alias("counterparty"))
    return growing(w).join(found, ["statement_id", "norm"]).select("statement_id", "beneficiary_name", "counterparty")


def merge_by_tokens(names: DataFrame, threshold: float = 0.82) -> DataFrame:
    """As ``merge_counterparties`` without order: each name goes to its most similar earlier name by shared tokens.

    Only column functions: candidates share a token. (statement_id, beneficiary_name, counterparty, score).
    """
    w = names.select("statement_id", "beneficiary_name", "first_id", s.normalize_for_matching(F.col("beneficiary_name")).alias("norm"))
    tokens = w.withColumn("token", F.explode(F.array_distinct(F.array_remove(F.split("norm", " "), ""))))
    i = tokens.select("statement_id", "token", F.col("beneficiary_name").alias("counterparty"), F.col("first_id").alias("i_id"), F.size(F.array_distinct(F.array_remove(F.split("norm", " "), ""))).alias("i_n"))
    j = tokens.withColumn("j_n", F.size(F.array_distinct(F.array_remove(F.split("norm", " "), ""))))
    shared = j.join(i, ["statement_id", "token"]).filter("i_id < first_id").groupBy("statement_id", "beneficiary_name", "counterparty", "i_id", "i_n", "j_n").agg(F.count(F.lit(1)).alias("n"))
    scored = shared.withColumn("score", F.col("n") / F.greatest("i_n", "j_n")).filter(F.col("score") >= threshold)
    best = scored.groupBy("statement_id", "beneficiary_name").agg(F.max(F.struct("score", -F.col("i_id"), "counterparty")).alias("b"))
    return w.join(best, ["statement_id", "beneficiary_name"], "left").select("statement_id", "beneficiary_name", F.coalesce("b.counterparty", "beneficiary_name").alias("counterparty"), F.coalesce("b.score", F.lit(1.0)).alias("score"))


def assign_counterparties(named: DataFrame, merged: DataFrame) -> DataFrame:
    """Adds ``counterparty`` to transactions with a beneficiary name."""
    return named.join(growing(merged), ["statement_id", "beneficiary_name"], "left")


def counterparty_financials(assigned: DataFrame) -> DataFrame:
    """By statement and counterparty: sums, net position (credit less debit), count, first and last date."""
    zero = F.lit(0).cast(s.MONEY)
    total = lambda c: F.coalesce(F.sum(c), zero).cast(s.MONEY)
    out = (
        assigned.filter("counterparty is not null")
        .groupBy("statement_id", "counterparty")
        .agg(total("debit").alias("total_debit"), total("credit").alias("total_credit"), F.count(F.lit(1)).alias("transaction_count"), F.min("txn_date").alias("first_transaction_date"), F.max("txn_date").alias("last_transaction_date"))
    )
    return out.withColumn("net_position", (F.col("total_credit") - F.col("total_debit")).cast(s.MONEY))


def build_ledger(assigned: DataFrame) -> DataFrame:
    """The counterparty ledger: financials with type and method of the first transaction and the highest confidence."""
    method = F.when(F.col("layer") == "LAYER_2", "LLM").when(F.col("layer") == "LAYER_3", "ANALYST").otherwise("RULE_BASED")
    about = (
        assigned.filter("counterparty is not null")
        .withColumn("method", method)
        .groupBy("statement_id", "counterparty")
        .agg(F.min_by("beneficiary_type", "id").alias("beneficiary_type"), F.min_by("method", "id").alias("identification_method"), F.max("confidence").alias("highest_confidence"))
    )
    return about.join(growing(counterparty_financials(assigned)), ["statement_id", "counterparty"])


def identification_audit(assigned: DataFrame) -> DataFrame:
    """One row an identified transaction: layer, confidence, basis and the layers' results as JSON."""
    result = F.to_json(F.struct("beneficiary_name", "beneficiary_type", "confidence", "basis"))
    return assigned.filter("counterparty is not null").select(
        F.col("id").alias("transaction_id"),
        "statement_id",
        "counterparty",
        F.col("layer").alias("layer_identified"),
        "confidence",
        F.col("basis").alias("extraction_basis"),
        F.when(F.col("layer") == "LAYER_1", result).alias("layer1_result"),
        F.when(F.col("layer") == "LAYER_2", result).alias("layer2_result"),
        F.lit(False).alias("analyst_confirmed"),
    )


def identification_stats(txns: DataFrame, ledger: DataFrame) -> DataFrame:
    """By statement (with ``counterparty`` set where identified): counterparties, identified, total, rate, pending."""
    t = txns.groupBy("statement_id").agg(F.count_if(F.col("counterparty").isNotNull()).alias("identified"), F.count(F.lit(1)).alias("total"))
    out = t.join(ledger.groupBy("statement_id").agg(F.count(F.lit(1)).alias("counterparties")), "statement_id", "left").fillna(0, ["counterparties"])
    return out.withColumn("rate", s.percent(F.col("identified"), F.col("total"))).withColumn("pending", F.col("total") - F.col("identified"))


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """By statement: counterparties, identified transactions, and the sum of their debits."""
    return ledger.groupBy("statement_id").agg(F.count(F.lit(1)).alias("counterparties"), F.sum("transaction_count").alias("identified"), F.sum("total_debit").cast(s.MONEY).alias("total_debit"))


def top_counterparties(ledger: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` counterparties of each statement with the highest net position; ties by name."""
    w = Window.partitionBy("statement_id").orderBy(F.desc("net_position"), "counterparty")
    return ledger.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def filter_ledger(ledger: DataFrame, search: str = "", kind: str = "", method: str = "", sort: Column | str | None = None) -> DataFrame:
    """Counterparties whose name holds ``search`` (any case), of a type and method; by default the largest debits first."""
    out = ledger
    if search:
        out = out.filter(F.lower("counterparty").contains(search.lower()))
    if kind:
        out = out.filter(F.col("beneficiary_type") == kind)
    if method:
        out = out.filter(F.col("identification_method") == method)
    return out.orderBy(sort if sort is not None else F.desc("total_debit"), "statement_id", "counterparty")


def counterparty_history(assigned: DataFrame, audit: DataFrame, statement_id: int | None, counterparty: str) -> DataFrame:
    """A counterparty's transactions (of all statements given if ``statement_id`` is None), newest first, each with its audit row."""
    t = assigned.filter(F.col("counterparty") == counterparty)
    if statement_id is not None:
        t = t.filter(F.col("statement_id") == statement_id)
    a = audit.select(F.col("transaction_id").alias("id"), "layer_identified", "extraction_basis", "analyst_confirmed")
    return t.join(a, "id", "left").orderBy(F.desc("txn_date"), F.desc("id"))
