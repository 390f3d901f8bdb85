"""Duplicates and reversals of a statement's transactions.

Each pair (i, j), i before j by id, gets the first that holds of: reversal, exact,
probable, near. An exact duplicate of an earlier row (its anchor) isn't compared with rows
after that anchor. This is set logic: anchors come from a window, pairs from
equality joins on null-safe keys (dates in buckets), so no pair is formed that no rule can meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions.similar import distinct_spread, first_elements, may_reach, ratio_from, share_first
from ..functions.staging import growing, staged

# Fixed values.
REVERSAL_WORDS = ("REV", "REVERSAL", "RETURN", "BOUNCE", "DISHONOUR")
GROUP = ("statement_id", "txn_date", "debit", "credit", "reference")
#: Days of a statement in which a row's nearest dates are looked for in one window.
BLOCK_DAYS = 256
REVERSAL_DAYS = 7


def has_reversal_word(narration: Column) -> Column:
    found = F.lit(False)
    for w in REVERSAL_WORDS:
        found = found | F.upper(narration).contains(w)
    return found


def searched(first: str, second: str) -> Column:
    """The narration in which reversal words count: the first row's, or the second's if that is empty."""
    blank = F.coalesce(F.col(first), F.lit("")) == ""
    return F.when(blank, F.coalesce(F.col(second), F.lit(""))).otherwise(F.col(first))


def with_anchors(txns: DataFrame, by: tuple[str, ...] = GROUP) -> DataFrame:
    """Adds ``anchor``: the id of the earlier row of which this one is an exact duplicate, or null.

    A group's first row is the anchor of all others. Where debit equals credit and there is a date a pair may be a reversal instead:
    rows whose narration has a reversal word are nobody's anchor, and a first row without narration isn't
    that of later ones with such a word. One window tells both. ``by``: columns that make the same groups as those of ``GROUP``.
    """
    text = F.coalesce("narration_raw", F.lit(""))
    word = F.col("debit").eqNullSafe(F.col("credit")) & F.col("txn_date").isNotNull() & has_reversal_word(text)
    leads = ~(word & (text != ""))
    first = F.min(F.when(leads, F.struct("id", (text == "").alias("blank")))).over(Window.partitionBy(*by))
    w = txns.withColumn("_lf_first", first)
    return w.withColumn("anchor", F.when((F.col("id") > F.col("_lf_first.id")) & ~(F.col("_lf_first.blank") & word), F.col("_lf_first.id"))).drop("_lf_first")


SIDE = ("id", "statement_id", "source_row", "txn_date", "debit", "credit", "reference", "narration_raw", "anchor", "clean")


def side(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{p}_{c}") for c in SIDE])


def evaluated() -> Column:
    """Whether the pair is compared at all."""
    return F.col("i_anchor").isNull() & (F.col("j_anchor").isNull() | (F.col("j_anchor") >= F.col("i_id")))


def is_exact() -> Column:
    return F.col("j_anchor").eqNullSafe(F.col("i_id"))


def is_reversal() -> Column:
    swapped = F.col("i_debit").eqNullSafe(F.col("j_credit")) & F.col("i_credit").eqNullSafe(F.col("j_debit"))
    near = F.abs(F.datediff("i_txn_date", "j_txn_date")) <= REVERSAL_DAYS
    return F.coalesce(near, F.lit(False)) & swapped & has_reversal_word(searched("i_narration_raw", "j_narration_raw"))


def is_probable() -> Column:
    keys = F.lit(True)
    for c in ("txn_date", "debit", "credit", "clean"):
        keys = keys & F.col(f"i_{c}").eqNullSafe(F.col(f"j_{c}"))
    return keys & ~F.coalesce("i_reference", F.lit("")).eqNullSafe(F.coalesce("j_reference", F.lit("")))


def prepared(txns: DataFrame) -> DataFrame:
    """The columns that the rules compare, and no others: what the caller derived beside them isn't computed, shuffled and written.

    ``_lf_days``: days to the nearest date among the statement's other rows or fewer; ``_lf_peers``: rows of the statement with its date
    and amounts, itself included. Every rule asks for a near date or for peers, so most rows meet none, and only peers compare ``clean``.
    """
    day = F.datediff("txn_date", F.lit("1970-01-01").cast("date"))
    w = txns.withColumn("_lf_block", day - F.pmod(day, F.lit(BLOCK_DAYS)))
    # The three windows need one exchange and one sort: the first has the order of the others.
    keys = ("statement_id", "_lf_block", "txn_date", "debit", "credit")
    dates = Window.partitionBy(*keys[:2]).orderBy(*keys[2:], "reference")
    into = F.pmod(day, F.lit(BLOCK_DAYS))
    near = [F.datediff("txn_date", F.lag("txn_date").over(dates)), F.datediff(F.lead("txn_date").over(dates), "txn_date")]
    w = w.withColumn("_lf_days", F.least(*near, into + 1, F.lit(BLOCK_DAYS) - into))  # the next block may begin with a row
    w = with_anchors(w.withColumn("_lf_peers", F.count(F.lit(1)).over(Window.partitionBy(*keys))), (*keys, "reference"))
    clean = F.when(F.col("_lf_peers") > 1, s.clean_narration(F.col("narration_raw")))
    return w.withColumn("clean", clean).select(*SIDE, "_lf_days", "_lf_peers")


def near_in_time(rows: DataFrame, days: int) -> DataFrame:
    """The dated rows of which the statement may have another at most ``days`` apart."""
    return rows.filter(F.col("_lf_days") <= days)


def with_peers(rows: DataFrame) -> DataFrame:
    return rows.filter("_lf_peers > 1")


def compared(rows: DataFrame) -> DataFrame:
    """The rows that can be in a pair of any kind, where near duplicates are as close as reversals or closer."""
    return rows.filter((F.col("_lf_days") <= REVERSAL_DAYS) | (F.col("_lf_peers") > 1))


def pairs_on(rows: DataFrame, i_keys: list[Column], j_keys: list[Column]) -> DataFrame:
    """Pairs i before j of a statement whose key columns are equal, null equal to null."""
    i, j = side(rows, "i"), side(rows, "j")
    on = F.col("i_statement_id") == F.col("j_statement_id")
    for a, b in zip(i_keys, j_keys, strict=True):
        on = on & a.eqNullSafe(b)
    return i.join(growing(j), on & (F.col("i_id") < F.col("j_id")))


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """Pairs (i, j) of a row and each exact duplicate of it; j's anchor is i."""
    rows = with_peers(rows)
    i, j = side(rows, "i"), side(rows.filter("anchor is not null"), "j")
    return i.join(growing(j), (F.col("j_anchor") == F.col("i_id")) & (F.col("i_statement_id") == F.col("j_statement_id")))


def reversal_pairs(rows: DataFrame) -> DataFrame:
    c = F.col
    # A condition on i alone, which the planner moves before the join: few rows have a reversal word or no narration.
    text = F.coalesce("i_narration_raw", F.lit(""))
    opens = (text == "") | has_reversal_word(text)
    return pairs_on(near_in_time(rows, REVERSAL_DAYS), [c("i_debit"), c("i_credit")], [c("j_credit"), c("j_debit")]).filter(opens & evaluated() & is_reversal())


def probable_duplicate_pairs(rows: DataFrame) -> DataFrame:
    c = F.col
    keys = ("txn_date", "debit", "credit", "clean")
    p = pairs_on(with_peers(rows), [c(f"i_{k}") for k in keys], [c(f"j_{k}") for k in keys])
    return p.filter(evaluated() & is_probable() & ~is_exact() & ~is_reversal())


def near_candidates(rows: DataFrame, days: int = 3) -> DataFrame:
    """Pairs at most ``days`` apart with an equal debit or credit whose narrations may be 0.9 alike.

    Dates fall into buckets of days + 1; one side also stands in the buckets before and
    after. The equal amount is part of the key, once as debit and once as credit. A ratio of 0.9 needs
    lengths of 9 to 11 at most, which is checked before texts are compared.
    """
    bucket = lambda c: F.call_function("div", F.datediff(c, F.lit("1970-01-01").cast("date")), F.lit(days + 1))
    dated = near_in_time(rows, days).filter("length(narration_raw) > 0")
    i, j = side(dated, "i").withColumn("i_b", bucket("i_txn_date")), side(dated, "j").withColumn("j_b", bucket("j_txn_date"))
    ik = i.withColumn("_k", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"i_{k}").alias("amount")) for k in ("debit", "credit")])))
    ik = ik.withColumn("_b", F.explode(F.array(F.col("i_b") - 1, F.col("i_b"), F.col("i_b") + 1)))
    jk = j.withColumn("_m", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"j_{k}").alias("amount")) for k in ("debit", "credit")])))
    on = (F.col("i_statement_id") == F.col("j_statement_id")) & (F.col("_b") == F.col("j_b")) & (F.col("_k.kind") == F.col("_m.kind")) & F.col("_k.amount").eqNullSafe(F.col("_m.amount"))
    p = ik.join(jk, on & (F.col("i_id") < F.col("j_id")))
    once = (F.col("_k.kind") == "debit") | ~F.col("i_debit").eqNullSafe(F.col("j_debit"))
    la, lb = F.length("i_narration_raw"), F.length("j_narration_raw")
    p = p.filter(once & (F.abs(F.datediff("i_txn_date", "j_txn_date")) <= days) & (F.least(la, lb) * 11 >= F.greatest(la, lb) * 9))
    return p.filter(evaluated() & ~is_exact() & ~is_reversal() & ~is_probable()).drop("_k", "_m", "_b", "i_b", "j_b")


def near_duplicate_pairs(rows: DataFrame, similarity: float = 0.90, days: int = 3, few: int = 64) -> DataFrame:
    """Pairs at most ``days`` apart with an equal debit or credit whose lower-case narrations are alike by ``sequence_ratio``.

    Only rows with another date of their statement near take part. Those of one date, narration and amounts are one group. Groups meet under a bucket of dates, and in statements with more than
    ``few`` groups in a bucket also under a rare letter of their narrations; never under an amount that both lack. Similar texts are
    scored once, and rows are paired last.
    """
    text = F.lower("narration_raw")
    dated = near_in_time(rows, days).select(*SIDE).filter("length(narration_raw) > 0").withColumn("_lf_text", text)
    same = Window.partitionBy("statement_id", "txn_date", "_lf_text", "debit", "credit")
    dated = staged(dated.withColumn("_lf_group", F.min("id").over(same)).withColumn("_lf_rows", F.count(F.lit(1)).over(same)))
    bucket = F.call_function("div", F.datediff("txn_date", F.lit("1970-01-01").cast("date")), F.lit(days + 1))
    groups = dated.filter("id = _lf_group").select("statement_id", "txn_date", "debit", "credit", F.col("_lf_text").alias("text"), F.col("id").alias("g"), bucket.alias("b"), "_lf_rows")
    dense = groups.groupBy("statement_id", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > few).select("statement_id").distinct()
    part = lambda p, *more: [F.col(c).alias(f"{p}_{c}") for c in ("g", "text", "txn_date", "debit", "credit", *more)]
    amount = F.col("i_debit").eqNullSafe(F.col("j_debit")) | F.col("i_credit").eqNullSafe(F.col("j_credit"))
    la, lb = F.length("i_text"), F.length("j_text")
    close = (F.abs(F.datediff("i_txn_date", "j_txn_date")) <= days) & amount & (F.least(la, lb) * (2 - similarity) >= F.greatest(la, lb) * similarity - 1e-6)

    def meet(d: DataFrame, *by: str) -> DataFrame:
        more = ("keys",) if by else ()
        i = d.select("statement_id", *by, F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"), *part("i", *more))
        j = d.select("statement_id", *by, "b", *part("j", *more))
        return growing(i).join(growing(j), ["statement_id", "b", *by]).filter((F.col("i_g") < F.col("j_g")) & close)

    crowded = staged(groups.join(dense, "statement_id", "left_semi"))
    keys = first_elements(crowded.select("text"), similarity, with_tokens=False)
    keyed = growing(crowded).join(keys, "text").withColumn("key", F.explode("keys"))
    few_met = meet(groups.join(dense, "statement_id", "left_anti"))
    many_met = meet(keyed, "key").filter(share_first(F.col("i_keys"), F.col("j_keys"), F.col("key")))
    pair = ("i_g", "j_g", "i_text", "j_text")
    met = staged(few_met.select(*pair).unionByName(many_met.select(*pair)))
    # The ratio depends on which text comes first; rows of two groups may come in either order.
    score = ratio_from(similarity)
    texts = staged(distinct_spread(met.filter("i_text <> j_text").select("i_text", "j_text"))).filter(may_reach(F.col("i_text"), F.col("j_text"), similarity)).withColumn("ahead", score("i_text", "j_text")).withColumn("behind", score("j_text", "i_text")).filter(F.greatest("ahead", "behind") >= similarity)
    alike = met.filter("i_text = j_text").select("i_g", "j_g", F.lit(1.0).alias("ahead"), F.lit(1.0).alias("behind"))
    alike = alike.union(growing(met).join(texts, ["i_text", "j_text"]).select("i_g", "j_g", "ahead", "behind"))
    one = F.lit(1.0)
    alike = alike.union(groups.filter("_lf_rows > 1").select(F.col("g").alias("i_g"), F.col("g").alias("j_g"), one, one))
    first, second = (dated.select(F.col("_lf_group").alias(g), F.struct(*[F.col(c) for c in SIDE]).alias(r)) for g, r in (("i_g", "p"), ("j_g", "q")))
    both = alike.join(growing(first), "i_g").join(growing(second), "j_g").filter((F.col("p.id") != F.col("q.id")) & ((F.col("i_g") != F.col("j_g")) | (F.col("p.id") < F.col("q.id"))))
    ahead = F.col("p.id") < F.col("q.id")
    pick = lambda c, p: F.when(ahead, F.col(f"p.{c}") if p == "i" else F.col(f"q.{c}")).otherwise(F.col(f"q.{c}") if p == "i" else F.col(f"p.{c}")).alias(f"{p}_{c}")
    pairs = both.select(*[pick(c, p) for p in "ij" for c in SIDE], F.when(ahead, F.col("ahead")).otherwise(F.col("behind")).alias("similarity"))
    return pairs.filter((F.col("similarity") >= similarity) & evaluated() & ~is_exact() & ~is_reversal() & ~is_probable())
