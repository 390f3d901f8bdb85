"""Quality rules with thresholds that adapt to language and source.

Counts per document come from array functions over its words. A share (of symbols, of
repeated lines, of repeated words) is known only as well as the text is long, so a document
enters with the upper confidence bound of its share (Wilson, 1927) and is judged by the lower
one: it fails if even that lies above its group's fence. Each value is rounded
down to ten significant bits, and the counts of the rounded values by language and source are
a log-linear quantile sketch (relative error below 1 / 512, no largest value) that merges by
addition: the sketches of a language's sources add up to the language's. Fences follow
from the quartiles of the sketch; a join brings them to the documents.

Only DataFrame functions; nothing but counts of rounded values is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The fences of word lengths stand so many interquartile ranges outside the quartiles.
RANGES = 3
#: Width of the confidence bounds of a share, in standard errors.
WIDTH = 3
#: The parent's quartiles count as much as those of so many documents of the group's own.
PRIOR = 20
#: Significant bits that the sketch keeps of a value.
BITS = 10
#: Millionths: the scale of the ratios.
SCALE = 1_000_000
#: By share: what is counted, of how many, and how many of either make one event (a repeated window of three words adds six words).
SHARES = {"symbols": ("n_symbols", "word_chars", 1), "dup_lines": ("n_dup_lines", "_lf_lines", 1), "repeats": ("n_repeat_words", "n_words", 6)}


def count_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five counts of COUNTS and ``_lf_lines`` (lines with a word), all long.

    A null or empty text counts 0 everywhere. Repeated three-word windows are found
    by sorting the hashes of a text's windows and comparing neighbours, so a text of
    n words costs n log n. Texts are read whole.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    w = df.withColumn("_lf_w", words(F.col(text)))
    w = w.withColumn(
        "_lf_g",
        F.sort_array(
            F.transform(
                F.when(F.size("_lf_w") > 2, F.slice("_lf_w", F.lit(1), F.size("_lf_w") - 2)).otherwise(F.array().cast("array<string>")),
                lambda x, i: F.struct(F.xxhash64(x, F.get("_lf_w", i + 1), F.get("_lf_w", i + 2)).alias("h"), i.alias("p")),
            )
        ),
    )
    g = F.col("_lf_g")
    same = lambda x, i: x["h"].eqNullSafe(F.get(g, i - 1)["h"]) | x["h"].eqNullSafe(F.get(g, i + 1)["h"])
    w = w.withColumn("_lf_p", F.array_sort(F.transform(F.filter(g, same), lambda x: x["p"])))
    covered = F.aggregate(
        "_lf_p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"\S"))
    w = w.withColumn("_lf_l", lines)
    joined = F.regexp_replace(t, r"\s+", "")
    return (
        w.withColumn("n_words", F.size("_lf_w").cast("long"))
        .withColumn("word_chars", F.length(joined).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lf_l") - F.size(F.array_distinct("_lf_l"))).cast("long"))
        .withColumn("n_repeat_words", covered)
        .withColumn("_lf_lines", F.size("_lf_l").cast("long"))
        .drop("_lf_w", "_lf_g", "_lf_p", "_lf_l")
    )


def share_bound(share: str, sign: int, width: float = WIDTH) -> Column:
    """The upper (``sign`` 1) or lower (-1) Wilson bound of a share, in whole millionths."""
    count, size, event = SHARES[share]
    c = F.col(count) / F.lit(float(event))
    n = F.greatest(F.col(size), F.lit(1)) / F.lit(float(event))
    square = float(width * width)
    spread = F.sqrt(c * (n - c) / n + F.lit(square / 4)) * F.lit(float(sign * width))
    return F.floor(F.lit(float(SCALE)) * (c + F.lit(square / 2) + spread) / (n + F.lit(square)))


def word_length() -> Column:
    """Characters a word, in whole millionths."""
    return F.call_function("div", F.col("word_chars") * SCALE, F.greatest(F.col("n_words"), F.lit(1)))


def sketched_values() -> dict[str, Column]:
    """Whole numbers: upper bounds of the shares, the word length, and the number of words."""
    return {k: share_bound(k, 1) for k in SHARES} | {"word_length": word_length(), "n_words": F.col("n_words")}


def rounded(v: Column, bits: int = BITS) -> Column:
    """A whole number rounded down to its ``bits`` leading binary digits."""
    past = F.greatest(F.length(F.bin(v)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, past), past)


def sketch(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each feature's rounded values by key: one row each of keys, feature, bin, n."""
    bins = F.array(*[F.struct(F.lit(k).alias("feature"), rounded(v).alias("bin")) for k, v in sketched_values().items()])
    return df.select(*keys, F.inline(bins)).groupBy(*keys, "feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "feature", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """By key and feature: ``size`` and the quartiles ``q1``, ``q2``, ``q3``, all double."""
    by = Window.partitionBy(*keys, "feature")
    cum = sketches.withColumn("c", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    at = lambda num: F.min(F.when(F.col("c") * 4 >= F.col("all") * num, F.col("bin"))).cast("double")
    return cum.groupBy(*keys, "feature").agg(F.max("all").cast("double").alias("size"), *[at(k).alias(f"q{k}") for k in (1, 2, 3)])


def shrunk(own: DataFrame, parent: DataFrame, keys: list[str], shared: list[str], prior: float) -> DataFrame:
    """``own`` with its quartiles drawn to the parent's by a weight that falls as the group grows."""
    o, p = own.alias("o"), parent.alias("p")
    same = F.col("o.feature") == F.col("p.feature")
    for k in shared:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"p.{k}"))
    size = F.col("o.size")
    mixed = [((size * F.col(f"o.q{k}") + F.lit(float(prior)) * F.col(f"p.q{k}")) / (size + F.lit(float(prior)))).alias(f"q{k}") for k in (1, 2, 3)]
    return o.join(p, same).select(*[F.col(f"o.{k}").alias(k) for k in keys], F.col("o.feature").alias("feature"), size.alias("size"), *mixed)


def fences(q: DataFrame, keys: list[str], ranges: float = RANGES) -> DataFrame:
    """By key: a map from feature to its fences ``lo`` (null for a share) and ``hi``.

    The fence of a share is the upper quartile of its bounds, taken as the mirror image of the
    lower one about the median: the same where a group is symmetric, and unmoved by outliers until
    they are half of the group. Those of word lengths stand ``2 * ranges + 1`` times the distance
    between the median and the quartile on the other side away from the median (Tukey's outer
    fences where a group is symmetric), a distance of at least one character in a document of the median size.
    """
    found = q.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("q1", "q2", "q3")))).alias("q"))
    of = lambda k: F.col("q")[k]
    entries = []
    for k in SHARES:
        entries += [F.lit(k), F.struct(F.lit(None).cast("double").alias("lo"), (of(k)["q2"] * 2.0 - of(k)["q1"]).alias("hi"))]
    v, wide = of("word_length"), float(2 * ranges + 1)
    step = F.lit(float(SCALE)) / F.greatest(of("n_words")["q2"], F.lit(1.0))
    lo = v["q2"] - F.greatest(v["q3"] - v["q2"], step) * wide
    hi = v["q2"] + F.greatest(v["q2"] - v["q1"], step) * wide
    return found.select(*keys, F.create_map(*entries, F.lit("word_length"), F.struct(lo.alias("lo"), hi.alias("hi"))).alias("fences"))


def thresholds(counted: DataFrame, ranges: float = RANGES, prior: float = PRIOR) -> DataFrame:
    """(_lf_lang, _lf_source, fences) of documents with their counts: sketches, merged upwards, then shrunk downwards."""
    fine = written(sketch(counted.filter("n_words > 0"), ["_lf_lang", "_lf_source"]))
    by_lang = merged(fine, ["_lf_lang"])
    lang = shrunk(quartiles(by_lang, ["_lf_lang"]), quartiles(merged(by_lang, []), []), ["_lf_lang"], [], prior)
    return fences(shrunk(quartiles(fine, ["_lf_lang", "_lf_source"]), lang, ["_lf_lang", "_lf_source"], ["_lf_lang"], prior), ["_lf_lang", "_lf_source"], ranges)


def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", prior: float = PRIOR, ranges: float = RANGES, carry_text: bool = True) -> DataFrame:
    """Adds the counts, ``base_failed``, ``failed_rules`` array<string> and ``kept``.

    ``base_failed``: fewer than 50 words, or over half of them in repeated windows.
    The adaptive rules judge what is left: a share whose lower bound is above its fence, or
    a word length outside its fences, fails. Thresholds come from all documents with a word;
    the quartiles of a group of n documents weigh n, those of its language ``prior``
    (and a language's n against ``prior`` for all).
    Null languages and sources are groups of their own; repeated rows count as often
    as they occur; an empty table gives an empty one. Input columns with the names of
    results are replaced.
    """
    own = [*COUNTS, "base_failed", "failed_rules", "kept"]
    df = df.drop(*[c for c in own if c not in (text, lang, source)])
    counted = count_features(df, text)
    counted = written(counted if carry_text else counted.drop(text))
    group = counted.select(F.col(lang).alias("_lf_lang"), F.col(source).alias("_lf_source"), *COUNTS, "_lf_lines")
    # One row a group, written so that its size is known before the join is planned.
    chosen = written(thresholds(group, ranges, prior)).withColumnRenamed("fences", "_lf_fences")
    joined = counted.join(chosen, F.col(lang).eqNullSafe(F.col("_lf_lang")) & F.col(source).eqNullSafe(F.col("_lf_source")), "left").drop("_lf_lang", "_lf_source")
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    fence = lambda k: F.col("_lf_fences")[k]
    rules = [F.when(share_bound(k, -1) > fence(k)["hi"], F.lit(k)) for k in SHARES]
    rules.append(F.when(word_length() > fence("word_length")["hi"], F.lit("word_length")))
    rules.append(F.when(word_length() < fence("word_length")["lo"], F.lit("word_length_low")))
    return (
        joined.withColumn("base_failed", base)
        .withColumn("failed_rules", F.array_compact(F.array(*rules)))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("_lf_fences", "_lf_lines")
    )
