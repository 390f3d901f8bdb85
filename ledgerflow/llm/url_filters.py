"""URL filters by a temporal list join.

List entries are dated changes: from ``since`` on, ``pattern`` has ``action`` (``block`` or
``allow``, or null: it is taken off the list). Changes of a pattern become validity
intervals, each up to the next change. A capture asks for every pattern that may cover
it (its host and parent domains, and the prefixes of its path by segment) as of its
fetch time; the most specific active entry decides.

Only DataFrame functions. Intervals are cut at the borders of periods, so the join is an
equality of pattern and period with a check of the dates. Distinct (pattern, time)
questions are joined, not captures: a host with a third of all captures asks once for
each period and time of fetching.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def url_host(url: Column) -> Column:
    """The lower-case host of a URL without user, port and final dot; '' if it has none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"\.$", "")


def url_path(url: Column) -> Column:
    """The path of a URL from its first slash, without query and fragment."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?", 1)


def patterns(host: Column, path: Column, most_labels: Column, most_segments: Column) -> Column:
    """(rank, pattern) of what may cover a URL; a higher rank is more specific.

    ``example.com`` covers the host and all below it; ``a.example.com/x`` covers the
    host itself with paths that begin with the segment x. Longer patterns than the list
    has can't be on it, so they aren't built: a URL costs what the list's longest
    patterns do, however many segments it has.
    """
    labels = F.split(host, r"\.")
    deepest = F.least(F.size(labels), most_labels)
    parents = F.transform(
        F.when(deepest > 0, F.sequence(F.lit(1), deepest)).otherwise(F.array().cast("array<int>")),
        lambda n: F.struct(n.alias("rank"), F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".").alias("pattern")),
    )
    segments = F.array_remove(F.split(path, "/"), "")
    longest = F.least(F.size(segments), most_segments)
    prefixes = F.transform(
        F.when(longest > 0, F.sequence(F.lit(1), longest)).otherwise(F.array().cast("array<int>")),
        lambda n: F.struct((n + 1000).alias("rank"), F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), n), "/")).alias("pattern")),
    )
    return F.when(host != "", F.concat(parents, prefixes)).otherwise(F.array().cast("array<struct<rank:int,pattern:string>>"))


def pattern_sizes(entries: DataFrame) -> DataFrame:
    """One row: the most labels of a pattern without a path, and the most segments of a path (0 if there are none)."""
    parts = F.size(F.split("pattern", "/")) - 1
    labels = F.when(parts == 0, F.size(F.split("pattern", r"\.")))
    return entries.filter("pattern is not null").agg(F.coalesce(F.max(labels), F.lit(0)).alias("most_labels"), F.coalesce(F.max(parts), F.lit(0)).alias("most_segments"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, since, until) of (pattern, action, since): until the pattern's next change, or null.

    Of several changes at one time the greatest action holds (null last). Changes
    without a pattern or date are left out.
    """
    day = entries.filter("pattern is not null and since is not null").groupBy("pattern", "since").agg(F.max("action").alias("action"))
    return day.withColumn("until", F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))).filter("action is not null")


def period(at: Column, days: int) -> Column:
    return F.call_function("div", F.datediff(at, F.lit("1970-01-01").cast("date")), F.lit(days))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", days: int = 30) -> DataFrame:
    """Adds ``host``, ``rule``, ``rule_action`` and ``url_kept`` to captures (url, fetched date).

    ``rule`` is the most specific entry active at the fetch time (since <= fetched < until),
    null if none is; a capture is dropped (``url_kept`` false) if the rule's action is
    ``block``. Null or broken URLs and null times match nothing and are kept; repeated
    captures are judged each; empty tables give no rows, or no rules; input columns with
    the names of results are replaced.
    """
    captures = captures.drop("host", "rule", "rule_action", "url_kept")
    host, path = url_host(F.col(url)), url_path(F.col(url))
    c = captures.withColumn("host", host).withColumn("_lf_path", path)
    ask = F.struct(F.col("host"), F.col("_lf_path").alias("path"))
    asked = c.filter(F.col(fetched).isNotNull()).select(ask.alias("place"), F.col(fetched).alias("at")).distinct()
    # One row is joined to all rows, here and below.
    asked = asked.join(F.broadcast(pattern_sizes(entries)), F.lit(True))
    covering = patterns(F.col("place.host"), F.col("place.path"), F.col("most_labels"), F.col("most_segments"))
    asked = asked.select("place", "at", F.inline(covering)).withColumn("period", period(F.col("at"), days))
    questions = asked.select("pattern", "period", "at").distinct()
    last = questions.agg(F.max("period").alias("last"))
    spans = intervals(entries).join(F.broadcast(last), F.lit(True))
    first = period(F.col("since"), days)
    spans = spans.withColumn("to", F.least(F.coalesce(period(F.col("until"), days), F.col("last")), F.col("last"))).filter(first <= F.col("to"))
    spans = spans.select("pattern", "action", "since", "until", F.explode(F.sequence(first, F.col("to"))).alias("period"))
    answers = questions.join(spans, ["pattern", "period"]).filter((F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until")))).select("pattern", "at", "action")
    best = asked.join(answers, ["pattern", "at"]).groupBy("place", "at").agg(F.max(F.struct("rank", "pattern", "action")).alias("_lf_best"))
    best = best.select(F.col("place").alias("_lf_place"), F.col("at").alias("_lf_at"), "_lf_best")
    out = c.join(best, (ask == F.col("_lf_place")) & (F.col(fetched) == F.col("_lf_at")), "left")
    return (
        out.withColumn("rule", F.col("_lf_best.pattern"))
        .withColumn("rule_action", F.col("_lf_best.action"))
        .withColumn("url_kept", F.coalesce(F.col("_lf_best.action") != "block", F.lit(True)))
        .drop("_lf_path", "_lf_place", "_lf_at", "_lf_best")
    )
