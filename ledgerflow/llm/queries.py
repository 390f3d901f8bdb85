"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, language_id, lm_scores, mixing, oracle, phrases, sharding, simhash, suffix_dedup, token_alignment, token_counts, url_filters
from . import quality_rules as rules
from .common import read_table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    keys = [F.col(c) for c in ("doc_id", "size", "text_crc32")]
    out = sharding.shard_rows(docs, keys, n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def number_of(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def url_list(pages: DataFrame) -> DataFrame:
    """Dated list changes (pattern, action, since) that Spark derives from the hosts and paths of ``pages``."""
    seen = pages.select(url_filters.url_host(F.col("url")).alias("host"), F.get(F.array_remove(F.split(url_filters.url_path(F.col("url")), "/"), ""), 0).alias("top")).filter("host <> ''").distinct()
    hosts = seen.select("host", number_of(F.col("host")).alias("k")).distinct()
    parents = hosts.filter("size(split(host, '[.]')) > 2").select(F.expr("substr(host, instr(host, '.') + 1)").alias("host")).distinct().select("host", number_of(F.col("host")).alias("k"))
    tops = seen.filter("top is not null").select(F.concat_ws("/", "host", "top").alias("pattern")).select("pattern", number_of(F.col("pattern")).alias("k"))
    day = lambda c: F.date_add(F.lit("2024-01-01").cast("date"), c.cast("int"))
    k = F.col("k")
    return (
        parents.select(F.col("host").alias("pattern"), F.lit("block").alias("action"), day(k % 180).alias("since"))
        .union(parents.select("host", F.lit(None).cast("string"), day(k % 180 + 90)))
        .union(hosts.filter(k % 3 == 0).select("host", F.lit("allow"), day(k % 200 + 20)))
        .union(hosts.filter(k % 3 == 1).select("host", F.lit("block"), day(k % 300)))
        .union(hosts.filter(k % 6 == 1).select("host", F.lit("allow"), day(k % 300 + 45)))
        .union(tops.filter(k % 5 == 0).select("pattern", F.lit("block"), day(k % 250)))
        .union(tops.filter(k % 10 == 0).select("pattern", F.lit(None).cast("string"), day(k % 250 + 70)))
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    out = url_filters.filter_urls(captures, url_list(pages))
    return out.select("page_id", "url", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "host", "rule", "rule_action", "url_kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs, carry_text=False).select("doc_id", "size", "source_size", "target", "taken")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.repeated_spans(docs, carry_text=False)
    digest = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("repeated_words").cast("long").alias("repeated_words"), F.size("spans").cast("long").alias("n_spans"), digest.alias("spans"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_text.add_main_text(pages)
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    items = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    out = decontamination.add_matches(docs, items, carry_text=False)
    return out.select("doc_id", (F.size("matches") > 0).alias("contaminated"), F.transform("matches", lambda m: m["item_id"]).alias("item_ids"), F.transform("matches", lambda m: m["distance"]).alias("distances"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = simhash.near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = token_counts.add_token_counts(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), carry_text=False)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    out = lm_scores.lm_scores(docs, ~held_out, carry_text=False)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = rules.quality_rules(docs, carry_text=False)
    return out.select("doc_id", *rules.COUNTS, "base_failed", "kept")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    out = language_id.add_language(docs, ~held_out, carry_text=False)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("text", "lang")
    return phrases.top_collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_alignment.add_alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), carry_text=False)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_sharding, op2_url_filters, op3_mixing, op4_suffix_dedup, op5_html_text, op6_decontamination, op7_simhash, op8_token_counts, op9_lm_scores, op10_quality_rules, op11_language_id, op12_collocations, op13_token_alignment)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
