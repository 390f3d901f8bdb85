"""The stages and queries on small data, and the pipeline against plain versions of its stages."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "docs")
        f(spark, docs, SF).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_stages_keep_columns_and_rows(stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name
        known = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in after.select("doc_id").collect()} <= known
    _, before, after = stages[-1]
    assert after.count() == before.count()


def test_duplicates_and_passages_are_gone(spark, stages):
    from ledgerflow.llm import decontamination, simhash

    dedup, clean = stages[1][2], stages[2][2]
    assert simhash.near_duplicates(dedup).filter("component_id <> doc_id").count() == 0
    kept = {r.component_id for r in simhash.near_duplicates(stages[1][1]).select("component_id").distinct().collect()}
    assert {r.doc_id for r in dedup.select("doc_id").collect()} == kept
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    norm = lambda t: " " + " ".join(decontamination.tokens(t)) + " "
    for r in clean.collect():
        assert not any(norm(i.text) in norm(r.text) for i in items)


def test_mix_repeats_whole_documents(stages):
    _, before, after = stages[3]
    texts = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert all(texts[r.doc_id] == r.text for r in rows) and max(Counter(r.doc_id for r in rows).values()) <= 2


def test_shards_are_even_and_gapless(stages):
    rows = stages[4][2].select("shard", "slot").collect()
    by = Counter(r.shard for r in rows)
    assert max(by.values()) - min(by.values()) <= 1 and len({(r.shard, r.slot) for r in rows}) == len(rows)


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    key = lambda d: sorted(map(tuple, d.select("doc_id", "shard", "slot", F.crc32(F.col("text").cast("binary"))).collect()))
    assert key(got) == key(stages[-1][2])


def test_other_columns_come_through_whole(spark):
    """Columns with the names that operators use keep their values; nulls, empty texts and repeated rows have a result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "a", 1), (7, " ", None, "a", 1), (7, " ", None, "a", 1)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(odd)
    tag = F.concat(F.lit("x"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    names = ["_lf_row", "copies", "kept", "matches", "size", "simhash", "n_words", "a.b", "shard", "CARRIED"]
    docs = docs.select(*[tag.alias(n) for n in names], *docs.columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [*names, "doc_id", "text", "lang", "source", "n_chars"], name
        docs = corpus_pipeline.written(docs)
        rows = docs.collect()
        assert rows and all(r[n] == f"x{'' if r.doc_id is None else r.doc_id}" for r in rows for n in names), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(rows) and all(r.copies == f"x{r.doc_id}" and 0 <= r.shard < 8 for r in last.collect())


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0).select("doc_id", "text", "lang", "source")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0 and out.columns[:4] == docs.columns, name


def test_queries_have_the_contracts_columns(spark):
    columns = {
        "op1": "doc_id size text_crc32 law shard slot grown_shard",
        "op3": "doc_id size source_size target taken",
        "op5": "page_id url text n_chars",
        "op7": "doc_id fingerprint component_id",
        "op8": "doc_id n_bytes n_tokens over_limit",
        "op9": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op10": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op11": "doc_id held_out lang_pred score",
        "op12": "lang rank phrase a l r n score",
        "op13": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    }
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert len(names) == 13 and "pipeline" in __spark_entry__.queries()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for n in names:
        df = __spark_entry__.queries()[n](spark, SF)
        want = columns.get(n.split("_")[0])
        assert want is None or df.columns == want.split(), n
        if "doc_id" in df.columns:
            assert df.count() == docs, n


def test_held_out_texts_score_better_than_the_base(spark):
    r = __spark_entry__.queries()["op9_lm_scores"](spark, SF).filter("held_out").agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert r.s > r.b
