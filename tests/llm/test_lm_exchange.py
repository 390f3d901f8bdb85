"""op9's counts beside broadcast words: their rows in the exchange, and rare words by slots of their endings."""

import os
import random
import string
import time

import numpy as np
from pyspark.sql import functions as F

from ledgerflow.llm import lm_scores
from ledgerflow.llm.common import RELEASE, written


def test_counts_go_by_blocks_and_rare_words_by_slots(spark, monkeypatch):
    rnd = random.Random(7)
    words = ["".join(rnd.choices(string.ascii_lowercase + "é", k=rnd.randint(1, 5))) for _ in range(300)]
    docs = [(k, " ".join(rnd.choices(words, k=rnd.randrange(30)))) for k in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    hot = lm_scores.word_counts(df, "text").orderBy(F.desc("n"), "word").limit(151).toArrow()
    made = lm_scores.encoded(df, "text", hot, len(docs)).select("_lf_lm.*")
    h, k = 151, 6
    cls = np.array([rnd.randrange(k - 1) for _ in range(h)] + [0, k - 1], dtype=np.uint8)
    starts = np.array([rnd.randrange(k - 1) for _ in range(lm_scores.ENDINGS)], dtype=np.uint8)
    rare = lm_scores.by_ending(starts)
    ids = {w: i for i, w in enumerate(hot["word"].to_pylist())}
    left, right, pairs = np.zeros((h, k)), np.zeros((h, k)), np.zeros((k, k))
    for _, text in docs:
        w = (text or "").split()
        c = [k - 1, *(cls[ids[x]] if x in ids else starts[lm_scores.ending(x.encode())] for x in w), k - 1]
        for p, x in enumerate(w):
            if x in ids:
                left[ids[x], c[p]] += 1
                right[ids[x], c[p + 2]] += 1
        np.add.at(pairs, (c[:-1], c[1:]), 1)
    monkeypatch.setattr(lm_scores, "COUNTED", 16)  # 151 words are several blocks, the last one short
    for part in (0, 1):
        found, used, before, after = lm_scores.class_counts(made.select("ids", "slots"), cls, rare, k, part)
        assert (found == pairs).all() and list(used) == list(range(part, h, 2))
        assert (before == left[part::2]).all() and (after == right[part::2]).all()
    table = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string")
    top = [w.encode() for w in ids]
    want = np.bincount([starts[lm_scores.ending(w.encode())] for w in dict.fromkeys(words) if w not in ids], minlength=k - 1)
    assert (lm_scores.start_sizes(table, top, starts, k - 1) == want).all()


def test_counts_reach_the_driver_compressed_and_block_by_block(spark, monkeypatch):
    h, k = 400, 6
    texts = spark.createDataFrame([(np.array([*range(d, h, 7), h + 1], dtype=np.int32).tobytes(), b"") for d in range(7)], "ids binary, slots binary")
    cls = np.array([*(np.arange(h) % (k - 1)), 0, k - 1], dtype=np.uint8)
    rare = lm_scores.by_ending(np.zeros(lm_scores.ENDINGS, dtype=np.uint8))
    monkeypatch.setattr(lm_scores, "COUNTED", 64)
    sent = []
    real = lm_scores.unpacked
    monkeypatch.setattr(lm_scores, "unpacked", lambda x, kind, cells: sent.append((x.as_buffer().size, cells * 8)) or real(x, kind, cells))
    _, blocks = lm_scores.near_words(texts, cls, rare, k, 1)
    assert len(sent) == 1  # the bigrams of classes alone are unpacked so far
    ids, left, right = next(blocks)
    assert list(ids) == list(range(1, 128, 2)) and (left.sum(axis=1) == 1).all() and (right.sum(axis=1) == 1).all()
    assert len(sent) == 2 and sent[1][0] * 8 < sent[1][1]
    assert [len(b[0]) for b in blocks] == [64, 64, 8]


def test_a_write_can_release_its_shuffle_files(spark):
    folders = spark.conf.get("spark.local.dir")

    def held():
        return sum(name.startswith("shuffle_") for _, _, names in os.walk(folders) for name in names)

    def one():
        return spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))

    before = held()
    out = written(one(), release=True)
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and spark.conf.get(RELEASE, None) is None
    assert out.count() == 7 and out.agg(F.sum("n")).first()[0] == 1000
