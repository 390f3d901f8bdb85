"""Language identification, collocations and token alignment against plain brute-force versions, and on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerflow.llm import language_id, phrases, token_alignment
from ledgerflow.llm.token_counts import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.01/documents.parquet"
#: Columns that the operators neither read nor may stumble over.
DOCS = "doc_id long, text string, lang string, lang_pred string, score string, n_best string, phrase string, n string, bucket string, row string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x", "x") for r in rows], DOCS).repartition(3)


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


# Language identification


def brute_lengths(texts, held, order=language_id.ORDER):
    """Bits of ``held`` under counts of ``texts``, byte by byte over dictionaries."""
    counts = defaultdict(Counter)
    for t in texts:
        t = b" " * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                counts[t[i - k : i]][t[i]] += 1
    t, bits = b" " * order + held, 0
    for i in range(order, len(t)):
        gone, x = set(), 0.0
        for k in range(order, -1, -1):
            c = counts.get(t[i - k : i])
            if c is None:
                continue
            rest = {b: n for b, n in c.items() if b not in gone}
            if t[i] in rest:
                x += math.log2((sum(rest.values()) + len(rest)) / rest[t[i]])
                break
            if rest:
                x += math.log2((sum(rest.values()) + len(rest)) / len(rest))
            gone = set(c)
        else:
            x += math.log2(256 - len(gone))
        bits += round(x * language_id.BIT)
    return bits


def model_of(texts):
    gram, n = np.unique(language_id.runs_of(texts)[0], return_counts=True)
    return gram, n


def test_code_lengths_equal_brute_force(monkeypatch):
    rnd = random.Random(4)
    text = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n)).encode()
    a, b = [text("abcd e", 60) for _ in range(20)], [text("abxé e", 60) for _ in range(12)]
    model = language_id.Model({"a": model_of(a), "b": model_of(b)}, {"a": 20, "b": 12})
    asked = [b"", b"a", *a[:2], text("abcdxé ez", 300), text("\x00\x7fqé", 40), text("abxé e", 5000)]
    want = [[brute_lengths(x, t) for x in (a, b)] for t in asked]
    assert model.texts(asked).tolist() == want
    monkeypatch.setattr(language_id, "CHUNK", 37)  # parts of a long text see the bytes before them
    assert model.texts(asked).tolist() == want


def test_shares_of_a_context_add_up_to_one():
    texts = [b"abracadabra ab", b"cab"]
    tree = language_id.tree_of(*model_of(texts))
    for context in (b"abra", b"zzzz", b"  ab", b"raca"):
        runs = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        share = np.exp2(-language_id.code_lengths(tree, runs) / language_id.BIT).sum()
        assert math.isclose(share, 1, rel_tol=1e-3)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(SMALL).select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = language_id.add_language(docs, ~held).filter(held).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) > 200
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(5)] + [(10 + i, "le chat et le chien", "fr") for i in range(5)]
    odd = [(None, None, None), (50, "", "en"), (51, "12 + 3 !", "fr"), (52, "the dog " * 200_000, None), (53, "le chien", None), (53, "le chien", None)]
    df = frame(spark, rows + odd)
    got = language_id.add_language(df, F.lit(True), carry_text=False)
    assert got.columns.count("lang_pred") == 1 and got.columns[-2:] == ["lang_pred", "score"]
    by = Counter((r.doc_id, r.lang_pred) for r in got.collect())
    assert by == Counter([(i, "en") for i in range(5)] + [(10 + i, "fr") for i in range(5)] + [(None, "und"), (50, "und"), (51, "und"), (52, "en"), (53, "fr"), (53, "fr")])
    assert {r.lang_pred for r in language_id.add_language(df, F.lit(False)).collect()} == {"und"}
    assert language_id.add_language(df.limit(0), F.lit(True)).count() == 0


# Collocations


def brute_phrases(rows, least=10, cover=50, k=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for p in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall("[^ \t]+", p)
            n[lang or "und"] += len(w)
            f[lang or "und"].update(tuple(w[i : i + m]) for m in (1, 2, 3) for i in range(len(w) - m + 1))
    out = set()
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = lambda p: max((a for q, a in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))), default=0)  # noqa: E731, B023
        scored = []
        for p, a in found.items():
            if 100 * inside(p) < cover * a:
                score, cut = min((1_000_000 * a * a // (c[p[:i]] * c[p[i:]]), i) for i in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        out |= {(lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(scored)[:k], 1)}
    return out


def phrase_rows(seed=3):
    rnd = random.Random(seed)
    vocab = ["é", "of", "THE", "new", "york", "x#", "日本"]
    texts = [" ".join(rnd.choice(vocab) + rnd.choice(["", "", "", ",", " .", "\n", "\t"]) for _ in range(rnd.randint(0, 90))) for _ in range(60)]
    return [(i, t, ("en", "fr", None)[i % 3]) for i, t in enumerate(texts)] + [(None, None, None), (99, "", "en"), (98, "no\x00pe yes", "xx"), (97, "a b " * 40_000, "long"), (96, "?!.", "en")]


@pytest.mark.parametrize("shard", [None, 300])
def test_collocations_equal_brute_force(spark, monkeypatch, shard):
    rows = phrase_rows()
    if shard:  # many shards, and texts cut between pieces
        monkeypatch.setattr(phrases.shards, "__defaults__", (shard,))
    got = phrases.top_collocations(frame(spark, rows).repartition(5)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert set(map(tuple, got)) == brute_phrases(rows) and len(got) == len(brute_phrases(rows))
    few = phrases.top_collocations(frame(spark, rows), k=3, least=4, cover=80).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert set(map(tuple, few)) == brute_phrases(rows, 4, 80, 3)


def test_collocations_of_nothing(spark):
    assert phrases.top_collocations(frame(spark, phrase_rows()).limit(0)).count() == 0
    assert phrases.top_collocations(frame(spark, [(1, None, None), (2, " \n", "en")])).count() == 0


def test_automata_hold_their_phrases():
    """Equal states are shared, all paths come back, and a union adds weights."""
    texts = [b"a b c. a b d. x b c. x b d. y b c, y b d", b"a b c. q. a b", b""]
    counts = [Counter(tuple(w[i : i + m]) for p in re.split(rb"[.,]", t) for w in [p.split()] for m in (1, 2, 3) for i in range(len(w) - m + 1)) for t in texts]

    def paths(words, g):
        one = {(words[i],): n for i, n in zip(g.one, g.n1, strict=True)}
        two = [(words[i], words[j]) for i, j in zip(g.first, g.second, strict=True)]
        return one | dict(zip(two, g.n2, strict=True)) | {(*two[p], words[k]): n for p, k, n in zip(g.pair, g.third, g.n3, strict=True)}

    made = [phrases.automaton(*next(iter(phrases.counted(t)))) for t in texts]
    assert [paths(m.words, phrases.grams_of(m)) for m in made] == counts
    assert len(made[0].first) == 5 and len(made[0].weight) == 2  # a b, x b and y b are one state, b c and b d another
    assert paths(*phrases.union([phrases.unpacked(phrases.packed(m)) for m in made])) == counts[0] + counts[1]
    bounds = [(b"a", b""), (b"a", b"b"), (b"b", b"d"), (b"x", b"")]
    parts = dict(phrases.cut(*next(iter(phrases.counted(texts[0]))), bounds))
    held = {k: paths(m.words, phrases.grams_of(m)) for k, m in parts.items()}
    assert sum(map(len, held.values())) == len(counts[0])
    for k, found in held.items():
        assert all(sum((x, y) <= (*p, b"")[:2] for x, y in bounds) == k for p in found)


# Token alignment


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: n for n, c in byte_letters().items()}
    made, counts = [], Counter()
    for key, text in rows:
        ids_a = a.encode(f" {text}", add_special_tokens=False) if text else None
        ids_b = b.encode(text) if text else []
        raw_a = [bytes(back[c] for c in t) for t in ids_a.tokens] if text else []
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        raw = f" {text}".encode()
        if not text or b"".join(raw_a) != raw or b"".join(raw_b) != raw:
            made.append((key, 0, 0, [], ""))
            continue
        ends = lambda parts: {sum(map(len, parts[: i + 1])): i for i in range(len(parts))}
        ea, eb, links, groups, i, j = ends(raw_a), ends(raw_b), [], [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            links.append((ids_a.ids[ea[e]], ids_b[eb[e]]))
            groups.append(",".join(map(str, ids_a.ids[i : ea[e] + 1])) + "|" + ",".join(map(str, ids_b[j : eb[e] + 1])))
            i, j = ea[e] + 1, eb[e] + 1
        counts.update(links)
        made.append((key, len(ids_a.ids), len(ids_b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return Counter((key, x, y, len(links), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest) for key, x, y, links, digest in made)


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def token_rows():
    rnd = random.Random(9)
    odd = [" ", "  ", "\n", "\n\n  ", "\t", "\r\n", "\r", chr(0xA0), chr(0x3000), chr(0x2581), chr(0x1C), "\x0b", chr(0x85)]
    words = ["the", "Über", "naïve", "<|endoftext|>", "<s>", "don't", "2024", "...", chr(0x1F600), "日本語", "a" * 40, "\x00", ";\r", "é", "x_y", chr(0x378)]
    texts = ["".join(rnd.choice(words) + rnd.choice(odd if k % 3 == 0 else [" ", " ", " ", "\n"]) for _ in range(rnd.randint(1, 60))) for k in range(80)]
    return [*enumerate(texts), (None, None), (200, ""), (201, " "), (202, "\n"), (203, "lead"), (204, "  two  "), (205, texts[1]), (205, texts[1]), (206, "trail \n ")]


def test_alignment_equals_brute_force(spark):
    rows = token_rows()
    got = token_alignment.add_alignment(frame(spark, [(*r, None) for r in rows]), A, B).select(*ALIGNED)
    assert Counter(map(tuple, got.collect())) == brute_alignment(rows)


def test_alignment_within_small_limits(spark, monkeypatch):
    """Long texts in slices, a cache that forgets, and blocks that are folded give the same."""
    rows = token_rows()
    for name, value in {"SLICE": 7, "CACHE": 2000, "LINKS": 50, "DOCS": 9}.items():
        monkeypatch.setattr(token_alignment, name, value)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "_lf_text": pa.array([r[1] for r in rows], pa.string())})
    out = pa.Table.from_batches(token_alignment.index_batches(iter([batch.slice(0, 40), batch.slice(40)]), ["doc_id"], A, B, 4, 5))
    assert out.column("_lf_block").unique().to_pylist()[:3] == [5, 6, 7]
    index = spark.createDataFrame(out)
    got = token_alignment.scored(index, token_alignment.pair_counts(index)).select(*ALIGNED)
    assert Counter(map(tuple, got.collect())) == brute_alignment(rows)


def test_pair_index(spark):
    """Documents and links of each pair, from bitmaps and their digits."""
    rows = [(i, "one two two two three " * (i % 5)) for i in range(40)]
    index = token_alignment.index_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "text", A, B, 3, True)
    got = {(r.a, r.b): (r.documents, r.links) for r in token_alignment.pair_counts(index).collect()}
    pair = token_alignment.tokenizers(A, B)
    per = Counter()
    docs = defaultdict(set)
    for i, t in rows:
        for units in token_alignment.units_of(t) if t else ():
            ids = [x.ids for x in pair.a.encode_batch_fast(units, add_special_tokens=False)], [pair.b.encode("\n" + u)[2:] for u in units]
            for code in token_alignment.aligned(pair, [u.encode() for u in units], *ids)[1].tolist():
                per[code & 0xFFFFFF, code >> 24] += 1
                docs[code & 0xFFFFFF, code >> 24].add(i)
    assert got == {p: (len(docs[p]), n) for p, n in per.items()}


def test_alignment_of_nothing(spark):
    none = token_alignment.add_alignment(frame(spark, [(1, "a", "b")]).limit(0), A, B)
    assert none.count() == 0 and none.columns.count("n_best") == 1
    got = token_alignment.add_alignment(frame(spark, [(1, None, None), (2, "", None)]), A, B).select(*ALIGNED).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
