"""Each operator of ``ledgerflow.llm`` against a plain brute-force version, and on awkward rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerflow.llm import components, decontamination, html_text, lm_scores, mixing, quality_rules, sharding, simhash, suffix_dedup, token_counts, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, shard string, matches int, simhash string, kept string, copies string, spans string, n_tokens string, row string, start string, n string"


def words(t):
    return WORD.findall(t or "")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 140))) for _ in range(n)]
    out = []
    for i, t in enumerate(base):
        if i % 7 == 0:
            t = base[i // 2]
        if i % 11 == 0:
            t = t.replace(" ", "\n", 3) + "  Ümlaut X\t#$"
        if i % 9 == 0:
            t = t + " " + base[3]
        out.append((i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None))
    return out


AWKWARD = [(None, None, None, None), (None, "", "en", "a"), (7, " \n\t ", "en", "a"), (7, " \n\t ", "en", "a"), (8, "one", None, "b"), (9, "x " * 30000, "en", None), (10, "wörter " * 60, "de", "b")]


def frame(spark, rows, extra=True):
    if extra:  # input columns with the names of results
        return spark.createDataFrame([(*r, "s", 1, "h", "k", "c", "p", "t", "r", "a", "n") for r in rows], DOCS).repartition(3)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus() + AWKWARD


# Sharding


def test_sharding_places(spark, rows):
    df = frame(spark, rows * 3)
    keys = [F.col("doc_id"), F.col("text")]
    got = sharding.shard_rows(df, keys, n_shards=5).select("doc_id", "shard", "slot").collect()
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(5)}
    assert len(got) == len(rows) * 3
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shard_rows(df.repartition(5), keys, n_shards=5).select("doc_id", "shard", "slot").collect()
    order = lambda r: (r.shard, r.slot, r.doc_id is None, r.doc_id)
    assert sorted(got, key=order) == sorted(again, key=order)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17])
def test_sharding_small_tables(spark, n):
    got = sharding.shard_rows(spark.range(n).withColumnRenamed("id", "doc_id"), [F.col("doc_id")], 8).collect()
    assert sorted(r.slot * 8 + r.shard for r in got) == list(range(n))


# URL filters


def test_url_filters_of_very_long_urls(spark):
    e = spark.createDataFrame([("h.com/a/a/a", "block"), ("com", "allow"), ("x/", "block")], "pattern string, action string").withColumn("since", F.lit("2024-01-01").cast("date"))
    long_path, long_host = "http://h.com" + "/a" * 100_000, "http://" + "b." * 50_000 + "com/"
    urls = [long_path, long_host, "http://h.com/a/a", "http://h.com/a/a/a", "http://x/"]
    c = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("fetched", F.lit("2024-01-02").cast("date"))
    got = {r.url: r.rule for r in url_filters.filter_urls(c, e).select("url", "rule").collect()}
    assert [got[u] for u in urls] == ["h.com/a/a/a", "com", "com", "h.com/a/a/a", None]
    got = url_filters.filter_urls(c, e.limit(0)).collect()
    assert len(got) == len(urls) and all(r.rule is None and r.url_kept for r in got)


def test_url_filters(spark):
    entries = [("example.com", "block", "2024-01-10"), ("example.com", None, "2024-03-01"), ("a.example.com", "allow", "2024-02-01"), ("a.example.com/x", "block", "2024-02-10"), ("other.org", "block", "2023-01-01"), (None, "block", "2024-01-01"), ("other.org", "allow", None), ("dup.net", "allow", "2024-01-01"), ("dup.net", "block", "2024-01-01")]
    e = spark.createDataFrame(entries, "pattern string, action string, since string").withColumn("since", F.to_date("since"))
    urls = ["http://example.com/", "https://u@A.Example.com:80/x/y?q=1", "http://a.example.com/xy", "http://b.other.org", "nonsense", None, "", "http://dup.net./p"]
    days = ["2023-12-31", "2024-01-10", "2024-02-05", "2024-02-10", "2024-03-01", None]
    rows = [(u, d, "old") for u in urls for d in days] * 2
    c = spark.createDataFrame(rows, "url string, fetched string, rule string").withColumn("fetched", F.to_date("fetched"))
    got = Counter((r.url, str(r.fetched) if r.fetched else None, r.rule, r.url_kept) for r in url_filters.filter_urls(c, e, days=7).collect())
    want = Counter()
    for u, d, _ in rows:
        m = re.match(r"[a-z]+://(?:[^/@]*@)?([^/?#:]*)(?::\d+)?([^?#]*)", u or "")
        host, path = (m[1].lower().rstrip("."), m[2]) if m else ("", "")
        best = None
        for p in {x[0] for x in entries if x[0]}:
            active = [(s, a or "") for q, a, s in entries if q == p and s and d and s <= d]
            if not active:
                continue
            action = max(active)[1]
            dom, _, seg = p.partition("/")
            hit = (host == dom and (path + "/").startswith("/" + seg + "/")) if seg else (host == dom or host.endswith("." + dom))
            if action and hit:
                best = max(best or (0, "", ""), (1000 + seg.count("/") + 1 if seg else dom.count(".") + 1, p, action))
        want[(u, d, best and best[1], not (best and best[2] == "block"))] += 1
    assert got == want
    empty = url_filters.filter_urls(c, e.limit(0))
    assert empty.filter("not url_kept or rule is not null").count() == 0 and empty.count() == len(rows)


# Mixing


def fill(sizes, share, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        for s in over or free:
            out[s] = most * sizes[s] if over else level * w[s]
        if not over:
            break
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def test_mixing(spark, rows):
    df = frame(spark, rows)
    got = mixing.mix_sources(df).collect()
    sizes, largest, taken = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
        largest[r[3]] = max(largest[r[3]], len(words(r[1])))
    want = fill(sizes, 1.5, 2.0)
    assert len(got) == len(rows)
    for r in got:
        taken[r.source] += r.taken
        assert r.size == len(words(r.text)) and r.source_size == sizes[r.source] and r.taken in (0, r.size, 2 * r.size)
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 for s in sizes)
    key = lambda x: sorted((r.doc_id is None, r.doc_id or 0, r.size, r.taken) for r in x)
    assert key(got) == key(mixing.mix_sources(df.repartition(5)).collect())
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_mixing_follows_keys(spark):
    """The chosen documents are those with the smallest keys."""
    docs = [(i, " ".join(["w"] * (1 + i % 5)), "en", "s" if i % 2 else "t") for i in range(400)]
    got = mixing.mix_sources(frame(spark, docs, extra=False), share=0.5, weights=(1,), steps=2).collect()
    import hashlib

    for s in ("s", "t"):
        mine = [r for r in got if r.source == s]
        key = lambda r: -math.log((int(hashlib.md5(f"42|{r.doc_id}|{hashlib.md5(r.text.encode()).hexdigest()}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48)
        total = 0
        for r in sorted(mine, key=key):
            assert r.copies == (total + r.size / 2 <= r.target)
            total += r.size


def test_mixing_sources_of_all_kinds(spark):
    """A source of low quality weights, one at its cap with texts without words, and one without any words."""
    rnd = random.Random(6)
    docs = [(i, "w " + "#" * 300, "en", "a-low") for i in range(3000)] + [(4000 + i, "w " * rnd.randint(1, 9), "en", "b") for i in range(900)]
    docs += [(6000 + i, "w" if i % 2 else None, "en", "c-small") for i in range(20)] + [(7000 + i, " ", "en", "d-none") for i in range(5)]
    df = frame(spark, docs, extra=False)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(docs)
    sizes = Counter({"d-none": 0})
    for r in docs:
        sizes[r[3]] += len(words(r[1]))
    want = fill(sizes, 1.5, 2.0)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.copies <= 2
    assert taken["c-small"] == 20 and taken["d-none"] == 0 and abs(taken["a-low"] - want["a-low"]) <= 1
    # No range holds a large part of the source, though all keys are divided by the same small weight.
    keys = [-math.log((rnd.random() * 2**48 + 0.5) / 2**48) * 1501 for _ in range(100_000)]
    assert max(Counter(math.floor(math.log2(k) * 1024) for k in keys).values()) < 100


# Suffix-array dedup


def brute_spans(texts, least):
    seen = Counter(tuple(w[k : k + least]) for w in map(words, texts) for k in range(len(w) - least + 1))
    out = []
    for t in texts:
        w = words(t)
        covered = {p for k in range(len(w) - least + 1) if seen[tuple(w[k : k + least])] > 1 for p in range(k, k + least)}
        spans, k = [], 0
        for p in sorted(covered):
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out.append([tuple(x) for x in spans])
    return out


@pytest.mark.parametrize(("least", "gram", "parts"), [(12, 5, 1), (12, 8, 7), (51, 31, 3)])
def test_repeated_spans(spark, rows, least, gram, parts):
    df = frame(spark, [(i, *r[1:]) for i, r in enumerate(rows)])
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_dedup.repeated_spans(df, least=least, gram=gram, partitions=parts).collect()}
    want = brute_spans([r[1] for r in rows], least)
    assert [got[i] for i in range(len(rows))] == want
    assert suffix_dedup.repeated_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeated_spans_of_few_words(spark, seed):
    """Two words only, so places have many partners that match on one side each."""
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    for least, gram in ((12, 4), (9, 5)):
        got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_dedup.repeated_spans(df, least=least, gram=gram, partitions=5).collect()}
        assert [got[i] for i in range(len(texts))] == brute_spans(texts, least)


def test_open_runs(spark):
    """A run whose partner is next to it in neither order: its neighbours share more on one side and less on the other."""
    mid = "m n o"
    texts = [f"1 2 3 4 {mid} 5 6 7 8", f"x 2 3 4 {mid} 5 6 y", *(f"1 2 3 4 {mid} {k} z" for k in "ab"), *(f"{k} w {mid} 5 6 7 8" for k in "cd")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for least in (7, 8):
        got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_dedup.repeated_spans(df, least=least, gram=3, partitions=2).collect()}
        assert [got[i] for i in range(len(texts))] == brute_spans(texts, least)


def test_repeat_longer_than_the_least_is_one_span(spark):
    rnd = random.Random(9)
    text = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    shared = text(400)
    df = spark.createDataFrame([(1, f"{text(70)} {shared} {text(5)}"), (2, f"{text(3)} {shared}")], "doc_id int, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_dedup.repeated_spans(df).collect()}
    assert got == {1: [(70, 470)], 2: [(3, 403)]}


# HTML


PAGE = """<html><head><title>T</title><style>p{x}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class=ad>Buy now</div>
<article><h1>Head &amp; line</h1><p><b>First   para&nbsp;with a<br>break<p>Second <i>para</i> &lt;ok&gt; caf&eacute; &#x41;
<ul><li>one<li>two</ul><form><input name=q> Search</form></article><aside>More</aside><section id="comments"><p>Nice post, really long comment text here</section><footer>&copy; me</footer>"""


def test_html_article():
    want = "Head & line\nFirst para with a break\nSecond para <ok> café A\none\ntwo"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text(PAGE.replace("article>", "div>")) == want


def test_html_marks():
    body = '<div class="page-header">Site</div><div class="content with-sidebar"><div class="post-header"><h1>Title</h1></div><p>Some text of the page that is long enough</p><div class="share-links">Share</div></div><div id="sidebar">Side</div>'
    assert html_text.main_text(body) == "Title\nSome text of the page that is long enough"


@pytest.mark.parametrize("html", [None, "", "<p>", "<!-- x", "<script>if (a<b) {}</script>", "&", "<nav>menu</nav>"])
def test_html_without_text(html):
    assert html_text.main_text(html) in ("", "&")


def test_html_frame(spark):
    long = "<body><article>" + "<p>word word word</p>" * 5000 + "</article>"
    df = spark.createDataFrame([(1, PAGE, "old"), (2, None, "old"), (3, long, "old"), (3, long, "old")], "page_id int, html string, main_text string")
    got = sorted((r.page_id, len(r.main_text)) for r in html_text.add_main_text(df).collect())
    assert got[0][1] > 0 and got[1] == (2, 0) and got[2] == got[3] == (3, 15 * 5000 - 1)
    assert html_text.add_main_text(df.limit(0)).count() == 0


# Decontamination


def brute_distance(a, b):
    """Least edit distance of ``a`` to any part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_distance():
    rnd = random.Random(3)
    for _ in range(300):
        a = [rnd.choice("abc") for _ in range(rnd.randint(1, 90))]
        b = [rnd.choice("abc") for _ in range(rnd.randint(0, 60))]
        assert decontamination.least_distance(a, b)[0] == brute_distance(a, b)


def test_matches(spark, rows):
    rnd = random.Random(5)
    texts = [r[1] or "" for r in rows]
    items = [(0, "never seen words at all here"), (1, ""), (2, None), (None, "one two three four five six seven")]
    for k in range(3, 25):
        w = words(rnd.choice(texts))[:40]
        for _ in range(rnd.randint(0, 6)):
            if w:
                w[rnd.randrange(len(w))] = "zz"
        items.append((k, " ".join(w).upper()))
    got = {}
    df = frame(spark, [(i, *r[1:]) for i, r in enumerate(rows)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (4 << 20, 300):
        got[block] = {r.doc_id: sorted((m.item_id, m.distance) for m in r.matches) for r in decontamination.add_matches(df, bench, block_bytes=block).collect()}
    assert got[300] == got[4 << 20]
    for i, r in enumerate(rows):
        if len(r[1] or "") > 5000:
            continue
        t, want = decontamination.tokens(r[1]), []
        for item, text in items:
            p = decontamination.tokens(text)
            if p and item is not None:
                d = brute_distance(p, t)
                if d <= decontamination.budget(len(p), 0.8) and t:
                    want.append((item, d))
        assert got[300][i] == sorted(want), (i, want)
    assert decontamination.add_matches(df, bench.limit(0)).filter("size(matches) > 0").count() == 0
    assert decontamination.add_matches(df.limit(0), bench).count() == 0


# SimHash


def brute_fingerprint(t):
    w = words(lower(t))
    sh = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(links, nodes):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints(rows):
    for r in rows:
        assert simhash.fingerprint(r[1]) % 2**64 == brute_fingerprint(r[1])


@pytest.mark.parametrize("dense", [1, 3, 64])
def test_near_pairs(spark, dense):
    """Chains, dense balls and random values; every ``dense`` gives the same classes."""
    rnd = random.Random(dense)
    values = {rnd.getrandbits(64) for _ in range(40)}
    for v in list(values)[:6]:
        values |= {v ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(25)}
        for _ in range(8):
            v ^= (1 << rnd.randrange(64)) | (1 << rnd.randrange(64))
            values.add(v)
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values | {0})
    prints = spark.createDataFrame([(v,) for v in values], "simhash long")
    got = {r.node: r.component for r in components.connected_components(simhash.near_pairs(prints, dense)).collect()}
    links = [(a, b) for i, a in enumerate(values) for b in values[:i] if ((a ^ b) % 2**64).bit_count() <= 2]
    want = classes(links, values)
    assert {v: got.get(v, v) for v in values} == want


def test_near_duplicates(spark, rows):
    df = frame(spark, rows)
    got = simhash.near_duplicates(df).collect()
    prints = [brute_fingerprint(r[1]) for r in rows]
    links = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 2]
    label = classes(links, set(prints))
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            least[label[p]] = min(least.get(label[p], r[0]), r[0])
    want = Counter((r[0], p, least.get(label[p])) for r, p in zip(rows, prints, strict=True))
    assert Counter((r.doc_id, r.simhash % 2**64, r.component_id) for r in got) == want
    assert sum(r.representative for r in got) == len(set(label.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 40)] + [(200, 200), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + k: 100 for k in range(40)}


# Token counts


def test_token_counts(spark, rows):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    texts = [r[1] for r in rows] + ["a<|endoftext|>b", "<|endoftext|>" * 3, "tabs\t\t x　y\u0085z", "\U000107bb\U00016ea0 new letters", "don't we'll 12345  \n\n end ", "日本語 texte 🙂🙂", "q" * 300]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id int, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in token_counts.add_token_counts(df, path, table_size=50).collect()}
    assert [got[i] for i in range(len(texts))] == [len(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert token_counts.add_token_counts(df.limit(0), path).count() == 0


# Language model


def lexicon_of(model, lexicon):
    """word -> (count, class) of all training words."""
    out = {w: (int(n), int(c)) for w, n, c in zip(model.top, model.counts, model.cls, strict=False)}
    return out | {r.word.encode(): (r.seen, r.cls) for r in lexicon.collect()}


def brute_model(texts, known, settings):
    """Transitions and emissions from the classes of all words, by plain counting."""
    k, end = settings.classes, settings.classes - 1
    moves, sizes, kinds = Counter(), Counter(), Counter(c for _, c in known.values())
    kinds[end] = 1
    for t in texts:
        c = [end, *(known[w][1] for w in lm_scores.tokens(t)), end]
        moves.update(zip(c, c[1:], strict=False))
    rows = Counter()
    for (a, b), n in moves.items():
        rows[a] += n
        sizes[b] += n
    total = sum(rows.values())
    new = sum(n == 1 for n, _ in known.values()) / total
    move = lambda a, b: math.log10((1 - new) * (moves[a, b] + 0.5) / (rows[a] + 0.5 * k) + new * (sizes[b] + 0.5) / (total + 0.5 * k))
    emit = lambda n, c: math.log10((n + 0.5) / (sizes[c] + 0.5 * (kinds[c] + 1)))
    return move, emit


@pytest.mark.parametrize(("hot", "window"), [(30, 20), (10, 10), (1000, 25)])
def test_lm_scores(spark, hot, window):
    docs = corpus(4, 120)
    learn = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    s = lm_scores.Settings(hot_words=hot, window=window, classes=6)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    df = frame(spark, docs + [(500, None, "en", "a"), (500, None, "en", "a")]).drop("n_tokens")
    got = lm_scores.lm_scores(df, train, settings=s).collect()
    texts = [r[1] for r in docs if learn(r[0])] + [None] * 2 * learn(500)
    counts = Counter(w for t in texts for w in lm_scores.tokens(t))
    total, distinct, ends = sum(counts.values()) + len(texts), len(counts) + 1, len(texts)
    model, lexicon, _ = lm_scores.fitted(df, train, "text", s, True)
    known = lexicon_of(model, lexicon)
    assert {w: n for w, (n, _) in known.items()} == counts and all(c < 5 for _, c in known.values())
    move, emit = brute_model(texts, known, s)
    for r in got:
        w = lm_scores.tokens(r.text)
        base = sum(math.log10((counts.get(x, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for x in w) + math.log10((ends + 0.5) / (total + 0.5 * (distinct + 1)))
        assert r.n_tokens == len(w) + 1 and r.n_known == sum(x in counts for x in w) + 1 and r.train_tokens == total
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
        pairs = [known.get(x, (0, int(model.endings[lm_scores.ending(x)]))) for x in w] + [(ends, 5)]
        score = sum(move(a, b) for a, b in zip([5, *(c for _, c in pairs)], [c for _, c in pairs], strict=False)) + sum(emit(n, c) for n, c in pairs)
        assert math.isclose(r.score, score, rel_tol=1e-9)
    assert lm_scores.lm_scores(df.limit(0), train, settings=s).count() == 0
    unseen = lm_scores.lm_scores(df, F.lit(False), settings=s).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in unseen)


def test_probabilities_add_up(spark):
    s = lm_scores.Settings(hot_words=40, window=30, classes=5)
    model, lexicon, _ = lm_scores.fitted(frame(spark, corpus(6, 60)), F.lit(True), "text", s, True)
    assert np.allclose((10**model.move).sum(axis=1), 1)
    mass = Counter()
    for n, c in lexicon_of(model, lexicon).values():
        mass[c] += (n + 0.5) / 10 ** model.emit[c]
    for c, m in mass.items():
        assert math.isclose(m + 0.5 / 10 ** model.emit[c], 1, rel_tol=1e-9)


@pytest.mark.parametrize(("hot", "window"), [(40, 15), (12, 12), (1000, 10)])
def test_likelihood_never_falls(spark, hot, window):
    """The likelihood of the class bigrams of all words, counted plainly, is the last on the way, and none on the way is lower than one before."""
    s = lm_scores.Settings(hot_words=hot, window=window, classes=5)
    docs = corpus(7, 150)
    model, lexicon, _ = lm_scores.fitted(frame(spark, docs), F.lit(True), "text", s, True)
    known = lexicon_of(model, lexicon)
    pairs = np.zeros((5, 5))
    for r in docs:
        c = [known[w][1] for w in lm_scores.tokens(r[1])] + [4]
        for a, b in zip([4, *c], c, strict=False):
            pairs[a, b] += 1
    sizes = Counter(c for _, c in known.values())
    prior = sum(n * math.log(n / len(known)) for n in sizes.values())
    assert math.isclose(model.trace[-1], likelihood(pairs, np.arange(5), 5) + prior, rel_tol=1e-12)
    assert len(model.trace) > 2 and all(a <= b for a, b in zip(model.trace, model.trace[1:], strict=False)) and model.trace[-1] > model.trace[0]


def test_rare_words_choose_by_all_neighbours(spark):
    """Each word that isn't broadcast has the likeliest class, its neighbours' classes being known, rare ones among them; counted plainly."""
    s = lm_scores.Settings(hot_words=12, window=6, classes=5)
    docs = corpus(8, 120)
    df = frame(spark, docs).withColumn("_lf_train", F.lit(True))
    counts = Counter(w for r in docs for w in lm_scores.tokens(r[1]))
    top = sorted(counts, key=lambda w: (-counts[w], w))[:12]
    hot = pa.table({"word": [w.decode() for w in top], "n": [counts[w] for w in top]})
    texts = lm_scores.encoded(df, "text", hot, len(docs)).select("_lf_lm.ids", F.col("_lf_lm.rare.word"))
    cls = np.append(np.arange(12) % 4, [0, 4]).astype(np.uint8)
    starts = lm_scores.start_classes(top, cls[:12], 4)
    now = {w: int(cls[top.index(w)]) if w in top else int(starts[lm_scores.ending(w)]) for w in counts}
    pairs, sides = np.zeros((5, 5)), {}
    for r in docs:
        w = lm_scores.tokens(r[1])
        c = [4, *(now[x] for x in w), 4]
        for a, b in zip(c, c[1:], strict=False):
            pairs[a, b] += 1
        for k, x in enumerate(w):
            sides.setdefault(x, []).append((c[k], c[k + 2]))
    found, ids, left, right = lm_scores.class_counts(texts, cls, lm_scores.by_ending(starts), 5, 1)
    assert np.array_equal(found, pairs)
    for i, x, y in zip(ids, left, right, strict=True):
        near = sides[top[i]]
        assert i % 2 == 1 and list(x) == [sum(a == j for a, _ in near) for j in range(5)] and list(y) == [sum(b == j for _, b in near) for j in range(5)]
    table = spark.createDataFrame([(w.decode(),) for w in counts], "word string")
    sizes = lm_scores.start_sizes(table, top, starts, 4)
    assert list(sizes) == [sum(now[w] == c for w in counts if w not in top) for c in range(4)]
    kinds = sizes + np.bincount(cls[:12], minlength=4)
    rows = lm_scores.rare_choices(texts, cls, starts, found, kinds, s).collect()
    assert {r.word.encode() for r in rows} == set(counts) - set(top)
    p = pairs + 0.5
    for r in rows:
        near = sides[r.word.encode()]
        gain = [math.log(kinds[c] + 0.5) + sum(math.log(p[a, c] * p[c, b] / p[:, c].sum() / p[c].sum()) for a, b in near) for c in range(4)]
        assert r.seen == len(near) and r.start == now[r.word.encode()] and gain[r.cls] >= max(gain) - 1e-9


def test_unseen_words_have_the_class_of_their_ending(spark):
    """Words of one, two and more bytes, and of letters of several bytes, that only a held-out text has: its score is that of a plain count."""
    s = lm_scores.Settings(hot_words=20, window=10, classes=5)
    docs = corpus(9, 60)
    held = (900, "q zz é 日本 naïve unheardof q", "en", "a")
    df, train = frame(spark, [*docs, held]).drop("n_tokens"), F.col("doc_id") != 900
    got = lm_scores.lm_scores(df, train, settings=s).filter("doc_id = 900").first()
    model, lexicon, _ = lm_scores.fitted(df, train, "text", s, True)
    known = lexicon_of(model, lexicon)
    move, emit = brute_model([r[1] for r in docs], known, s)
    pairs = [known.get(x, (0, int(model.endings[zlib.crc32(x[-3:]) % 65536]))) for x in lm_scores.tokens(held[1])] + [(len(docs), 4)]
    score = sum(move(a, b) for a, b in zip([4, *(c for _, c in pairs)], [c for _, c in pairs], strict=False)) + sum(emit(n, c) for n, c in pairs)
    assert math.isclose(got.score, score, rel_tol=1e-9) and any(n == 0 for n, _ in pairs)


def likelihood(pairs, cls, k):
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    one = np.eye(k)[cls]
    m = one.T @ pairs @ one
    return f(m) - f(m.sum(axis=0)) - f(m.sum(axis=1))


@pytest.mark.parametrize("own", [1, 2])
def test_exchange_ends_where_no_move_helps(own):
    rnd = np.random.default_rng(own)
    n, k = 24, 5
    pairs = rnd.poisson(1.5, (n, n)) * rnd.poisson(1, (n, n))
    cls = lm_scores.exchange(pairs, k, own)
    best = likelihood(pairs, cls, k)
    assert list(cls[n - own :]) == list(range(k - own, k)) and cls[: n - own].max() < k - own
    for u in range(n - own):
        for c in range(k - own):
            other = cls.copy()
            other[u] = c
            assert likelihood(pairs, other, k) <= best + 1e-5


def test_exchange_mixes_no_languages():
    """Words of four languages, and twice as many classes: none has words of two."""
    rnd = np.random.default_rng(1)
    n, k = 41, 9
    pairs = np.zeros((n, n), dtype=np.int64)
    for a in range(40):
        for b in range(40):
            pairs[a, b] = rnd.poisson(5 if a // 10 == b // 10 else 0.05)
    pairs[40, :40] = pairs[:40, 40] = 3
    cls = lm_scores.exchange(pairs, k)
    start = np.append(np.arange(40) % (k - 1), k - 1)
    assert likelihood(pairs, cls, k) > likelihood(pairs, start, k) and cls[40] == k - 1
    assert all(len({u // 10 for u in range(40) if cls[u] == c}) <= 1 for c in range(k - 1))


# Quality rules


def brute_counts(t):
    w, t = words(t), t or ""
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {p for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, rows):
    rows = rows + [(90, "a b c a b c a b c d\na b c\n\na b c\n x", "en", "a"), (91, "###  $$ | \n###  $$ | ", None, None)]
    got = quality_rules.quality_rules(frame(spark, rows), prior=5).collect()
    want = Counter((r[0], *brute_counts(r[1])) for r in rows)
    assert Counter((r.doc_id, *(r[c] for c in quality_rules.COUNTS)) for r in got) == want
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and (not r.kept if failed else r.kept == (not r.failed_rules))
    assert quality_rules.quality_rules(frame(spark, rows).limit(0)).count() == 0


def test_quality_thresholds_adapt(spark):
    """A share of symbols that is usual in one source is an outlier in another."""
    rnd = random.Random(2)
    text = lambda marks: " ".join(("#" if rnd.random() < marks else "") + "".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(120))
    docs = [(i, text(0.0), "en", "plain") for i in range(150)] + [(200 + i, text(0.3 + 0.2 * rnd.random()), "en", "tags") for i in range(150)]
    docs += [(500, text(0.45), "en", "plain"), (501, text(0.45), "en", "tags")]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(frame(spark, docs)).collect()}
    assert not got[500] and got[501] and all(got[i] for i in range(150)) and all(got[200 + i] for i in range(150))


def test_rounding_keeps_ten_bits(spark):
    values = [0, 1, 1023, 1024, 1025, 2047, 2049, 10**6, 10**12 + 7, 2**62 + 5]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality_rules.rounded(F.col("v")).alias("b")).collect()]
    assert got == [v if v < 1024 else v >> (v.bit_length() - 10) << (v.bit_length() - 10) for v in values]


def test_quality_fences_by_hand(spark):
    """The fences of one group, whose language and whole table are itself, from its sorted values."""
    rnd = random.Random(8)
    docs = [(i, " ".join("ab"[rnd.randint(0, 1)] * rnd.randint(3, 7) + f"{i}x{k}" + "$" * (rnd.random() < 0.2) for k in range(60 + i)), "en", "a") for i in range(40)]
    counted = quality_rules.count_features(frame(spark, docs, extra=False)).select(F.col("lang").alias("_lf_lang"), F.col("source").alias("_lf_source"), *quality_rules.COUNTS, "_lf_lines")
    got = quality_rules.thresholds(counted).first().fences
    cut = lambda v: v if v < 1024 else v >> (v.bit_length() - 10) << (v.bit_length() - 10)
    rows = counted.collect()
    at = lambda vs, k: sorted(vs)[-(-len(vs) * k // 4) - 1]
    def bound(c, n, z):
        return math.floor(1e6 * (c + 4.5 + z * math.sqrt(c * (n - c) / n + 2.25)) / (n + 9))

    for name, count, size, event in (("symbols", "n_symbols", "word_chars", 1), ("repeats", "n_repeat_words", "n_words", 6), ("dup_lines", "n_dup_lines", "_lf_lines", 1)):
        vs = [cut(bound(r[count] / event, r[size] / event, 3)) for r in rows]
        assert math.isclose(got[name].hi, 2 * at(vs, 2) - at(vs, 1), rel_tol=1e-9) and got[name].lo is None
    vs = [cut(10**6 * r.word_chars // r.n_words) for r in rows]
    room = 1e6 / at([r.n_words for r in rows], 2)
    assert math.isclose(got["word_length"].hi, at(vs, 2) + 7 * max(at(vs, 2) - at(vs, 1), room), rel_tol=1e-9)
    assert math.isclose(got["word_length"].lo, at(vs, 2) - 7 * max(at(vs, 3) - at(vs, 2), room), rel_tol=1e-9)


def test_each_group_has_fences_of_its_own(spark):
    """No value is the fence of over a third of the groups (few lines a text make some equal by chance)."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    counted = quality_rules.count_features(docs).select(F.col("lang").alias("_lf_lang"), F.col("source").alias("_lf_source"), *quality_rules.COUNTS, "_lf_lines")
    found = [r.fences for r in quality_rules.thresholds(counted, prior=0).collect()]
    for rule in (*quality_rules.SHARES, "word_length"):
        seen = Counter(f[rule].hi for f in found)
        assert min(seen) > 0 and 3 * max(seen.values()) <= len(found), rule


def test_one_event_in_a_short_text_fails_nothing(spark):
    """In a source of like texts without symbols one symbol, or one repeated line, is no outlier; many are."""
    rnd = random.Random(5)
    line = lambda n: " ".join(f"{rnd.randint(10**4, 10**5)}" for _ in range(n))
    docs = [(i, "\n".join(line(12) for _ in range(10)), "en", "a") for i in range(60)]
    docs += [(100, docs[0][1] + " #", "en", "a"), (101, docs[1][1] + "\n" + docs[1][1].split("\n")[0], "en", "a"), (102, docs[2][1].replace(" ", " #"), "en", "a"), (103, line(60) + " 1234%", "en", "a")]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(frame(spark, docs)).collect()}
    assert [k for k, kept in got.items() if not kept] == [102]


def test_spam_up_to_half_of_a_source_moves_no_fence(spark):
    rnd = random.Random(3)
    text = lambda marks: " ".join(f"{rnd.randint(0, 9**9)}" + "#" * marks for _ in range(100))
    docs = [(i, text(0 if i % 5 < 3 else 2), "en", "a") for i in range(200)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(frame(spark, docs)).collect()}
    assert all(got[i] == (i % 5 < 3) for i in range(200))


def test_verdicts_differ_from_fixed_cutoffs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = quality_rules.quality_rules(docs, carry_text=False).filter("not base_failed")
    fixed = (F.col("n_symbols") <= F.col("n_words") * 0.1) & (F.col("n_repeat_words") <= F.col("n_words") * 0.3)
    # Fifteen: fourteen by word length, and one of 51 words with repeats of 0.31, too few words to tell.
    assert got.filter(F.col("kept") != fixed).count() > 10


def test_labelled_documents(spark):
    """Every labelled document of low quality fails, and of the good ones that pass the base at most one in a hundred."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    got = quality_rules.quality_rules(docs, carry_text=False).filter("not base_failed").join(labels, "doc_id")
    share = {r.quality: r.share for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[0] == 0 and share[1] >= 0.99, share


def test_sketches_merge(spark, rows):
    counted = quality_rules.count_features(frame(spark, rows, extra=False)).select("lang", "source", *quality_rules.COUNTS, "_lf_lines").filter("n_words > 0")
    a = quality_rules.merged(quality_rules.sketch(counted, ["lang", "source"]), ["lang"])
    b = quality_rules.sketch(counted, ["lang"])
    key = lambda d: sorted(map(str, d.select("lang", "feature", "bin", "n").collect()))
    assert key(a) == key(b)
