"""SQL for the queries of this subpackage that SQL can express, run by another engine over the same tables."""

from __future__ import annotations

from .quality_rules import BITS, PRIOR, RANGES, SCALE, WIDTH
from .sharding import PRIME, ROUNDS

SPACE = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '')"


def permuted(source: str, columns: str, seed: int = 42) -> str:
    """One pass of the Feistel network over column p of ``source``."""
    q = f"SELECT {columns}, n, side, p // side AS l, p % side AS r FROM {source}"
    for a, b, c in ROUNDS:
        b = (b + seed) % PRIME
        q = f"SELECT {columns}, n, side, l, r, (r * {a} + {b}) % {PRIME} AS t FROM ({q})"
        q = f"SELECT {columns}, n, side, l, r, (t * t + {c}) % {PRIME} AS t FROM ({q})"
        q = f"SELECT {columns}, n, side, r AS l, (l + (t * t + {b}) % {PRIME}) % side AS r FROM ({q})"
    return f"SELECT {columns}, n, side, l * side + r AS p FROM ({q})"


COLUMNS = "doc_id, size, text_crc32, row_no"
SHARDING = f"""
WITH RECURSIVE hexed AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
steps AS (SELECT doc_id, size, flatten(list_transform(range(0, length(h) // 2), lambda i: [('0x' || substr(h, (2 * i + 1)::INTEGER, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])) AS b FROM hexed),
summed AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS text_crc32 FROM steps),
numbered AS (SELECT *, row_number() OVER (ORDER BY md5(coalesce('=' || doc_id, '-') || '|=' || size || '|=' || text_crc32)) - 1 AS row_no, count(*) OVER () AS n FROM summed),
placed AS (SELECT *, row_no AS p, ceil(sqrt(n))::BIGINT AS side FROM numbered),
walk AS ({permuted("placed", COLUMNS)} UNION ALL {permuted("walk WHERE p >= n", COLUMNS)})
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % 8)::INTEGER AS shard, p // 8 AS slot, NULL::INTEGER AS grown_shard FROM walk WHERE p < n
"""

URL_FILTERS = r"""
WITH seen AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INTEGER AS fetched, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host,
  list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?', 1), '/'), lambda x: x <> '') AS seg FROM pages),
hosts AS (SELECT host, ('0x' || substr(md5(host), 1, 8))::BIGINT AS k FROM (SELECT DISTINCT host FROM seen WHERE host <> '')),
parents AS (SELECT host, ('0x' || substr(md5(host), 1, 8))::BIGINT AS k FROM (SELECT DISTINCT substr(host, instr(host, '.') + 1) AS host FROM hosts WHERE len(string_split(host, '.')) > 2)),
tops AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 8))::BIGINT AS k FROM (SELECT DISTINCT host || '/' || seg[1] AS pattern FROM seen WHERE host <> '' AND len(seg) > 0)),
entries AS (SELECT host AS pattern, 'block' AS action, k % 180 AS d FROM parents UNION ALL SELECT host, NULL, k % 180 + 90 FROM parents UNION ALL SELECT host, 'allow', k % 200 + 20 FROM hosts WHERE k % 3 = 0
  UNION ALL SELECT host, 'block', k % 300 FROM hosts WHERE k % 3 = 1 UNION ALL SELECT host, 'allow', k % 300 + 45 FROM hosts WHERE k % 6 = 1
  UNION ALL SELECT pattern, 'block', k % 250 FROM tops WHERE k % 5 = 0 UNION ALL SELECT pattern, NULL, k % 250 + 70 FROM tops WHERE k % 10 = 0),
dated AS (SELECT pattern, DATE '2024-01-01' + d::INTEGER AS since, max(action) AS action FROM entries GROUP BY 1, 2),
spans AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM dated),
hits AS (SELECT s.page_id, e.pattern, e.action, CASE WHEN contains(e.pattern, '/') THEN 1001 + len(string_split(e.pattern, '/')) - 1 ELSE len(string_split(e.pattern, '.')) END AS rank
  FROM seen s JOIN spans e ON e.action IS NOT NULL AND s.fetched >= e.since AND (e.until IS NULL OR s.fetched < e.until)
    AND (s.host = e.pattern OR (NOT contains(e.pattern, '/') AND ends_with(s.host, '.' || e.pattern)) OR starts_with(s.host || '/' || array_to_string(s.seg, '/') || '/', CASE WHEN contains(e.pattern, '/') THEN e.pattern || '/' END)) WHERE s.host <> ''),
best AS (SELECT page_id, arg_max(pattern, (rank, pattern)) AS rule, arg_max(action, (rank, pattern)) AS rule_action FROM hits GROUP BY 1)
SELECT page_id, url, fetched::VARCHAR AS fetched, host, rule, rule_action, coalesce(rule_action <> 'block', true) AS url_kept FROM seen LEFT JOIN best USING (page_id)
"""

MIXING = f"""
WITH sized AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size, length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>!', '')) AS marks,
  md5('42|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))) AS h FROM documents),
keyed AS (SELECT *, -ln((('0x' || substr(h, 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE) / CASE WHEN size > 0 THEN size::DOUBLE / (size + marks * 5) ELSE 1 END AS key FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
weighed AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w, source_size * 2::DOUBLE AS cap FROM sources),
ranked AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS pos, sum(source_size) OVER () * 1.5::DOUBLE AS whole FROM weighed),
levels AS (SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
first AS (SELECT min(pos) AS pos, arg_min(level, pos) AS level FROM levels WHERE level * w <= cap),
goals AS (SELECT s.source, source_size, CASE WHEN f.pos IS NULL OR s.pos < f.pos THEN cap ELSE f.level * w END AS target FROM levels s, first f),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS laps FROM goals),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, h ROWS UNBOUNDED PRECEDING) - size / 2::DOUBLE AS middle FROM keyed)
SELECT doc_id, size, source_size, target, ((laps + CASE WHEN middle <= target - laps * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM summed k JOIN epochs e ON k.source IS NOT DISTINCT FROM e.source
"""

SUFFIXES = f"""
WITH worded AS (SELECT row_number() OVER () AS row, doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT row, w, unnest(range(0, len(w) - 50)) AS s FROM worded WHERE len(w) > 50),
runs AS (SELECT row, s, md5(array_to_string(w[s + 1 : s + 51], ' ')) AS run FROM starts),
twice AS (SELECT row, s FROM runs QUALIFY count(*) OVER (PARTITION BY run) > 1),
marked AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY row ORDER BY s) <= 51 THEN 0 ELSE 1 END AS new FROM twice),
islands AS (SELECT row, s, sum(new) OVER (PARTITION BY row ORDER BY s) AS island FROM marked),
spans AS (SELECT row, island, min(s) AS a, max(s) + 51 AS b FROM islands GROUP BY 1, 2),
listed AS (SELECT row, sum(b - a)::BIGINT AS repeated_words, count(*) AS n_spans, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM spans GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(repeated_words, 0) AS repeated_words, coalesce(n_spans, 0) AS n_spans, coalesce(spans, '') AS spans FROM worded LEFT JOIN listed USING (row)
"""

def share_bound(count: str, size: str, event: int, sign: str) -> str:
    """Wilson's bound of a share in millionths."""
    c, n, square = f"({count} / {float(event)}::DOUBLE)", f"(greatest({size}, 1) / {float(event)}::DOUBLE)", float(WIDTH * WIDTH)
    spread = f"sqrt({c} * ({n} - {c}) / {n} + {square / 4}::DOUBLE) * {sign}{float(WIDTH)}::DOUBLE"
    return f"floor({float(SCALE)}::DOUBLE * ({c} + {square / 2}::DOUBLE + {spread}) / ({n} + {square}::DOUBLE))::BIGINT"


VALUES = {
    **{k + end: share_bound(*of, sign) for end, sign in (("", ""), ("_low", "-")) for k, of in {"symbols": ("n_symbols", "word_chars", 1), "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", 6)}.items()},
    "word_length": f"{SCALE} * word_chars // greatest(n_words, 1)",
    "words": "n_words",
}
SKETCHED = "symbols, dup_lines, repeats, word_length, words"


def quartile_mix(k: int) -> str:
    """Quartile k of a group, its language's and all documents', the latter two as a prior."""
    lang = f"(g.n * g.q{k} + {float(PRIOR)}::DOUBLE * h.q{k}) / (g.n + {float(PRIOR)}::DOUBLE)"
    return f"(f.n * f.q{k} + {float(PRIOR)}::DOUBLE * ({lang})) / (f.n + {float(PRIOR)}::DOUBLE) AS q{k}"


WIDE = f"{float(2 * RANGES + 1)}::DOUBLE"
QUALITY = f"""
WITH worded AS (SELECT row_number() OVER () AS row, doc_id, lang, source, {WORDS} AS w, length(regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g')) AS word_chars,
  length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS n_symbols, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
grams AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM worded WHERE len(w) > 2)),
again AS (SELECT row, i FROM grams QUALIFY count(*) OVER (PARTITION BY row, g) > 1),
covered AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY 1),
counted AS (SELECT row, doc_id, lang, source, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM worded LEFT JOIN covered USING (row)),
valued AS (SELECT *, {", ".join(f"{e} AS {k}" for k, e in VALUES.items())} FROM counted),
long AS (SELECT lang, source, feature, v, greatest(length(bin(v)) - {BITS}, 0)::INTEGER AS past FROM (SELECT lang, source, {SKETCHED} FROM valued WHERE n_words > 0) UNPIVOT (v FOR feature IN ({SKETCHED}))),
levels AS (SELECT 0 AS level, lang, source, feature, (v >> past) << past AS bin FROM long UNION ALL SELECT 1, lang, NULL, feature, (v >> past) << past FROM long UNION ALL SELECT 2, NULL, NULL, feature, (v >> past) << past FROM long),
ordered AS (SELECT *, row_number() OVER (PARTITION BY level, lang, source, feature ORDER BY bin) AS r, count(*) OVER (PARTITION BY level, lang, source, feature) AS n FROM levels),
quartiles AS (SELECT level, lang, source, feature, max(n)::DOUBLE AS n, (min(bin) FILTER (r * 4 >= n))::DOUBLE AS q1, (min(bin) FILTER (r * 4 >= 2 * n))::DOUBLE AS q2, (min(bin) FILTER (r * 4 >= 3 * n))::DOUBLE AS q3 FROM ordered GROUP BY ALL),
shrunk AS (SELECT f.lang, f.source, f.feature, {", ".join(quartile_mix(k) for k in (1, 2, 3))}
  FROM quartiles f JOIN quartiles g ON g.level = 1 AND f.lang IS NOT DISTINCT FROM g.lang AND f.feature = g.feature JOIN quartiles h ON h.level = 2 AND f.feature = h.feature WHERE f.level = 0),
stepped AS (SELECT *, {float(SCALE)}::DOUBLE / greatest(max(q2) FILTER (feature = 'words') OVER (PARTITION BY lang, source), 1::DOUBLE) AS step FROM shrunk),
chosen AS (SELECT lang, source, feature, q2 - greatest(q3 - q2, step) * {WIDE} AS lo, CASE feature WHEN 'word_length' THEN q2 + greatest(q2 - q1, step) * {WIDE} ELSE q2 * 2::DOUBLE - q1 END AS hi FROM stepped),
judged AS (SELECT b.row, bool_or(CASE c.feature WHEN 'symbols' THEN symbols_low > hi WHEN 'dup_lines' THEN dup_lines_low > hi WHEN 'repeats' THEN repeats_low > hi WHEN 'word_length' THEN word_length > hi OR word_length < lo END) AS failed
  FROM valued b JOIN chosen c ON b.lang IS NOT DISTINCT FROM c.lang AND b.source IS NOT DISTINCT FROM c.source GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(failed, false) AS kept FROM counted LEFT JOIN judged USING (row)
"""

COLLOCATIONS = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
occurring AS (SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: w[i : i + k - 1])) AS ws FROM pieces, range(1, 4) t(k)),
freq AS (SELECT lang, k, array_to_string(ws, ' ') AS phrase, any_value(ws) AS ws, count(*) AS f FROM occurring GROUP BY lang, k, array_to_string(ws, ' ')),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM freq WHERE k = 1 GROUP BY lang),
found AS (SELECT lang, k, phrase, ws, f AS a FROM freq WHERE k > 1 AND f >= 10),
longer AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase FROM found WHERE k = 3) GROUP BY lang, phrase),
kept AS (SELECT f.* FROM found f LEFT JOIN longer m ON f.lang = m.lang AND f.phrase = m.phrase WHERE most IS NULL OR 100 * most < 50 * a),
cuts AS (SELECT lang, phrase, a, c, array_to_string(ws[1:c], ' ') AS head, array_to_string(ws[c + 1:], ' ') AS rest FROM kept, range(1, 3) t(c) WHERE c < k),
scored AS (SELECT c.lang, c.phrase, a, c, h.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (h.f::HUGEINT * r.f) AS score FROM cuts c JOIN freq h ON c.lang = h.lang AND c.head = h.phrase JOIN freq r ON c.lang = r.lang AND c.rest = r.phrase),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM best b JOIN sizes s ON b.lang = s.lang
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": SHARDING, "op2_url_filters": URL_FILTERS, "op3_mixing": MIXING, "op4_suffix_dedup": SUFFIXES, "op10_quality_rules": QUALITY, "op12_collocations": COLLOCATIONS}
