"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

TARGETS = """
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
    source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
    row_number() OVER (ORDER BY source NULLS LAST) AS rn
  FROM by_source),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / w, rn) AS place
  FROM weighed),
shared AS (SELECT level FROM levels WHERE cap > level * w ORDER BY place LIMIT 1),
targets AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM shared) * w), cap) AS target FROM levels)
"""

OP5 = r"""
WITH pg AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id * 37 % 700)::INT AS fetched,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS host,
    coalesce(nullif(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/') AS path, CASE WHEN path LIKE '%/' THEN path ELSE path || '/' END AS folder
  FROM pages),
hosts AS (SELECT host, ('0x' || substr(md5(host), 1, 6))::INT AS n FROM (SELECT DISTINCT host FROM pg WHERE host <> '')),
urls AS (SELECT u, ('0x' || substr(md5(u), 1, 6))::INT AS n FROM (SELECT DISTINCT host || path AS u FROM pg WHERE host <> '')),
entries AS (
  SELECT 'spam' AS list, 'host:' || host AS key, 'add' AS action, DATE '2024-01-01' + n % 400 AS since FROM hosts WHERE n % 3 = 0
  UNION ALL SELECT 'spam', 'host:' || host, 'remove', DATE '2024-01-01' + (n % 400 + 90) FROM hosts WHERE n % 6 = 0
  UNION ALL SELECT 'spam', 'host:' || host, 'add', DATE '2024-01-01' + (n % 400 + 150) FROM hosts WHERE n % 12 = 0
  UNION ALL SELECT 'adult', 'prefix:' || host || '/en/', 'add', DATE '2024-01-01' + n % 300 FROM hosts WHERE n % 5 = 1
  UNION ALL SELECT 'allow', 'prefix:' || host || '/', 'add', DATE '2024-01-01' + n % 500 FROM hosts WHERE n % 7 = 2
  UNION ALL SELECT 'adult', 'url:' || u, 'add', DATE '2024-01-01' + n % 600 FROM urls WHERE n % 10 = 0),
spans AS (SELECT *, coalesce(lead(since) OVER (PARTITION BY list, key ORDER BY since), DATE '9999-12-31') AS until FROM entries),
keyed AS (
  SELECT page_id, fetched, unnest(list_distinct(
      list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: 'host:' || array_to_string(string_split(host, '.')[i:], '.'))
      || list_transform(range(1, len(string_split(folder, '/'))), lambda i: 'prefix:' || host || array_to_string(string_split(folder, '/')[1:i], '/') || '/')
      || ['url:' || host || path])) AS key
  FROM pg WHERE host <> ''),
hits AS (
  SELECT page_id, string_agg(list || '=' || k.key, ',' ORDER BY list || '=' || k.key) AS hits,
    bool_or(list IN ('spam', 'adult')) AS blocked, bool_or(list = 'allow') AS allowed
  FROM keyed k JOIN spans s ON k.key = s.key AND s.action = 'add' AND s.since <= k.fetched AND k.fetched < s.until GROUP BY page_id)
SELECT pg.page_id, host, fetched, coalesce(hits, '') AS hits, coalesce(NOT blocked OR allowed, true) AS kept
FROM pg LEFT JOIN hits USING (page_id)
"""


WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"


def em_sql(rounds: int = 20, n_rules: int = 7) -> str:
    """CTEs m0 .. m<rounds>: a model row each, from the table patterns (v1 .. v7, n)."""
    rules = range(1, n_rules + 1)
    out = ["m0 AS (SELECT 0.8::DOUBLE AS prior, " + ", ".join(f"0.95::DOUBLE AS g{j}, 0.5::DOUBLE AS b{j}" for j in rules) + ")"]
    for k in range(rounds):
        bad = lambda j: f"((coalesce(sum(CASE WHEN v{j} < 0 THEN n * (1 - p) END), 0) + 5.0::DOUBLE) / (coalesce(sum(CASE WHEN v{j} <> 0 THEN n * (1 - p) END), 0) + 10))"
        good = lambda j: f"((coalesce(sum(CASE WHEN v{j} > 0 THEN n * p END), 0) + 9.5::DOUBLE) / (coalesce(sum(CASE WHEN v{j} <> 0 THEN n * p END), 0) + 10))"
        shares = ", ".join(f"greatest(1 - {bad(j)}, {good(j)}) AS g{j}, {bad(j)} AS b{j}" for j in rules)
        out.append(
            f"m{k + 1} AS MATERIALIZED (SELECT (coalesce(sum(n * p), 0) + 8.0::DOUBLE) / (coalesce(sum(n), 0) + 10) AS prior, {shares} FROM (SELECT patterns.*, {posterior_sql(n_rules)} AS p FROM patterns, m{k}))"
        )
    return ",\n".join(out)


def posterior_sql(n_rules: int = 7) -> str:
    side = lambda up, down: " + ".join(f"CASE WHEN v{j} > 0 THEN ln({up.format(j=j)}) WHEN v{j} < 0 THEN ln({down.format(j=j)}) ELSE 0 END" for j in range(1, n_rules + 1))
    good, bad = side("g{j}", "1 - g{j}"), side("1 - b{j}", "b{j}")
    return f"1 / (1 + exp(least(700.0, (ln(1 - prior) + {bad}) - (ln(prior) + {good}))))"


#: From documents to p, their features, votes and posterior.
QUALITY = f"""
d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, {WORDS.format(t="t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT k, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT k, count(DISTINCT i + s)::BIGINT AS n FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win), range(0, 3) o(s) WHERE c > 1 GROUP BY k),
f AS (SELECT w.k, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals FROM w LEFT JOIN rep USING (k)),
v AS (SELECT *, CASE WHEN n_words < 50 THEN -1 WHEN n_words >= 80 THEN 1 ELSE 0 END AS v1,
  CASE WHEN n_symbols * 10 > n_words THEN -1 WHEN n_symbols * 50 <= n_words THEN 1 ELSE 0 END AS v2,
  CASE WHEN n_symbols * 25 > word_chars THEN -1 WHEN n_symbols * 200 <= word_chars THEN 1 ELSE 0 END AS v3,
  CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN -1 ELSE 0 END AS v4,
  CASE WHEN n_dup_lines * 10 > 3 * n_lines THEN -1 ELSE 0 END AS v5,
  CASE WHEN n_repeat_words * 10 > 3 * n_words THEN -1 ELSE 0 END AS v6,
  CASE WHEN n_capitals * 10 > 3 * word_chars THEN -1 ELSE 0 END AS v7 FROM f),
patterns AS MATERIALIZED (SELECT v1, v2, v3, v4, v5, v6, v7, count(*) AS n FROM v GROUP BY ALL),
{em_sql()},
p AS (SELECT v.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {posterior_sql()} AS p FROM v, m20)
"""

OP2 = f"""
WITH {QUALITY}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept, round(p, 6) AS posterior,
  v1 AS vote_length, v2 AS vote_symbols, v3 AS vote_symbol_share, v4 AS vote_word_length, v5 AS vote_line_repeats, v6 AS vote_word_repeats, v7 AS vote_capitals FROM p
"""

OP3 = f"""
WITH {QUALITY},
sized AS (SELECT d.doc_id, source, n_words AS size, greatest(round(p, 6), 0.01::DOUBLE) AS weight FROM p JOIN d USING (k)),
{TARGETS},
keyed AS (
  SELECT doc_id, s.source, size, source_size, target, round(target)::BIGINT AS whole,
    -ln((('0x' || substr(md5('mix:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / weight AS k
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS first,
    CASE WHEN source_size > 0 THEN whole // source_size ELSE 0 END AS epochs
  FROM keyed)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, whole - epochs * source_size - first)))::BIGINT AS taken,
  source, epochs::BIGINT AS epochs
FROM placed
"""


OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS MATERIALIZED (SELECT l, r FROM (SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL) x
  JOIN n p ON p.doc_id = l JOIN n q ON q.doc_id = r WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(src, dst) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.src, e.r FROM reach JOIN e ON reach.dst = e.l),
c AS (SELECT src AS doc_id, min(dst) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


#: Every break is followed by a mark, so that pieces keep their lengths; the mark is a control character.
OP9 = """
WITH marked AS (SELECT doc_id, regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(10), chr(10) || chr(30)),
    '([.!?…]+)([\\x20\\x09-\\x0D])', '\\1' || chr(30) || '\\2', 'g'), '([。！？]+)', '\\1' || chr(30), 'g') AS t FROM documents),
pieces AS (SELECT doc_id, i, list_sum([0] || list_transform(s[1 : i - 1], lambda x: length(x)))::INT AS off, s[i] AS piece
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(30)) AS s FROM marked))),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS no, off + length(piece) - length(ltrim(piece, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS a,
    off + length(rtrim(piece, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS b, len(words) AS words, array_to_string(words, ' ') AS unit
  FROM (SELECT *, regexp_extract_all(lower(piece), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words FROM pieces) WHERE len(words) > 0),
ranked AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS first_id, first_value(no) OVER w AS first_no FROM units WINDOW w AS (PARTITION BY unit ORDER BY doc_id, a)),
runs AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS run FROM ranked WHERE place > 1),
weighed AS (SELECT *, words >= 4 OR b - a >= 24 OR coalesce(lag(first_id) OVER w = first_id AND lag(first_no) OVER w = first_no - 1, false) OR coalesce(lead(first_id) OVER w = first_id AND lead(first_no) OVER w = first_no + 1, false) AS counts
  FROM runs WINDOW w AS (PARTITION BY doc_id, run ORDER BY no)),
passages AS (SELECT doc_id, min(a) AS a, max(b) AS b, count(*) AS n, list(first_id) AS ids FROM weighed GROUP BY doc_id, run HAVING 2 * sum(words) FILTER (counts) >= sum(words) AND (sum(words) FILTER (counts) >= 20 OR sum(b - a) FILTER (counts) >= 160))
SELECT doc_id, sum(n)::BIGINT AS n_units, sum(b - a)::BIGINT AS n_chars_cut, string_agg(a || ':' || b, ',' ORDER BY a) AS spans, list_sort(list_distinct(flatten(list(ids)))) AS first_ids
FROM passages GROUP BY doc_id
"""


def op6_sql() -> str:
    """Spans from the lengths of matches and of the pieces between them, rule by rule."""
    from pairgraph.llm.secret_scan import BASE_RULES, MORE_RULES

    parts = []
    for no, rule in enumerate(BASE_RULES + MORE_RULES):
        re = rule.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {no} AS no, '{rule.name}' AS kind, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0))::INT AS a, length(m[i]) AS n
  FROM (SELECT doc_id, m, gaps, parts, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{re}') AS m, string_split_regex(t, '{re}') AS gaps, regexp_extract_all(t, '{re}', {rule.group}) AS parts FROM d)) WHERE length(parts[i]) >= {rule.least}""")
    spans = " UNION ALL ".join(parts)
    line = "string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, no)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({spans}),
g AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex, {line} FILTER (no < 3) AS base, {line} AS spans FROM spans GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2, "op3_source_mixing": OP3, "op4_near_duplicates": OP4, "op5_url_filter": OP5, "op6_secret_scan": op6_sql(), "op9_substring_dedup": OP9}
