"""DuckDB SQL for the queries that SQL can express, over the same whole tables."""

from sheetloom.llm.url_filter import LEAST_GOOD, RULES, SECOND_LEVEL, STRONGEST, WEAKEST, Z

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d),
counted AS (SELECT r, k, count(*) OVER (PARTITION BY array_to_string(w[k:k + 34], ' ')) AS m FROM starts),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS j FROM counted WHERE m > 1),
spread AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS s FROM spread ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

_NGRAM_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS k FROM d),
shingles AS (SELECT DISTINCT r, array_to_string(w[k:k + 4], ' ') AS s FROM starts),
sets AS (SELECT r, count(*) AS n, sha256(string_agg(s, chr(10) ORDER BY s)) AS c FROM shingles GROUP BY r),
classes AS (SELECT c, min(r) AS r, any_value(n) AS n, min(doc_id) AS least_id FROM sets JOIN d USING (r) GROUP BY c),
theirs AS (SELECT c, n, s FROM shingles JOIN classes USING (r)),
common AS (SELECT a.c AS x, b.c AS y, a.n AS m, b.n AS n, count(*) AS i FROM theirs a JOIN theirs b ON a.s = b.s AND a.c <> b.c GROUP BY ALL),
links AS (SELECT x, y FROM common WHERE 100 * i >= 80 * (m + n - i)),
reach AS (SELECT c AS x, c AS y FROM classes UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x AS c, min(least_id) AS component_id FROM reach JOIN classes ON classes.c = reach.y GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN doc_id ELSE component_id END AS component_id
FROM d LEFT JOIN sets USING (r) LEFT JOIN least USING (c)
"""

_DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_PLAIN}) AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER}, {_PLAIN}) AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 13) AS z FROM items WHERE len(w) > 0),
item_starts AS (SELECT item, w, z, unnest(range(1, len(w) - z + 2)) AS k FROM sized),
windows AS (SELECT DISTINCT item, z, array_to_string(w[k:k + z - 1], ' ') AS s FROM item_starts),
doc_starts AS (SELECT r, w, z, unnest(range(1, len(w) - z + 2)) AS k FROM d, (SELECT DISTINCT z FROM windows)),
found AS (SELECT r, k, z, item FROM (SELECT r, k, z, array_to_string(w[k:k + z - 1], ' ') AS s FROM doc_starts) JOIN windows USING (z, s)),
hits AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(k, k + z)) AS j FROM found) GROUP BY r),
whose AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(whose.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN whose USING (r)
"""

_HOST = "coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"


def _strength(stats: str) -> str:
    """Pages that a prior counts for, by moments, from a table of n, good and mean."""
    return f"""(SELECT CASE WHEN n IS NULL OR n = 0 OR v = 0 OR g < 2 OR n <= g THEN {WEAKEST}
WHEN (s / (v / n) - g) / (n - g) <= 1 / ({STRONGEST} + 1) THEN {STRONGEST}
ELSE least(greatest(1 / ((s / (v / n) - g) / (n - g)) - 1, {WEAKEST}), {STRONGEST}) END::DOUBLE AS m
FROM (SELECT sum(n)::DOUBLE AS n, count(*) AS g, sum(mean * (1 - mean) * n) AS v, sum((good - n * mean) ** 2 / n) AS s FROM {stats}))"""


def _bound(mean: str, count: str) -> str:
    return f"{mean} - {Z!r} * sqrt({mean} * (1 - {mean}) / ({count} + 1))"


def _rule() -> tuple[str, str]:
    """The longest rule that fits and its verdict, as expressions."""
    cases = []
    for rule, says in sorted(RULES, key=lambda r: -len(r[0])):
        own, slash, start = rule.partition("/")
        cases.append((f"WHEN (host = '{own}' OR suffix(host, '.{own}')) AND prefix(path, '{slash}{start}') THEN", rule, says))
    return tuple("CASE " + " ".join(f"{c[0]} '{c[k]}'" for c in cases) + " END" for k in (1, 2))


_URL_FILTER = rf"""
WITH urls AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
    FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages)),
names AS (SELECT host, l, CASE WHEN len(l) > 2 AND length(l[-1]) = 2 AND l[-2] IN {SECOND_LEVEL} THEN 2 ELSE 1 END AS k
    FROM (SELECT host, string_split(host, '.') AS l FROM (SELECT DISTINCT host FROM urls))),
parts AS (SELECT host, array_to_string(l[greatest(len(l) - k, 1):], '.') AS domain, array_to_string(l[greatest(len(l) - k + 1, 1):], '.') AS suffix FROM names),
labelled AS (SELECT host, (quality = 1 AND toxic = 0)::INT AS good FROM labels JOIN urls ON page_id = doc_id WHERE (quality = 1 AND toxic = 0) IS NOT NULL),
hosts AS (SELECT host, domain, suffix, count(*) AS n, sum(good) AS good FROM labelled JOIN parts USING (host) GROUP BY ALL),
overall AS (SELECT CASE WHEN count(*) > 0 THEN (sum(good) + 1) / (sum(n) + 2) ELSE 0.5 END::DOUBLE AS p FROM hosts),
s1 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(p) AS mean FROM hosts, overall GROUP BY suffix),
m1 AS {_strength("s1")},
suffixes AS (SELECT suffix, (good + m * mean) / (n + m) AS own FROM s1, m1),
s2 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good, any_value(own) AS mean FROM hosts JOIN suffixes USING (suffix) GROUP BY ALL),
m2 AS {_strength("s2")},
domains AS (SELECT domain, (good + m * mean) / (n + m) AS own FROM s2, m2),
s3 AS (SELECT host, n, good, own AS mean FROM hosts JOIN domains USING (domain)),
m3 AS {_strength("s3")},
host_bounds AS (SELECT host, {_bound("own", "(n + m)")} AS b FROM (SELECT host, n, m, (good + m * mean) / (n + m) AS own FROM s3, m3)),
domain_bounds AS (SELECT domain, {_bound("own", "m")} AS b FROM domains, m3),
suffix_bounds AS (SELECT suffix, {_bound("own", "m")} AS b FROM suffixes, m2),
bounds AS (SELECT host, coalesce(h.b, d.b, s.b, {_bound("p", "m")}) AS b FROM parts LEFT JOIN host_bounds h USING (host)
    LEFT JOIN domain_bounds d USING (domain) LEFT JOIN suffix_bounds s USING (suffix), overall, m1)
SELECT page_id, host, path, {_rule()[0]} AS rule, coalesce({_rule()[1]}, CASE WHEN b >= {LEAST_GOOD} THEN 'allow' ELSE 'block' END) AS verdict
FROM urls JOIN bounds USING (host)
"""

SQL: dict[str, str] = {
    "op1_url_filter": _URL_FILTER,
    "op3_substring_dedup": _SUBSTRING_DEDUP,
    "op7_ngram_jaccard": _NGRAM_JACCARD,
    "op10_decontamination": _DECONTAMINATION,
}
