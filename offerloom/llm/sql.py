"""DuckDB SQL for the rows of the registered queries that SQL can express."""

from __future__ import annotations

from . import license_scan, lm_score, quality, word_score

_WORDS = r"list_filter(string_split_regex({}, '[ \t-\r]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHINGLES = "list_distinct(list_transform(range(1, len({w}) - {k} + 2), lambda i: array_to_string(list_slice({w}, i, i + {k} - 1), ' ')))"


def contained_items(k: int, threshold: float) -> str:
    words, shingles = _WORDS.format(_LOWER.format("text")), _SHINGLES.format(w="w", k="k")
    return f"""
WITH i AS (SELECT item_id, w, least(len(w), {k}) AS k FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
t AS (SELECT DISTINCT item_id, k, unnest({shingles}) AS s FROM i),
n AS (SELECT item_id, count(*) AS n_shingles FROM t GROUP BY item_id),
d AS (SELECT doc_id, w, k FROM (SELECT doc_id, {words} AS w FROM documents), (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
o AS (SELECT DISTINCT doc_id, k, unnest({shingles}) AS s FROM d),
h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM o JOIN t USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM h JOIN n USING (item_id) WHERE n_shared / n_shingles >= {threshold}"""


def revisits(least_bytes: int) -> str:
    again = f"payload_bytes >= {least_bytes} AND first <> page_id"
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN {again} THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN {again} THEN first END AS refers_to FROM f"""


def quality_rules(risk: float) -> str:
    words, w = _WORDS.format("coalesce(text, '')"), quality.WINDOW
    ratios = {r: "coalesce({} / nullif({}, 0), 0)".format(*e.split(" / ")) for r, e in quality.RULES.items()}
    scores = " UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, {e} AS score FROM holdout" for r, e in ratios.items())
    over = " OR ".join(f"coalesce({e} > (SELECT cutoff FROM cuts c WHERE c.stratum = s.stratum AND c.rule = '{r}'), false)" for r, e in ratios.items())
    grid = ", ".join(f"({i}, {c})" for i, c in enumerate(quality.GRID))
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, {words} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \\t-\\r]')) AS l FROM documents),
j AS (SELECT *, array_to_string(w, '') AS joined FROM t),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {w - 1}), ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - {w - 2})) AS i FROM t WHERE len(w) >= {w})),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range({w}) AS r(o) GROUP BY doc_id),
s0 AS (SELECT doc_id, lang, len(w) AS n_words, length(joined) AS word_chars, length(regexp_replace(joined, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(joined, '[^A-Z]', '', 'g')) AS n_capitals, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM j LEFT JOIN rep USING (doc_id)),
s1 AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s0),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
h0 AS (SELECT * FROM s1 SEMI JOIN good USING (doc_id) WHERE NOT base_failed),
own AS (SELECT lang FROM h0 GROUP BY lang HAVING count(*) >= greatest(1, (SELECT count(*) FROM h0) * {quality.LEAST_STRATUM})),
s AS (SELECT s1.*, CASE WHEN own.lang IS NULL THEN 'other' ELSE '=' || own.lang END AS stratum FROM s1 LEFT JOIN own ON s1.lang = own.lang),
holdout AS (SELECT s.* FROM s SEMI JOIN good USING (doc_id) WHERE NOT base_failed),
scores AS ({scores}),
grid AS (SELECT * FROM (VALUES {grid}) AS g(i, c)),
tests AS (SELECT stratum, rule, i, c, count(*) AS n, count(*) FILTER (WHERE score > c) AS k FROM scores, grid GROUP BY stratum, rule, i, c),
tails AS (SELECT *, CASE WHEN k > n * {risk} THEN 1 ELSE list_sum(list_transform(range(k + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({risk}) + (n - x) * ln(1 - {risk})))) END AS p FROM tests),
stops AS (SELECT *, min(CASE WHEN p > {quality.DELTA} / (SELECT greatest(1, count(DISTINCT stratum) * {len(quality.RULES)}) FROM holdout) THEN i END) OVER (PARTITION BY stratum, rule) AS stop FROM tails),
cuts AS (SELECT stratum, rule, arg_max(c, i) AS cutoff FROM stops WHERE stop IS NULL OR i < stop GROUP BY stratum, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept FROM s"""


def backoff_scores() -> str:
    order, steps = lm_score.ORDER, []
    for k in range(1, order + 1):
        steps.append(f"n{k} AS (SELECT right(g, {2 * k}) AS g, count(*) AS n FROM b GROUP BY ALL)")
        if k == 1:
            steps.append("s1 AS (SELECT g, n / (SELECT sum(n) FROM n1) AS s FROM n1)")
        else:
            steps.append(f"c{k} AS (SELECT left(g, {2 * k - 2}) AS c, sum(n) AS a FROM n{k} GROUP BY ALL)")
            steps.append(f"s{k} AS (SELECT n{k}.g, CASE WHEN n >= {lm_score.MIN_COUNT} THEN n / a ELSE {lm_score.BACKOFF} * s{k - 1}.s END AS s FROM n{k} JOIN c{k} ON c = left(n{k}.g, {2 * k - 2}) JOIN s{k - 1} ON s{k - 1}.g = right(n{k}.g, {2 * k - 2}))")
    return f"""
WITH h AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, '{"00" * (order - 1)}' || hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, substr(h, CAST(2 * i + 1 AS BIGINT), {2 * order}) AS g FROM (SELECT doc_id, h, unnest(range(n_bytes)) AS i FROM h)),
{", ".join(steps)},
r AS (SELECT doc_id, sum(ln(s)) AS x FROM b JOIN s{order} USING (g) GROUP BY doc_id)
SELECT doc_id, n_bytes, round(coalesce(x, 0), 4) AS log_score, round(coalesce(x, 0) / nullif(n_bytes, 0), 6) AS mean_log_score FROM h LEFT JOIN r USING (doc_id)"""


def word_scores() -> str:
    words, f, least = _WORDS.format("coalesce(text, '')"), word_score.BACKOFF, word_score.MIN_COUNT
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
t AS (SELECT r, unnest(w) AS c, unnest(list_concat([NULL], w)) AS b, unnest(list_concat([NULL, NULL], w)) AS a FROM d),
g AS (SELECT r, c, b, b || ' ' || c AS bc, a || ' ' || b AS ab, a || ' ' || b || ' ' || c AS abc FROM t WHERE c IS NOT NULL),
n AS (SELECT g, count(*)::DOUBLE AS n FROM (SELECT c AS g FROM g UNION ALL SELECT bc FROM g UNION ALL SELECT abc FROM g) WHERE g IS NOT NULL GROUP BY g),
s AS (SELECT r, CASE WHEN n3.n >= {least} THEN n3.n / nab.n ELSE CASE WHEN abc IS NULL THEN 1 ELSE {f} END
  * CASE WHEN n2.n >= {least} THEN n2.n / nb.n ELSE CASE WHEN bc IS NULL THEN 1 ELSE {f} END * n1.n / (SELECT count(*) FROM g) END END AS s
  FROM g JOIN n n1 ON n1.g = c LEFT JOIN n nb ON nb.g = b LEFT JOIN n n2 ON n2.g = bc LEFT JOIN n nab ON nab.g = ab LEFT JOIN n n3 ON n3.g = abc),
x AS (SELECT r, sum(ln(s)) AS x FROM s GROUP BY r)
SELECT doc_id, len(w) AS n_words, round(coalesce(x, 0), 4) AS log_score, round(coalesce(x, 0) / nullif(len(w), 0), 6) AS mean_log_score FROM d LEFT JOIN x USING (r)"""


def license_matches() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(n)}, {i}, {quoted(t)})" for n, texts in license_scan.TEMPLATES.items() for i, t in enumerate(texts))
    words = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    d = license_scan.THRESHOLD
    return f"""
WITH k AS (SELECT license, version, {pairs} AS p FROM (SELECT license, version, {words.format("body")} AS w FROM (VALUES {known}) AS v(license, version, body))),
u AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), string_split_regex(text, '{license_scan.DIVIDER}'), [text]))) AS unit FROM documents WHERE text IS NOT NULL),
q AS (SELECT doc_id, unit, {pairs} AS p FROM (SELECT doc_id, unit, {words.format("unit")} AS w FROM u)),
f AS (SELECT doc_id, unit, len(p) AS a, unnest(p) AS pair FROM q WHERE len(p) BETWEEN 1 AND (SELECT max(len(p)) FROM k) * {2 - d} / {d}),
m AS (SELECT doc_id, unit, license, version, 2 * count(*) / (a + b) AS dice FROM f JOIN (SELECT license, version, len(p) AS b, unnest(p) AS pair FROM k) USING (pair) GROUP BY doc_id, unit, license, version, a, b HAVING 2 * count(*) / (a + b) >= {d}),
best AS (SELECT doc_id, unit, max(dice) AS dice, arg_min(license, (-dice, license)) AS license FROM m GROUP BY doc_id, unit)
SELECT doc_id, license, count(*) AS n_units, max(dice) AS dice FROM best GROUP BY doc_id, license"""


def near_duplicates(k: int, percent: int) -> str:
    words, shingles = _WORDS.format(_LOWER.format("text")), _SHINGLES.format(w="w", k=f"least(len(w), {k})")
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort({shingles}) END AS h FROM d),
c AS (SELECT h, min(doc_id) AS rep FROM s WHERE len(h) > 0 GROUP BY h),
x AS (SELECT rep, len(h) AS n, unnest(h) AS g FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT rep AS node, rep AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a WHERE r.root < e.b),
o AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, len(s.h) AS n_shingles, coalesce(o.root, s.doc_id) AS component_id, coalesce(o.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.h = c.h LEFT JOIN o ON o.node = c.rep"""


def ranked_search(k: int) -> str:
    """Every document scored for every item, in whole numbers."""
    terms = lambda table, key: f"SELECT {key}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM {table}"
    return f"""WITH d AS ({terms("documents", "doc_id")}), b AS ({terms("benchmark", "item_id")}),
s AS (SELECT count(*) FILTER (len(t) > 0) AS big_n, sum(len(t)) AS big_l FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term, big_n),
i AS (SELECT DISTINCT item_id, unnest(t) AS term FROM b),
r AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * big_n) // big_l))))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL HAVING score > 0),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM r)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {k}"""
