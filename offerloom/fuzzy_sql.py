"""The fuzzy points of relevance in SQL, for patterns of at most 32 characters.

One round of the recursion allows one more error; within it, a fold goes over
the text from right to left. Lists of bit masks begin at the column where the
fold is, so that the first element is always the column to the right.
"""


def fuzzy(pairs: str) -> str:
    """A query that gives (nm, q, fuzzy) of each distinct row of ``pairs`` (nm, q)."""
    return f"""WITH RECURSIVE z AS (SELECT DISTINCT nm, q, CAST(length(q) AS INT) AS m, CAST(length(nm) AS INT) AS n FROM ({pairs}) WHERE length(nm) > 0 AND length(q) BETWEEN 1 AND 32),
a AS (SELECT *, list_transform(range(1, n + 1), lambda j: list_sum(list_transform(range(1, m + 1), lambda k: CASE WHEN substr(nm, j, 1) = substr(q, k, 1) THEN CAST(pow(2, m - k) AS BIGINT) ELSE 0 END))::BIGINT) AS same,
  CASE WHEN contains(nm, q) THEN least(CAST(0.6 AS DOUBLE), (instr(nm, q) - 1) / CAST(100 AS DOUBLE)) ELSE CAST(0.6 AS DOUBLE) END AS first FROM z),
l AS (SELECT nm, q, m, n, same, 0 AS i, n + m AS reach, []::BIGINT[] AS bits, first AS most, false AS found, CAST(1 AS DOUBLE) AS score FROM a
UNION ALL
SELECT nm, q, m, n, same, i + 1, b, s.bits, s.most, s.found, s.score FROM (
  SELECT *, list_reduce(list_transform(range(least(b, n) + m, 0, -1), lambda j: {{'j': j, 'bits': []::BIGINT[], 'most': most, 'found': found, 'score': score}}),
    lambda acc, x: (
      list_transform([coalesce(((2 * acc.bits[1] + 1) & coalesce(same[x.j], 0)), 0) | CASE WHEN i > 0 THEN (2 * (coalesce(bits[x.j + 1], 0) | coalesce(bits[x.j], 0)) + 1) | coalesce(bits[x.j + 1], 0) ELSE 0 END], lambda v:
        CASE WHEN (v & CAST(pow(2, m - 1) AS BIGINT)) <> 0 THEN {{'j': x.j, 'bits': [v & CAST(pow(2, m) - 1 AS BIGINT)] || acc.bits,
          'most': least(acc.most, i / CAST(m AS DOUBLE) + (x.j - 1) / CAST(100 AS DOUBLE)), 'found': acc.found OR i / CAST(m AS DOUBLE) + (x.j - 1) / CAST(100 AS DOUBLE) <= acc.most, 'score': i / CAST(m AS DOUBLE) + (x.j - 1) / CAST(100 AS DOUBLE)}}
        ELSE {{'j': x.j, 'bits': [v & CAST(pow(2, m) - 1 AS BIGINT)] || acc.bits, 'most': acc.most, 'found': acc.found, 'score': acc.score}} END))[1],
    {{'j': CAST(0 AS BIGINT), 'bits': [CAST(pow(2, i) - 1 AS BIGINT)], 'most': most, 'found': found, 'score': score}}) AS s
  FROM (SELECT *, CAST(least(reach, greatest(0, len(list_filter(range(0, 101), lambda d: i / CAST(m AS DOUBLE) + d / CAST(100 AS DOUBLE) <= most)) - 1)) AS INT) AS b FROM l WHERE i < m AND i / CAST(m AS DOUBLE) <= most)))
SELECT p.nm, p.q, CASE WHEN p.nm = p.q AND length(p.nm) > 0 THEN CAST(15 AS DOUBLE) WHEN e.found THEN (CAST(1 AS DOUBLE) - pow(greatest(CAST(0.001 AS DOUBLE), e.score), floor(1000 / sqrt(len(list_filter(string_split(p.nm, ' '), lambda w: w <> ''))) + 0.5) / CAST(1000 AS DOUBLE))) * 15 ELSE CAST(0 AS DOUBLE) END AS fuzzy
FROM (SELECT DISTINCT nm, q FROM ({pairs})) p LEFT JOIN (SELECT nm, q, arg_max(found, i) AS found, arg_max(score, i) AS score FROM l GROUP BY nm, q) e ON p.nm = e.nm AND p.q = e.q"""
