"""Queries on terms and phrases, and their SQL: ranked search, quality classes, collocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import classify, collocations, search
from .common import table


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op11_ranked_search, op12_quality_classes, op13_collocations)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
totals AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM d WHERE len(ts) > 0),
i AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS}) AS ts FROM benchmark),
q AS (SELECT i, unnest(ts) AS term FROM i),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, totals GROUP BY term, docs),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(ts)::BIGINT * docs) // terms AS m FROM d, totals WHERE len(ts) > 0),
s AS (SELECT i, p.r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN p ON q.term = p.term JOIN w ON w.term = p.term JOIN m ON m.r = p.r GROUP BY ALL),
k AS (SELECT i, doc_id, score, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s JOIN d ON s.r = d.r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k JOIN i ON k.i = i.i WHERE rank <= 50
"""

_OP13 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
sizes AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= {collocations.LEAST}),
inner_of AS (SELECT lang, array_to_string(ws[b:b + n - 1], ' ') AS phrase, max(a) AS longest FROM c, (VALUES (2), (3)) AS u(n), (VALUES (1), (2), (3)) AS v(b) WHERE n < k AND b + n - 1 <= k GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inner_of i ON c.lang = i.lang AND c.phrase = i.phrase WHERE longest IS NULL OR 100::HUGEINT * longest < {collocations.COVERED}::HUGEINT * a),
cuts AS (SELECT c.lang, c.phrase, c.a, j, x.a AS l, y.a AS r, 2000000::HUGEINT * c.a // (x.a + y.a) AS score FROM kept c, (VALUES (1), (2), (3)) AS v(j), f x, f y
  WHERE j < c.k AND x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ') AND y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best JOIN sizes ON best.lang = sizes.lang QUALIFY row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, phrase) <= {collocations.MOST_RANKED}
"""

SQL = {"op11_ranked_search": _OP11, "op13_collocations": _OP13}
