"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, html_text, idfiles, lines, mixing, packing, quality, queries_text, secrets, simhash, urls
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == list(secrets.KINDS).index(kind))).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in secrets.BASE], F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"), "n_live", "n_example", "most_owners", "most_repos")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_boilerplate(table(spark, sf_dir, "documents"), distinct=True, most=0.5)
    return out.select("doc_id", "source", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), "text")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    led = quality.apply_policy(quality.ledger(docs, stems=quality.learn_stems(docs, table(spark, sf_dir, "labels"))))
    own = [F.col(f"measures.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return led.select("doc_id", *own, (F.col("failed").bitwiseAND(F.lit(quality.BASE_MASK)) != 0).alias("base_failed"), "kept", F.col("failed").alias("failed_bits"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.seed_model()).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = idfiles.round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (op1_secret_scan, op2_line_dedup, op3_fingerprints, op4_best_fit_packing, op5_simhash, op6_quality_rules, op7_url_filter, op8_source_mixing, op9_token_files, op10_html_text)
} | queries_text.QUERIES
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _op1() -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = list(secrets.KINDS)
    found = " UNION ALL ".join(f"SELECT r, {i} AS kind, string_split_regex(t, {q(p)}) AS gaps, regexp_extract_all(t, {q(p)}, 0) AS ms, regexp_extract_all(t, {q(p)}, {g}) AS vs FROM d" for i, (p, g, _) in enumerate(secrets.KINDS.values()))
    passes = " OR ".join(f"kind = {i} AND length(v) >= {n}" + "".join(f" AND regexp_matches(v, {q(h)})" for h in secrets.HOLDS.get(k, ())) for i, (k, (_, _, n)) in enumerate(secrets.KINDS.items()))
    listed = f"string_agg([{', '.join(map(q, kinds))}][kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind)"
    n = len(secrets.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
m AS ({found}),
e AS (SELECT r, kind, gaps, ms, vs, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (SELECT r, kind, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(ms[i]) AS n, vs[i] AS v FROM e),
f AS (SELECT r, kind, a, a + n AS b, sha256(v) AS h FROM s WHERE {passes}),
owned AS (SELECT h, count(DISTINCT owner) AS owners, count(DISTINCT (owner, t)) AS repos, count(DISTINCT CASE WHEN owner = '' THEN t END) AS unowned FROM f JOIN d ON f.r = d.r GROUP BY h),
g AS (SELECT f.*, owners, repos, owners <= {secrets.MOST_OWNERS} AND unowned <= {secrets.MOST_REPOS} AS live FROM f JOIN owned ON f.h = owned.h),
per AS (SELECT r, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(secrets.BASE))}, {listed} FILTER (kind < {n}) AS base, {listed} FILTER (kind < {n} OR live) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, max(owners) AS most_owners, max(repos) AS most_repos FROM g GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN per ON d.r = per.r
"""


_HAS_WORD = r"regexp_matches({}, '[^\x20\x09-\x0D]')"

_OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT DISTINCT source, text, line FROM (SELECT source, text, unnest(ls) AS line FROM d) WHERE {_HAS_WORD.format("line")}),
totals AS (SELECT source, count(*) AS pages FROM (SELECT DISTINCT source, text FROM d) GROUP BY source),
bad AS (SELECT c.source, list(line) AS drops FROM (SELECT source, line, count(*) AS n FROM lines GROUP BY source, line) c
  JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= {lines.MIN_PAGES} AND n > {lines.RATIO}::DOUBLE * pages GROUP BY c.source),
f AS (SELECT doc_id, d.source, text, ls, list_filter(ls, lambda x: NOT coalesce(list_contains(drops, x), false)) AS fewer FROM d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source),
-- a text that would lose over half of its lines stays whole
k AS (SELECT *, CASE WHEN 2 * (len(ls) - len(fewer)) <= len(list_filter(ls, lambda x: {_HAS_WORD.format("x")})) THEN fewer ELSE ls END AS kept FROM f)
SELECT doc_id, source, len(ls) AS n_lines, len(ls) - len(kept) AS n_dropped, CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text FROM k
"""

_CONDITIONS = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "5 * n_symbols > n_words",
    "few_letters": "10 * n_marks > 4 * word_chars",
    "shouting": "10 * n_upper > 4 * (word_chars - n_marks)",
    "bang_heavy": "2 * n_bangs > n_words",
    "odd_word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "abusive_stems": "n_stems >= 3 AND 1000 * n_stems >= 5 * n_words",
}
_OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS ws, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS letters FROM documents),
-- stems that mark abuse, from a sample of the labelled documents
known AS (SELECT CAST(doc_id AS BIGINT) AS k, max(CAST(toxic AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
sizes AS (SELECT count(*) FILTER (toxic = 1) AS n1, count(*) FILTER (toxic = 0) AS n0 FROM known),
chosen AS (SELECT k, toxic FROM known, sizes WHERE CAST('0x' || substr(md5(CAST(k AS VARCHAR)), 1, 5) AS INT) <
  CASE WHEN toxic = 1 THEN {quality._GRAIN * quality.MOST_TOXIC} // greatest(1, n1) + 1 ELSE {quality._GRAIN * quality.MOST_CLEAN} // greatest(1, n0) + 1 END AND n1 > 0),
sample AS (SELECT r, lang, toxic, letters, len(letters) AS n FROM d JOIN chosen ON d.doc_id = chosen.k WHERE len(letters) >= 20),
groups AS (SELECT lang, greatest(1, count(*) FILTER (toxic = 1)) AS bad, greatest(1, count(*) FILTER (toxic = 0)) AS good FROM sample GROUP BY lang),
begins AS (SELECT r, lang, toxic, n, left(w, j) AS stem FROM (SELECT r, lang, toxic, n, unnest(letters) AS w FROM sample), (VALUES {", ".join(f"({j})" for j in quality.STEM)}) AS v(j) WHERE length(w) >= j),
shares AS (SELECT r, lang, toxic, stem, least({quality.WHOLE}, {20 * quality.WHOLE} * count(*) // n) AS share FROM begins GROUP BY r, lang, toxic, n, stem),
sums AS (SELECT lang, stem, sum(CASE WHEN toxic = 1 THEN share ELSE 0 END) AS hit, sum(CASE WHEN toxic = 0 THEN share ELSE 0 END) AS base, count(*) FILTER (toxic = 1) AS n_hit, count(*) FILTER (toxic = 0) AS n_base FROM shares GROUP BY lang, stem),
stems AS (SELECT sums.lang, stem FROM sums JOIN groups ON sums.lang IS NOT DISTINCT FROM groups.lang WHERE n_hit >= {quality.STEM_DOCS} AND 100 * n_hit >= {quality.STEM_HUNDREDTHS} * bad
  AND hit * good >= {quality.STEM_RATIO} * (base + {quality.FLOOR}) * bad AND n_hit * good >= 3 * n_base * bad),
abuse AS (SELECT r, count(*) AS n FROM (SELECT r, lang, unnest(letters) AS w FROM d) x WHERE EXISTS (SELECT 1 FROM stems s WHERE s.lang IS NOT DISTINCT FROM x.lang AND starts_with(x.w, s.stem)) GROUP BY r),
windows AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
reps AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: {_HAS_WORD.format("x")}) AS ls,
  coalesce(reps.n, 0) AS n_repeat_words,
  length(t) - length(regexp_replace(t, '[!-@\[-`{{-~]', '', 'g')) AS n_marks,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
  length(t) - length(replace(t, '!', '')) AS n_bangs,
  coalesce(abuse.n, 0) AS n_stems
  FROM d LEFT JOIN reps ON d.r = reps.r LEFT JOIN abuse ON d.r = abuse.r),
x AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM m),
f AS (SELECT *, CAST({" + ".join(f"CASE WHEN {c} THEN {quality.BIT[n]} ELSE 0 END" for n, c in _CONDITIONS.items())} AS BIGINT) AS failed_bits FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & {quality.BASE_MASK} <> 0 AS base_failed, failed_bits & {quality.POLICIES[quality.CURRENT]} = 0 AS kept, failed_bits FROM f
"""

_OP8 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(i - 1) % 3 + 1]::DOUBLE AS weight, {mixing.SHARE}::DOUBLE * sum(source_size) OVER () AS total FROM s),
-- sources by the level at which they are full; with the first j of them full, the rest share what is left
o AS (SELECT *, 2.0::DOUBLE * source_size / weight AS full_at, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, i) AS j FROM w),
p AS (SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM o),
level AS (SELECT min(j) AS j FROM p WHERE (total - given) / open <= full_at),
t AS (SELECT source, source_size, CASE WHEN p.j < level.j THEN 2.0::DOUBLE * source_size ELSE (SELECT total - given FROM p, level WHERE p.j = level.j) * weight / (SELECT open FROM p, level WHERE p.j = level.j) END AS target FROM p, level),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM t),
g AS (SELECT source, k, sum(size) AS n FROM d GROUP BY source, k),
c AS (SELECT source, k, n, sum(n) OVER (PARTITION BY source ORDER BY k) - n AS before FROM g)
SELECT d.doc_id, d.size, q.source_size, q.target, CAST(d.size * (q.passes + CASE WHEN 2 * c.before + c.n <= 2 * (q.target - q.passes * q.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.k = d.k
"""



def _op7() -> str:
    """The features in SQL, and the fitted trees as nested cases."""
    m = urls.seed_model()
    q = lambda p: "'" + p.replace("'", "''") + "'"

    def tree(nodes, k=0) -> str:
        f, t, lo, hi, v = nodes[k]
        return f"{v!r}::DOUBLE" if f < 0 else f"CASE WHEN {urls.FEATURES[f]} <= {t!r}::DOUBLE THEN {tree(nodes, lo)} ELSE {tree(nodes, hi)} END"

    fits = lambda h, p: f"(host = {q(h)} OR ends_with(host, {q('.' + h)})) AND starts_with(path, {q(p)})"
    ordered = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN {q(h + p)}" for _, h, p in ordered)
    ruled = " ".join(f"WHEN {fits(h, p)} THEN {q(v)}" for v, h, p in ordered)
    rates = " ".join(f"WHEN {q(k)} THEN {v!r}::DOUBLE" for k, v in m.suffix.items())
    return rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
h AS (SELECT *, translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
  regexp_extract(u, '^[^?#]*\?([^#]*)', 1, 's') AS query FROM u),
f AS (SELECT *, length(u)::DOUBLE AS length, length(host)::DOUBLE AS host_length, len(list_filter(string_split(path, '/'), lambda x: x <> ''))::DOUBLE AS depth,
  CASE WHEN u = '' THEN 0 ELSE length(regexp_replace(u, '[^0-9]', '', 'g'))::DOUBLE / length(u) END AS digit_ratio,
  length(regexp_replace(host, '[^0-9]', '', 'g'))::DOUBLE AS host_digits, length(regexp_replace(host, '[^-_]', '', 'g'))::DOUBLE AS host_marks, len(string_split(host, '.'))::DOUBLE AS host_parts,
  CASE WHEN u = '' THEN 0 ELSE round(log2(length(u)) - list_sum(list_transform(map_values(list_histogram(regexp_extract_all(u, '(?s).'))), lambda c: c * log2(c))) / length(u), 6) END AS entropy,
  CASE WHEN query = '' THEN 0 ELSE len(string_split(query, '&')) END::DOUBLE AS n_params, length(query)::DOUBLE AS query_length,
  coalesce(list_max(list_transform(list_filter(string_split_regex(host, '[.-]'), lambda w: length(w) > 1), lambda w: length(w))), 0)::DOUBLE AS longest_part,
  len(regexp_replace(regexp_replace(host, '\.?[^.]*\.?[^.]*$', ''), '[^-_]', '', 'g'))::DOUBLE AS marks_below,
  coalesce(list_max(list_transform(string_split_regex(array_to_string(list_filter(string_split(host, '.'), lambda x: regexp_matches(x, '[-_]')), '-'), '[-_]'), lambda w: length(w))), 0)::DOUBLE AS marked_part,
  CASE list_last(string_split(host, '.')) {rates} ELSE {m.usual!r}::DOUBLE END AS suffix_rate FROM h),
s AS (SELECT *, {m.trees.start!r}::DOUBLE + {" + ".join(tree(t) for t in m.trees.trees)} AS score FROM f)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {ruled} WHEN score > 0 THEN 'block' ELSE 'allow' END AS verdict, round(score, 6) AS score FROM s
"""


@lru_cache(maxsize=1)
def _sql() -> dict[str, str]:
    """The other operators hash, tokenize, search or parse in ways SQL can't follow; tests hold them against plain versions."""
    return {"op1_secret_scan": _op1(), "op2_line_dedup": _OP2, "op6_quality_rules": _OP6, "op7_url_filter": _op7(), "op8_source_mixing": _OP8} | queries_text.SQL


def __getattr__(name: str):
    if name == "SQL":  # written when it is asked for, as op7's needs fitted trees
        return _sql()
    raise AttributeError(name)
