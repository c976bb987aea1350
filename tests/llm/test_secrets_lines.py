"""Ownership of secrets, boilerplate of sites, and long texts with many matches or lines."""

import time
from collections import Counter

from gaugelab.llm import lines, secrets
from gaugelab.llm.secrets import F

from . import plain


def spans_of(df, **how):
    return {r.doc_id: r for r in secrets.scan(df, **how).select("doc_id", secrets.listed(F.col("spans")).alias("spans"), "n_live", "n_example", "most_owners", "most_repos").collect()}


def test_owners_and_repositories_decide(spark):
    key = lambda c: f"ghp_{c}" + "a1B2" * 9
    rows = [(i, f"one owner pastes it into many texts {i} {key('P')}", "en", "hot", 0) for i in range(10)]
    rows += [(20 + i, f"a tutorial {i} {key('T')}", "en", f"o{i}", 0) for i in range(5)]
    rows += [(30 + i, f"moved {key('M')}", "en", f"o{i}", 0) for i in range(2)] + [(40 + i, f"forked {key('F')}", "en", "hot", 0) for i in range(50)]
    rows += [(100 + i, f"no owner {i} {key('N')}", "en", None, 0) for i in range(6)]
    got = spans_of(spark.createDataFrame(rows, plain.SCHEMA))
    live = {d for d, r in got.items() if "issued" in r.spans}
    assert live == {*range(10), 30, 31, *range(40, 90)}  # one owner's key is live in ten texts, a key of five owners is an example, and so is one of six unknown
    assert (got[3].most_owners, got[3].most_repos) == (1, 10) and (got[22].most_owners, got[22].most_repos) == (5, 5)
    assert (got[30].most_owners, got[30].most_repos) == (2, 2) and (got[45].most_owners, got[45].most_repos) == (1, 1)
    named = spans_of(spark.createDataFrame(rows, plain.SCHEMA).withColumn("repo", F.lit("r")), repo="repo")
    assert "issued" in named[3].spans  # one repository of one owner


def test_many_matches_take_time_in_proportion(spark):
    text = lambda n: " ".join(f"password=secret{i:07d}" for i in range(n))
    spans_of(spark.createDataFrame([(1, text(10), "en", "a", 0)], plain.SCHEMA))
    df = spark.createDataFrame([(1, text(40_000), "en", "a", 0)], plain.SCHEMA)
    began = time.monotonic()
    got = spans_of(df)[1].spans.split(",")
    assert time.monotonic() - began < 30
    assert [got[0], got[1], got[-1]] == ["assign:0:22", "assign:23:45", f"assign:{39_999 * 23}:{39_999 * 23 + 22}"] and len(got) == 40_000


def test_many_lines_take_time_in_proportion(spark):
    big = "\n".join(f"line {i} of the text" for i in range(40_000))
    df = spark.createDataFrame([(k, f"{big}\n\nown {k}", "en", "a", 0) for k in range(3)], plain.SCHEMA)
    lines.drop_boilerplate(df.limit(1)).collect()
    began = time.monotonic()
    got = lines.drop_boilerplate(df, distinct=True).collect()
    assert time.monotonic() - began < 30
    assert sorted((r.text, r._n_dropped, r._n_lines) for r in got) == [(f"\nown {k}", 40_000, 40_002) for k in range(3)]


def test_near_copies_stay_whole_if_most_of_them_is_shared(spark):
    own = lambda i: [f"{w} of page {i} and word {w * 2}" for w in ("alpha", "beta", "gamma", "delta")]
    rows = [(i, "\n".join([*own(0), f"edited {i}"]), "en", "s", 0) for i in range(10)] + [(100 + i, "\n".join([*own(100 + i), "site menu"]), "en", "s", 0) for i in range(40)]
    df = spark.createDataFrame(rows, plain.SCHEMA)
    texts = {r.doc_id: r.text for r in lines.drop_boilerplate(df, distinct=True, most=0.5, counts=None).collect()}
    assert all(texts[i] == r for i, r, *_ in rows[:10]) and all(texts[100 + i] == "\n".join(own(100 + i)) for i in range(40))
    assert {r.text for r in lines.drop_boilerplate(df, distinct=True).where("doc_id < 10").collect()} == {f"edited {i}" for i in range(10)}


def test_clashing_columns(spark):
    df = spark.createDataFrame(plain.ODD, plain.SCHEMA)
    names = ["row", "all", "owner", "repo", "hash", "s", "base", "spans", "n_live", "n_owners", "with.dot", "at", "l", "ls", "_drops", "_n_lines", "_host", "_th"]
    wide = df.select("*", *[F.lit("x").alias(n) for n in names])
    assert Counter(map(str, secrets.scan(wide).collect())) == Counter(map(str, secrets.scan(df).collect()))
    dropped = lines.drop_boilerplate(wide, counts=None)
    assert dropped.columns == wide.columns and all(r[n] == "x" for r in dropped.collect() for n in names)
    assert lines.drop_boilerplate(wide).columns == [*(c for c in wide.columns if c != "_n_lines"), "_n_lines", "_n_dropped"]
    dotted = df.withColumnsRenamed({"text": "my.text", "source": "my.host", "doc_id": "my.id"})
    assert Counter(r["my.text"] for r in lines.drop_boilerplate(dotted, "my.host", "my.text").collect()) == Counter(r.text for r in lines.drop_boilerplate(df).collect())
    assert secrets.scan(dotted, "my.id", "my.text", "my.host").count() == df.count()
