"""Mixing with many sources, in groups and by joins that aren't broadcast, and the order of what comes out."""

from collections import Counter, defaultdict

import pytest

from gaugelab.llm import mixing
from gaugelab.llm.mixing import F

from . import plain


@pytest.fixture
def many(spark):
    """300 sources of one to four documents, one of many, one that is null, one of empty texts."""
    rows = [(1000 * s + k, " ".join(["w"] * (1 + (s * 7 + k) % 9)), "en", f"s{s:03d}é" if s % 2 else f"S{s}", 0) for s in range(300) for k in range(1 + s % 4)]
    rows += [(10**6 + k, " ".join(["x"] * (k % 13)), "en", "hot", 0) for k in range(600)] + [(2 * 10**6 + k, "a b c", "en", None, 0) for k in range(20)] + [(3 * 10**6 + k, "", "en", "none", 0) for k in range(5)]
    return rows, spark.createDataFrame(rows, plain.SCHEMA)


@pytest.mark.parametrize("group,broadcast", [(4096, 100_000), (7, 0)])
def test_many_sources(monkeypatch, many, group, broadcast):
    monkeypatch.setattr(mixing, "GROUP", group)
    monkeypatch.setattr(mixing, "MOST_BROADCAST", broadcast)
    rows, df = many
    got = mixing.taken(df, block_docs=8, shard_words=150).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    size, largest, took = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in rows:
        size[s] += len(t.split())
        largest[s] = max(largest[s], len(t.split()))
    names = sorted(size, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    goal = dict(zip(names, plain.targets([size[s] for s in names])))
    for r in got:
        took[r.source] += r.taken
        assert r.source_size == size[r.source] and abs(r.target - goal[r.source]) <= 1e-6 * max(1, goal[r.source]) and r.taken <= 2 * r.size
    assert all(abs(took[s] - goal[s]) <= largest[s] for s in names)


def test_groups_of_sources_share_shards_fairly(monkeypatch, many):
    monkeypatch.setattr(mixing, "GROUP", 50)
    rows, df = many
    p = mixing.plan(df, block_docs=2, shard_words=100)
    places = p.places.collect()
    quota = {r.i: r.n_blocks * r.passes + (0 if r.last_block is None else r.last_block + 1) for r in p.sources.collect()}
    assert Counter(r.i for r in places) == Counter({k: v for k, v in quota.items() if v})
    assert len({(r.i, r.block, r.pass_no) for r in places}) == len(places)
    per = Counter(r.shard for r in places)
    assert len(per) >= 32 and max(per.values()) - min(per.values()) <= 8


def test_targets_when_all_are_full(spark):
    per = spark.createDataFrame([("a", 10), ("b", 20), (None, 5)], "src string, source_size long")
    got = {r.src: r.target for r in mixing.targets(per, share=2.0).collect()}
    assert got == {"a": 20, "b": 40, None: 10}
    assert mixing.targets(per.limit(0)).count() == 0


def test_mix_comes_in_the_order_of_its_shards(many):
    rows, df = many
    out = mixing.mix(df.withColumn("_shard", F.lit("x")).withColumn("with.dot", F.lit("y")), block_docs=8, shard_words=500)
    assert out.columns == [*df.columns, "with.dot", "_shard", "_place"]
    parts = defaultdict(list)
    for r in out.withColumn("p", F.spark_partition_id()).collect():
        parts[r.p].append((r._shard, r._place % 2**64 >> 61, r._place))
    assert len(parts) > 1 and all(v == sorted(v) for v in parts.values())
    again = mixing.mix(df.repartition(3), block_docs=8, shard_words=500, places=None)
    assert again.columns == df.columns and Counter(r.doc_id for r in again.collect()) == Counter(r.doc_id for r in out.collect())
