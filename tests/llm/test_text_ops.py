import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugelab.llm import classify, collocations, search

from . import plain

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [(1, "the CAT sat"), (2, None), (3, "w1 w2 w3 w3 more a"), (3, "w1 w2 w3 w3 more a"), (None, "no id É́ı"), (5, "nowhere-at-all"), (6, "")]


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def ranked(docs, items, k):
    found = [(i, Counter(TERM.findall(ascii_lower(t)))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in found:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(TERM.findall(ascii_lower(text))) if t in c)
            if s > 0:
                scored.append((s, doc))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r, doc, s) for r, (s, doc) in enumerate(scored[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("k", "size"), [(50, 32_000_000), (3, 2000), (1, 1)])
def test_search_against_all_documents(spark, k, size):
    rng = random.Random(k)
    words = [f"t{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(100 + i, " ".join(rng.choices(words, k=rng.randrange(1, 60))), "en", "s", 1) for i in range(150)]
    rows += [(1000 + i, "t1 t2 t3 copy", "en", "s", 1) for i in range(120)] + plain.ODD  # many equal scores
    items = [*ITEMS, (7, "t1 t2 t5 t9 t11"), (8, "copy t3"), (9, " ".join(f"t{i}" for i in range(1, 90)))]
    docs = spark.createDataFrame(rows, plain.SCHEMA).withColumns({"term": F.lit("x"), "shard": F.lit(3)})
    got = search.search(docs, spark.createDataFrame(items, "item_id long, text string"), k, size)
    assert Counter(map(tuple, got.collect())) == ranked([r[:2] for r in rows], items, k)


def test_search_of_nothing(spark):
    none, items = spark.createDataFrame([], plain.SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(none, items).count() == 0
    assert search.search(spark.createDataFrame(plain.ODD, plain.SCHEMA), items.limit(0)).count() == 0


def test_index_makes_no_objects_for_terms(spark):
    """Shards go from Arrow to Arrow: pandas held an object for each text and four for each term, some 270 MB more in a task."""
    docs = spark.createDataFrame([(2, "b a b"), (1, "a"), (None, "c\ufffd c"), (3, None)], "doc_id long, text string").coalesce(1)
    made = search.index(docs, 3, 6)
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()
    rows = {r.term: r for r in made.collect()}
    assert {t: r["size"] for t, r in rows.items()} == {"a": 2, "b": 1, "c": 1, "c\ufffd": 1, None: 4}
    assert np.frombuffer(rows[None]["at"], "<i8").tolist() == [1, 2, 3] and np.frombuffer(rows[None].tf, "<i4").tolist() == [1, 3, 0, 2]
    assert sorted(np.frombuffer(rows["a"]["at"], "<i4").tolist()) == [0, 1] and np.frombuffer(rows["b"].tf, "<i4").tolist() == [2] and len(rows["a"].left) == 8


def test_treaps_are_search_trees_and_heaps():
    rng = np.random.default_rng(5)
    sizes = [1, 2, 3, 50, 700]
    end = np.cumsum(sizes)
    key = rng.permutation(int(end[-1]))
    order, left = search.treaps(end - sizes, end, key)

    def walk(a, b):  # the subtree that stands at [a, b) of the preorder
        if a == b:
            return []
        cut = a + 1 + left[a]
        below = [*walk(a + 1, cut), *walk(cut, b)]
        assert all(key[order[a]] > key[x] for x in below)
        return [*walk(a + 1, cut), order[a], *walk(cut, b)] if b - a < 60 else sorted([order[a], *below])

    for a, b in zip(end - sizes, end):
        assert walk(int(a), int(b)) == list(range(a, b))


def test_search_prunes_and_splits(monkeypatch):
    """Small steps, so that intervals are split down to single documents, against sums over all postings."""
    monkeypatch.setattr(search, "FEW", 1)
    monkeypatch.setattr(search, "WIDTH", 2)
    rng = np.random.default_rng(9)
    n_docs, terms = 3000, [f"t{i}" for i in range(8)]
    n = rng.integers(5, 400, n_docs)
    rows, full = [(None, n_docs, np.arange(n_docs).astype("<i8").tobytes(), n.astype("<i4").tobytes(), b"", 0)], np.zeros(n_docs, np.int64)
    for i, t in enumerate(terms):
        at = np.sort(rng.choice(n_docs, 40 * (i + 1) ** 2, replace=False))
        tf, weight = rng.integers(1, 9, len(at)), 5000 - 500 * i
        imp = search.impacts(tf, n[at], n_docs, int(n.sum()))
        order, left = search.treaps(np.array([0]), np.array([len(at)]), (imp << 32) | (at * 2654435761 % (1 << 32)))
        rows.append((t, len(at), at[order].astype("<i4").tobytes(), tf[order].astype("<i4").tobytes(), left.astype("<i4").tobytes(), weight))
        full[at] += imp * weight
    seen = []
    take = search.Best.take
    monkeypatch.setattr(search.Best, "take", lambda self, s, places, ids: (seen.extend(places.tolist()), take(self, s, places, ids))[1])
    best = search.Best(10)
    search.Shard(rows, n_docs, int(n.sum())).search(terms, best)
    want = sorted(((-s, i) for i, s in enumerate(full.tolist())))[:10]
    assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist())] == want
    assert len(seen) == len(set(seen)) < 0.6 * np.count_nonzero(full)  # each document once, and many not at all


def mined(rows, least):
    counts, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    counts[lang, tuple(ws[i : i + k])] += 1
    cands = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least}
    covered = set()
    for (lang, p), a in cands.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= 80 * cands[lang, p[i : i + k]]:
                    covered.add((lang, p[i : i + k]))
    out = {}
    for (lang, p), a in cands.items():
        if (lang, p) not in covered:
            score, k, l, r = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i, p.decode(), -a, l, r, sizes[lang], -s) for lang, xs in out.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:2000], 1)}


@pytest.mark.parametrize(("least", "size"), [(3, 16_000_000), (2, 50), (30, 16_000_000)])
def test_collocations_against_counts(spark, least, size):
    rng = random.Random(least)
    rows = [(i, " ".join(rng.choices(["a", "b", "Cé", "d,", "e.", "f\n", "g\tg", "\x00", "h  h"], k=40)), rng.choice(["en", None, "fr"]), "s", 1) for i in range(60)]
    rows += [(900, "one two three four " * 2000, "en", "s", 1)] + plain.ODD
    docs = spark.createDataFrame(rows, plain.SCHEMA).withColumns({"word": F.lit(1), "block": F.lit(2)})
    assert {tuple(r) for r in collocations.mine(docs, least, size).collect()} == mined([(r[2], r[1]) for r in rows], least)


def test_collocations_ranges_meet(monkeypatch):
    """Runs that go over a splitter are added up, and long streams are cut without losing or doubling keys."""
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 4, 5000).astype(np.int64)
    hi, lo = collocations._keys(ids)
    want = Counter(tuple(int(x) for x in (ids[i], ids[i + 1], (ids[i + 2] if i + 2 < len(ids) else 0), (ids[i + 3] if i + 3 < len(ids) and ids[i + 2] else 0))) for i in range(len(ids) - 1) if ids[i] and ids[i + 1])
    h, low, n = collocations._counted(hi, lo, np.ones(len(hi), np.uint64))
    assert Counter({(int(a) >> 32, int(a) & 0xFFFFFFFF, int(b) >> 32, int(b) & 0xFFFFFFFF): int(c) for a, b, c in zip(h, low, n)}) == want
    assert all((a == b).all() for a, b in zip(collocations._unpack(collocations._pack(h, low, n)), (h, low, n)))


def test_collocations_of_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], plain.SCHEMA)).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, None, None, None, 0)], plain.SCHEMA)).count() == 0


def test_words_and_neighbours():
    found, at = classify.buckets("Ab cD HELLO 12345 ab ***  ok!!\nwÖrd".encode())
    words = {"Ab": 0, "ab": 18}
    assert len(found) == 9 and found[list(at).index(words["Ab"])] == found[list(at).index(words["ab"])]
    assert found[2] == classify._CAPITALS and found[3] == classify._NUMBER and found[5] == classify.VOCABULARY - 256 + ord("*")
    places, signs = classify.index_vectors()
    doc = np.array([0] * 5 + [1] * 4)
    want = np.zeros((classify.VOCABULARY, classify.DIM + 1))
    for i, b in enumerate(found):
        want[b, -1] += 1
        for j in range(len(found)):
            if i != j and abs(i - j) <= classify.WINDOW and doc[i] == doc[j]:
                np.add.at(want[b], places[found[j]], signs[found[j]])
    assert (classify.neighbours(found, doc, places, signs) == want).all()


def test_pooling_by_hand():
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(classify.VOCABULARY, classify.DIM)).astype(np.float32)
    texts = [b"", b"one two two", ("word " * 900_000).encode() + b"end", b" \n "]  # the third is worked on in steps
    got = classify.pooled(texts, vectors)
    for text, row in zip(texts, got):
        v = vectors[classify.buckets(text)[0]].astype(float)
        want = np.zeros(classify.FEATURES)
        if len(v):
            want = np.concatenate([v.mean(axis=0), v.std(axis=0), [(v[1:] * v[:-1]).sum() / len(v), np.log1p(len(v))]])
        assert np.allclose(row, want, atol=2e-2)


def test_quality_classes_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = classify.score(docs, labels)
    assert got.count() == docs.count() and got.dtypes[0] == ("doc_id", "bigint")
    r = got.where("held_out").join(labels, "doc_id").toPandas()
    good, bad = r[r.quality == 1].score.to_numpy(), r[r.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (good >= 0.3).mean() > 0.97 and (bad < 0.3).mean() > 0.7
    assert ((r.score >= 0.3) == (r.predicted == 1)).all()
    swapped = labels.withColumn("quality", F.when(classify.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {x.doc_id: x.score for x in classify.score(docs.withColumns({"lang": F.lit("x"), "source": F.lit(None)}), swapped).collect()}
    assert all(abs(again[x.doc_id] - x.score) < 1e-9 for x in got.collect())  # held-out labels, lang and source aren't read


def test_quality_classes_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(plain.ODD, plain.SCHEMA).withColumns({"score": F.lit("x"), "held_out": F.lit(1)})
    got = classify.score(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in plain.ODD)
    assert all(0 <= r.score <= 1 for r in got) and all(r.held_out for r in got if r.doc_id is None)
    assert classify.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in classify.score(docs, labels.limit(0)).collect()} == {0.5}
