"""Digests against a plain version, and what they tell apart."""

import time
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from gaugelab.llm import fingerprints

from . import plain


def like(a: bytes, b: bytes) -> float:
    return fingerprints.likeness(*fingerprints.digests([a, b]))


def filters(digest):
    return [set(np.flatnonzero(np.unpackbits(f)).tolist()) for f in digest]


@pytest.fixture(scope="module")
def texts(sf_dir):
    return [(t or "").encode() for t in pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist()]


def test_digests_and_likeness_against_a_plain_version(texts):
    some = [t for t in texts if len(t) < 3000][:30] + [t[:n] for t, n in zip(texts, (1, 5, 7, 8, 9, 15, 16, 17, 63, 64, 65, 130))] + [b"", b"a" * 400, b"ab" * 300, bytes(range(256)) * 3, b"=" * 90 + b"x"]
    got = fingerprints.digests(some)
    want = [plain.digest(t, fingerprints._MIX, fingerprints.USUAL) for t in some]
    assert [filters(d) for d in got] == want
    for i in range(len(some) - 1):
        assert abs(fingerprints.likeness(got[i], got[i + 1]) - plain.likeness(want[i], want[i + 1], got[i].sizes, got[i + 1].sizes)) < 1e-9
        part = fingerprints.digests([some[i][: len(some[i]) // 2 + 1]])[0]
        assert abs(fingerprints.likeness(got[i], part) - plain.likeness(want[i], filters(part), got[i].sizes, part.sizes)) < 1e-9


def test_filler_is_told_apart():
    assert like(b"a" * 1000, b"b" * 1000) == 0
    assert like(b"=" * 600, b"\n" * 5000) == 0
    assert like(b"a" * 1000, b"a" * 1000) == like(b"", b"") == 1
    assert like(b"", b"a") == 0


def test_short_texts_have_features(texts):
    long = [t for t in texts if len(t) > 900]
    for n in (20, 30, 50):
        for a, b in zip(long, long[1:]):
            own, other = a[:n], b[:n]
            edited = own[: n - n // 2] + other[: n // 2]
            assert like(own, edited) > like(own, other) or own == other


@pytest.mark.parametrize("n", [60, 200, 400, 500, 512, 530, 700])
def test_a_few_bytes_more_change_little(texts, n):
    some = [t for t in texts if len(t) > 900][:40]
    assert np.mean([like(t[:n], t[: n + 20]) for t in some]) > (0.85 if n >= 200 else 0.6)


def test_long_texts_take_time_in_proportion():
    """Ten megabytes, edited as in the contract, shifted by an insertion, and unrelated."""
    rng = np.random.default_rng(1)
    words = [bytes(rng.choice(np.frombuffer(b"etaoinshrdlucmfw", np.uint8), rng.integers(1, 9))) for _ in range(5000)]
    text = lambda n: b" ".join(words[i] for i in rng.integers(0, 5000, n))
    big, other = text(1_800_000), text(900_000)
    edited, shifted = big[: len(big) - len(big) // 2] + other, big[:1000] + text(20_000) + big[1000:]
    made = fingerprints.digests([big, edited, shifted, other])
    assert len(made[0]) > 1000
    began = time.monotonic()
    near = [fingerprints.likeness(made[0], d) for d in made[1:]]
    assert time.monotonic() - began < 20
    assert 0.4 < near[0] < 0.65 and near[1] > 0.6 and near[2] < 0.1


def test_order_with_hot_and_missing_ids(spark):
    """A doc_id, and null, that hold a third of the rows each, in many buckets."""
    rows = [(None, f"null {i}") for i in range(60)] + [(7, f"seven {i}") for i in range(60)] + [(i, f"text {i}") for i in range(60)] + [(7, "twice"), (7, "twice"), (-(1 << 63), "low"), ((1 << 63) - 1, "high")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.in_order(df, "doc_id", "text", 12).collect()
    assert Counter((r.doc_id, r.text) for r in got if not r.extra) == Counter(rows)
    where = {}
    for r in got:
        where.setdefault(r.bucket, []).append(r)
    assert max(len(v) for v in where.values()) < 50
    names = sorted(where)
    for b, after in zip(names, names[1:] + names[:1]):
        assert where[b][-1].extra and not any(r.extra for r in where[b][:-1])
        assert (where[b][-1].doc_id, where[b][-1].text) == (where[after][0].doc_id, where[after][0].text)
    line = [r for b in names for r in where[b] if not r.extra]
    assert [r.doc_id for r in line] == sorted((r[0] for r in rows if r[0] is not None), reverse=True) + [None] * 60


def test_clashing_columns(spark):
    df = spark.createDataFrame(plain.ODD, plain.SCHEMA)
    wide = df.select("*", *[fingerprints.F.lit("x").alias(n) for n in ("u", "bucket", "extra", "d", "fingerprint", "with.dot")])
    assert Counter(map(tuple, fingerprints.compare_with_next(wide).collect())) == Counter(map(tuple, fingerprints.compare_with_next(df).collect()))
