"""The ledger beside a caller's columns, and abuse by language in the query."""

import numpy as np

from gaugelab.llm import quality, queries
from gaugelab.llm.quality import F

from . import plain


def test_query_finds_abuse_in_every_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = queries.op6_quality_rules(spark, sf).select("doc_id", "kept", "base_failed").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    for lang in ("en", "fr", "de", "es"):
        assert np.mean([not r.kept for r in got if r.lang == lang and r.toxic]) > 0.9, lang
        assert np.mean([r.kept for r in got if r.lang == lang and not r.toxic and r.quality and not r.base_failed]) > 0.98, lang


def test_a_callers_columns_stay(spark):
    df = spark.createDataFrame(plain.ODD, plain.SCHEMA)
    wide = df.select("*", *[F.lit(n).alias(n) for n in ("_m", "_text", "_lang", "_row", "_measures", "with.dot", "failed", "measures", "kept")])
    led = quality.apply_policy(quality.ledger(wide, stems={"en": ["cat"], None: ["x"]}))
    rows = led.collect()
    assert all(r[n] == n for r in rows for n in ("_m", "_text", "_lang", "_row", "_measures", "with.dot"))
    want = quality.apply_policy(quality.ledger(df, stems={"en": ["cat"], None: ["x"]})).collect()
    key = lambda r: (str(r.doc_id), str(r.text), r.failed, r.kept, str(r.measures))
    assert sorted(map(key, rows)) == sorted(map(key, want))
    assert max(r.measures.n_stems for r in rows) == 30
    dotted = df.withColumnsRenamed({"text": "my.text", "lang": "my.lang"})
    assert quality.ledger(dotted, "my.text", {"en": ["cat"]}, "my.lang").count() == df.count()
