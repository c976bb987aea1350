"""The pipeline's stages beside a caller's columns, and what they leave in the shared folder."""

import os

import corpus_pipeline
from gaugelab.llm.common import F, shared_dir

from . import plain


def test_stages_keep_a_callers_columns(spark, tmp_path):
    """Columns named as those that the operators add, and one with a dot in its name."""
    odd = spark.createDataFrame([*plain.ODD, *[(100 + i, " ".join(f"word{i}x{k}" for k in range(80)), "en", "s", 5) for i in range(6)]], plain.SCHEMA)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100, 1, 0), (101, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["with.dot", "_n_lines", "_n_dropped", "_shard", "_place", "_eighth", "measures", "failed", "kept", "_m", "_row", "i", "src", "fp", "root", "_drops", "at"]
    wide = odd.select("*", *[F.lit(n).alias(n) for n in names])
    docs, bare = wide, odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, plain_out = stage(spark, docs, str(tmp_path)), stage(spark, bare, str(tmp_path))
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in plain_out.collect()), name
        assert rows and all(r[n] == n for r in rows for n in names), name
        docs, bare = spark.createDataFrame(rows, out.schema), spark.createDataFrame([tuple(r)[:5] for r in rows], odd.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len({r.doc_id for r in rows})


def test_superseded_stages_are_deleted(spark, sf_dir):
    root = shared_dir(spark).removeprefix("file:")
    had = set(os.listdir(root)) if os.path.isdir(root) else set()
    corpus_pipeline.run(spark, sf_dir)
    left = {n.rpartition("-")[0] for n in set(os.listdir(root)) - had}
    assert "pipeline-mix_sources" in left
    assert not left & {"pipeline-quality_rules", "pipeline-line_dedup", "pipeline-near_dedup", "simhash-edges", "simhash-least", "simhash-comp", "mix-sizes", "mix-blocks", "quality-labelled"}
