"""Random access to ids in the files."""

import contextlib
import glob
import io

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from gaugelab.llm import idfiles, tokens
from gaugelab.llm.idfiles import F

from . import plain


def test_a_place_reads_one_block(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    idfiles.write(df, f"{tmp_path}/ids", block_ids=2000)
    files = spark.read.parquet(f"{tmp_path}/ids")
    t = Tokenizer.from_file(tokens.default_tokenizer())
    every = np.concatenate([[*t.encode(r.text or "", add_special_tokens=False).ids, idfiles.END_ID] for r in df.orderBy("doc_id").collect()])
    n_blocks = files.count()
    groups = sum(pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(f"{tmp_path}/ids/*.parquet"))
    assert n_blocks > 20 and groups == n_blocks
    for at in (0, 1, 1999, 2000, len(every) // 2, len(every) - 1):
        assert idfiles.token_at(files, at) == every[at]
    for at, n in ((0, 10), (1990, 3000), (len(every) // 3, 9000), (len(every) - 5, 50), (7, 0), (len(every), 5)):
        got = sorted((r.position, r.ids) for r in idfiles.slice_at(files, at, n).collect())
        assert np.concatenate([np.zeros(0, int), *[np.frombuffer(x, "<u4") for _, x in got]]).tolist() == every[at : at + n].tolist()
        assert not got or got[0][0] == at
    with pytest.raises(IndexError):
        idfiles.token_at(files, len(every))
    with pytest.raises(ValueError):
        idfiles.slice_at(files, -1, 2)
    # one row group's data is touched: filters that its statistics answer reach the scan, and one row is left
    plan = idfiles.slice_at(files, len(every) // 2, 1)
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        plan.explain("formatted")
    text = said.getvalue()
    assert "EqualTo(part" in text and "LessThan(first" in text and "GreaterThanOrEqual(first" in text
    assert plan.count() == 1


def test_one_id_needs_few_look_ups(monkeypatch):
    """A token is found by a chunk, a bit and a rank for each of its levels, whatever the block's size."""
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 49408, 200_000).astype(np.uint32)
    b = idfiles.Block(idfiles.encode_block(ids, np.array([len(ids)])))
    calls = []
    rank = b.rank
    monkeypatch.setattr(b, "rank", lambda level, i: calls.append((level, i)) or rank(level, i))
    for i in rng.integers(0, len(ids), 200):
        calls.clear()
        assert b[int(i)] == ids[i] and len(calls) <= 2


def test_hot_and_missing_ids(spark):
    rows = [(None, f"null {i}") for i in range(40)] + [(7, f"seven {i}") for i in range(40)] + [(7, "twice"), (7, "twice"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("x") for n in ("part", "h", "ids", "data", "with.dot")})
    got = idfiles.round_trip(df, block_ids=50).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 40 + [3] + [7] * 42
    ends = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *ends[:-1].tolist()]
    assert idfiles.blocks(df).select("part").distinct().count() > 2
