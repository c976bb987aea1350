from collections import Counter, defaultdict

import numpy as np
import pytest

from gaugelab.llm import lines, mixing, packing, quality, queries, simhash, tokens

from . import plain


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(plain.ODD, plain.SCHEMA)


def empty(spark):
    return spark.createDataFrame([], plain.SCHEMA)


def test_quality_measures(spark, docs, odd, sf_dir):
    got = {r.doc_id: r for r in queries.op6_quality_rules(spark, sf_dir).collect()}
    for d, t, *_ in docs:
        r = got[d]
        m = plain.quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m, d
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (r.base_failed and r.kept)
    rows = quality.ledger(odd).collect()
    assert Counter(tuple(r.measures[:5]) for r in rows) == Counter(plain.quality(x[1]) for x in plain.ODD)
    assert quality.apply_policy(quality.ledger(empty(spark))).count() == 0


def test_quality_verdicts_follow_labels(spark):
    sf = "/root/testdata/sf0.01"
    led = quality.apply_policy(quality.ledger(spark.read.parquet(f"{sf}/documents.parquet")))
    x = led.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("failed & 3 = 0").select("quality", "toxic", "kept").collect()
    clean = [r.kept for r in x if r.quality == 1 and r.toxic == 0]
    junk = [r.kept for r in x if r.quality == 0]
    assert np.mean(clean) > 0.99
    assert np.mean(junk) < 0.1


def test_ablations(spark, odd):
    led = quality.ledger(odd)
    rows = led.collect()
    m = quality.POLICIES[quality.CURRENT]
    for r in quality.ablations(led).collect():
        b = quality.BIT[r.rule]
        assert r.n_failed == sum(bool(x.failed & b) for x in rows)
        assert r.n_failed_alone == sum(x.failed & m == b for x in rows)
        assert r.n_kept_without == sum(not x.failed & m & ~b for x in rows)


@pytest.mark.parametrize("ratio,least", [(0.1, 3), (0.3, 2)])
def test_line_dedup(spark, docs, odd, ratio, least):
    for rows, df in ((docs, spark.createDataFrame(docs, plain.SCHEMA)), (plain.ODD, odd)):
        want = plain.line_dedup([(r[0], r[1], r[3]) for r in rows], ratio, least)
        got = lines.drop_boilerplate(df, ratio=ratio, min_pages=least)
        assert got.columns[:5] == df.columns
        got = got.collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], t) for r, t in zip(rows, want))
        old = {r[0]: r[1] for r in rows}
        assert all(r._n_dropped == (old[r.doc_id] or "").count("\n") - (r.text or "").count("\n") + (r.text == "" and old[r.doc_id] != "") for r in got if r.doc_id is not None)
    assert lines.drop_boilerplate(empty(spark)).count() == 0


def test_simhash(spark, docs, odd):
    for rows, df in ((docs, spark.createDataFrame(docs, plain.SCHEMA)), (plain.ODD, odd)):
        fps = [plain.simhash(r[1]) for r in rows]
        want = plain.components([r[0] for r in rows], fps)
        got = simhash.near_duplicates(df).collect()
        assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == Counter(zip((r[0] for r in rows), fps, want))
        kept = simhash.keep_one(df).collect()
        comp = plain.components(list(range(len(rows))), fps)
        assert len(kept) == len(set(comp))
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0


@pytest.mark.parametrize("n,flips", [(300, 2), (2000, 4)])
def test_simhash_links_in_dense_groups(n, flips):
    """Fingerprints around a few centres, against all pairs."""
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    f = rng.choice(centres, n)
    for _ in range(flips):
        f = f ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    f = np.unique(f)
    rows = [b for b in simhash._balls([__import__("pyarrow").RecordBatch.from_arrays([__import__("pyarrow").array(f.view(np.int64))], ["fp"])])]
    key, fp, inner = (np.concatenate([np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for b in rows]) for i in range(3))
    at = np.argsort(key, kind="stable")
    a, b = simhash._met(key[at], fp[at].view(np.uint64), inner[at])
    place = {int(x): i for i, x in enumerate(f)}
    got = plain.roots(len(f), [(place[int(x)], place[int(y)]) for x, y in zip(a, b)])
    want = plain.roots(len(f), [(i, j) for i in range(len(f)) for j in (np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 3) + i + 1).tolist()])
    assert got == want


def test_mixing(spark, docs, odd):
    for rows, df in ((docs, spark.createDataFrame(docs, plain.SCHEMA)), (plain.ODD, odd)):
        got = mixing.taken(df, block_docs=4, shard_words=500).collect()
        assert len(got) == len(rows)
        size = defaultdict(int)
        for r in rows:
            size[r[3]] += plain.quality(r[1])[0]
        names = sorted(size, key=lambda s: (s is None, [ord(c) for c in s or ""]))
        goal = dict(zip(names, plain.targets([size[s] for s in names])))
        took, largest = defaultdict(int), defaultdict(int)
        for r in got:
            assert r.source_size == size[r.source]
            assert abs(r.target - goal[r.source]) <= 1e-6 * max(1, goal[r.source])
            assert r.taken in (0, r.size, 2 * r.size)
            took[r.source] += r.taken
            largest[r.source] = max(largest[r.source], r.size)
        assert all(abs(took[s] - goal[s]) <= largest[s] for s in names)
        again = mixing.taken(df.repartition(3), block_docs=4, shard_words=500).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))
        mixed = mixing.mix(df, block_docs=4, shard_words=500).collect()
        assert Counter(r.doc_id for r in mixed if r.text) == Counter({k: v for k, v in Counter(x for r in got if r.size for x in [r.doc_id] * r.times).items()}) + Counter(r.doc_id for r in mixed if r.text and not plain.quality(r.text)[0])
    assert mixing.taken(empty(spark)).count() == 0
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_shards_are_fair(spark, docs):
    df = spark.createDataFrame(docs, plain.SCHEMA)
    p = mixing.plan(df, block_docs=2, shard_words=4000)
    per = defaultdict(Counter)
    for r in p.places.collect():
        per[r.shard][r.i] += 1
    totals = sum(per.values(), Counter())
    n = [sum(c.values()) for c in per.values()]
    assert max(n) - min(n) <= np.log2(len(per)) + 1
    assert all(totals[r.i] >= r.n_blocks * r.passes for r in p.sources.collect())
    assert len({(r.i, r.block, r.pass_no) for r in p.places.collect()}) == p.places.count()


def check_packing(rows, got, capacity=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    want = Counter()
    for d, x, *_ in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            want[d, k, at, len(ids[at : at + capacity]), plain.crc(ids[at : at + capacity])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for at, n in sorted(b):
            assert at == end
            end += n
        assert end <= capacity
    return len(bins), -(-sum(r.length for r in got) // capacity)


def test_packing(spark, docs, odd):
    n, floor = check_packing(docs, packing.pack_documents(spark.createDataFrame(docs, plain.SCHEMA), with_ids=False).collect())
    assert n <= floor + 2
    check_packing(plain.ODD, packing.pack_documents(odd, with_ids=False).collect())
    assert packing.pack_documents(empty(spark)).count() == 0
    n, _ = check_packing(docs, packing.pack_documents(spark.createDataFrame(docs, plain.SCHEMA), shard_items=20).collect())
    assert n <= floor + 8


def test_genetic_steps_keep_packings_whole():
    rng = np.random.default_rng(5)
    lengths = np.sort(rng.integers(1, 100, 300))[::-1].copy()
    pop = packing.first_population(lengths, 100, 4, rng)
    for x in [*pop, packing.cross(pop[0], pop[1], lengths, 100, rng), *packing.evolve(pop, lengths, 100, 4, rng)]:
        assert (x >= 0).all() and np.bincount(x, weights=lengths).max() <= 100
        assert len(np.unique(x)) == x.max() + 1


def test_tokens_equal_the_library(docs):
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    odd = ["Áb <|endoftext|>. x<|EndOfText|>, it's don't O'S.", "ΑΣ. ΣΑΣ,", " a b\x1cc", "é., a..", "", None, "\n", "İI. K,", "12,5. 3.", "👍🏽. a,b.", "ﬁn. á. Á,", "a\x00b \x85 c", "É!! é$$$ 5é, é5", "́x. x́."]
    texts = [r[1] for r in docs] + odd
    got = [x.tolist() for x in tokens.encoded(pa.array(texts, pa.string()), tokens.default_tokenizer())]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_sql_on_odd_rows(spark, odd, tmp_path):
    """The SQL of the queries, over nulls, empty texts, ties and repeats."""
    import duckdb

    labels = [(1, 1, 0), (1, 1, 1), (5, 0, 0), (8, 1, 1), (8, 1, 1), (10, 1, 0), (11, 1, None), (None, 0, 1), (99, 0, 1)]
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "http://a.com/en/1", "x"), (1, "http://a.com/en/1", "x"), (2, None, None), (None, "", ""), (4, "https://A-b.C.xyz/p?q=1&r=%20#f", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    items = [(1, "the CAT sat"), (2, None), (3, "w1 w2 w3 w3 more a"), (3, "w1 w2 w3 w3 more a"), (None, "no id É́ı"), (5, "nowhere-at-all"), (6, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert queries.SQL.keys() <= queries.QUERIES.keys()
    for name, sql in queries.SQL.items():
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        want = Counter(cur.fetchall())
        got = queries.QUERIES[name](spark, str(tmp_path)).select(*names).collect()
        assert Counter(map(tuple, got)) == want, name


def test_extra_columns_with_clashing_names(spark, odd):
    """Columns that are named as those inside the operators keep their values."""
    names = ["fp", "size", "shard", "n_words", "host", "_keep", "_drops", "_th", "ls", "l", "i", "k", "row", "all", "uid", "_uid", "length", "kept", "failed", "measures", "_m", "_k", "src", "target", "passes", "cut", "_row", "_n", "_d", "with.dot", "part", "first"]
    wide = odd.select("*", *[quality.F.lit(n).alias(n) for n in names])
    for f in (simhash.keep_one, lines.drop_boilerplate, mixing.mix, quality.keep, mixing.taken, simhash.near_duplicates):
        rows, plain_rows = f(wide), f(odd)
        assert rows.count() == plain_rows.count()
        if f not in (mixing.taken, simhash.near_duplicates):
            assert rows.columns[: 5 + len(names)] == wide.columns
            assert all(r[n] == n for r in rows.collect() for n in names)
    cut = packing.pieces(odd, with_ids=False).select("*", quality.F.lit("x").alias("uid"), quality.F.lit("x").alias("shard"), quality.F.lit(5).alias("offset"))
    packed = packing.pack(cut).collect()
    assert len(packed) == cut.count() and all(r.uid == r.shard == "x" for r in packed)


def test_stages_on_odd_and_empty_tables(spark, odd):
    import corpus_pipeline

    for docs in (odd, empty(spark)):
        for _, f in corpus_pipeline.STAGES[:-1]:
            docs_out = f(spark, docs, "")
            assert docs_out.columns == docs.columns
            docs = docs_out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 0


def test_pipeline_against_a_plain_version(spark, sf_dir):
    import corpus_pipeline

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    led = {r.doc_id: r.kept for r in queries.op6_quality_rules(spark, sf_dir).collect()}
    rows = [r for r in docs if led[r[0]]]
    rows = [(r[0], t, r[2], r[3]) for r, t in zip(rows, plain.line_dedup([(r[0], r[1], r[3]) for r in rows], lines.RATIO, lines.MIN_PAGES))]
    comp = plain.components([r[0] for r in rows], [plain.simhash(r[1]) for r in rows], [r[1] for r in rows])
    rows = [r for r, c in zip(rows, comp) if r[0] == c]
    stage = spark.createDataFrame([(*r, len(r[1])) for r in rows], plain.SCHEMA)
    times = {r.doc_id: r.times for r in mixing.taken(stage).collect()}
    mixed = [r for r in rows for _ in range(times[r[0]])]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    n, floor = check_packing(mixed, got)
    assert n <= floor + 3
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in corpus_pipeline.STAGES[:-1]:
        now = f(spark, now, sf_dir)
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_copies_found(spark, sf):
    """Of all pairs of a similarity of 0.8 or more, those that the stage joins; of texts that no link reaches, none is lost."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain.components([r[0] for r in rows], [plain.simhash(r[1]) for r in rows], [r[1] for r in rows])
    known = simhash.materialize(simhash.fingerprints(docs), "test-fp")
    found = {r.doc_id: r.root for r in known.join(simhash._classes_of(known, simhash.similar_links(docs, known)), "fp").select("doc_id", "root").collect()}
    pairs = plain.similar_pairs([r[1] for r in rows])
    joined = [found[rows[i][0]] == found[rows[j][0]] for i, j in pairs]
    assert len(joined) >= 10 and np.mean(joined) >= 0.99
    kept = {r.doc_id for r in simhash.keep_one(docs, similar=0.8).collect()}
    assert kept <= set(want) | {r[0] for r in rows} and {r[0] for r, c in zip(rows, want) if r[0] == c} <= kept


def test_similar_texts_beside_a_plain_version(spark, odd):
    """Near copies that differ in many bits, in a group of hundreds, with short, empty and missing texts."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 200)]
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    for i in range(150):
        t = list(base)
        for k in rng.choice(200, 2, replace=False):
            t[k] = f"x{rng.integers(10**6)}"
        rows.append((1000 + i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs, similar=0.8).collect()}
    want = plain.components([r[0] for r in rows], [plain.simhash(r[1]) for r in rows], [r[1] for r in rows])
    assert {x for x in kept if x is not None} == {c for c in want if c is not None}


def test_quality_stage_finds_abuse_in_every_language(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, sf).select("doc_id").collect()}
    for lang in ("en", "fr", "de", "es"):
        x = [r.doc_id in kept for r in docs.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(f"lang = '{lang}' AND toxic = 1").select("doc_id").collect()]
        assert 1 - np.mean(x) > 0.9, lang


def test_stems_are_learned_from_other_documents(spark):
    """Half of the labels, held against the documents of the other half."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    stems = quality.learn_stems(docs, labels.where("doc_id % 2 = 0"))
    led = quality.apply_policy(quality.ledger(docs.where("doc_id % 2 = 1"), stems=stems), quality.LEARNED)
    x = led.join(labels, "doc_id").select("lang", "toxic", "quality", "kept", (quality.F.col("failed").bitwiseAND(quality.F.lit(quality.BIT["abusive_stems"])) != 0).alias("stem")).collect()
    for lang in ("en", "fr", "de", "es"):
        assert np.mean([not r.kept for r in x if r.lang == lang and r.toxic]) > 0.85, lang
        assert np.mean([r.stem for r in x if r.lang == lang and not r.toxic and r.quality]) < 0.02, lang
    assert quality.learn_stems(docs, labels.where("toxic = 0")) == {}


def test_groups_of_copies_keep_one_whole_text(spark):
    """A third of a source, or three copies among few pages; a line of many different texts goes as before."""
    import corpus_pipeline

    own = lambda i: "\n".join(f"{w} of page {i} and word {w * 2}" for w in ("alpha", "beta", "gamma", "delta"))
    rows = [(i, own(0), "en", "big", 0) for i in range(20)] + [(100 + i, f"{own(100 + i)}\nsite menu", "en", "big", 0) for i in range(40)]
    rows += [(200 + i, own(1), "en", "small", 0) for i in range(3)] + [(300 + i, own(300 + i), "en", "small", 0) for i in range(26)]
    got = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, plain.SCHEMA), "")
    texts = {r.doc_id: r.text for r in got.collect()}
    assert all(texts[i] == own(0) for i in range(20)) and all(texts[200 + i] == own(1) for i in range(3))
    assert all(texts[100 + i] == own(100 + i) for i in range(40))
    kept = Counter(r.text for r in corpus_pipeline.near_dedup(spark, got, "").collect())
    assert kept[own(0)] == kept[own(1)] == 1
