import hashlib
import re
import time
from collections import Counter

import numpy as np
import pytest

from gaugelab.llm import fingerprints, html_text, idfiles, queries, secrets, tokens, trees, urls

from . import plain

BASE = {
    "assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def base_spans(text):
    return sorted((m.start(), i, m.end(), k) for i, (k, (p, ok)) in enumerate(BASE.items()) for m in p.finditer(text or "") if ok(m))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def odd(spark):
    return spark.createDataFrame(plain.ODD, plain.SCHEMA)


def empty(spark):
    return spark.createDataFrame([], plain.SCHEMA)


def test_secrets_base(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")  # the smallest tables hold no secrets
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op1_secret_scan(spark, sf_dir).collect()}
    assert sum(r.n_assign + r.n_access + r.n_hex for r in got.values()) > 0
    for d in docs:
        want, r = base_spans(d.text), got[d.doc_id]
        c = Counter(k for *_, k in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (c["assign"], c["access"], c["hex"])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert set(joined(want).split(",")) <= set(r.spans.split(","))


def test_secrets_edges_and_ownership(spark):
    key = "ghp_" + "a1B2" * 9
    rows = [
        (1, f"👍🏽 {key} Password = 'abc.defg' token==abcdef secret: api: abcdefgh", "en", "o1", 1),
        (2, "copied ghp_" + "Zz91" * 9, "en", "o1", 1),
        (3, "copied ghp_" + "Zz91" * 9, "fr", "o2", 1),
        (4, "TOKEN: token : abcdefgh apikey\"  :\"x1y2z3 AKIAKIA" + "B" * 20, None, None, 1),
        (4, None, "en", "o1", 1),
        (None, "f" * 5000 + " " + "password=secret1 " * 300, "en", "o3", 1),
    ]
    df = spark.createDataFrame(rows, plain.SCHEMA)
    got = secrets.scan(df, most_owners=1).select("doc_id", secrets.listed(secrets.F.col("base")).alias("base"), secrets.listed(secrets.F.col("spans")).alias("spans"), "n_live", "n_example").collect()
    assert Counter((r.doc_id, r.base) for r in got) == Counter((x[0], joined(base_spans(x[1]))) for x in rows)
    by = {r.doc_id: r for r in got}
    assert "issued:3:43" in by[1].spans
    assert "issued" not in by[2].spans and "issued" not in by[3].spans and by[2].n_example > 0
    assert secrets.scan(empty(spark)).count() == 0


def entropy_by_hand(x):
    c = np.bincount(x, minlength=256)
    p = c[c > 0] / len(x)
    return -(p * np.log2(p)).sum()


def test_entropy_and_features():
    rng = np.random.default_rng(3)
    x = rng.choice(np.frombuffer(b"abcdefgh  etaoin\n", np.uint8), 500)
    e = fingerprints._entropy(x)
    for i in range(0, len(e), 13):
        assert abs(e[i] / 256 - entropy_by_hand(x[i : i + 64])) < 0.02
    texts = [bytes(rng.choice(np.frombuffer(b"abcdefghijklm nop", np.uint8), n)) for n in (0, 1, 63, 64, 65, 130, 1000, 40000)]
    alone = [fingerprints.digests([t])[0] for t in texts]
    together = fingerprints.digests(texts)
    shuffled = fingerprints.digests(texts[::-1])[::-1]
    for a, b, c in zip(alone, together, shuffled):
        assert fingerprints.text_of(a) == fingerprints.text_of(b) == fingerprints.text_of(c)
    assert len(alone[0]) == 0 and len(alone[-1]) > 1 and fingerprints.likeness(alone[-1], together[-1]) == 1.0


def test_fingerprints_of_edited(spark, sf_dir):
    for df in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd(spark)):
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        want = Counter()
        for (d, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
            n = len(t) // 2
            want[d, len(t), hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest(), fingerprints.text_of(fingerprints.digests([t.encode()])[0])] += 1
        got = fingerprints.compare_with_next(df).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        if df.count() > 100:
            long = [r for r in got if r.n_chars > 600]
            assert np.mean([r.near_edited for r in long]) > 0.35
            assert np.mean([r.near_next for r in long]) < 0.15
    assert fingerprints.compare_with_next(empty(spark)).count() == 0


def test_trees_learn_and_agree_with_their_expression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
    m = trees.fit(x[:1500], y[:1500], rounds=20)
    s = m.score(x[1500:])
    assert ((s > 0) == y[1500:]).mean() > 0.95
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in x[1500:1600]], "a double, b double, c double")
    got = df.select(m.column([urls.F.col(c) for c in "abc"]).alias("s")).collect()
    assert np.allclose([r.s for r in got], s[:100])


def test_url_parts_and_rules(spark):
    cases = {
        "http://A.example.com/en/7?q#f": ("a.example.com", "/en/7", "example.com/en/7", "allow"),
        "http://x.com/en/1": ("x.com", "/en/1", "com/en/", "block"),
        "https://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "https://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"),
        "https://net/de/": ("net", "/de/", "net/de/", "allow"),
        "https://a.org#/es/": ("a.org", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "no scheme/en/": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "http://É.ORG/es/é\nx": ("É.org", "/es/é\nx", "org/es/", "block"),
        "://": ("", "", None, None),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, verdict string")
    m = urls.seed_model(spark)
    for r in urls.judge(df, m).collect():
        host, path, rule, verdict = cases[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    held = urls.seed_labels(1000, seed=99)
    got = urls.judge(spark.createDataFrame(held, "url string, y int"), m, rules=(("block", "nowhere.invalid", "/"),)).collect()
    assert np.mean([(r.verdict == "block") == r.y for r in got]) > 0.93
    assert urls.train(spark.createDataFrame([], "url string, label int")).trees.trees == []


def test_url_verdicts_on_pages(spark, sf_dir):
    got = [r for r in queries.op7_url_filter(spark, sf_dir.replace("0.001", "0.01")).collect() if r.rule is None]
    lures = [r.verdict == "block" for r in got if "-" in r.host]
    rest = [r.verdict == "allow" for r in got if "-" not in r.host]
    assert np.mean(lures) > 0.9 and np.mean(rest) > 0.95


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_give_random_access(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.3, rng.integers(0, 256, n), np.where(rng.random(n) < 0.9, rng.integers(0, 49408, n), rng.integers(0, 1 << 32, n))).astype(np.uint32)
    ends = np.unique(np.append(rng.integers(0, n + 1, 7), n))
    b = idfiles.Block(idfiles.encode_block(ids, ends))
    assert b.ids(0, n).tolist() == ids.tolist()
    for lo, hi in rng.integers(0, n + 1, (20, 2)):
        lo, hi = sorted((int(lo), int(hi)))
        assert b.ids(lo, hi).tolist() == ids[lo:hi].tolist()
    for i in rng.integers(0, max(n, 1), 50 if n else 0):
        assert b[int(i)] == ids[i]
    assert np.concatenate([b.document(k) for k in range(len(ends))]).tolist() == ids.tolist()


def test_token_files(spark, sf_dir):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    for df in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd(spark)):
        rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        want, at = Counter(), 0
        for d, x in rows:
            ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
            want[d, at, len(ids), plain.crc(ids)] += 1
            at += len(ids)
        got = idfiles.round_trip(df, block_ids=5000).select("doc_id", "start", "n_tokens", urls.F.crc32("ids").alias("c")).collect()
        assert Counter(map(tuple, got)) == want
    assert idfiles.round_trip(empty(spark)).count() == 0


def article(page):
    """The main text of the test tables' pages, by their one layout."""
    import html

    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", body)
    texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", p)).replace("\0", "")) for p in (re.sub(r"</?[a-z]+>", lambda m: m[0] if m[0] == "<br>" else "", p) for p in parts))
    return "\n".join(t.strip() for t in texts if t.strip())


def test_html_of_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op10_html_text(spark, sf_dir).collect()
    assert [r.text for r in got] == [article(pages[r.page_id]) for r in got]
    assert all(r.n_chars == len(r.text) for r in got)


def test_html_held_out_layouts():
    m = html_text.default_model()
    x, y = html_text.training_sample(150, seed=77)
    assert ((m.score(x) > 0) == y).mean() > 0.97


def test_html_cases(spark):
    m = html_text.default_model()
    one = lambda p: html_text.extract_all([p], m)[0]
    words = "The quick brown fox jumps over the lazy dog, and runs on. " * 6
    page = f"""<html><head><title>no</title><script>var a="<p>no</p>"</script></head><body><header><h1>Site no</h1><nav><a href=/>no</a></nav></header>
    <main><article><h1>Head &amp; &eacute;</h1><p>One\n two&nbsp;three <b>bold</b>.<p>{words}<div class="ad">no ad</div><ul><li>first item<li>second item</ul></article>
    <section class="comments"><h3>Comments no</h3><div class="comment"><p>no I think</p></div></section></main><aside class="sidebar"><p>no side</p></aside>
    <form><label>no</label><input></form><div class="cookie-notice"><p>no cookies</p></div><footer>&copy; no</footer></body></html>"""
    got = one(page).split("\n")
    assert got[:3] == ["Head & é", "One two three bold.", words.strip()]
    assert not re.search(r"\bno\b", one(page))
    assert html_text.extract_all([None, "", "<", "<p", "</div></div>", "<p>" * 3000], m)[0] == ""
    for hard in ("<a" * 60_000, "<a '" * 60_000, "<div>" * 20_000 + "</span>" * 60_000, "<b>" * 20_000 + "<p>" * 20_000, "<!--" * 50_000, "<script>" * 20_000, "<li>" * 20_000 + "</ul>" * 20_000, "&" * 100_000):
        began = time.monotonic()
        html_text.extract_all([hard + ">"], m)
        assert time.monotonic() - began < 20
    df = spark.createDataFrame([(1, None, None), (1, "u", page), (None, "u", "")], "page_id long, url string, html string")
    assert Counter((r.page_id, r.text) for r in html_text.extract(df).collect()) == Counter([(1, ""), (1, one(page)), (None, "")])
    assert html_text.extract(df.limit(0)).count() == 0


def test_likeness_does_not_jump_at_a_length(sf_dir):
    import pyarrow.parquet as pq

    texts = [t.encode() for t in pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist() if t and len(t.encode()) > 700][:40]
    for n in (200, 511, 512, 600):
        like = [fingerprints.likeness(*fingerprints.digests([t[:n], t[: n + 2]])) for t in texts]
        assert np.mean(like) > 0.9, n
