"""Secret scans with corpus-wide ownership frequency (DataFrame expressions only).

Each text is searched once. Base kinds are reported wherever they match. Two further kinds are candidates: keys in the format of a known
issuer, and opaque strings of mixed letters and digits. What decides on a candidate is who holds it: its hash is counted over the corpus by
distinct owners and distinct repositories. A value that many owners hold is a widely copied example; one that few hold is theirs and looks live, in
however many of their repositories they have left it. Live-looking candidates become spans; base spans are graded the same way but always stay.

A repository is one owner's body of work that may be copied as a whole. Where no column names it, it is a different text of an owner: copies
of one document, as forks are, count once. Where the owner is unknown, repositories stand in for owners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

#: Kind -> (pattern, group that holds the value, least length of the value). The base kinds are fixed values.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
FURTHER = {
    "issued": (r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|sk_(?:live|test)_[A-Za-z0-9]{16,})", 0, 1),
    "opaque": (r"[A-Za-z0-9+/_-]{24,}={0,2}", 0, 24),
}
#: What a value of a kind holds besides.
HOLDS = {"opaque": ("[0-9]", "[A-Z]", "[a-z]")}
KINDS = BASE | FURTHER
#: A value that more owners hold, or more repositories of unknown owners, is an example. A few of each are copies and moves of the real thing.
MOST_OWNERS, MOST_REPOS = 3, 3

_SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _running(sizes: Column, block: int = 64) -> Column:
    """Sums of an array of numbers up to and with each, in blocks: the work grows with the array, not with its square.

    Places are read one by one, as a slice of an array costs the whole array.
    """
    zero = F.lit(0).cast("long")

    def over(a: Column) -> Column:
        total = lambda lo, hi: F.aggregate(F.sequence(lo, hi), zero, lambda x, k: x + F.get(a, k))
        last = F.size(a) - 1
        blocks = F.transform(F.sequence(F.lit(0), F.floor(last / F.lit(block)).cast("int")), lambda b: total(b * block, F.least(last, b * block + (block - 1))))

        def joined(parts: Column) -> Column:
            step = lambda acc, p: F.struct((acc["at"] + p).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
            before = F.aggregate(parts, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), step)["out"]
            each = lambda starts: F.transform(a, lambda _, i: F.get(starts, F.floor(i / F.lit(block)).cast("int")) + total(i - i % block, i))
            return let(before, each)

        return let(blocks, joined)

    return let(sizes, over)


def _found(text: Column, kind: str) -> Column:
    """Leftmost matches that don't overlap, as an array of spans in code points; those whose value is too short are dropped afterwards.

    The gaps between matches (``split``) and the matches give the places. Texts without a match pay for one search.
    """
    pattern, group, least = KINDS[kind]
    number = list(KINDS).index(kind)
    none = F.array().cast(f"array<{_SPAN}>")
    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    parts = F.struct(F.split(text, pattern, -1).alias("gap"), every(0).alias("match"), every(group).alias("value"))

    def place(p: Column) -> Column:
        ends = _running(F.transform(p["match"], lambda m, i: (F.char_length(F.get(p["gap"], i)) + F.char_length(m)).cast("long")))

        def spans(e: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                end = F.get(e, i).cast("int")
                return F.struct((end - F.char_length(m)).alias("start"), F.lit(number).alias("kind"), end.alias("end"), F.get(p["value"], i).alias("value"))

            return F.transform(p["match"], span)

        return let(ends, spans)

    def counts(s: Column) -> Column:
        ok = F.char_length(s["value"]) >= least
        for held in HOLDS.get(kind, ()):
            ok = ok & s["value"].rlike(held)
        return ok

    spans = F.filter(let(parts, place), counts)
    return F.when(text.rlike(pattern), spans).otherwise(none)


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """``(hash, owner, repo)`` rows -> one row for each hash: numbers of distinct owners, of distinct repositories (each of one owner), and of those without owner.

    Owners are reduced before hashes, so that a hash that all documents hold is many small groups first.
    """
    pairs = candidates.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return pairs.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"), F.sum(F.when(F.col("owner") == "", F.col("n")).otherwise(0)).alias("n_unowned"))


def scan(docs: DataFrame, doc_id="doc_id", text="text", owner="source", repo: str | None = None, most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """One row for each row of ``docs``: ``(doc_id, base, spans, n_live, n_example, most_owners, most_repos)``.

    ``base`` and ``spans`` are arrays of (start, kind, end, hash); ``spans`` are the base spans and the live-looking candidates. ``n_live`` and
    ``n_example`` count the values by ownership, and the last two tell how many owners and repositories the most copied value of the row has (0
    without values). ``repo`` is a column, or None for the text itself. A null text counts as empty; documents without owner count as one
    owner's, so that only their repositories tell an example among them; repeated rows each get theirs. Values themselves leave the scan as
    SHA-256 hashes only. The work on a text grows with its length and its matches.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def search(x: Column) -> Column:
        return F.concat(*[_found(x, k) for k in KINDS])

    hashed = F.transform(let(t, search), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    who = F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit(""))
    work = F.md5(t) if repo is None else F.coalesce(F.col(f"`{repo}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), who.alias("owner"), work.alias("repo"), hashed.alias("all"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "secrets-spans")  # written, so that row numbers stay

    n_base = len(BASE)
    base = F.filter("all", lambda s: s["kind"] < n_base)
    some = rows.where(F.size("all") > 0)
    each = some.select("row", "owner", "repo", F.explode("all").alias("s"))
    owned = ownership(each.select(F.col("s.hash").alias("hash"), "owner", "repo"))
    graded = each.select("row", "s", F.col("s.hash").alias("hash")).join(owned, "hash")
    live = (F.col("n_owners") <= most_owners) & (F.col("n_unowned") <= most_repos)
    per = graded.groupBy("row").agg(
        F.collect_list(F.when((F.col("s.kind") < n_base) | live, F.col("s"))).alias("spans"),
        F.sum(live.cast("long")).alias("n_live"),
        F.sum((~live).cast("long")).alias("n_example"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repos").alias("most_repos"),
    )
    counts = ["n_live", "n_example", "most_owners", "most_repos"]
    nothing = rows.where(F.size("all") == 0).select("doc_id", F.col("all").alias("base"), F.col("all").alias("spans"), *[F.lit(0).cast("long").alias(c) for c in counts])
    return some.join(per, "row").select("doc_id", base.alias("base"), "spans", *counts).unionAll(nothing)
