"""Line dedup by site-relative frequency.

Pages are grouped by host. A line is boilerplate of its host if it stands on at least ``min_pages`` of the host's pages and on more than
``ratio`` of them; all its occurrences there are dropped. The number of boilerplate lines of a host is bounded by its mean number of
lines a page divided by ``ratio``, whatever the number of pages.

A page is a row, or with ``distinct`` a different text: copies of one document then are one page, so that their own lines aren't
taken for boilerplate. Near copies are pages of their own; ``most`` keeps texts whole that would lose more than that share of their
lines, as what such a text shares with others isn't the frame of a page but the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, unwrapped, wide_hash, wrapped

#: On a site's pages, what stands on one of fifty is part of the site; under three pages nothing is a habit, however few pages there are.
RATIO = 0.02
MIN_PAGES = 3


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1)


def _blank(line: Column) -> Column:
    return ~line.rlike(WORD)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """``(_host, _a, _b, n_pages, host_pages)`` of each boilerplate line, known by a 128-bit hash. Blank lines never count.

    A page counts once for a line however often it repeats it; repeated rows are pages of their own unless ``distinct``. A null host is a host.
    """
    a, b = wide_hash(F.col("l"))
    ta, tb = wide_hash(F.col(f"`{text}`"))
    own = {"_ta": ta, "_tb": tb} if distinct else {}
    pages = docs.select(F.col(f"`{host}`").alias("_host"), *[c.alias(n) for n, c in own.items()], F.array_distinct(F.filter(_lines(text), lambda s: ~_blank(s))).alias("ls"))
    per = pages.select("_host", *own)
    lines = pages.select("_host", *own, F.explode("ls").alias("l")).select("_host", *own, a.alias("_a"), b.alias("_b"))
    if distinct:  # narrow rows of hashes, reduced where copies are read
        per, lines = per.distinct(), lines.distinct()
    totals = per.groupBy("_host").agg(F.count("*").alias("host_pages"))
    counts = lines.groupBy("_host", "_a", "_b").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    joined = counts.join(totals.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    return joined.where(F.col("n_pages") > F.lit(float(ratio)) * F.col("host_pages"))


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = False, most: float = 1.0, counts: tuple[str, str] | None = ("_n_lines", "_n_dropped")
) -> DataFrame:
    """``docs`` with ``text`` lacking its host's boilerplate lines, and with the numbers of all its lines and of those dropped (long) in the columns
    ``counts``, which replace columns of those names; None adds none.

    Columns of ``docs`` keep their names and places. A null text stays null and has one blank line; a text all of whose lines go
    becomes empty; the rest of a text is unchanged, byte for byte. The places of dropped lines are looked up once for copies of a text in one
    host, and a text is taken apart and put together once, however many of its lines go.
    """
    ta, tb = wide_hash(F.col(f"`{text}`"))
    la, lb = wide_hash(F.col("l"))
    found = boilerplate(docs, host, text, ratio, min_pages, distinct)
    # hashed before it is taken apart, once a text
    texts = docs.select(F.col(f"`{host}`").alias("_th"), ta.alias("_ta"), tb.alias("_tb"), _lines(text).alias("ls"))
    lines = texts.select("_th", "_ta", "_tb", F.posexplode("ls").alias("at", "l")).where(~_blank(F.col("l"))).select("_th", "_ta", "_tb", "at", la.alias("_la"), lb.alias("_lb"))
    hit = lines.join(found.select("_host", "_a", "_b"), F.col("_th").eqNullSafe(F.col("_host")) & (F.col("_la") == F.col("_a")) & (F.col("_lb") == F.col("_b")))
    drops = hit.groupBy("_th", "_ta", "_tb").agg(F.sort_array(F.collect_set("at")).alias("_drops"))
    rows = wrapped(docs, _hh=F.col(f"`{host}`"), _t=F.col(f"`{text}`"), _xa=ta, _xb=tb)
    out = rows.join(drops, F.col("_hh").eqNullSafe(F.col("_th")) & (F.col("_xa") == F.col("_ta")) & (F.col("_xb") == F.col("_tb")), "left")
    if most < 1.0:
        full = F.size(F.filter(_lines("_t"), lambda s: ~_blank(s)))
        out = out.withColumn("_drops", F.when(F.size("_drops") <= F.lit(float(most)) * full, F.col("_drops")))
    has = F.col("_drops").isNotNull()

    def others(ls: Column) -> Column:
        """The lines at other places; places are compared as numbers, by a hash table."""
        places = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_drops"))
        return F.transform(places, lambda k: F.get(ls, k))

    kept = unwrapped(docs, {text: F.when(has, F.array_join(let(_lines("_t"), others), "\n")).otherwise(F.col("_t"))})
    if counts is None:
        return out.select(*kept)
    own = [c for c, n in zip(kept, docs.columns) if n not in counts]
    return out.select(*own, F.size(_lines("_t")).cast("long").alias(counts[0]), F.when(has, F.size("_drops")).otherwise(F.lit(0)).cast("long").alias(counts[1]))
