"""URL filters: rules by host and path, and gradient-boosted trees on lexical features (DataFrame expressions on the main path).

Features of a URL are length, depth, digit ratio, character entropy, parameter counts, punctuation of its host, and the smoothed rate of blocked
ones among the labelled URLs of its host's suffix. No word is looked up. The trees are fitted on a bounded sample of labelled URLs and are applied as
one expression. ``features_of`` computes the same features of one URL on the driver, where the trees are fitted.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import trees
from .common import ascii_lower, let, unwrapped, wrapped

#: (verdict, host, path prefix); fixed values.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: At most so many labelled URLs, of least hash, are used for a fit.
MOST_LABELLED = 20_000
FEATURES = ("length", "host_length", "depth", "digit_ratio", "host_digits", "host_marks", "host_parts", "entropy", "n_params", "query_length", "longest_part", "marks_below", "marked_part", "suffix_rate")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a domain above it, and the path's beginning; null if none does."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


@dataclass
class Model:
    """``suffix``: rate of URLs to block by the host's last part; ``usual``: that of others."""

    trees: trees.Trees
    suffix: dict[str, float]
    usual: float


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _parts(host: Column) -> Column:
    return F.filter(F.split(host, "[.-]"), lambda w: F.char_length(w) > 1)


def _entropy(s: Column) -> Column:
    """Bits a character, to six places, from the runs of the sorted characters."""
    n = F.char_length(s)

    def step(acc: Column, c: Column) -> Column:
        same = acc["c"] == c
        return F.struct(c.alias("c"), F.when(same, acc["run"] + 1.0).otherwise(1.0).alias("run"), F.when(same, acc["sum"]).otherwise(acc["sum"] + acc["run"] * F.log2(acc["run"])).alias("sum"))

    start = F.struct(F.lit("").alias("c"), F.lit(1.0).alias("run"), F.lit(0.0).alias("sum"))
    total = F.aggregate(F.array_sort(F.split(s, "")), start, step, lambda acc: acc["sum"] + acc["run"] * F.log2(acc["run"]))
    return F.when(n > 0, F.round(F.log2(n.cast("double")) - total / n, 6)).otherwise(0.0)


def _marked(host: Column) -> Column:
    """The longest part of the host's names that hold a hyphen or underscore; 0 if none does."""
    names = F.filter(F.split(host, r"\."), lambda x: x.rlike("[-_]"))
    return F.coalesce(F.array_max(F.transform(F.split(F.array_join(names, "-"), "[-_]"), lambda w: F.char_length(w))), F.lit(0))


def features(url: Column, host: Column, path: Column, m: Model) -> list[Column]:
    """In the order of FEATURES."""
    u = F.coalesce(url, F.lit(""))
    size = F.char_length(u)
    query = F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1)
    digits = lambda s: F.char_length(F.regexp_replace(s, "[^0-9]+", ""))
    rate = F.lit(m.usual)
    if m.suffix:
        at = F.array_position(F.array(*[F.lit(k) for k in m.suffix]), _suffix(host)).cast("int") - 1
        rate = F.when(at >= 0, F.get(F.array(*[F.lit(v) for v in m.suffix.values()]), at)).otherwise(m.usual)
    out = [
        size,
        F.char_length(host),
        F.size(F.filter(F.split(path, "/"), lambda s: s != "")),
        F.when(size > 0, digits(u) / size).otherwise(0.0),
        digits(host),
        F.char_length(F.regexp_replace(host, "[^-_]+", "")),
        F.size(F.split(host, r"\.")),
        _entropy(u),
        F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        F.char_length(query),
        F.coalesce(F.array_max(F.transform(_parts(host), lambda w: F.char_length(w))), F.lit(0)),
        F.char_length(F.regexp_replace(F.regexp_replace(host, r"\.?[^.]*\.?[^.]*$", ""), "[^-_]+", "")),
        _marked(host),
        rate,
    ]
    return [c.cast("double") for c in out]


def features_of(url: str | None, m: Model | None = None) -> tuple[str, list[float]]:
    """The suffix of one URL's host, and its features; without a model's rates the last one is left out."""
    u = url or ""
    host = u.partition("://")[2] if "://" in u else ""
    rest = re.split("[/?#]", host, maxsplit=1)[0]
    path = re.split("[?#]", host[len(rest) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda x: x[0].lower(), rest)
    before, asked, query = u.partition("?")
    query = query.partition("#")[0] if asked and "#" not in before else ""
    suffix = host.rpartition(".")[2]
    counts = Counter(u)
    n = len(u)
    bits = round(math.log2(n) - sum(c * math.log2(c) for c in counts.values()) / n, 6) if n else 0.0
    out = [
        n, len(host), sum(1 for x in path.split("/") if x), len(re.findall("[0-9]", u)) / n if n else 0.0, len(re.findall("[0-9]", host)), len(re.findall("[-_]", host)),
        len(host.split(".")), bits, len(query.split("&")) if query else 0, len(query), max((len(w) for w in re.split("[.-]", host) if len(w) > 1), default=0),
        len(re.findall("[-_]", ".".join(host.split(".")[:-2]))), max((len(w) for x in host.split(".") if re.search("[-_]", x) for w in re.split("[-_]", x)), default=0),
    ]
    return suffix, [float(x) for x in (out if m is None else [*out, m.suffix.get(suffix, m.usual)])]


def fit(labelled: list[tuple[str, int]], **how) -> Model:
    """From (URL, label) pairs, label 1 to block."""
    if not labelled:
        return Model(trees.Trees(0.0, []), {}, 0.5)
    known = [features_of(u) for u, _ in labelled]
    y = [int(v) for _, v in labelled]
    usual = sum(y) / len(y)
    seen: dict[str, list[int]] = {}
    for (s, _), v in zip(known, y):
        seen.setdefault(s, []).append(v)
    suffix = {k: (sum(v) + 4 * usual) / (len(v) + 4) for k, v in sorted(seen.items())}
    x = np.array([[*f, suffix[s]] for s, f in known])
    return Model(trees.fit(x, np.array(y), **how), suffix, usual)


def train(labelled: DataFrame, url="url", label="label", most: int = MOST_LABELLED, **how) -> Model:
    """From ``label`` 1 (block) or 0 (allow). At most ``most`` rows, those of least URL hash, come to the driver. Nulls are left out."""
    rows = labelled.select(F.col(f"`{url}`").alias("u"), F.col(f"`{label}`").cast("int").alias("y")).where("u IS NOT NULL AND y IS NOT NULL")
    return fit([(r["u"], r["y"]) for r in rows.orderBy(F.xxhash64("u"), "u", "y").limit(most).collect()], **how)


def score(url: Column, host: Column, path: Column, m: Model) -> Column:
    """Log-odds that the URL is one to block."""
    return let(F.array(*features(url, host, path, m)), lambda f: m.trees.column([F.get(f, F.lit(i)) for i in range(len(FEATURES))]))


def judge(pages: DataFrame, m: Model, url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``score``; columns of those names are replaced, also if one is the URL's. A null URL is judged as an empty one; repeated rows are judged each for itself."""
    new = ("host", "path", "rule", "verdict", "score")
    kept = [c for c, n in zip(unwrapped(pages), pages.columns) if n not in new]
    rows = wrapped(pages, _url=F.col(f"`{url}`"), host=host_of(F.col(f"`{url}`")), path=path_of(F.col(f"`{url}`")))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    out = rows.select("_row", "host", "path", rule.alias("rule"), verdict.alias("ruled"), score(F.col("_url"), F.col("host"), F.col("path"), m).alias("score"))
    own = F.when(F.col("score") > 0, "block").otherwise("allow")
    return out.select(*kept, "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")


def _name(r: random.Random, syllables: int) -> str:
    return "".join(r.choice("bcdfghjklmnprstvwz") + r.choice(("", "", "", "h", "r", "l")) + r.choice("aeiou") + r.choice(("", "", "n", "r", "s", "t", "l")) for _ in range(syllables))


#: Suffixes of generated URLs with how often plain sites and those to block have them.
_SUFFIXES = {"com": (44, 36), "org": (14, 5), "net": (10, 12), "edu": (7, 0.3), "gov": (4, 0.1), "de": (6, 3), "fr": (5, 2), "uk": (5, 3), "io": (3, 4), "info": (1.5, 11), "biz": (0.5, 9), "xyz": (0.4, 9), "top": (0.1, 6)}


def _word(r: random.Random, least: int, most: int) -> str:
    return (_name(r, 5) + "nestor")[: r.randint(least, most)]


def seed_labels(n: int = 6000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled URLs from a rule of shape alone, for tables that carry no labels; half of them are to block.

    Hyphens, digits, depth, parameters and cheap suffixes stand on both sides, and what tells them apart is how they meet. To block are two or three short
    words joined below a platform's name; own names with digits or hyphens under a cheap suffix; names of letters and digits in disorder with long
    queries. Plain sites join words in a name of their own, or below it where one of them is long; they have digits, deep paths and parameters
    too, each less often together.
    """
    r = random.Random(seed)
    plain = lambda bad: r.choices(list(_SUFFIXES), [v[bad] for v in _SUFFIXES.values()])[0]
    cheap = lambda: r.choice(("info", "biz", "xyz", "top", "xyz"))
    above = lambda p: [r.choice(("www", "www", "blog", "m", "news", "shop"))] if r.random() < p else []
    segment = lambda: r.choice((_name(r, r.randint(1, 4)), _name(r, 2) + "-" + _name(r, 2), r.choice(("en", "de", "fr", "es")), str(r.randint(1, 99999))))
    out = []
    for i in range(n):
        bad, k = i % 2, r.random()
        asked = r.choice((0, 0, 0, 1, 2, 3) if not bad else (0, 0, 0, 1, 2, 4))
        if bad and k < 0.42:  # a lure below a platform
            name = r.choice("--__-----").join([_word(r, 2, 6), _word(r, 1, 6), *([_word(r, 2, 5)] if r.random() < 0.2 else [])])
            host = [*above(0.5), name, _name(r, r.randint(2, 4)) if r.random() < 0.7 else "example", r.choice((plain(0), plain(0), cheap()))]
        elif bad and k < 0.7:  # a name of its own that says too much
            name = "-".join(_word(r, 2, 7) for _ in range(r.choice((1, 2, 3, 4))))
            host = [*above(0.4), name + (str(r.randint(1, 999)) if r.random() < 0.6 else ""), cheap()]
            asked = r.choice((1, 2, 4, 6))
        elif bad:  # disorder
            name = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(9, 22)))
            host = [*above(0.2), name, plain(1)]
            asked = r.choice((0, 1, 2, 3, 6))
        elif k < 0.28:  # words joined in a name of its own
            host = [*above(0.6), "-".join(_word(r, 2, 9) for _ in range(r.choice((2, 2, 2, 3, 4)))), plain(0) if r.random() < 0.95 else cheap()]
        elif k < 0.4:  # joined below it, one of them long
            parts = [_word(r, 8, 13), *[_word(r, 2, 9) for _ in range(r.choice((1, 1, 2)))]]
            r.shuffle(parts)
            host = [*above(0.3), "-".join(parts), _name(r, r.randint(2, 3)), plain(0)]
        else:
            name = _name(r, r.randint(1, 5)) + (str(r.randint(1, 999)) if r.random() < 0.1 else "")
            host = [*above(0.6), *([_name(r, r.randint(1, 4))] if r.random() < 0.5 else []), name if r.random() < 0.8 else "example", plain(0) if r.random() < 0.96 else cheap()]
        path = "".join("/" + segment() for _ in range(r.randint(0, 5)))
        tail = "?" + "&".join(f"{_name(r, 1)}={r.choice((_name(r, 2), str(r.randint(0, 10**6))))}" for _ in range(asked)) if asked else r.choice(("", "/", ".html", "#top"))
        out.append((r.choice(("http", "https")) + "://" + ".".join(host) + path + tail, bad))
    return out


@lru_cache(maxsize=1)
def seed_model(spark: SparkSession | None = None) -> Model:
    """Fitted on generated URLs; the same in every session."""
    return fit(seed_labels())
