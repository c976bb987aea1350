"""Quality rules as a bitmask ledger (DataFrame expressions only).

Every rule is evaluated once for each document. The ledger keeps the measurements and one failure bit for each rule; a policy is a named
version with a mask of the rules that reject, so that policies are applied, compared and ablated by bitwise operations on the ledger
without reading a text again.

Abuse is known by stems that are learned from labelled documents, language by language (``learn_stems``); no word is written down here. A
ledger without stems never fails their rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, discard, let, materialize, shuffle_width, unwrapped, words_of, wrapped

#: Rule name -> failure, as a function of the measurements. The place in this table is the bit; rules are only ever appended, and a retired one keeps its
#: place and never fails, so that stored ledgers read as they were written.
RULES = {
    "too_few_words": lambda m: m["n_words"] < 50,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbol_heavy": lambda m: 5 * m["n_symbols"] > m["n_words"],
    "few_letters": lambda m: 10 * m["n_marks"] > 4 * m["word_chars"],
    "shouting": lambda m: 10 * m["n_upper"] > 4 * (m["word_chars"] - m["n_marks"]),
    "bang_heavy": lambda m: 2 * m["n_bangs"] > m["n_words"],
    "odd_word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]),
    "repeated_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
    "abusive_words": None,  # a fixed list, retired
    "abusive_stems": lambda m: (m["n_stems"] >= 3) & (1000 * m["n_stems"] >= 5 * m["n_words"]),
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE_MASK = BIT["too_few_words"] | BIT["repeated_windows"]


def mask(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: Versions are never edited, only added. web-2 and web-3 had a rule of fixed words, which is gone with them.
POLICIES = {
    "base-1": BASE_MASK,
    "web-1": mask("too_few_words", "repeated_windows", "symbol_heavy", "few_letters", "shouting", "bang_heavy", "odd_word_length", "repeated_lines"),
    "web-4": mask(*[n for n, rule in RULES.items() if rule]),
}
CURRENT = LEARNED = "web-4"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_bangs", "n_stems")

#: Labelled documents that stems are learned from, at most about so many of each class, chosen by a hash of doc_id.
MOST_TOXIC, MOST_CLEAN = 1000, 2000
#: A stem is the first so many letters of a word.
STEM = (4, 5, 6, 7)
#: A stem marks abuse if it is in so many toxic documents of its language and in so many hundredths of them, with a share of the words so many times that of clean ones.
STEM_DOCS, STEM_HUNDREDTHS, STEM_RATIO = 4, 3, 15
#: What counts as a document's whole share, and what is added to the share in clean documents, in parts of a whole one.
WHOLE, FLOOR = 10_000, 200
_LETTERS = r"[\p{L}\p{N}_]+"
#: Places that a hash gives a doc_id for the choice of the sample.
_GRAIN = 1 << 20


def learn_stems(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str | None, list[str]]:
    """Language -> stems that mark its abuse, from the documents that ``labels`` (doc_id, toxic) has; of nested stems the shortest.

    The sample is bounded, and so is what comes to the driver. A document's share counts up to a twentieth of its words, so that no
    document decides alone. Labels that contradict each other count as toxic.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_d")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    size = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    if not size.get(1):
        return {}
    part = lambda y, most: F.lit(_GRAIN * most // max(1, size.get(y, 0)) + 1)
    place = F.conv(F.substring(F.md5(F.col("_d").cast("string")), 1, 5), 16, 10).cast("int")
    chosen = known.where(place < F.when(F.col("_toxic") == 1, part(1, MOST_TOXIC)).otherwise(part(0, MOST_CLEAN)))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_d"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    # at most about MOST_TOXIC + MOST_CLEAN rows are broadcast, and no text is parted before it is chosen; the chosen ones are dealt out again, as few of the files' parts hold them
    chosen_rows = materialize(rows.join(F.broadcast(chosen), "_d").repartition(shuffle_width(docs.sparkSession), F.xxhash64("_d", "text")), "quality-labelled")
    rows = chosen_rows.withColumn("_ws", F.regexp_extract_all(F.lower("text"), F.lit(_LETTERS), F.lit(0)))
    words = rows.select("_d", "lang", "_toxic", F.size("_ws").alias("n"), F.explode("_ws").alias("word")).groupBy("_d", "lang", "_toxic", "n", "word").agg(F.count("*").alias("c"))
    written = materialize(words, "quality-words")  # prefixes are cut from different words
    discard(chosen_rows)  # written, as Spark would move filters on their words before the choice
    held = written.where("n >= 20")
    groups = held.select("_d", "lang", "_toxic").distinct().groupBy("lang").agg(F.greatest(F.lit(1), F.count_if(F.col("_toxic") == 1)).alias("bad"), F.greatest(F.lit(1), F.count_if(F.col("_toxic") == 0)).alias("good"))
    begins = F.array_compact(F.array(*[F.when(F.char_length("word") >= j, F.left("word", F.lit(j))) for j in STEM]))
    each = held.select("_d", "lang", "_toxic", "n", "c", F.explode(begins).alias("stem"))
    # whole numbers, so that no order of adding up matters
    share = each.groupBy("_d", "lang", "_toxic", "n", "stem").agg(F.least(F.lit(WHOLE).cast("long"), F.floor(20 * WHOLE * F.sum("c") / F.col("n"))).alias("share"))
    toxic = F.col("_toxic") == 1
    sums = share.groupBy("lang", "stem").agg(*[F.sum(F.when(c, v).otherwise(F.lit(0).cast("long"))).alias(k) for k, c, v in (("hit", toxic, F.col("share")), ("base", ~toxic, F.col("share")), ("n_hit", toxic, F.lit(1)), ("n_base", ~toxic, F.lit(1)))])
    sums = sums.join(groups.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))  # a row for each language
    bad, good = F.col("bad"), F.col("good")
    often = (F.col("n_hit") >= STEM_DOCS) & (100 * F.col("n_hit") >= STEM_HUNDREDTHS * bad)
    marks = often & (F.col("hit") * good >= STEM_RATIO * (F.col("base") + FLOOR) * bad) & (F.col("n_hit") * good >= 3 * F.col("n_base") * bad)
    out: dict[str | None, list[str]] = {}
    for r in sums.where(marks).select("lang", "stem").collect():
        out.setdefault(r["lang"], []).append(r["stem"])
    discard(written)
    return {k: sorted(x for x in v if not any(x[:j] in v for j in range(1, len(x)))) for k, v in out.items()}


def _stem_count(text: Column, lang: Column, stems: dict[str | None, list[str]]) -> Column:
    """Words of a text that begin with a stem of its language."""
    count = F.lit(0)
    for k, v in stems.items():
        count = F.when(lang.eqNullSafe(F.lit(k)), F.regexp_count(F.lower(text), F.lit(rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(v)})"))).otherwise(count)
    return count.cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that is found twice or more. Texts without such a window, which are most, skip the sort."""

    def count(ws: Column) -> Column:
        hashes = F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
        return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(F.slice(hashes, F.lit(1), F.size(ws) - 2), repeated))

    def repeated(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]))
        at = F.sort_array(F.transform(again, lambda x: x["i"]))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    return let(words, count).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``_m`` of the measurements. A null text counts as empty.

    Words are runs of anything but the six ASCII blanks; lines are parted by ``\\n`` and count if they hold a word; marks are the visible
    ASCII characters that aren't letters, upper-case letters those from A to Z.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def of(p: Column) -> Column:
        x, ws = p["t"], p["w"]
        size = F.char_length(x)
        count = lambda kept, alias: (size - F.char_length(kept)).cast("long").alias(alias)
        lines = F.filter(F.split(x, "\n", -1), lambda s: s.rlike(WORD))
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            count(F.regexp_replace(x, r"[#*$%&|<>]+", ""), "n_symbols"),
            let(lines, lambda s: F.struct(F.size(s).cast("long").alias("all"), (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(ws).alias("n_repeat_words"),
            count(F.regexp_replace(x, r"[!-@\[-`{-~]+", ""), "n_marks"),
            count(F.regexp_replace(x, r"[A-Z]+", ""), "n_upper"),
            count(F.replace(x, F.lit("!"), F.lit("")), "n_bangs"),
        )

    return docs.withColumn("_m", let(F.struct(t.alias("t"), words_of(F.col(f"`{text}`")).alias("w")), of))


def ledger(docs: DataFrame, text: str = "text", stems: dict[str | None, list[str]] | None = None, lang: str = "lang") -> DataFrame:
    """``docs`` with the measurements as columns of ``measures`` and the failure bits ``failed`` (long); columns of those names are replaced. ``stems`` by ``lang`` as ``learn_stems`` gives them.

    A null text counts as empty and fails for its few words; repeated rows are judged each for itself.
    """
    m = F.col("_m")
    parts = {"n_dup_lines": m["lines"]["dup"], "n_lines": m["lines"]["all"]}
    parts["n_stems"] = _stem_count(F.coalesce(F.col("_text"), F.lit("")), F.col("_lang"), stems) if stems else F.lit(0).cast("long")
    own = {"_text": F.col(f"`{text}`")} | ({"_lang": F.col(f"`{lang}`")} if stems else {})
    kept = [c for c, n in zip(unwrapped(docs), docs.columns) if n not in ("measures", "failed")]
    out = measure(wrapped(docs, **own), "_text").withColumn("_measures", F.struct(*[(parts[k] if k in parts else m[k]).alias(k) for k in MEASURES]))
    bits = [F.when(rule(F.col("_measures")), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items() if rule]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return out.select(*kept, F.col("_measures").alias("measures"), failed.cast("long").alias("failed"))


def apply_policy(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``kept`` (a column of that name is replaced): no rule of the policy's mask failed."""
    return led.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def keep(docs: DataFrame, policy: str | None = None, text: str = "text", stems: dict[str | None, list[str]] | None = None, lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, as they are: the current one, or web-1 where no stems are given. A policy with the rule of stems needs
    some, though it be none that were found."""
    policy = policy or (CURRENT if stems is not None else "web-1")
    if stems is None and POLICIES[policy] & BIT["abusive_stems"]:
        raise ValueError(f"{policy} needs stems; web-1 has the same rules without them")
    own = {"_text": F.col(f"`{text}`")} | ({"_lang": F.col(f"`{lang}`")} if stems else {})
    led = apply_policy(ledger(wrapped(docs, **own), "_text", stems, "_lang"), policy)
    return led.where("kept").select(unwrapped(docs))


def ablations(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row for each rule of the policy: documents failing it, failing it alone, and kept were it dropped. One pass over the ledger's bits."""
    m = POLICIES[policy]
    hit = F.col("failed").bitwiseAND(F.lit(m))
    groups = led.select(hit.alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    rules = led.sparkSession.createDataFrame([(n, b) for n, b in BIT.items() if b & m], "rule string, bit long")
    g, bit = F.col("bits"), F.col("bit")
    return (
        groups.join(F.broadcast(rules))  # a few rules against at most 2 ** rules groups
        .groupBy("rule")
        .agg(
            F.sum(F.when(g.bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(g == bit, F.col("n")).otherwise(0)).alias("n_failed_alone"),
            F.sum(F.when((g == bit) | (g == 0), F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )
