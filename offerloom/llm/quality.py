"""Quality rules whose cutoffs carry a guarantee on false rejections.

All of it is DataFrame expressions. Base statistics come from the words and
lines of each text. Rules are ratios of them; the cutoff of a rule in a stratum
is the strictest for which labelled holdout documents show, by an exact binomial
test, that at most ``risk`` of good documents exceed it. Cutoffs are tested from
lenient to strict and testing stops at the first failure, which needs no
correction along the sequence (fixed-sequence testing); over rules and strata
the error is divided (Bonferroni). So with probability 1 - delta every stratum
rejects at most ``rules * risk`` of its good documents (Learn then Test,
Angelopoulos et al., 2021).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 8
RISK, DELTA = 0.005, 0.05
#: Cutoffs in the order in which they are tested.
GRID = [0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01]
RULES = {
    "symbols": "n_symbols / word_chars",
    "capitals": "n_capitals / word_chars",
    "dup_lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
}
#: Strata with a smaller share of the labels are pooled, so at most 1000 remain.
LEAST_STRATUM = 1 / 1000


def _covered(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in windows that the text has more than once.

    ``whash`` holds the words' hashes. Most texts repeat no window and are done
    once their windows are known to be distinct; the others sort windows to find
    equal neighbours and add up the stretches that these cover.
    """
    windows = F.transform("whash", lambda _, i: F.xxhash64(F.slice("whash", i + 1, WINDOW)))
    docs = docs.withColumn("wins", F.when(F.col("n_words") > WINDOW, F.slice(windows, 1, F.col("n_words") - (WINDOW - 1))))
    again = F.size(F.array_distinct("wins")) < F.size("wins")
    docs = docs.withColumn("pairs", F.when(again, F.sort_array(F.transform("wins", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("pairs", lambda p, j: F.coalesce(p["h"] == F.get("pairs", j - 1)["h"], F.lit(False)) | F.coalesce(p["h"] == F.get("pairs", j + 1)["h"], F.lit(False)))
    docs = docs.withColumn("starts", F.sort_array(F.transform(twice, lambda p: p["i"])))
    steps = F.transform("starts", lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - s, F.lit(WINDOW))).cast("bigint"))
    return docs.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(0)))


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_capitals, n_lines,
    n_dup_lines, n_repeat_words (bigint) of each text; null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(*keep, F.array_remove(F.split(text, "[ \\t-\\r]+"), "").alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"))
    joined = docs.select(*keep, F.size("words").cast("bigint").alias("n_words"), F.array_join("words", "").alias("joined"), F.transform("words", lambda w: F.xxhash64(w)).alias("whash"), F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"))
    count = lambda pattern: F.length(F.regexp_replace("joined", pattern, "")).cast("bigint")
    counted = joined.withColumns({"word_chars": F.length("joined").cast("bigint"), "n_symbols": count("[^#*$%&|<>]+"), "n_capitals": count("[^A-Z]+"), "n_words": F.col("n_words").cast("int")})
    out = _covered(counted.drop("joined"))
    return out.select(*keep, F.col("n_words").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), summed in logarithms; 1 where k > n p."""
    from math import log

    odds = log(p) - log(1 - p)
    begin = F.struct((n * log(1 - p)).cast("double").alias("t"), (n * log(1 - p)).cast("double").alias("s"))

    def step(acc: Column, j: Column) -> Column:
        t = acc["t"] + F.log((n - j + 1) / j) + odds
        high, low = F.greatest(acc["s"], t), F.least(acc["s"], t)
        return F.struct(t.alias("t"), (high + F.log1p(F.exp(low - high))).alias("s"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(terms, begin, step)["s"]))


def cutoffs(holdout: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) that the good documents of ``holdout`` certify.

    ``holdout`` has (stratum, one column for each rule). A pair of stratum and
    rule without certified cutoff has no row.
    """
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in RULES]))
    scores = holdout.select("stratum", rules.alias("x")).select("stratum", "x.*")
    over = [F.count_if(F.col("score") > c).alias(f"k{i}") for i, c in enumerate(GRID)]
    counts = scores.groupBy("stratum", "rule").agg(F.count(F.lit(1)).alias("n"), *over)
    tests = holdout.select("stratum").distinct().count() * len(RULES)
    level = delta / max(tests, 1)
    tried = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("cutoff"), (binomial_tail(F.col("n"), F.col(f"k{i}"), risk) <= level).alias("ok")) for i, c in enumerate(GRID)])
    passed = counts.select("stratum", "rule", F.explode(tried).alias("x")).select("stratum", "rule", "x.*")
    failed = F.min(F.when(~F.col("ok"), F.col("i")))
    first = passed.groupBy("stratum", "rule").agg(F.coalesce(failed, F.lit(len(GRID))).alias("stop"), F.sort_array(F.collect_list(F.struct("i", "cutoff"))).alias("all"))
    return first.filter("stop > 0").select("stratum", "rule", F.get("all", F.col("stop") - 1)["cutoff"].alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Statistics and verdict of each document.

    Takes (doc_id bigint, text, lang, ...) and labels (doc_id, quality 0 or 1,
    ...). Returns (doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept), one row for each row. A text fails the
    base rules with fewer than 20 words or more than 30 per cent of them in
    repeated windows of eight; others are rejected if a rule exceeds the cutoff
    of their stratum, the language. Languages with under a thousandth of the
    labels, and unseen ones, share a stratum; null counts as a language of its
    own, the empty one. Where labels certify no
    cutoff, because they are too few or absent, nothing is rejected by it. A
    null or empty text has no words and fails. A document with several labels
    is good if all say so; labels of unknown documents and null labels are
    ignored. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("lang"))
    stats = materialize(statistics(docs, ["doc_id", "lang"]).withColumn("base_failed", base_failed()), "statistics")
    good = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality")).filter("quality = 1")
    scored = stats.join(good.select("doc_id"), "doc_id", "left_semi").filter("NOT base_failed")
    scored = scored.select("lang", *[F.coalesce(F.try_divide(*[F.col(c.strip()) for c in e.split("/")]), F.lit(0.0)).alias(r) for r, e in RULES.items()])
    scored = materialize(scored, "holdout")
    total = scored.count()
    own = scored.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(1, total * LEAST_STRATUM)).select("lang", F.col("lang").alias("own"))
    placed = lambda df: df.join(F.broadcast(own), "lang", "left").withColumn("stratum", F.coalesce(F.concat(F.lit("="), "own"), F.lit("other")))
    found = cutoffs(placed(scored), risk, delta)
    chosen = found.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    judged = placed(stats).join(F.broadcast(chosen), "stratum", "left")
    exceeds = F.lit(False)
    for r, e in RULES.items():
        a, b = (F.col(c.strip()) for c in e.split("/"))
        exceeds = exceeds | F.coalesce(F.try_divide(a, b) > F.col(f"cut_{r}"), F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~exceeds).alias("kept"))
