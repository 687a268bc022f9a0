"""Quality rules with risk-controlled thresholds.

Every rule rejects a document whose statistic (a share between 0 and 1) exceeds a cutoff. Cutoffs are
chosen per stratum from labelled holdouts: a cutoff is admissible if "the rule rejects more than
``ALPHA / number of rules`` of the good documents of this stratum" is refuted by an exact binomial
test. Within a stratum and rule the cutoffs are tested from lenient to strict, a fixed sequence; over
strata and rules the level is divided (Bonferroni). So with probability ``1 - DELTA`` no stratum
loses more than ``ALPHA`` of its good documents, over all rules together. Among admissible cutoffs the
one rejecting most bad holdouts is taken (then the fewest good ones, then the most lenient). A stratum
with too few holdouts certifies nothing and keeps everything.

All of it is column expressions and aggregates; the tables of holdout counts have one row per
stratum, rule and cutoff.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom.llm.text import SPACES, words
from seqloom.session import stored

ALPHA, DELTA = 0.05, 0.05
CUTOFFS = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02, 0.01)
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rule: numerator and denominator among the features.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "capitals": ("n_capitals", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
FEATURES = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def features(docs: DataFrame, text: str) -> DataFrame:
    """Add the ``FEATURES`` of every whole text; null and blank texts have zeros everywhere.

    Each array is a column before a lambda refers to it, so that it is made once per row. Columns
    named like a feature are replaced.
    """
    rest = [c for c in docs.columns if c not in FEATURES]
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.struct(*rest).alias("doc"), whole.alias("t"), words(whole).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    hashes = F.transform(
        F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)),
    )
    df = df.select(
        "doc",
        F.size("w").alias("n_words"),
        (F.length("t") - _without(F.col("t"), SPACES)).alias("word_chars"),
        _without(F.col("t"), SYMBOLS).alias("n_symbols"),
        _without(F.col("t"), CAPITALS).alias("n_capitals"),
        lines.alias("l"),
        hashes.alias("h"),
    )
    # Windows in order of their hash: equal ones are neighbours.
    ordered = F.when(
        F.size(F.array_distinct("h")) < F.size("h"),
        F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    )
    df = df.select(
        "doc",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_capitals",
        F.size("l").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        ordered.alias("s"),
    )
    again = F.filter(
        "s",
        lambda x, i: x["h"].eqNullSafe(F.get("s", i - 1)["h"]) | x["h"].eqNullSafe(F.get("s", i + 1)["h"]),
    )
    covered = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    repeated = F.when(F.col("s").isNull(), 0).otherwise(F.size(F.array_distinct(covered)))
    return df.select("doc.*", *(F.col(c).cast("long").alias(c) for c in FEATURES[:-1]), repeated.cast("long").alias("n_repeat_words"))


def statistic(rule: str) -> Column:
    above, below = RULES[rule]
    return F.when(F.col(below) > 0, F.col(above) / F.col(below)).otherwise(F.lit(0.0))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """``P(X <= k)`` for ``X`` binomial ``(n, p)``, summed in logarithms; 1 where ``k`` is at least the mean."""
    first = F.struct((n * F.lit(math.log1p(-p))).alias("term"), (n * F.lit(math.log1p(-p))).alias("sum"))
    odds = math.log(p) - math.log1p(-p)

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.ln((n - i + 1) / i) + F.lit(odds)
        high, low = F.greatest(term, acc["sum"]), F.least(term, acc["sum"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    ks = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.least(F.exp(F.aggregate(ks, first, add)["sum"]), F.lit(1.0)))


def thresholds(holdouts: DataFrame, stratum: str, good: str) -> DataFrame:
    """``stratum, rule, cutoff, n_good, good_rejected, bad_rejected, p_value``: the cutoffs that were certified.

    ``holdouts`` has the features, the stratum (null is one of its own) and ``good``, 1 or 0; rows
    with another or no label are left out.
    """
    # A statistic falls into the slot of the first cutoff it exceeds; stricter ones it exceeds too.
    def slot(rule: str) -> Column:
        out = F.lit(len(CUTOFFS))
        for i in reversed(range(len(CUTOFFS))):
            out = F.when(statistic(rule) > F.lit(CUTOFFS[i]), i).otherwise(out)
        return out

    rules = F.array(*(F.struct(F.lit(r).alias("rule"), slot(r).alias("slot")) for r in RULES))
    counted = (
        holdouts.where(F.col(good).isin(0, 1))
        .select(F.col(stratum).alias("stratum"), F.col(good).alias("good"), F.inline(rules))
        .groupBy("stratum", "rule", "slot")
        .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    )
    counted = stored(counted, "holdouts")
    strata = max(1, counted.select("stratum").distinct().count())
    # Every cutoff has a row, with or without statistics in its slot.
    every = (
        counted.groupBy("stratum", "rule")
        .agg(F.sum("good").alias("n_good"))
        .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(len(CUTOFFS) - 1))))
    )
    upto = Window.partitionBy("stratum", "rule").orderBy("slot")
    keys = ["stratum", "rule", "slot"]
    joined = every.alias("e").join(
        counted.alias("c"),
        F.col("e.stratum").eqNullSafe(F.col("c.stratum")) & (F.col("e.rule") == F.col("c.rule")) & (F.col("e.slot") == F.col("c.slot")),
        "left",
    )
    tested = (
        joined.select(*(F.col(f"e.{k}").alias(k) for k in keys), "e.n_good", F.coalesce("c.good", F.lit(0)).alias("good"), F.coalesce("c.bad", F.lit(0)).alias("bad"))
        .withColumn("good_rejected", F.sum("good").over(upto))
        .withColumn("bad_rejected", F.sum("bad").over(upto))
        .withColumn("p_value", binomial_tail(F.col("n_good"), F.col("good_rejected"), ALPHA / len(RULES)))
        .where(F.col("p_value") <= F.lit(DELTA / len(RULES) / strata))
        .where("bad_rejected > 0")
    )
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("bad_rejected"), "good_rejected", "slot")
    cutoff = F.element_at(F.array(*map(F.lit, CUTOFFS)), F.col("slot") + 1)
    return (
        tested.withColumn("place", F.row_number().over(best))
        .where("place = 1")
        .select("stratum", "rule", cutoff.alias("cutoff"), "n_good", "good_rejected", "bad_rejected", "p_value")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, key: str, text: str, stratum: str, labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, stratum``, the features, ``base_failed, rejected_by, kept`` of every row of ``docs``.

    ``labels`` has ``key`` and ``label`` (1 good, 0 bad). Holdouts are the labelled documents that
    pass the base rules. Null keys have no label; a document labelled several times counts as often.
    Repeated rows are judged alike. Without labels only the base rules reject; an empty table gives an
    empty result. Other columns are not read.
    """
    measured = stored(
        features(docs.select(F.col(key).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text")), "text").drop("text"),
        "features",
    ).withColumn("base_failed", base_failed())
    marked = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("long").alias("good"))
    chosen = thresholds(measured.where("NOT base_failed").join(marked, "doc_id"), "stratum", "good")
    cutoffs = chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff")).withColumnRenamed("stratum", "of")
    broken = F.array_compact(F.array(*(F.when(statistic(r) > F.col(r), F.lit(r)) for r in RULES)))
    return (
        measured.join(cutoffs, F.col("stratum").eqNullSafe(F.col("of")), "left")
        .withColumn("rejected_by", F.when(~F.col("base_failed"), F.array_join(broken, ",")).otherwise(F.lit("base")))
        .withColumn("kept", F.col("rejected_by") == "")
        .select("doc_id", "stratum", *FEATURES, "base_failed", "rejected_by", "kept")
    )
