"""Scores and checks: cross-entropy, key-value recall, parity, leakage, state sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.functions.seeded import digest, draw_int
from seqloom.functions.text import IGNORE
from seqloom.functions.vectors import logsumexp
from seqloom.session import stored

# The shape of a recall prompt.
KEY_SPACE = 10**8
FILLER = " filler"
PAIR_PATTERN = r"(K\d+)=(V\d+);"
QUERY_PATTERN = r"Query: (K\d+)="


def token_nll(logits: Column, label: Column) -> Column:
    """``logsumexp(logits) - logits[label]``; null where the label is not a target.

    A label without a logit is an error: left out of the mean it would pass unseen.
    """
    outside = F.raise_error(F.concat(F.lit("no logit for label "), label.cast("string"))).cast("double")
    return F.when(label != IGNORE, logsumexp(logits) - F.coalesce(F.get(logits, label), outside))


def cross_entropy(df: DataFrame, by: Sequence[str], logits: str, label: str) -> DataFrame:
    """Mean loss over targets and its exponential; NaN when there is no target."""
    nll = token_nll(F.col(logits), F.col(label))
    return (
        df.select(*by, nll.alias("_nll"))
        .groupBy(*by)
        .agg(
            F.count("_nll").alias("targets"),
            F.coalesce(F.avg("_nll"), F.lit(float("nan"))).alias("loss"),
            F.coalesce(F.exp(F.avg("_nll")), F.lit(float("nan"))).alias("perplexity"),
        )
    )


def recall_prompts(
    df: DataFrame,
    key: str,
    pairs: int = 16,
    distractors: int = 64,
    seed: int = 42,
    keep: Sequence[str] = (),
) -> DataFrame:
    """A key-value recall prompt and its answer for every row, drawn from the row's key."""
    if pairs < 1:
        raise ValueError("a prompt needs at least one pair")
    places = F.sequence(F.lit(0), F.lit(pairs - 1))

    def number(kind: str, j: Column) -> Column:
        drawn = draw_int(digest(seed, F.col(key), F.lit(kind), j), KEY_SPACE)
        return F.concat(F.lit(kind), drawn.cast("string"))

    drawn = df.select(
        key,
        *keep,
        F.transform(places, lambda j: number("K", j)).alias("_k"),
        F.transform(places, lambda j: number("V", j)).alias("_v"),
        draw_int(digest(seed, F.col(key), "target"), pairs).cast("int").alias("_t"),
    )
    body = F.array_join(F.zip_with("_k", "_v", lambda k, v: F.concat(k, F.lit("="), v, F.lit(";"))), " ")
    query = F.concat(F.lit(" Query: "), F.get("_k", F.col("_t")), F.lit("="))
    return drawn.select(
        key,
        *keep,
        F.concat(body, F.repeat(F.lit(FILLER), distractors), query).alias("prompt"),
        F.get("_v", F.col("_t")).alias("answer"),
    )


def lookup_values(prompt: Column) -> Column:
    """All values a prompt gives for the key it asks about, in order, read from its text."""
    found_keys = F.regexp_extract_all(prompt, F.lit(PAIR_PATTERN), F.lit(1))
    found_values = F.regexp_extract_all(prompt, F.lit(PAIR_PATTERN), F.lit(2))
    asked = F.regexp_extract(prompt, QUERY_PATTERN, 1)
    pairs = F.arrays_zip(found_keys.alias("k"), found_values.alias("v"))
    return F.transform(F.filter(pairs, lambda p: p["k"] == asked), lambda p: p["v"])


def recall_score(df: DataFrame, prediction: str, answer: str, by: Sequence[str] = ()) -> DataFrame:
    """The share of predictions that contain their answer."""
    hit = F.contains(F.col(prediction), F.col(answer)).cast("int")
    return df.groupBy(*by).agg(F.count("*").alias("prompts"), F.avg(hit).alias("score"))


def parity(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row comparing two results by key: counts, and maximum and mean absolute difference."""
    left = a.select(*keys, F.col(value).cast("double").alias("_a"), F.lit(1).alias("_in_a"))
    right = b.select(*keys, F.col(value).cast("double").alias("_b"), F.lit(1).alias("_in_b"))
    both = left.join(right, list(keys), "full")
    gap = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(
        F.count_if(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()).alias("matched"),
        F.count_if(F.col("_in_b").isNull()).alias("only_left"),
        F.count_if(F.col("_in_a").isNull()).alias("only_right"),
        F.max(gap).alias("max_abs_diff"),
        F.avg(gap).alias("mean_abs_diff"),
    )


#: Ranges of key hashes whose contents are compared before any rows are.
RANGES = 4096


def fingerprints(df: DataFrame, keys: Sequence[str], value: str, ranges: int = RANGES) -> DataFrame:
    """``(range, rows, mark)``: what each range of key hashes holds, as a count and sums that add up wherever they meet.

    The sums are over two 64-bit hashes of a row's key and value, so they tell multisets apart whatever the order of the rows.
    """
    flags = [F.col(c).isNull() for c in [*keys, value]]
    row = [F.col(k) for k in keys] + [F.col(value).cast("double")] + flags
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), *row).cast("decimal(38,0)"))
    marked = df.withColumn("_range", _range(keys, ranges))
    return marked.groupBy("_range").agg(F.count(F.lit(1)).alias("rows"), F.struct(total(0), total(1)).alias("mark"))


def _range(keys: Sequence[str], ranges: int) -> Column:
    """The range of a row; a null key meets no other row, so such rows have one that is always compared."""
    missing = F.lit(False)
    for k in keys:
        missing |= F.col(k).isNull()
    return F.when(missing, F.lit(-1)).otherwise(F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int"))


def parity_by_ranges(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, ranges: int = RANGES) -> DataFrame:
    """``parity`` (keys unique on each side) that joins only rows of ranges whose fingerprints differ.

    Ranges with equal fingerprints are taken as matched without a difference. Two tables that are equal are read once
    each, and only a row per range is shuffled. The extra column ``ranges_compared`` counts the ranges that were joined.
    """
    left = fingerprints(a, keys, value, ranges)
    right = fingerprints(b, keys, value, ranges).withColumnsRenamed({"rows": "rows_b", "mark": "mark_b"})
    same = F.coalesce((F.col("rows") == F.col("rows_b")) & (F.col("mark") == F.col("mark_b")) & (F.col("_range") >= 0), F.lit(False))
    compared = stored(left.join(right, "_range", "full").select("_range", "rows", same.alias("same")), "ranges")
    equal = compared.where("same").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"]
    differ = compared.where("NOT same").select("_range")
    n = differ.count()
    some = lambda df: df.withColumn("_range", _range(keys, ranges)).join(differ, "_range", "left_semi").drop("_range")
    # Tables that are equal leave nothing to join: their rows are not even read again.
    rows = parity(some(a), some(b), keys, value) if n else parity(a.limit(0), b.limit(0), keys, value)
    matched = F.col("matched") + F.lit(equal)
    mean = F.when(matched > 0, F.coalesce(F.col("mean_abs_diff") * F.col("matched"), F.lit(0.0)) / matched)
    return rows.select(
        matched.alias("matched"),
        "only_left",
        "only_right",
        F.coalesce("max_abs_diff", F.lit(0.0) if equal else F.lit(None).cast("double")).alias("max_abs_diff"),
        mean.alias("mean_abs_diff"),
        F.lit(n).cast("long").alias("ranges_compared"),
    )


def leakage(
    operator, df: DataFrame, changed: DataFrame, kept: Column, keys: Sequence[str], value: str
) -> DataFrame:
    """Does ``operator`` let later rows change earlier results?

    ``changed`` differs from ``df`` only in rows where ``kept`` is false. The report compares the
    operator's results on the rows that are the same; a causal operator shows no difference, and then no row is joined.
    """
    before = operator(df).where(kept)
    after = operator(changed).where(kept)
    return parity_by_ranges(before, after, keys, value).drop("ranges_compared")
