"""Logits as rows ``(key, token, logit)``, for vocabularies that are no array: losses and nuclei by aggregates alone.

Nothing here sorts or windows the tokens of a key. All aggregates are combined in the tasks before they are
shuffled, down to a few bins per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.functions.text import IGNORE
from seqloom.functions.vectors import array_sum
from seqloom.session import stored

#: Logits of one bin differ by at most this: their exponentials, taken from the bin's own base, cannot overflow.
SPAN = 256.0
#: Bins per key and pass of the nucleus cut, and the tokens that may be sorted in a row in the end.
BINS, LEAF = 1024, 512
#: Passes over the fixed-point digits of a score and over those of a token id.
SCORE_LEVELS, TOKEN_LEVELS = 6, 7


def _checked(logit: Column) -> Column:
    """A null or undefined logit is an error; minus infinity is a token that cannot occur."""
    bad = logit.isNull() | F.isnan(logit)
    return F.when(bad, F.raise_error(F.lit("a logit is missing or not a number")).cast("double")).otherwise(logit)


def log_sum_exp(df: DataFrame, keys: Sequence[str], logit: str, extra: Sequence[Column] = ()) -> DataFrame:
    """``(keys, top, lse, …)``: the largest logit and ``ln(sum(exp(logit)))`` of each key; ``extra`` aggregates go along.

    The sum is kept per key and bin of ``SPAN`` as ``sum(exp(logit - base))``. Such sums add up wherever they meet, and a key's
    few bins are put together at the largest base. A key of impossible tokens only has ``-inf``.
    """
    rows = df.withColumn("_l", _checked(F.col(logit).cast("double")))
    finite = F.col("_l") > float("-inf")
    bin_ = F.when(finite, F.floor(F.col("_l") / SPAN))
    mass = F.sum(F.when(finite, F.exp(F.col("_l") - F.col("_bin") * SPAN)))
    partial = rows.withColumn("_bin", bin_).groupBy(*keys, "_bin").agg(mass.alias("_mass"), F.max("_l").alias("_top"), *extra)
    names = [c for c in partial.columns if c not in {*keys, "_bin", "_mass", "_top"}]
    # A key has as many bins as its logits span multiples of SPAN: one or two, as a rule.
    bins = F.collect_list(F.when(F.col("_bin").isNotNull(), F.struct("_bin", "_mass")))
    whole = partial.groupBy(*keys).agg(bins.alias("_bins"), F.max("_top").alias("top"), *[F.max(n).alias(n) for n in names])
    base = F.array_max(F.transform("_bins", lambda b: b["_bin"]))
    total = array_sum(F.transform("_bins", lambda b: b["_mass"] * F.exp((b["_bin"] - F.col("_base")) * SPAN)))
    lse = F.when(F.size("_bins") > 0, F.col("_base") * SPAN + F.ln(total)).otherwise(F.lit(float("-inf")))
    return whole.withColumn("_base", base).select(*keys, "top", lse.alias("lse"), *names)


def token_losses(df: DataFrame, keys: Sequence[str], token: str, logit: str, label: str) -> DataFrame:
    """``(keys, nll)``: ``lse - logit[label]`` of each key; null where its label (the same in all its rows) is no target.

    A label without a logit is an error.
    """
    mine = F.max(F.when(F.col(token) == F.col(label), F.col(logit).cast("double"))).alias("_mine")
    found = log_sum_exp(df, keys, logit, [mine, F.max(label).alias("_label")])
    outside = F.raise_error(F.concat(F.lit("no logit for label "), F.col("_label").cast("string"))).cast("double")
    nll = F.when(F.col("_label") != IGNORE, F.col("lse") - F.coalesce("_mine", outside))
    return found.select(*keys, nll.alias("nll"))


def cross_entropy(
    df: DataFrame, keys: Sequence[str], by: Sequence[str], token: str, logit: str, label: str
) -> DataFrame:
    """Mean loss over the targets of each group ``by`` (columns of ``keys``) and its exponential; NaN without a target."""
    nan = F.lit(float("nan"))
    return token_losses(df, keys, token, logit, label).groupBy(*by).agg(
        F.count("nll").alias("targets"),
        F.coalesce(F.avg("nll"), nan).alias("loss"),
        F.coalesce(F.exp(F.avg("nll")), nan).alias("perplexity"),
    )


def nucleus(
    df: DataFrame, keys: Sequence[str], token: str, logit: str, top_p: float = 0.95, temperature: float = 0.8
) -> DataFrame:
    """``(keys, token, p)``: the tokens kept of each key and their renormalised probabilities.

    Tokens stand in order of probability, then id (ids are integers from 0, each once per key). One is kept if those before it hold at
    most ``top_p``. The cut is found by digits: the distance of a score from the key's best is a fixed-point number, and a pass sums the
    probabilities by one digit of ``BINS``. The bin in which ``top_p`` is crossed is the only one whose tokens the
    next pass looks at, by the next digit, and after the score's digits (equal scores) by those of the id. Once it holds at most
    ``LEAF`` tokens for every key, they are sorted inside a row. One or two passes do, unless many scores are equal.
    """
    if temperature <= 0:
        raise ValueError("a temperature of zero or less is greedy decoding")
    if top_p < 0:
        raise ValueError("top_p must not be negative")
    keys = list(keys)
    rows = df.select(*keys, F.col(token).cast("long").alias("_t"), (F.col(logit).cast("double") / temperature).alias("_s"))
    norms = stored(log_sum_exp(rows, keys, "_s"), "norms")
    scored = rows.join(norms, keys).select(
        *keys, "_t", (F.col("top") - F.col("_s")).alias("_u"), F.exp(F.col("_s") - F.col("lse")).alias("_p")
    )
    scored = scored.where(F.col("_p") > 0)  # what underflows to zero is not in the nucleus
    # Digits of the distance: the first covers 64 (below it probabilities vanish against any top_p < 1), the others follow.
    rest, digits = F.col("_u") * (BINS / 64.0), []
    for level in range(SCORE_LEVELS):
        digit = F.least(F.floor(rest), F.lit(BINS - 1)).cast("int")
        digits.append(digit)
        rest = (rest - digit) * float(BINS)
    for level in range(TOKEN_LEVELS):
        digits.append((F.shiftright("_t", 10 * (TOKEN_LEVELS - 1 - level)) % BINS).cast("int"))

    open_, cut = scored, norms.select(*keys, F.lit(0.0).alias("_before"))
    kept = []
    for level, digit in enumerate(digits):
        held = open_.withColumn("_d", digit)
        bins = held.groupBy(*keys, "_d").agg(F.sum("_p").alias("_m"), F.count(F.lit(1)).alias("_n"))
        # At most BINS entries per key.
        listed = bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_d", "_m", "_n"))).alias("_bins"))
        crossed = stored(listed.join(cut, keys).select(*keys, _crossing(top_p).alias("c")).select(*keys, "c.*"), "cut")
        placed = held.join(crossed, keys)
        kept.append(placed.where(F.col("_d") < F.col("_at")).select(*keys, "_t", "_p"))
        open_ = stored(placed.where(F.col("_d") == F.col("_at")).select(*keys, "_t", "_u", "_p"), "open")
        cut = crossed.select(*keys, "_before")
        if (crossed.agg(F.max("_inside")).first()[0] or 0) <= LEAF:
            break
    gathered = F.array_sort(F.collect_list(F.struct("_u", "_t", "_p"))).alias("_leaf")
    leaves = open_.groupBy(*keys).agg(gathered).join(cut, keys)
    leaf = leaves.select(*keys, F.inline(_leading(top_p)))
    for part in kept:
        leaf = leaf.unionByName(part)
    return _renormalised(leaf, keys, token)


def _crossing(top_p: float) -> Column:
    """``(_at, _before, _inside)``: the bin whose mass, with all before it, exceeds ``top_p``; the last bin if none does."""
    start = F.struct(F.lit(-1).alias("_at"), F.col("_before").alias("_before"), F.lit(0).cast("long").alias("_inside"), F.lit(0.0).alias("own"))

    def step(acc: Column, b: Column) -> Column:
        passed = acc["_before"] + acc["own"]
        done = (acc["_at"] >= 0) & (passed > top_p)
        moved = F.struct(b["_d"].alias("_at"), passed.alias("_before"), b["_n"].alias("_inside"), b["_m"].alias("own"))
        return F.when(done, acc).otherwise(moved)

    return F.aggregate("_bins", start, step)


def _leading(top_p: float) -> Column:
    """The tokens of the sorted last bin that those before them leave in the nucleus."""
    empty = F.array().cast("array<struct<_t: bigint, _p: double>>")
    start = F.struct(F.col("_before").alias("sum"), empty.alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        more = F.concat(acc["kept"], F.array(F.struct(x["_t"].alias("_t"), x["_p"].alias("_p"))))
        return F.struct((acc["sum"] + x["_p"]).alias("sum"), F.when(acc["sum"] <= top_p, more).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate("_leaf", start, step, lambda acc: acc["kept"])


def _renormalised(kept: DataFrame, keys: Sequence[str], token: str) -> DataFrame:
    kept = stored(kept, "kept")
    total = kept.groupBy(*keys).agg(F.sum("_p").alias("_total"))
    p = F.col("_p") / F.greatest("_total", F.lit(1e-12))
    return kept.join(total, list(keys)).select(*keys, F.col("_t").alias(token), p.alias("p"))
