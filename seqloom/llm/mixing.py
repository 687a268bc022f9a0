"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every document is cut into blocks of at most ``block_words`` words (or is one block). A block
   is a narrow row; no text moves.
2. Targets: the sources share the words of the whole corpus by weight, none more than
   ``max_passes`` times its own words.
3. A source gives whole passes over its blocks and, for the rest, the first blocks of a seeded
   permutation until their words come nearest to its target. That fixes each source's quota of
   block draws exactly.
4. The quotas are divided among the output shards by a binary tree: at each node the draws going
   left are multivariate hypergeometric, as if all draws had been shuffled and cut. Only counts
   pass through the driver, one row per source.
5. A source's permuted draws are dealt to the shards in ranges of their rank, which makes the shards
   disjoint; within its shard a draw gets a seeded position.

Ranks and running words are found per (source, leading digits of the permutation's hash), so a
source that holds a third of all rows is as many groups as there are digits, and only their totals
meet. Reruns agree: every draw is a hash or a seeded generator.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom.llm.text import with_row
from seqloom.session import stored

#: One row per source passes through the driver, and one array of shard counts goes back.
MAX_SOURCES = 100_000
ROWS_PER_GROUP = 50_000
#: numpy's hypergeometric generator takes populations below this.
EXACT_DRAW = 10**9


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], max_passes: int = 3) -> dict[str | None, float]:
    """Words each source should give: weight's share of all words, at most ``max_passes`` times its own."""
    total, out, free = sum(sizes.values()), {}, dict(weights)
    while free:
        unit = (total - sum(max_passes * sizes[s] for s in out)) / sum(free.values())
        full = [s for s, w in free.items() if unit * w > max_passes * sizes[s]]
        if not full:
            return out_caps(out, sizes, max_passes) | {s: unit * w for s, w in free.items()}
        for s in full:
            out[s] = free.pop(s)
    return out_caps(out, sizes, max_passes)


def out_caps(full: dict, sizes: dict, max_passes: int) -> dict:
    return {s: float(max_passes * sizes[s]) for s in full}


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among ``drawn``; beyond numpy's range the normal limit, rounded and kept possible."""
    if drawn == 0 or good == 0:
        return 0
    if good + bad < EXACT_DRAW:
        return int(rng.hypergeometric(good, bad, drawn))
    n = good + bad
    mean = drawn * good / n
    spread = (mean * (bad / n) * ((n - drawn) / max(n - 1, 1))) ** 0.5
    return int(min(max(round(rng.normal(mean, spread)), drawn - bad, 0), good, drawn))


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Draws of each source (row) for each shard (column); shards differ by at most one draw in all."""
    out = np.zeros((len(quotas), shards), np.int64)
    todo = [(np.asarray(quotas, np.int64), 0, shards)]
    while todo:
        have, low, high = todo.pop()
        if high - low == 1:
            out[:, low] = have
            continue
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = np.zeros_like(have)
        need, rest = int(have.sum()) * (middle - low) // (high - low), int(have.sum())
        for i, n in enumerate(have.tolist()):
            rest -= n
            left[i] = _hypergeometric(rng, n, rest, need)
            need -= int(left[i])
        todo += [(left, low, middle), (have - left, middle, high)]
    return out


def numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns with a unique ``row``, written down so that a row keeps its number."""
    return stored(with_row(docs.select(*columns), "row"), "numbered")


def mix(
    rows: DataFrame,
    weights: Callable[[list[str | None]], list[float]],
    *,
    shards: int = 16,
    block_words: int | None = 128,
    max_passes: int = 3,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """The drawn blocks of ``rows`` (``row, key, source, size``; see ``numbered``), and the sources.

    ``weights`` gives the weights of a list of sources (by code point, null last).
    Draws: ``row, part, pass, first_word, n_words, shard, position``; ordered by
    ``shard, position`` they are the mixed stream. Sources: ``source, source_size, target``.

    A null source is a source of its own; documents without words have no block and are never
    drawn; repeated rows are drawn as different documents; an empty table gives empty results.
    """
    spark = rows.sparkSession
    narrow = rows.select("row", "key", "source", "size")
    length = F.lit(block_words) if block_words else F.greatest("size", F.lit(1))
    pieces = F.ceil(F.col("size") / length)
    by_source = narrow.groupBy("source").agg(
        F.sum("size").alias("words"), F.sum(pieces).cast("long").alias("blocks")
    )
    found = sorted(by_source.limit(MAX_SOURCES + 1).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: fold the small ones first")
    names = [r["source"] for r in found]
    sizes = {r["source"]: r["words"] for r in found}
    goal = targets(sizes, dict(zip(names, weights(names), strict=True)), max_passes)
    plan = []
    for i, s in enumerate(names):
        wanted, have = round(goal[s]), sizes[s]
        plan.append((i, s, have, goal[s], wanted // have if have else 0, wanted % have if have else 0))
    plan = spark.createDataFrame(
        plan, "number int, source string, source_size long, target double, passes long, rest long"
    )

    # The permutation: digits of a hash cut each source into groups that a task can order.
    digits = 2
    while sum(r["blocks"] for r in found) > ROWS_PER_GROUP * 16**digits and digits < 8:
        digits += 1
    blocks = (
        narrow.where("size > 0")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), pieces.cast("long") - 1)))
        .withColumn("n_words", F.least(length, F.col("size") - F.col("part") * length).cast("long"))
        .withColumn("hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("key").cast("string"), F.lit("null")), F.col("part"))))
        .withColumn("group", F.substring("hash", 1, digits))
        .join(F.broadcast(plan.select(F.col("source").alias("of"), "number", "passes", "rest")), F.col("source").eqNullSafe(F.col("of")))
        .select("row", "part", "n_words", "hash", "group", "number", "passes", "rest", (F.col("part") * length).cast("long").alias("first_word"))
    )
    group = Window.partitionBy("number", "group")
    order = group.orderBy("hash", "row", "part")
    totals = blocks.groupBy("number", "group").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("w"))
    upto = Window.partitionBy("number").orderBy("group")
    starts = totals.select(
        "number",
        "group",
        (F.sum("n").over(upto) - F.col("n")).alias("rank0"),
        (F.sum("w").over(upto) - F.col("w")).alias("words0"),
    )
    ranked = (
        blocks.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("words", F.sum("n_words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_words"))
        .join(starts, ["number", "group"])
        .withColumn("rank", F.col("rank") + F.col("rank0"))
        .withColumn("words", F.col("words") + F.col("words0"))
        # One more pass while that brings the source nearer to its target.
        .withColumn("draws", F.col("passes") + (2 * F.col("words") + F.col("n_words") <= 2 * F.col("rest")).cast("long"))
        .where("draws > 0")
        .select("row", "part", "first_word", "n_words", "number", "rank", "draws", "hash")
    )
    ranked = stored(ranked, "ranked")

    # Blocks of one pass are numbered by rank, after those of the passes before.
    counted = ranked.groupBy("number").agg(
        F.sum("draws").alias("quota"), F.max(F.col("rank")).alias("last"), F.max("draws").alias("most")
    )
    quota = {r["number"]: r for r in counted.collect()}
    numbers = sorted(quota)
    dealt = split_quotas([quota[i]["quota"] for i in numbers], shards, seed)
    ends = spark.createDataFrame(
        [(i, quota[i]["last"] + 1, np.cumsum(dealt[k]).tolist()) for k, i in enumerate(numbers)],
        "number int, per_pass long, ends array<long>",
    )
    draws = (
        ranked.join(F.broadcast(ends), "number")
        .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1)))
        .withColumn("draw", F.col("pass") * F.col("per_pass") + F.col("rank"))
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("draw"))))
        .withColumn("position", F.xxhash64(F.lit(seed), "hash", "pass"))
        .select("row", "part", "pass", "first_word", "n_words", "shard", "position")
    )
    return draws, plan.select("source", "source_size", "target")


def mixed_documents(
    docs: DataFrame, key: str, source: str, size: Column, weights: Callable[[list[str | None]], list[float]], **how
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; every document is one block.

    Documents without words are not part of the mix and stay once. Columns are those of ``docs``.
    """
    rows = numbered(
        docs, F.struct(*docs.columns).alias("doc"), F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size")
    )
    draws, _ = mix(rows, weights, block_words=None, **how)
    times = draws.groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("times"))
    return (
        rows.join(times, "row", "left")
        .withColumn("times", F.when(F.col("size") == 0, 1).otherwise(F.coalesce("times", F.lit(0))))
        .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
        .select("doc.*")
    )
