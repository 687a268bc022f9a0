"""Connected components of a table of links, by alternating large and small stars.

A large star joins every node's larger neighbours to its smallest one, a small star its smaller
neighbours; both keep the components and together they turn each one into a star around its
smallest node in a logarithmic number of rounds. Only minima are aggregated, which Spark combines
before it shuffles, so a node with very many links is no burden. Every round is written to the
shared folder and read again: lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqloom.session import counted, tasks_for


def _star(links: DataFrame) -> DataFrame:
    """``links (u, v)``: every ``v`` above ``u``'s smallest neighbour, and ``u`` itself, to that neighbour."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return links.join(least, "u").select("u", "v", "m")


def _written(links: DataFrame, rows: int | None) -> tuple[DataFrame, dict]:
    """The links as a table, and what tells one set of links from another, observed while writing."""
    # The tables are read again at once: as many files as shuffle partitions would cost more than the links in them.
    return counted(
        links if rows is None else tasks_for(links, rows),
        "links",
        n=F.count(F.lit(1)),
        hash=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
    )


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """``node, component`` for every node of ``links (a, b)``: the smallest node it can reach.

    Links may be repeated, in either direction, or from a node to itself; an empty table gives an
    empty result. ``rows``, if it is known, is about how many links there are: it sets the number of tasks, not the result.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, state = _written(links, rows)
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        links = (
            small.select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(small.select("u", "m"))
            .where("a <> b")
            .distinct()
        )
        before = state
        links, state = _written(links, before["n"])
        if before == state:
            break
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(links.select("b", "b").distinct())
