"""Documents to training shards: toxicity, near duplicates, benchmark passages, mixing, sharding.

Every stage takes ``(spark, docs, sf_dir)`` and returns the rows it keeps; ``run`` writes each result to the
shared folder and gives the table to the next stage, so a lost executor never costs more than its stage.
All stages but the last return the columns of ``documents``; the last adds ``shard``, ``slot`` and ``grown_shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.llm import decontamination, mixing, near_duplicates, sharding, toxicity
from seqloom.llm.queries import MIX_SEED, PASSES, SHARDS, cyclic_weights
from seqloom.llm.text import word_count
from seqloom.plans.registry import table
from seqloom.session import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's threshold. Labels come from ``labels``; without both classes nothing is rejected.

    Null and empty texts are scored as texts without words, repeated rows alike, and rows with a null ``doc_id`` or ``lang``
    stay unless their score says otherwise. An empty table gives an empty result; other columns pass through.
    """
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "lang", "toxic")
    return scored.where(~F.col("toxic")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest ``doc_id``; of repeated rows one.

    Documents without words (null and blank texts) are linked with nothing and all stay; null ids come last. An empty table gives an empty result; other columns pass through.
    """
    return near_duplicates.keep_one(docs, "doc_id", "text")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window resembles an item of ``benchmark``. Null and empty texts, and all texts when there are no items, stay.

    Repeated rows are judged alike; an empty table gives an empty result; other columns pass through.
    """
    items = table(spark, sf_dir, "benchmark")
    judged = decontamination.contaminated(docs, "text", items, "item_id", "text")
    return judged.where(~F.col("contaminated")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: some several times, some not at all, by the weights of their sources.

    A null source is a source of its own. Documents without words stay once, as they have no share of the mix. Rows of equal id are rows of
    their own; an empty table gives an empty result; other columns pass through.
    """
    size = word_count(F.col("text"))
    return mixing.mixed_documents(
        docs, "doc_id", "source", size, cyclic_weights, shards=SHARDS, max_passes=PASSES, seed=MIX_SEED
    )


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its ``shard``, its ``slot`` there and its shard if there were one more (such columns are replaced).

    Equal ids go to one shard, null ids too; texts play no part. An empty table gives an empty result.
    """
    return sharding.place(docs, "doc_id", sharding.regular(SHARDS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: SQL trains no classifier, so it cannot tell which documents the first stage rejects.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
