"""Words and row numbers as column expressions, shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPACES = " \t\n\u000b\f\r"
BETWEEN = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null and for blank texts."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, BETWEEN)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def with_row(df: DataFrame, name: str) -> DataFrame:
    """Number the rows within their task.

    The number may differ when a task runs again, so the caller writes the result to a table
    before anything depends on it.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def task_of(row: Column | str) -> Column:
    """The task that numbered a row (the upper bits of the number)."""
    row = F.col(row) if isinstance(row, str) else row
    return F.shiftright(row, 33)
