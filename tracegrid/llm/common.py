"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrid.functions.shared import cut, fresh_path, shared_dir

__all__ = ["SPACE", "WORD", "copy_numbers", "cut", "fresh_path", "running_total", "shared_dir", "table", "word_count", "words_of"]

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def running_total(cells: DataFrame, by: list[str], at: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """``cells`` with ``name``: the sum of ``value`` over the cells of the same ``by`` before the integer ``at``.

    Sums go up in two levels (``width`` numbers, then their totals), so that no ``by`` meets in one task whole.
    """
    wide = cells.withColumn("_wide", F.floor(F.col(at) / width))
    inner = Window.partitionBy(*by, "_wide").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*by).orderBy("_wide").rowsBetween(Window.unboundedPreceding, 0)
    totals = wide.groupBy(*by, "_wide").agg(F.sum(value).alias("_n")).withColumn("_before", F.sum("_n").over(outer) - F.col("_n")).drop("_n")
    return wide.withColumn("_in", F.sum(value).over(inner) - F.col(value)).join(totals, [*by, "_wide"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_wide", "_in", "_before")


#: Rows of one origin that are numbered together: uid >> PART is the origin's number.
PART = 13


def copy_numbers(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, part, uids, before) of ``rows`` (uid, by): the rows that agree in ``by``, by parts of at most 2**PART rows of the
    input, and how many copies are in the parts before. So copies, which nothing tells apart, get numbers 0, 1, 2, ...
    without meeting in one task. ``uid`` must be written or otherwise fixed."""
    cells = cut(rows.groupBy(*by, F.shiftright("uid", PART).alias("part")).agg(F.sort_array(F.collect_list("uid")).alias("uids")), "copies")
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    counted = cells.select(*by, "part", F.size("uids").cast("long").alias("n")).withColumn("before", F.sum("n").over(before) - F.col("n")).drop("n")
    return cells.join(counted, [*by, "part"])
