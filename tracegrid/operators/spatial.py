"""Range and nearest joins on pages through a grid: equi-joins on cells in place of nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.geometry import Box


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))


def grown_rows(exploded: DataFrame) -> DataFrame:
    """``exploded`` as a side of a join that is never broadcast: Spark takes rows that were exploded for as many as there
    were before, so millions of them would go through the driver."""
    return exploded.hint("merge")


def range_join(left: DataFrame, right: DataFrame, left_box: Box, right_box: Box, radius: float, keys: list[str], left_id: str, right_id: str, cell: float | None = None) -> DataFrame:
    """All pairs whose boxes, the left ones grown by ``radius``, meet; each pair once.

    Both sides go to the cells that they cover, and a pair counts in the one cell that holds the lower corner of what
    they share, so no distinct is needed. The exact predicate is the caller's. Column names of the sides must differ
    but for ``keys``.
    """
    size = cell or max(4 * radius, 64.0)
    x, y, w, h = left_box
    grown = left.withColumns({"_lx": x - radius, "_ly": y - radius, "_lx1": x + w + radius, "_ly1": y + h + radius})
    a = grown.withColumn("_cx", F.explode(_cells(F.col("_lx"), F.col("_lx1"), size))).withColumn("_cy", F.explode(_cells(F.col("_ly"), F.col("_ly1"), size)))
    x, y, w, h = right_box
    b = right.withColumns({"_rx": x, "_ry": y, "_rx1": x + w, "_ry1": y + h})
    b = b.withColumn("_cx", F.explode(_cells(F.col("_rx"), F.col("_rx1"), size))).withColumn("_cy", F.explode(_cells(F.col("_ry"), F.col("_ry1"), size)))
    met = grown_rows(a).join(grown_rows(b), [*keys, "_cx", "_cy"])
    meet = (F.col("_lx") <= F.col("_rx1")) & (F.col("_rx") <= F.col("_lx1")) & (F.col("_ly") <= F.col("_ry1")) & (F.col("_ry") <= F.col("_ly1"))
    here = (F.floor(F.greatest("_lx", "_rx") / size) == F.col("_cx")) & (F.floor(F.greatest("_ly", "_ry") / size) == F.col("_cy"))
    return met.filter(meet & here).drop("_cx", "_cy", "_lx", "_ly", "_lx1", "_ly1", "_rx", "_ry", "_rx1", "_ry1")
