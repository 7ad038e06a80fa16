"""The evidence algebra: every fact is resolved, unresolved or conflicted, and never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Confidence classes by rank.
RANK = {"high": 3, "medium": 2, "low": 1, "unresolved": 0}


def rank(confidence: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), confidence)


def confidence_of(r: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in RANK.items() for x in (v, k))), r)


def status_of(n_distinct: Column) -> Column:
    return F.when(n_distinct == 0, "unresolved").when(n_distinct == 1, "resolved").otherwise("conflicted")


def resolve_or_conflict(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, status): one distinct non-empty value resolves a group, more conflict, none leaves it open.

    Minimum, maximum and their equality stand for the set of values, so nothing is collected.
    """
    x = F.when(F.col(value) != "", F.col(value))
    got = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    status = F.when(F.col("_lo").isNull(), "unresolved").when(F.col("_lo") == F.col("_hi"), "resolved").otherwise("conflicted")
    return got.select(*keys, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias(value), status.alias("status"))


def strongest_unless_tied(df: DataFrame, keys: list[str], value: str, confidence: str, then: list[Column]) -> DataFrame:
    """The row of each group with the highest confidence, by ``then`` among equals; groups whose strongest rows differ
    in ``value`` have none."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_r", rank(F.col(confidence)))
    top = ranked.withColumn("_top", F.max("_r").over(w)).filter("_r = _top")
    one = top.withColumns({"_lo": F.min(value).over(w), "_hi": F.max(value).over(w)}).filter("_lo = _hi")
    return one.withColumn("_i", F.row_number().over(w.orderBy(*then))).filter("_i = 1").drop("_r", "_top", "_lo", "_hi", "_i")


def nearest_unique(df: DataFrame, keys: list[str], target: str, dist: str) -> DataFrame:
    """The rows at each group's least distance, if they name one target; ties between targets leave it open."""
    w = Window.partitionBy(*keys)
    near = df.withColumn("_d", F.min(dist).over(w)).filter(F.col(dist) == F.col("_d"))
    one = near.withColumns({"_lo": F.min(target).over(w), "_hi": F.max(target).over(w)}).filter("_lo = _hi")
    return one.withColumn("_i", F.row_number().over(w.orderBy(target))).filter("_i = 1").drop("_d", "_lo", "_hi", "_i")


def pair_reinforced(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(value, status, confidence) of a fact seen at both ends: equal is high, one is medium, differing conflicts."""
    a, b = F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))
    differ = a.isNotNull() & b.isNotNull() & (a != b)
    value = F.when(~F.coalesce(differ, F.lit(False)), F.coalesce(a, b))
    status = F.when(F.coalesce(differ, F.lit(False)), "conflicted").when(value.isNull(), "unresolved").otherwise("resolved")
    confidence = F.when(status != "resolved", "unresolved").when(a.isNotNull() & b.isNotNull(), "high").otherwise("medium")
    return value, status, confidence
