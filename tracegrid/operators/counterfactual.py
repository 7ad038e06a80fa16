"""What a drawing would be without what lies inside some objects, and what becomes of its open ends.

Both variants go through one plan: the masked one has a source of its own, and every operator keeps sources apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrid.operators.spatial import range_join
from tracegrid.operators.topology import PAGE


def masked_segments(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """What is left of ``segments`` (page, o, axis, lo, hi) outside ``boxes`` (page, bx, by, bw, bh): the pieces between the
    parts inside; borders of a box belong to it, and pieces without length go."""
    numbered = segments.select(*PAGE, "o", "axis", "lo", "hi").distinct().withColumn("seg", F.struct("o", "axis", "lo", "hi"))
    flat = F.col("o") == "H"
    zero = F.lit(0)
    box = (F.when(flat, F.col("lo")).otherwise(F.col("axis")), F.when(flat, F.col("axis")).otherwise(F.col("lo")), F.when(flat, F.col("hi") - F.col("lo")).otherwise(zero), F.when(flat, zero).otherwise(F.col("hi") - F.col("lo")))
    mask = boxes.select(*PAGE, F.struct(*boxes.columns).alias("box"), *(F.col(c).alias(f"m_{c}") for c in ("bx", "by", "bw", "bh")))
    met = range_join(numbered, mask, box, tuple(F.col(f"m_{c}") for c in ("bx", "by", "bw", "bh")), 0.0, PAGE, "seg", "box", cell=160.0)
    begin, size = F.when(flat, F.col("m_bx")).otherwise(F.col("m_by")), F.when(flat, F.col("m_bw")).otherwise(F.col("m_bh"))
    inside = met.select(*PAGE, "o", "axis", "lo", "hi", F.greatest(begin, F.col("lo")).alias("a"), F.least(begin + size, F.col("hi")).alias("b"))
    # the parts inside in order, with the segment's end as the last of them
    last = numbered.select(*PAGE, "o", "axis", "lo", "hi", F.col("hi").alias("a"), F.col("hi").alias("b"))
    along = Window.partitionBy(*PAGE, "o", "axis", "lo", "hi").orderBy("a", "b")
    reach = F.coalesce(F.max("b").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.col("lo"))
    pieces = inside.unionByName(last).withColumn("from", reach).filter(F.col("a") > F.col("from"))
    return pieces.select(*PAGE, "o", "axis", F.col("from").alias("lo"), F.col("a").alias("hi"))


def with_variant(segments: DataFrame, boxes: DataFrame, suffix: str = "~masked") -> DataFrame:
    """``segments`` and, under sources with ``suffix``, what is left of them outside ``boxes``."""
    other = masked_segments(segments, boxes).withColumn("source_id", F.concat("source_id", F.lit(suffix)))
    return segments.select(*PAGE, "o", "axis", "lo", "hi").unionByName(other)


def open_ends_after(endpoints: DataFrame, wires: DataFrame, radius: float = 12.0, suffix: str = "~masked") -> DataFrame:
    """(page, id, match_id, d2, outcome) of each end without a wire in the plain variant.

    An end and an end of the masked variant match if each is the other's nearest within ``radius`` (ties to the smaller
    id), so no end is matched twice. The outcome is gone (no match), open (its match has no wire) or wired.
    """
    held = wires.select(*PAGE, F.explode(F.array("start_endpoint", "end_endpoint")).alias("id")).distinct().withColumn("wired", F.lit(True))
    known = endpoints.select(*PAGE, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(held, [*PAGE, "id"], "left").withColumn("wired", F.coalesce("wired", F.lit(False)))
    is_other = F.endswith("source_id", F.lit(suffix))
    plain = known.filter(~is_other)
    other = known.filter(is_other).select(F.expr(f"left(source_id, length(source_id) - {len(suffix)})").alias("source_id"), "page", F.col("id").alias("o_id"), F.col("x").alias("o_x"), F.col("y").alias("o_y"), F.col("wired").alias("o_wired"))
    zero = F.lit(0.0)
    d2 = (F.col("x") - F.col("o_x")) * (F.col("x") - F.col("o_x")) + (F.col("y") - F.col("o_y")) * (F.col("y") - F.col("o_y"))
    near = range_join(plain, other, (F.col("x"), F.col("y"), zero, zero), (F.col("o_x"), F.col("o_y"), zero, zero), radius, PAGE, "id", "o_id").withColumn("d2", d2).filter(F.col("d2") <= radius * radius)
    place = lambda mine, theirs: F.row_number().over(Window.partitionBy(*PAGE, mine).orderBy("d2", theirs))
    matched = near.withColumns({"mine": place("id", "o_id"), "theirs": place("o_id", "id")}).filter("mine = 1 AND theirs = 1").select(*PAGE, "id", F.col("o_id").alias("match_id"), "d2", "o_wired")
    outcome = F.when(F.col("match_id").isNull(), "gone").when(F.col("o_wired"), "wired").otherwise("open")
    return plain.filter("NOT wired").select(*PAGE, "id").join(matched, [*PAGE, "id"], "left").select(*PAGE, "id", "match_id", "d2", outcome.alias("outcome"))
