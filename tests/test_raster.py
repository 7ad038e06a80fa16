import numpy as np
from pyspark.sql import functions as F

from tracegrid.operators import raster

BOX = "source_id string, page long, id string, bx long, by long, bw long, bh long"
INK = "source_id string, page long, y long, x long"


def test_adaptive_ink_is_the_plain_sum(spark):
    rng = np.random.default_rng(3)
    image = (200 + rng.integers(-40, 40, (300, 37))).astype(np.uint8)
    image[100:140, 5:9] = 20
    rows = [("s", 1, 37, 300, bytearray(image.tobytes())), ("s", 2, 0, 0, bytearray())]
    got = raster.adaptive_ink(spark.createDataFrame(rows, "source_id string, page long, width long, height long, gray binary")).collect()
    w = np.exp(-(np.arange(-15, 16) ** 2) / 50.0)
    w = np.outer(w, w) / w.sum() ** 2
    padded = np.pad(image.astype(float), 15, mode="edge")
    want = {(y, x) for y in range(300) for x in range(37) if image[y, x] <= np.rint((padded[y : y + 31, x : x + 31] * w).sum()) - 7}
    assert {(r.y, r.x) for r in got} == want and {r.page for r in got} == {1} and len(got) == len(want)


def traced(spark, cells, box=("s", 1, "g", 40, 50, 10, 6)):
    ink = spark.createDataFrame([("s", 1, y, x) for y, x in cells], INK)
    rows = raster.ground_approaches(spark.createDataFrame([box], BOX), ink).orderBy("n").collect()
    return [(r.x1, r.y1, r.x2, r.y2) for r in rows]


def test_a_straight_approach_is_one_line(spark):
    assert traced(spark, [(y, 45) for y in range(35, 50)]) == [(45.0, 35.0, 45.0, 50.0)]


def test_a_bend_keeps_its_corner(spark):
    lines = traced(spark, [(y, 45) for y in range(42, 50)] + [(41 - i, 45 + i) for i in range(10)])
    assert len(lines) == 2 and lines[0][:2] == (54.0, 32.0) and lines[-1][2:] == (45.0, 50.0) and lines[0][2:] == lines[1][:2]


def test_no_approach(spark):
    assert traced(spark, [(y, 45) for y in range(35, 49)]) == []  # does not touch the symbol
    assert traced(spark, [(49, 45), (48, 45), (47, 45)]) == []  # too few cells
    comb = [(48, x) for x in range(33, 58)] + [(y, x) for y in range(40, 48) for x in range(33, 58, 3)] + [(49, 45)]
    assert traced(spark, comb) == []  # too many runs
    assert traced(spark, [(y, 60) for y in range(35, 50)]) == []  # beside the corridor


def test_groups_of_letters(spark):
    rows = [("s", 1, "a", 0, 0, 5, 8), ("s", 1, "b", 8, 1, 5, 8), ("s", 1, "c", 40, 0, 5, 8), ("s", 1, "d", 0, 30, 50, 1), ("s", 2, "e", 0, 0, 9, 4)]
    got = {(r.page, r.n, r.bx, r.by, r.bw, r.bh, r.members, r.confidence) for r in raster.text_groups(spark.createDataFrame(rows, BOX)).collect()}
    assert got == {(1, 0, 0, 0, 13, 9, 2, 0.7), (2, 0, 0, 0, 9, 4, 1, 0.85)}


def test_an_overlapped_region_that_went_hides_none(spark):
    rows = [("s", 1, "a", 0, 0, 100, 100), ("s", 1, "b", 85, 0, 100, 10), ("s", 1, "c", 50, 0, 100, 10), ("s", 1, "d", 0, 0, 10, 10), ("s", 1, "e", 5, 5, 0, 9)]
    got = raster.suppress_overlaps(spark.createDataFrame(rows, BOX)).collect()
    assert sorted(r.id for r in got) == ["a", "b", "c"]
    chain = [("s", 1, "a", 0, 0, 100, 10), ("s", 1, "b", 15, 0, 100, 10), ("s", 1, "c", 30, 0, 100, 10)]
    assert sorted(r.id for r in raster.suppress_overlaps(spark.createDataFrame(chain, BOX)).collect()) == ["a", "c"]


def test_exploded_rows_are_never_broadcast(spark):
    from tracegrid.operators.spatial import range_join

    boxes = spark.createDataFrame([("s", 1, "b", 0, 0, 30, 30)], "source_id string, page long, id string, x0 long, y0 long, x1 long, y1 long")
    ink = spark.createDataFrame([("s", 1, 3, 4), ("s", 1, 3, 5), ("s", 1, 40, 5)], "source_id string, page long, y long, x long")
    found = raster.ink_in_boxes(boxes, ink, "id")
    side = lambda p: boxes.select("source_id", "page", F.col("id").alias(f"{p}id"), *(F.col(c).alias(f"{p}{c}") for c in ("x0", "y0")))
    point = lambda p: (F.col(f"{p}x0"), F.col(f"{p}y0"), F.lit(0.0), F.lit(0.0))
    met = range_join(side("l"), side("r"), point("l"), point("r"), 5.0, ["source_id", "page"], "lid", "rid")
    assert [r.dark for r in found.collect()] == [2] and met.count() == 1
    for df in (found, met):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
