import os

from pyspark.sql import functions as F

from tracegrid.functions import evidence, geometry, ids, shared, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cut_and_release(spark):
    df = shared.cut(spark.range(5), "numbers")
    assert sorted(r.id for r in df.collect()) == list(range(5))
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and shared.release(spark) >= 1 and not os.path.exists(path) and shared.release(spark) == 0


def test_stable_id(spark):
    assert one(spark, ids.stable_id("wire", F.lit("source:0:1,2-3,4"))) == "wire-ce83e11763faff89"
    assert one(spark, ids.stable_id("wire", F.lit("a"))) != one(spark, ids.stable_id("wire", F.lit("b")))
    for s in ("", "é", "x" * 300):
        assert one(spark, ids.stable_id("n", F.lit(s))) == f"n-{ids.fnv1a(s.encode(), ids.fnv1a(b'n' + bytes([255]))):016x}"
    assert one(spark, ids.stable_id("n", F.lit(None).cast("string"))) is None


def test_fmt_num(spark):
    for value, told in ((20.0, "20"), (20.5, "20.5"), (20.25, "20.25"), (0.0, "0"), (100.0, "100")):
        assert one(spark, ids.fmt_num(F.lit(value))) == told


def test_wire_key_ignores_direction(spark):
    a, b = F.array(F.lit("e2"), F.lit("e1")), F.array(F.lit("e1"), F.lit("e2"))
    assert one(spark, ids.wire_key(F.lit("p"), F.lit("q"), a, a)) == one(spark, ids.wire_key(F.lit("q"), F.lit("p"), b, b))


def test_text_vocabulary(spark):
    rows = [("GND", "ground_label"), ("b+", "power_feed_label"), ("shared-function-feed", "shared_function_feed_label"), ("  ign:", "function_label"), ("red", "wire_color"), ("connector  C1", "connector_label"), ("pin_3", "terminal_label"), ("arbitrary label", "unknown"), ("PIN", "unknown"), ("", "unknown")]
    df = spark.createDataFrame(rows, "t string, k string")
    assert all(r.k == r.got for r in df.withColumn("got", text.classify(text.normalize(F.col("t")))).collect())


def test_only_ascii_letters_change(spark):
    assert one(spark, text.normalize(F.lit("  é-à_b.;"))) == "é à B"
    assert one(spark, text.normalize_identity(F.lit("a b-c_é"))) == "ABCé"


def test_resolve_or_conflict(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", None), ("c", "")], "k string, v string")
    got = {r.k: (r.v, r.status) for r in evidence.resolve_or_conflict(df, ["k"], "v").collect()}
    assert got == {"a": ("x", "resolved"), "b": (None, "conflicted"), "c": (None, "unresolved")}


def test_strongest_unless_tied(spark):
    df = spark.createDataFrame([("a", "x", "high", 1), ("a", "y", "low", 0), ("b", "x", "low", 0), ("b", "y", "low", 1), ("c", "x", "low", 2), ("c", "x", "low", 1)], "k string, v string, c string, d int")
    got = {r.k: (r.v, r.d) for r in evidence.strongest_unless_tied(df, ["k"], "v", "c", [F.col("d")]).collect()}
    assert got == {"a": ("x", 1), "c": ("x", 1)}


def test_nearest_unique(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 1.0), ("b", "y", 1.0)], "k string, t string, d double")
    assert [(r.k, r.t) for r in evidence.nearest_unique(df, ["k"], "t", "d").collect()] == [("a", "x")]


def test_pair_reinforced(spark):
    rows = [("r", "r", "r", "resolved", "high"), ("r", None, "r", "resolved", "medium"), ("r", "b", None, "conflicted", "unresolved"), (None, "", None, "unresolved", "unresolved")]
    df = spark.createDataFrame(rows, "a string, b string, v string, s string, c string")
    v, s, c = evidence.pair_reinforced(F.col("a"), F.col("b"))
    for r in df.select("*", v.alias("v2"), s.alias("s2"), c.alias("c2")).collect():
        assert (r.v2, r.s2, r.c2) == (r.v, r.s, r.c)


def test_geometry(spark):
    box = tuple(F.lit(float(x)) for x in (10, 10, 20, 10))
    at = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    assert one(spark, geometry.point_box2(at(7, 6), box)) == 25.0
    assert one(spark, geometry.overlap_fraction(at(0, 15), at(40, 15), box)) == 0.5
    assert one(spark, geometry.overlap_fraction(at(0, 5), at(40, 5), box)) == 0.0
    assert one(spark, geometry.point_segment2(at(5, 3), at(0, 0), at(10, 0))) == 9.0
    assert one(spark, geometry.strictly_inside(at(10, 15), box)) is False
    assert one(spark, geometry.segment_box2(at(0, 0), at(40, 0), box)) == 100.0
    assert one(spark, geometry.box_gap2(box, tuple(F.lit(float(x)) for x in (33, 24, 1, 1)))) == 25.0
