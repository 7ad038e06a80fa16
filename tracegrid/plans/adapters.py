"""Views that turn the star-schema tables into drawings, so that every operator has input at any scale.

Pages, boxes and texts follow fixed integer formulas on a 10-pixel lattice.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.functions.shared import lay_pages

TEXTS = ["GND", "b+", "shared-function-feed", "  ign:", "red", "connector  C1", "pin_3", "arbitrary label", "Chassis-Ground.", "Battery positive", "YELLOW;", "CONN A", "terminal 30", "horn", "", "grey,"]
KINDS = ["enclosure", "circular_symbol", "chassis_ground", "primitive_symbol", "diagram_furniture"]
CONFIDENCE = ["high", "medium", "low", "unresolved"]
SOURCE = "lattice"
#: Offsets of drawn lines from the lattice: of an axis, of a lower and an upper end.
AXIS_OFF, LO_OFF, HI_OFF = (0.0, 0.0, 0.25, 0.5, -0.25, 1.0, -2.0, 3.0), (0.0, 0.5, -1.0, 2.5, -2.75), (0.0, -0.5, 1.0, -2.5, 3.0)

#: Ten drawn symbols a page, in two rows of five; k says what is drawn and n how. Cells (dx, dy) of a symbol's 56 by 40 that
#: are ink: boxes with a gap in the top side and content, circles and crossing lines, connector bodies with notches, ground
#: symbols, objects with parts inside.
SYMBOL_PAGE = (600, 200)
SYMBOL_INK = """CASE k
 WHEN 0 THEN (dx < 30 + n % 20 AND dy < 22 + n % 13 AND (dx IN (0, 29 + n % 20) OR dy IN (0, 21 + n % 13)) AND NOT (n % 3 = 1 AND dy = 0 AND dx BETWEEN 8 AND 8 + n % 23)) OR (n % 4 <> 3 AND dx BETWEEN 10 AND 13 AND dy BETWEEN 9 AND 11) OR (n % 7 = 2 AND dy = 15 AND dx BETWEEN 6 AND 22)
 WHEN 1 THEN CASE WHEN n % 4 <> 0 THEN 4 * ((dx - 20) * (dx - 20) + (dy - 18) * (dy - 18)) BETWEEN (11 + 2 * (n % 11)) * (11 + 2 * (n % 11)) AND (13 + 2 * (n % 11)) * (13 + 2 * (n % 11)) ELSE dx IN (16, 24 + n % 7) OR dy IN (14, 22 + n % 7) END
 WHEN 2 THEN dy < 24 + n % 9 AND dx < 36 + n % 12 AND (dx = (CASE WHEN dy BETWEEN 8 AND 15 THEN n % 6 ELSE 0 END) OR dx = 35 + n % 12 - (CASE WHEN dy BETWEEN 8 AND 15 AND n % 5 <> 2 THEN n % 6 ELSE 0 END) OR dy IN (0, 23 + n % 9)
   OR (dy IN (8, 15) AND (dx <= n % 6 OR (n % 5 <> 2 AND dx >= 35 + n % 12 - n % 6))))
 WHEN 3 THEN (dx = 20 AND dy < 6 AND n % 7 <> 0) OR (dy IN (6, 7) AND dx BETWEEN 10 AND 30) OR (dy IN (11 + n % 3, 12 + n % 3) AND dx BETWEEN 11 + n % 4 AND 29 - n % 4) OR (dy IN (16 + n % 3 + n % 5, 17 + n % 3 + n % 5) AND dx BETWEEN 15 + n % 2 AND 25 - n % 3)
 ELSE (dx < 46 AND dy < 36 AND (dx IN (0, 45) OR dy IN (0, 35))) OR CASE n % 6 WHEN 0 THEN 4 * ((dx - 20) * (dx - 20) + (dy - 18) * (dy - 18)) <= 121 WHEN 1 THEN dx BETWEEN 10 AND 18 AND dy BETWEEN 8 AND 15 WHEN 2 THEN dy = 12 AND dx BETWEEN 8 AND 28
   WHEN 3 THEN dy IN (18, 19) AND dx BETWEEN 1 AND 14 WHEN 4 THEN (dx = 10 AND dy BETWEEN 6 AND 20) OR (dy = 20 AND dx BETWEEN 10 AND 20) ELSE (dx BETWEEN 20 AND 24 AND dy BETWEEN 1 AND 14) OR (dx BETWEEN 8 AND 10 AND dy BETWEEN 20 AND 21) END END"""


def _rules(cases: str) -> list[str]:
    """The rule of each k from 0 on of a ``CASE k``, without what lies in cases within them."""
    depth, starts = 0, []
    for word in re.finditer(r"\b(CASE|WHEN|ELSE|END)\b", cases):
        depth += {"CASE": 1, "END": -1}.get(word[0], 0)
        if depth == 1 and word[0] in ("WHEN", "ELSE") or depth == 0:
            starts.append(word)
    rules = [cases[a.end() : b.start()] for a, b in zip(starts, starts[1:])]
    return [r.split("THEN", 1)[1] if a[0] == "WHEN" else r for a, r in zip(starts, rules)]


def pick(values: list, index) -> F.Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), index.cast("int") + 1)


class Adapters:
    """Lazily built views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def segments(self, dense: bool = False) -> DataFrame:
        """(source_id, page, o, axis, lo, hi) from lineitem."""
        mx, my, ml = (40, 30, 12) if dense else (80, 60, 6)
        df = self.table("lineitem").selectExpr(
            "l_orderkey div 75 AS page", "CASE WHEN l_linenumber % 2 = 0 THEN 'V' ELSE 'H' END AS o",
            f"10 * ((l_partkey * 7 + l_orderkey) % {mx}) AS x", f"10 * ((l_suppkey * 13 + l_orderkey * 3) % {my}) AS y",
            f"CAST(10 * (1 + CAST(l_quantity AS INT) % {ml}) AS BIGINT) AS len",
        )
        drawn = df.selectExpr(f"'{SOURCE}' AS source_id", "page", "o", "CASE WHEN o = 'H' THEN y ELSE x END AS axis", "CASE WHEN o = 'H' THEN x ELSE y END AS lo", "CASE WHEN o = 'H' THEN x ELSE y END + len AS hi")
        return lay_pages(drawn).distinct()

    def jittered_points(self, offsets) -> DataFrame:
        """(source_id, page, seq, x, y) from lineitem: lattice points moved by ``offsets``."""
        df = self.table("lineitem")
        return df.select(
            F.lit(SOURCE).alias("source_id"), F.expr("l_orderkey div 75").alias("page"), F.expr("l_orderkey * 8 + l_linenumber").alias("seq"),
            (F.expr("10 * ((l_partkey * 7 + l_orderkey) % 12)") + pick(list(offsets), F.col("l_suppkey") % len(offsets))).alias("x"), (F.expr("10 * ((l_suppkey * 13 + l_orderkey * 3) % 9)") + pick(list(offsets), F.col("l_partkey") % len(offsets))).alias("y"),
        )

    def drawn_segments(self) -> DataFrame:
        """(source_id, page, id, o, axis, lo, hi, thickness, heavy, confidence) from lineitem: lines off the lattice, some of
        them drawn twice or in pieces on axes that nearly agree."""
        df = self.table("lineitem").selectExpr(
            "l_orderkey div 75 AS page", "concat_ws('-', 'c', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS id", "CASE WHEN l_linenumber % 2 = 0 THEN 'V' ELSE 'H' END AS o",
            "10 * ((l_partkey * 7 + l_orderkey) % 50) AS x", "10 * ((l_suppkey * 13 + l_orderkey * 3) % 40) AS y", "10 * (1 + CAST(l_quantity AS INT) % 6) AS len",
            "l_suppkey % 8 AS a", "l_partkey % 5 AS b", "(l_partkey + l_linenumber) % 5 AS c", "CAST(1 + l_partkey % 3 AS DOUBLE) AS thickness", "l_partkey % 17 = 0 AS heavy", "CASE l_returnflag WHEN 'A' THEN 4 WHEN 'N' THEN 3 ELSE 2 END AS confidence",
        ).distinct()
        flat = F.col("o") == "H"
        return df.select(
            F.lit(SOURCE).alias("source_id"), "page", "id", "o", (F.when(flat, F.col("y")).otherwise(F.col("x")) + pick(list(AXIS_OFF), F.col("a"))).alias("axis"),
            (F.when(flat, F.col("x")).otherwise(F.col("y")) + pick(list(LO_OFF), F.col("b"))).alias("lo"), (F.when(flat, F.col("x")).otherwise(F.col("y")) + F.col("len") + pick(list(HI_OFF), F.col("c"))).alias("hi"), "thickness", "heavy", "confidence",
        )

    def dashes(self) -> DataFrame:
        """(source_id, page, y, x, value) from lineitem: gray pixels beyond the upper end of every third drawn line."""
        df = self.table("lineitem").filter("l_partkey % 3 = 0").selectExpr(
            f"'{SOURCE}' AS source_id", "l_orderkey div 75 AS page", "l_linenumber % 2 = 0 AS upright", "10 * ((l_partkey * 7 + l_orderkey) % 50) AS x", "10 * ((l_suppkey * 13 + l_orderkey * 3) % 40) AS y",
            "10 * (1 + CAST(l_quantity AS INT) % 6) AS len", "2 + l_suppkey % 11 AS every", "l_partkey", "explode(sequence(0, 20)) AS i",
        )
        spot = df.filter("i % every = 0").selectExpr("source_id", "page", "CASE WHEN upright THEN y + len + i ELSE y END AS y", "CASE WHEN upright THEN x ELSE x + len + i END AS x", "(l_partkey * 7 + i * 31) % 256 AS value")
        return spot.groupBy("source_id", "page", "y", "x").agg(F.min("value").alias("value"))

    def symbols(self) -> DataFrame:
        """(source_id, page, id, k, n, bx, by) from part: where ten symbols a page stand and what they are."""
        return self.table("part").selectExpr(f"'{SOURCE}' AS source_id", "p_partkey div 10 AS page", "concat('symbol-', p_partkey) AS id", "p_size % 5 AS k", "p_partkey AS n", "20 + 110 * (p_partkey % 5) AS bx", "20 + 90 * ((p_partkey % 10) div 5) AS by")

    def symbol_ink(self) -> DataFrame:
        """(source_id, page, y, x): the pixels of the drawn symbols."""
        # the rows of ``part`` are few and their cells many, so they are dealt out first, and each kind has a stage of its own
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = self.symbols().repartition(n, "source_id", "page")
        rules = _rules(SYMBOL_INK)
        kind = lambda k: f"k = {k}" if k < len(rules) - 1 else f"k IS NULL OR k NOT BETWEEN 0 AND {len(rules) - 2}"
        parts = [dealt.filter(kind(k)).select("*", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("dy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(55))).alias("dx")).filter(rule) for k, rule in enumerate(rules)]
        return functools.reduce(DataFrame.unionByName, parts).selectExpr("source_id", "page", "by + dy AS y", "bx + dx AS x")

    def endpoint_kinds(self, endpoints: DataFrame) -> DataFrame:
        h = F.expr("((x + y) div 10) % 7")
        return endpoints.withColumn("kind", F.when(h == 0, "ground").when(h <= 3, "component_terminal").otherwise("geometric"))

    def components(self) -> DataFrame:
        """(source_id, page, id, kind, bx, by, bw, bh, confidence, label) from part."""
        k = self.table("part").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k"))
        return k.select(
            F.lit(SOURCE).alias("source_id"), F.expr("p_partkey div 10").alias("page"), F.concat_ws("-", F.lit("component"), "p_partkey", "k").alias("id"),
            pick(KINDS, F.col("p_size") % 5).alias("kind"),
            F.expr("10 * ((p_partkey * 37 + k * 23) % 80) - 5").alias("bx"), F.expr("10 * ((p_partkey * 11 + k * 29) % 60) - 5").alias("by"),
            F.expr("CAST(10 + 10 * (p_size % 3) AS BIGINT)").alias("bw"), F.expr("CAST(10 + 10 * ((p_size div 3) % 3) AS BIGINT)").alias("bh"),
            pick(CONFIDENCE, F.col("p_size") % 4).alias("confidence"), F.col("p_name").alias("label"),
        )

    def text_regions(self) -> DataFrame:
        """(source_id, page, id, bx, by, bw, bh, confidence) from orders."""
        return self.table("orders").select(
            F.lit(SOURCE).alias("source_id"), F.expr("o_orderkey div 75").alias("page"), F.concat(F.lit("text-region-"), F.col("o_orderkey")).alias("id"),
            F.expr("10 * ((o_custkey * 7 + o_orderkey) % 80)").alias("bx"), F.expr("10 * ((o_orderkey * 17) % 60)").alias("by"),
            F.expr("20 + 10 * (o_orderkey % 3)").alias("bw"), F.lit(10).cast("long").alias("bh"),
            pick([0.55, 0.70, 0.85], F.col("o_orderkey") % 3).alias("confidence"),
        )

    def glyphs(self) -> DataFrame:
        """(source_id, page, id, bx, by, bw, bh) from lineitem: boxes of letters in rows."""
        return self.table("lineitem").select(
            F.lit(SOURCE).alias("source_id"), F.expr("l_orderkey div 75").alias("page"), F.concat_ws("-", F.lit("glyph"), "l_orderkey", "l_linenumber").alias("id"),
            F.expr("(l_partkey * 7 + l_orderkey * 5) % 400").alias("bx"), F.expr("12 * ((l_suppkey * 13 + l_orderkey) % 25) + l_linenumber % 5").alias("by"),
            F.expr("3 + l_partkey % 12").alias("bw"), F.expr("4 + l_suppkey % 9").alias("bh"),
        )

    def recognition(self) -> DataFrame:
        """(text_region_id, raw_text, confidence, provider) from events."""
        conf = F.when(F.col("event_type").isin("click", "signup"), "high").when(F.col("event_type") == "view", "medium").when(F.col("event_type") == "purchase", "low").otherwise("unresolved")
        return self.table("events").select(F.concat(F.lit("text-region-"), F.col("event_id")).alias("text_region_id"), pick(TEXTS, F.col("event_id") % 16).alias("raw_text"), conf.alias("confidence"), F.when(F.col("user_id") % 2 == 0, "json-observation").otherwise("").alias("provider"))

    def terminal_evidence(self) -> DataFrame:
        """(endpoint_id, component_id, kind, confidence) from lineitem."""
        df = self.table("lineitem").filter("l_linenumber <= 3")
        conf = F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low")
        kind = pick(["component_terminal", "connector_terminal", "ground"], F.col("l_partkey") % 3)
        return df.select(F.concat(F.lit("ep-"), F.col("l_orderkey")).alias("endpoint_id"), F.concat(F.lit("component-"), F.col("l_partkey") % 3).alias("component_id"), kind.alias("kind"), conf.alias("confidence"))

    def registry(self) -> DataFrame:
        """(canonical_id, canonical_name, aliases) from nation and region; SHARED is ambiguous."""
        names = self.table("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_set("n_name").alias("aliases"))
        both = self.table("region").join(names, "r_regionkey", "left")
        shared = F.when(F.col("r_regionkey") <= 1, F.array(F.lit("SHARED"))).otherwise(F.array().cast("array<string>"))
        return both.select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("canonical_id"), F.col("r_name").alias("canonical_name"), F.concat(F.coalesce("aliases", F.array().cast("array<string>")), shared).alias("aliases"))

    def identities(self) -> DataFrame:
        """(component_id, identity) of suppliers to look up in the registry."""
        s = self.table("supplier").join(self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey", "left")
        name = F.when(F.col("s_suppkey") % 10 == 0, "SHARED").when(F.col("s_suppkey") % 3 == 0, F.replace("n_name", F.lit("_"), F.lit("-"))).when(F.col("s_suppkey") % 3 == 1, F.lower("n_name")).otherwise("NOWHERE")
        return s.select(F.concat(F.lit("component-"), F.col("s_suppkey")).alias("component_id"), name.alias("identity"))

    def ink(self) -> DataFrame:
        """(source_id, page, y, x): lattice cells under segments."""
        s = self.segments()
        along = F.explode(F.expr("sequence(lo div 10, hi div 10)"))
        cells = s.select("source_id", "page", "o", F.expr("axis div 10").alias("a"), along.alias("c"))
        return cells.select("source_id", "page", F.when(F.col("o") == "H", F.col("a")).otherwise(F.col("c")).alias("y"), F.when(F.col("o") == "H", F.col("c")).otherwise(F.col("a")).alias("x")).distinct()
