"""From drawn segments to a planar graph of nodes and edges.

A segment is (source_id, page, o, axis, lo, hi): 'H' lies on y = axis from x = lo to hi, 'V' on x = axis. Every
operator works page by page, so all joins and windows share the partitioning by (source_id, page).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrid.functions.shared import cut_pages, lay_pages
from tracegrid.operators.spatial import range_join

PAGE = ["source_id", "page"]
#: Tolerances: along one line, where two lines cross; gaps that can be bridged.
COLLINEAR, CROSS = 0.75, 0.75
MIN_GAP, MAX_GAP, FACING = 1.5, 18.0, 1.5


def node_id(x: Column, y: Column) -> Column:
    return F.concat_ws(":", x.cast("string"), y.cast("string"))


def segment_id() -> Column:
    return F.concat(F.col("o"), F.col("axis").cast("string"), F.lit(":"), F.col("lo").cast("string"))


def normalize_conductors(segments: DataFrame, tolerance: float = COLLINEAR) -> DataFrame:
    """Segments of one line that overlap or touch become one (gaps and islands, one window pass)."""
    line = Window.partitionBy(*PAGE, "o", "axis").orderBy("lo", "hi")
    reach = F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = segments.withColumn("_new", F.when(F.col("lo") > reach + tolerance, 1).otherwise(0))
    runs = marked.withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*PAGE, "o", "axis", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def segment_intersections(segments: DataFrame, tolerance: float = CROSS) -> DataFrame:
    """(page, x, y, h, v): where horizontal and vertical segments meet, with both segments' ids."""
    h = segments.filter("o = 'H'").select(*PAGE, F.col("axis").alias("y"), F.col("lo").alias("hlo"), F.col("hi").alias("hhi"), segment_id().alias("h"))
    v = segments.filter("o = 'V'").select(*PAGE, F.col("axis").alias("x"), F.col("lo").alias("vlo"), F.col("hi").alias("vhi"), segment_id().alias("v"))
    zero = F.lit(0.0)
    met = range_join(h, v, (F.col("hlo"), F.col("y"), F.col("hhi") - F.col("hlo"), zero), (F.col("x"), F.col("vlo"), zero, F.col("vhi") - F.col("vlo")), tolerance, PAGE, "h", "v", cell=160.0)
    return met.select(*PAGE, "x", "y", "h", "v")


def split_points(segments: DataFrame) -> DataFrame:
    """(page, seg, x, y, is_end): the ends of each segment and the points where others meet it, each once."""
    at = lambda along: (F.when(F.col("o") == "H", F.col(along)).otherwise(F.col("axis")), F.when(F.col("o") == "H", F.col("axis")).otherwise(F.col(along)))
    ends = F.explode(F.array(*(F.struct(at(c)[0].alias("x"), at(c)[1].alias("y")) for c in ("lo", "hi"))))
    own = segments.select(*PAGE, segment_id().alias("seg"), ends.alias("p")).select(*PAGE, "seg", "p.x", "p.y", F.lit(True).alias("is_end"))
    met = segment_intersections(segments)
    hits = met.select(*PAGE, F.col("h").alias("seg"), "x", "y").unionByName(met.select(*PAGE, F.col("v").alias("seg"), "x", "y")).withColumn("is_end", F.lit(False))
    return lay_pages(own.unionByName(hits)).groupBy(*PAGE, "seg", "x", "y").agg(F.max("is_end").alias("is_end"))


def topology_edges(points: DataFrame) -> DataFrame:
    """(page, id, seg, from_node, to_node, x1, y1, x2, y2): pieces of segments between neighbouring points."""
    along = Window.partitionBy(*PAGE, "seg").orderBy("x", "y")
    nxt = points.withColumns({"x2": F.lead("x").over(along), "y2": F.lead("y").over(along)}).filter("x2 IS NOT NULL")
    a, b = node_id(F.col("x"), F.col("y")), node_id(F.col("x2"), F.col("y2"))
    return nxt.select(*PAGE, F.concat_ws("@", "seg", a).alias("id"), "seg", a.alias("from_node"), b.alias("to_node"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def node_degree(edges: DataFrame) -> DataFrame:
    """(page, id, degree)."""
    ends = edges.select(*PAGE, F.explode(F.array("from_node", "to_node")).alias("id"))
    return ends.groupBy(*PAGE, "id").agg(F.count(F.lit(1)).alias("degree"))


def node_kind(ends: Column, inner: Column, degree: Column) -> tuple[Column, Column]:
    """(type, crossing or not) of a node at which so many segments end and so many pass."""
    crossing = (inner >= 2) & (ends == 0)
    junction = (inner + ends >= 3) | ((ends > 0) & (inner > 0))
    return F.when(crossing, "crossing").when(junction & (degree >= 3), "splice").when(junction, "junction").when(inner + ends == 2, "continuation").otherwise("conductor_end"), crossing


def topology_nodes(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(page, id, x, y, type, connective, degree). Two or more segments that cross without an end do not connect."""
    seen = points.groupBy(*PAGE, "x", "y").agg(F.count(F.when(F.col("is_end"), 1)).alias("ends"), F.count(F.when(~F.col("is_end"), 1)).alias("inner"))
    seen = seen.withColumn("id", node_id(F.col("x"), F.col("y"))).join(node_degree(edges), [*PAGE, "id"], "left")
    degree = F.coalesce("degree", F.lit(0)).cast("long")
    kind, crossing = node_kind(F.col("ends"), F.col("inner"), degree)
    return seen.select(*PAGE, "id", "x", "y", kind.alias("type"), (~crossing).alias("connective"), degree.alias("degree"))


def endpoints(nodes: DataFrame) -> DataFrame:
    """(page, id, node_id, x, y, kind, confidence): ends of conductors with one edge."""
    return nodes.filter("type = 'conductor_end' AND degree = 1").select(*PAGE, F.concat(F.lit("ep-"), F.col("id")).alias("id"), F.col("id").alias("node_id"), "x", "y", F.lit("geometric").alias("kind"), F.lit("low").alias("confidence"))


class Topology:
    """Nodes and edges of normalised segments. Split points are written once, as both are made from them; with
    ``reuse`` nodes and edges are as well, for queries that need them more than once."""

    def __init__(self, segments: DataFrame, keep: bool = True, reuse: bool = False):
        self.segments = segments
        self.points = cut_pages(split_points(segments), "points", laid=True) if keep else split_points(segments)
        self.edges = topology_edges(self.points)
        if reuse:
            self.edges = cut_pages(self.edges, "edges", laid=True)
        self.nodes = topology_nodes(self.points, self.edges)
        if reuse:
            self.nodes = cut_pages(self.nodes, "nodes", laid=True)


def facing_ends(nodes: DataFrame, edges: DataFrame, lo: float = MIN_GAP, hi: float = MAX_GAP, facing: float = FACING) -> DataFrame:
    """(page, an, ax, ay, bn, bx, by, gap2): pairs of degree-1 ends on one line that face each other, an before bn."""
    ends = nodes.filter("type = 'conductor_end' AND degree = 1").select(*PAGE, F.col("id").alias("n"), "x", "y")
    both = edges.select(*PAGE, F.col("from_node").alias("n"), F.col("x2").alias("nx"), F.col("y2").alias("ny")).unionByName(edges.select(*PAGE, F.col("to_node").alias("n"), F.col("x1").alias("nx"), F.col("y1").alias("ny")))
    known = ends.join(both, [*PAGE, "n"]).withColumns({"dx": F.col("x") - F.col("nx"), "dy": F.col("y") - F.col("ny")})
    side = lambda p: known.select(*PAGE, *(F.col(c).alias(f"{p}{c}") for c in ("n", "x", "y", "dx", "dy")))
    zero = F.lit(0.0)
    near = range_join(side("a"), side("b"), (F.col("ax"), F.col("ay"), zero, zero), (F.col("bx"), F.col("by"), zero, zero), hi, PAGE, "an", "bn").filter("an < bn")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    gap2 = dx * dx + dy * dy
    flat = (F.abs(dy) <= facing) & (F.abs(dx) > facing) & (F.col("adx") * dx > 0) & (F.col("bdx") * -dx > 0) & (F.abs("ady") <= facing) & (F.abs("bdy") <= facing)
    steep = (F.abs(dx) <= facing) & (F.abs(dy) > facing) & (F.col("ady") * dy > 0) & (F.col("bdy") * -dy > 0) & (F.abs("adx") <= facing) & (F.abs("bdx") <= facing)
    return near.filter((gap2 >= lo * lo) & (gap2 <= hi * hi) & (flat | steep)).select(*PAGE, "an", "ax", "ay", "bn", "bx", "by", gap2.alias("gap2"))


def gap_candidates(nodes: DataFrame, edges: DataFrame, lo: float = MIN_GAP, hi: float = MAX_GAP, facing: float = FACING) -> DataFrame:
    """(page, a, b, gap2): pairs of degree-1 ends on one line that face each other, a before b."""
    return facing_ends(nodes, edges, lo, hi, facing).select(*PAGE, F.col("an").alias("a"), F.col("bn").alias("b"), "gap2")


def bridge_gaps(candidates: DataFrame) -> DataFrame:
    """(page, a, b): each end, in id order, takes its nearest free partner; every end is used once."""

    def match(pdf):
        used, out = set(), []
        for a, group in pdf.sort_values(["a", "gap2", "b"]).groupby("a", sort=True):
            free = [b for b in group["b"] if b not in used]
            if a not in used and free:
                used |= {a, free[0]}
                out.append((group["source_id"].iloc[0], group["page"].iloc[0], a, free[0]))
        import pandas as pd

        return pd.DataFrame(out, columns=["source_id", "page", "a", "b"])

    return candidates.groupBy(*PAGE).applyInPandas(match, "source_id string, page long, a string, b string")


def snap_points(points: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """(page, seq, x, y, nx, ny): points off the lattice, in order of ``seq`` (then of x and y), go to the first leader within
    ``tolerance``; a page at a time, as the rule depends on order."""

    def lead(pdf):
        pdf = pdf.sort_values(["seq", "x", "y"])
        leaders: dict[tuple[int, int], list[tuple[float, float]]] = {}
        order: dict[tuple[float, float], int] = {}
        placed = []
        for x, y in zip(pdf["x"], pdf["y"]):
            cx, cy = int(x // tolerance), int(y // tolerance)
            near = [p for i in (-1, 0, 1) for j in (-1, 0, 1) for p in leaders.get((cx + i, cy + j), []) if (p[0] - x) ** 2 + (p[1] - y) ** 2 <= tolerance**2]
            here = near[0] if len(near) == 1 else min(near, key=order.get) if near else (x, y)
            if not near:
                leaders.setdefault((cx, cy), []).append(here)
                order[here] = len(order)
            placed.append(here)
        return pdf.assign(nx=[p[0] for p in placed], ny=[p[1] for p in placed])[["source_id", "page", "seq", "x", "y", "nx", "ny"]]

    return points.groupBy(*PAGE).applyInPandas(lead, "source_id string, page long, seq long, x double, y double, nx double, ny double")
