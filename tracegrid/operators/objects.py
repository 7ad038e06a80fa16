"""Joins of drawn geometry with objects: who owns a segment, where terminals and connector pins are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrid.functions.evidence import status_of
from tracegrid.functions.geometry import box_gap2, box_of, cosine, inside, point_box2, segment_box2
from tracegrid.operators.graph import single_linkage
from tracegrid.operators.semantics import TERMINAL_KIND, map_column
from tracegrid.operators.spatial import range_join
from tracegrid.operators.topology import PAGE, segment_id

COMPONENT_SHARE, TEXT_SHARE, BOUNDARY = 0.5, 0.25, 2.0
REJECT_LENGTH, REJECT_COMPONENT, REJECT_TEXT = 12, 8.0, 6.0
TERMINAL_REACH, ALIGNED_REACH, ALIGNED_COSINE = 8.0, 16.0, 0.85
PIN_OVERLAP, PIN_END, PIN_ENDPOINT = 3.0, 2.0, 6.0
GROUND_COVERED = 8.0


def drawn(segments: DataFrame) -> DataFrame:
    """Segments with seg, x1, y1, x2, y2."""
    flat = F.col("o") == "H"
    at = lambda a, b: F.when(flat, F.col(a)).otherwise(F.col(b)).cast("double")
    return segments.select(*PAGE, segment_id().alias("seg"), "o", "axis", "lo", "hi", at("lo", "axis").alias("x1"), at("axis", "lo").alias("y1"), at("hi", "axis").alias("x2"), at("axis", "hi").alias("y2"))


def _segment_box() -> tuple[Column, ...]:
    return F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")


def _named(boxes: DataFrame, *more: str) -> DataFrame:
    return boxes.select(*PAGE, F.col("id").alias("obj"), *(F.col(c).cast("double").alias(f"o_{c}") for c in ("bx", "by", "bw", "bh")), *more)


def overlap(box: str = "o_") -> Column:
    """Length of an axis-parallel segment inside a box, 0 if they do not meet."""
    flat = F.col("o") == "H"
    across = F.when(flat, (F.col("axis") >= F.col(f"{box}by")) & (F.col("axis") <= F.col(f"{box}by") + F.col(f"{box}bh"))).otherwise((F.col("axis") >= F.col(f"{box}bx")) & (F.col("axis") <= F.col(f"{box}bx") + F.col(f"{box}bw")))
    lo = F.when(flat, F.col(f"{box}bx")).otherwise(F.col(f"{box}by"))
    hi = F.when(flat, F.col(f"{box}bx") + F.col(f"{box}bw")).otherwise(F.col(f"{box}by") + F.col(f"{box}bh"))
    return F.when(across, F.greatest(F.lit(0.0), F.least(F.col("hi").cast("double"), hi) - F.greatest(F.col("lo").cast("double"), lo))).otherwise(0.0)


def _best_owner(segments: DataFrame, boxes: DataFrame, share: float, kind: str) -> DataFrame:
    """(page, seg, kind_id, kind_owned): the box with most of the segment, by id among equals; it owns the segment if
    both ends lie strictly inside and the share suffices, or if the segment traces its boundary."""
    met = range_join(segments, _named(boxes), _segment_box(), box_of("o_"), BOUNDARY, PAGE, "seg", "obj", cell=160.0).withColumn("ov", overlap())
    strict = (F.col("x1") > F.col("o_bx")) & (F.col("x2") < F.col("o_bx") + F.col("o_bw")) & (F.col("y1") > F.col("o_by")) & (F.col("y2") < F.col("o_by") + F.col("o_bh"))
    near = lambda a, b: F.abs(a - b) <= BOUNDARY
    flat = F.col("o") == "H"
    side = F.when(flat, near(F.col("axis"), F.col("o_by")) | near(F.col("axis"), F.col("o_by") + F.col("o_bh"))).otherwise(near(F.col("axis"), F.col("o_bx")) | near(F.col("axis"), F.col("o_bx") + F.col("o_bw")))
    met = met.withColumns({"own": strict & (F.col("ov") / (F.col("hi") - F.col("lo")) >= share), "trace": side & (F.col("x1") >= F.col("o_bx") - BOUNDARY) & (F.col("x2") <= F.col("o_bx") + F.col("o_bw") + BOUNDARY) & (F.col("y1") >= F.col("o_by") - BOUNDARY) & (F.col("y2") <= F.col("o_by") + F.col("o_bh") + BOUNDARY)})
    best = met.groupBy(*PAGE, "seg").agg(F.min(F.when(F.col("ov") > 0, F.struct(-F.col("ov"), F.col("obj").alias("obj"), F.col("own").alias("own")))).alias("b"), F.min(F.when(F.col("trace"), F.col("obj"))).alias(f"{kind}_traced"))
    return best.select(*PAGE, "seg", F.col("b.obj").alias(f"{kind}_id"), F.coalesce("b.own", F.lit(False)).alias(f"{kind}_owned"), f"{kind}_traced")


def geometry_ownership(segments: DataFrame, components: DataFrame, texts: DataFrame) -> DataFrame:
    """(page, seg, owner_kind, owner_id): inner geometry of components and texts; the rest are conductors."""
    s = drawn(segments)
    c, t = _best_owner(s, components, COMPONENT_SHARE, "component"), _best_owner(s, texts, TEXT_SHARE, "text")
    met = s.select(*PAGE, "seg").join(c, [*PAGE, "seg"], "left").join(t, [*PAGE, "seg"], "left")
    kind = F.when(F.col("component_owned"), "component").when(F.col("text_owned"), "text").when(F.col("component_traced").isNotNull(), "boundary").otherwise("conductor")
    owner = F.when(kind == "component", F.col("component_id")).when(kind == "text", F.col("text_id")).when(kind == "boundary", F.col("component_traced"))
    return met.select(*PAGE, "seg", kind.alias("owner_kind"), owner.alias("owner_id"))


def conductor_filter(segments: DataFrame, min_length: float = REJECT_LENGTH) -> DataFrame:
    """(page, seg, length, reason): reason is null for segments that stay."""
    s = drawn(segments)
    length = (F.col("hi") - F.col("lo")).cast("double")
    return s.withColumns({"length": length, "reason": F.when(length < min_length, "below_minimum_length")})


def rejected_associations(rejected: DataFrame, components: DataFrame, texts: DataFrame) -> DataFrame:
    """(page, seg, classification, associated_id): the nearest component (8 px), else the nearest text (6 px)."""

    def nearest(boxes: DataFrame, reach: float, kind: str, *more: str) -> DataFrame:
        met = range_join(rejected, _named(boxes, *more), _segment_box(), box_of("o_"), reach, PAGE, "seg", "obj", cell=160.0)
        met = met.withColumn("d2", segment_box2((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")), box_of("o_"))).filter(F.col("d2") <= reach * reach)
        return met.groupBy(*PAGE, "seg").agg(F.min(F.struct("d2", "obj", *more)).alias(kind))

    c, t = nearest(components, REJECT_COMPONENT, "c", "kind"), nearest(texts, REJECT_TEXT, "t")
    met = rejected.select(*PAGE, "seg").join(c, [*PAGE, "seg"], "left").join(t, [*PAGE, "seg"], "left")
    to_component = F.col("c").isNotNull() & (F.col("t").isNull() | (F.col("c.d2") <= F.col("t.d2")))
    kind = F.when(to_component, F.when(F.col("c.kind") == "primitive_symbol", "connector_associated").otherwise("component_associated")).when(F.col("t").isNotNull(), "text_associated").otherwise("unresolved")
    return met.select(*PAGE, "seg", kind.alias("classification"), F.when(to_component, F.col("c.obj")).otherwise(F.col("t.obj")).alias("associated_id"))


def circle_context(components: DataFrame, segments: DataFrame, measures: DataFrame, max_run: float = 0.75, reach: float = 5.0) -> DataFrame:
    """Components but circular ones without a conductor at hand, or with a straight run along too much of them.

    ``measures`` is (id, run_fraction).
    """
    circles = components.filter("kind = 'circular_symbol'").join(measures, "id").filter(F.col("run_fraction") < max_run)
    s = drawn(segments)
    met = range_join(s, _named(circles), _segment_box(), box_of("o_"), reach, PAGE, "seg", "obj", cell=160.0)
    ends = F.least(point_box2((F.col("x1"), F.col("y1")), box_of("o_")), point_box2((F.col("x2"), F.col("y2")), box_of("o_"))) <= reach * reach
    touched = met.filter(ends | (overlap() > 0)).select(F.col("obj").alias("id")).distinct()
    return components.filter("kind <> 'circular_symbol'").unionByName(circles.drop("run_fraction").join(touched, "id", "left_semi").select(*components.columns))


def terminal_locations(endpoints: DataFrame, components: DataFrame, evidenced: DataFrame, reach: float = TERMINAL_REACH) -> DataFrame:
    """(page, endpoint_id, component_id, kind, d2, confidence): the nearest component that has evidence of its own.

    ``evidenced`` is (id): components with primitives or rejected segments.
    """
    owned = _named(components.join(evidenced.select("id").distinct(), "id", "left_semi"), "kind")
    p = endpoints.select(*PAGE, F.col("id").alias("endpoint_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    zero = F.lit(0.0)
    met = range_join(p, owned, (F.col("x"), F.col("y"), zero, zero), box_of("o_"), reach, PAGE, "endpoint_id", "obj", cell=160.0)
    met = met.withColumn("d2", point_box2((F.col("x"), F.col("y")), box_of("o_"))).filter(F.col("d2") <= reach * reach)
    best = met.groupBy(*PAGE, "endpoint_id").agg(F.min(F.struct("d2", "obj", "kind")).alias("b"))
    return best.select(*PAGE, "endpoint_id", F.col("b.obj").alias("component_id"), F.coalesce(map_column(TERMINAL_KIND, F.col("b.kind")), F.lit("unknown")).alias("kind"), F.col("b.d2").alias("d2"), F.when(F.col("b.d2") <= 6.25, "high").when(F.col("b.d2") <= 25, "medium").otherwise("low").alias("confidence"))


def aligned_terminals(endpoints: DataFrame, edges: DataFrame, components: DataFrame, existing: DataFrame, reach: float = ALIGNED_REACH, least: float = ALIGNED_COSINE) -> DataFrame:
    """(page, endpoint_id, component_id): ends near a box whose conductor points at it, but for pairs in ``existing``."""
    both = edges.select(*PAGE, F.col("from_node").alias("node_id"), F.col("x2").alias("nx"), F.col("y2").alias("ny")).unionByName(edges.select(*PAGE, F.col("to_node").alias("node_id"), F.col("x1").alias("nx"), F.col("y1").alias("ny")))
    p = endpoints.join(both, [*PAGE, "node_id"]).select(*PAGE, F.col("id").alias("endpoint_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("x") - F.col("nx")).alias("dx"), (F.col("y") - F.col("ny")).alias("dy"))
    zero = F.lit(0.0)
    met = range_join(p, _named(components.filter(F.col("kind").isin(*TERMINAL_KIND))), (F.col("x"), F.col("y"), zero, zero), box_of("o_"), reach, PAGE, "endpoint_id", "obj", cell=160.0)
    d2 = point_box2((F.col("x"), F.col("y")), box_of("o_"))
    nearest = lambda v, lo, size: F.greatest(F.col(lo), F.least(F.col(v), F.col(lo) + F.col(size)))
    toward = cosine(F.col("dx"), F.col("dy"), nearest("x", "o_bx", "o_bw") - F.col("x"), nearest("y", "o_by", "o_bh") - F.col("y"))
    found = met.filter((d2 > 0) & (d2 <= reach * reach) & (toward >= least)).select(*PAGE, "endpoint_id", F.col("obj").alias("component_id")).distinct()
    return found.join(existing.select(*PAGE, "endpoint_id", "component_id"), [*PAGE, "endpoint_id", "component_id"], "left_anti")


def recognized_terminals(components: DataFrame, primitives: DataFrame, endpoints: DataFrame, edges: DataFrame, existing: DataFrame, lead_reach: float = 6.0, reach: float = ALIGNED_REACH, least: float = ALIGNED_COSINE) -> DataFrame:
    """(page, endpoint_id, component_id, primitive_id, kind, confidence): terminals that the parts of components tell of.

    A lead (``primitives`` page, id, component_id, kind, bx, by, bw, bh, confidence) takes the end nearest to it, within
    ``lead_reach``; two that are as near give none. The weaker of the lead's confidence and that of the distance holds,
    and an unresolved one gives no terminal. A component with parts but no lead takes the ends near its box, but not on
    it, of which a conductor goes on towards the nearest point of the box. A pair of end and component comes once, by the
    first lead, and not if ``existing`` has it.
    """
    known = components.filter(F.col("kind").isin(*TERMINAL_KIND)).select(*PAGE, F.col("id").alias("component_id"), F.col("kind").alias("component_kind"))
    had = existing.select(*PAGE, "endpoint_id", "component_id")
    points = endpoints.select(*PAGE, F.col("id").alias("endpoint_id"), "node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    zero, at = F.lit(0.0), (F.col("x"), F.col("y"))
    d2 = point_box2(at, box_of("o_"))
    leads = primitives.filter("kind = 'terminal_lead'")
    met = range_join(points, _named(leads, "component_id", "confidence"), (*at, zero, zero), box_of("o_"), lead_reach, PAGE, "endpoint_id", "obj", cell=160.0).withColumn("d2", d2).filter(F.col("d2") <= lead_reach * lead_reach)
    nearest = met.withColumn("k", F.rank().over(Window.partitionBy(*PAGE, "obj").orderBy("d2"))).filter("k = 1").groupBy(*PAGE, F.col("obj").alias("primitive_id"), "component_id", "confidence").agg(F.count(F.lit(1)).alias("n"), F.min("endpoint_id").alias("endpoint_id"), F.min("d2").alias("d2")).filter("n = 1")
    ranks, names = F.create_map(*(F.lit(v) for pair in (("high", 3), ("medium", 2), ("low", 1)) for v in pair)), F.array(*(F.lit(c) for c in ("low", "medium", "high")))
    by_distance = F.when(F.col("d2") <= 4, 3).when(F.col("d2") <= 16, 2).otherwise(1)
    weaker = F.least(F.coalesce(ranks[F.col("confidence")], F.lit(0)), by_distance)
    told = nearest.withColumn("rank", weaker).filter("rank > 0").join(known, [*PAGE, "component_id"]).join(had, [*PAGE, "endpoint_id", "component_id"], "left_anti")
    first = told.withColumn("k", F.row_number().over(Window.partitionBy(*PAGE, "endpoint_id", "component_id").orderBy("primitive_id"))).filter("k = 1")
    by_lead = first.select(*PAGE, "endpoint_id", "component_id", "primitive_id", map_column(TERMINAL_KIND, F.col("component_kind")).alias("kind"), F.element_at(names, F.col("rank")).alias("confidence"))
    owners = primitives.groupBy(*PAGE, "component_id").agg(F.max(F.col("kind") == "terminal_lead").alias("has_lead")).filter("NOT has_lead")
    bare = components.filter(F.col("kind").isin(*TERMINAL_KIND)).join(owners.select(*PAGE, F.col("component_id").alias("id")), [*PAGE, "id"], "left_semi")
    both = edges.select(*PAGE, F.col("from_node").alias("node_id"), F.col("x2").alias("nx"), F.col("y2").alias("ny")).unionByName(edges.select(*PAGE, F.col("to_node").alias("node_id"), F.col("x1").alias("nx"), F.col("y1").alias("ny")))
    ends = points.join(both, [*PAGE, "node_id"])
    near = range_join(ends, _named(bare, "kind"), (*at, zero, zero), box_of("o_"), reach, PAGE, "endpoint_id", "obj", cell=160.0).withColumn("d2", d2)
    side = lambda v, lo, size: F.greatest(F.col(lo), F.least(F.col(v), F.col(lo) + F.col(size)))
    toward = cosine(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"), side("x", "o_bx", "o_bw") - F.col("x"), side("y", "o_by", "o_bh") - F.col("y"))
    aligned = near.filter((F.col("d2") > 0) & (F.col("d2") <= reach * reach) & (toward >= least)).groupBy(*PAGE, "endpoint_id", F.col("obj").alias("component_id"), "kind").agg(F.min("d2").alias("d2")).join(had, [*PAGE, "endpoint_id", "component_id"], "left_anti")
    by_direction = aligned.select(*PAGE, "endpoint_id", "component_id", F.lit(None).cast("string").alias("primitive_id"), map_column(TERMINAL_KIND, F.col("kind")).alias("kind"), F.when(F.col("d2") <= 16, "medium").otherwise("low").alias("confidence"))
    return by_lead.unionByName(by_direction)


def connector_attachment(connectors: DataFrame, components: DataFrame, reach: float = 2.0) -> DataFrame:
    """(page, id, topology, component_id): one component at hand is the carrier, none makes it inline, more unknown."""
    left = connectors.select(*PAGE, "id", *(F.col(c).cast("double").alias(f"c_{c}") for c in ("bx", "by", "bw", "bh")))
    met = range_join(left, _named(components.filter("kind <> 'diagram_furniture'")), box_of("c_"), box_of("o_"), reach, PAGE, "id", "obj", cell=160.0)
    met = met.filter((F.col("id") != F.col("obj")) & (box_gap2(box_of("c_"), box_of("o_")) <= reach * reach)).groupBy(*PAGE, "id").agg(F.count(F.lit(1)).alias("n"), F.min("obj").alias("obj"))
    n = F.coalesce("n", F.lit(0))
    return connectors.select(*PAGE, "id").join(met, [*PAGE, "id"], "left").select(*PAGE, "id", F.when(n == 1, "component_attached").when(n == 0, "inline").otherwise("unknown").alias("topology"), F.when(n == 1, F.col("obj")).alias("component_id"))


def connector_pins(connectors: DataFrame, segments: DataFrame) -> DataFrame:
    """(page, connector_id, ordinal, seg, x, y, interaction): conductors inside a connector, two at least.

    One end inside ends the conductor there; otherwise it passes, and the pin lies in the middle of the inner part.
    """
    met = range_join(drawn(segments), _named(connectors), _segment_box(), box_of("o_"), 0.0, PAGE, "seg", "obj", cell=160.0).withColumn("ov", overlap()).filter(F.col("ov") >= PIN_OVERLAP)
    near = lambda x, y: point_box2((F.col(x), F.col(y)), box_of("o_")) <= PIN_END * PIN_END
    a, b = near("x1", "y1"), near("x2", "y2")
    ends = a != b
    mid = lambda p, q, lo, size: (F.greatest(F.col(p), F.col(lo)) + F.least(F.col(q), F.col(lo) + F.col(size))) / 2
    x = F.when(ends, F.when(a, F.col("x1")).otherwise(F.col("x2"))).otherwise(mid("x1", "x2", "o_bx", "o_bw"))
    y = F.when(ends, F.when(a, F.col("y1")).otherwise(F.col("y2"))).otherwise(mid("y1", "y2", "o_by", "o_bh"))
    pins = met.select(*PAGE, F.col("obj").alias("connector_id"), "seg", x.alias("x"), y.alias("y"), F.when(ends, "termination").otherwise("pass_through").alias("interaction"))
    w = Window.partitionBy(*PAGE, "connector_id")
    return pins.withColumns({"n": F.count(F.lit(1)).over(w), "ordinal": F.row_number().over(w.orderBy("y", "x", "seg")) - 1}).filter("n >= 2").drop("n")


def pin_endpoints(pins: DataFrame, endpoints: DataFrame, edges: DataFrame, reach: float = PIN_ENDPOINT) -> DataFrame:
    """(page, connector_id, ordinal, status, endpoint_id): ends near a pin on the pin's own segment."""
    ends = edges.select(*PAGE, "seg", F.explode(F.array("from_node", "to_node")).alias("node_id"))
    p = endpoints.join(ends, [*PAGE, "node_id"]).select(*PAGE, F.col("id").alias("ep"), F.col("seg").alias("ep_seg"), F.col("x").cast("double").alias("ex"), F.col("y").cast("double").alias("ey"))
    zero = F.lit(0.0)
    left = pins.select(*PAGE, "connector_id", "ordinal", "seg", "x", "y")
    met = range_join(left, p, (F.col("x"), F.col("y"), zero, zero), (F.col("ex"), F.col("ey"), zero, zero), reach, PAGE, "connector_id", "ep", cell=160.0).filter("seg = ep_seg")
    near = met.filter((F.col("x") - F.col("ex")) * (F.col("x") - F.col("ex")) + (F.col("y") - F.col("ey")) * (F.col("y") - F.col("ey")) <= reach * reach)
    got = near.groupBy(*PAGE, "connector_id", "ordinal").agg(F.countDistinct("ep").alias("n"), F.min("ep").alias("ep"))
    n = F.coalesce("n", F.lit(0))
    return left.select(*PAGE, "connector_id", "ordinal").join(got, [*PAGE, "connector_id", "ordinal"], "left").select(*PAGE, "connector_id", "ordinal", status_of(n).alias("status"), F.when(n == 1, F.col("ep")).alias("endpoint_id"))


def reconcile_associations(associations: DataFrame, kinds: DataFrame) -> DataFrame:
    """``associations`` after endpoint kinds are final: resolved ones whose endpoint is gone are open again, those whose
    endpoint turned out to be something else conflict. ``kinds`` is (page, endpoint_id, kind)."""
    met = associations.join(kinds.select(*PAGE, "endpoint_id", F.col("kind").alias("_k")), [*PAGE, "endpoint_id"], "left")
    was = F.col("status") == "resolved"
    status = F.when(~was, F.col("status")).when(F.col("_k").isNull() | (F.col("_k") == "unresolved"), "unresolved").when(F.col("_k").isin("geometric", "connector_terminal"), "resolved").otherwise("conflicted")
    return met.select(*PAGE, "connector_id", "ordinal", status.alias("status"), F.when(status == "resolved", F.col("endpoint_id")).alias("endpoint_id"))


def connector_terminals(associations: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(page, connector_id, ordinal, endpoint_id, kind) of resolved associations."""
    return associations.filter("status = 'resolved'").join(endpoints.select(*PAGE, F.col("id").alias("endpoint_id"), "kind"), [*PAGE, "endpoint_id"]).select(*PAGE, "connector_id", "ordinal", "endpoint_id", "kind")


def match_points(truth: DataFrame, found: DataFrame, reach: float) -> DataFrame:
    """(page, truth_id, found_id, d2): the nearest found point of each true one, none beyond ``reach``; ties by id."""
    zero = F.lit(0.0)
    t = truth.select(*PAGE, F.col("id").alias("truth_id"), F.col("x").cast("double").alias("tx"), F.col("y").cast("double").alias("ty"))
    f = found.select(*PAGE, F.col("id").alias("found_id"), F.col("x").cast("double").alias("fx"), F.col("y").cast("double").alias("fy"))
    met = range_join(t, f, (F.col("tx"), F.col("ty"), zero, zero), (F.col("fx"), F.col("fy"), zero, zero), reach, PAGE, "truth_id", "found_id", cell=160.0)
    d2 = (F.col("tx") - F.col("fx")) * (F.col("tx") - F.col("fx")) + (F.col("ty") - F.col("fy")) * (F.col("ty") - F.col("fy"))
    best = met.withColumn("d2", d2).filter(F.col("d2") <= reach * reach).groupBy(*PAGE, "truth_id").agg(F.min(F.struct("d2", "found_id")).alias("b"))
    return t.select(*PAGE, "truth_id").join(best, [*PAGE, "truth_id"], "left").select(*PAGE, "truth_id", F.col("b.found_id").alias("found_id"), F.col("b.d2").alias("d2"))


def furniture_clusters(components: DataFrame, gap: float = 45.0, align: float = 6.0, members: int = 16, rows: int = 2, columns: int = 3) -> DataFrame:
    """(page, root, members, rows, columns): regular grids of small symbols, which are furniture and not circuits."""
    small = components.filter("kind IN ('circular_symbol', 'primitive_symbol')")
    tied = single_linkage(small, "id", gap).join(small.select(*PAGE, F.col("id").alias("node"), "bx", "by", "bw", "bh"), [*PAGE, "node"])
    tied = tied.withColumns({"cx": F.col("bx") + F.col("bw") / 2, "cy": F.col("by") + F.col("bh") / 2})
    line = lambda c: F.when(F.col(c) - F.lag(c).over(Window.partitionBy(*PAGE, "root").orderBy(c, "node")) <= align, 0).otherwise(1)
    counted = tied.withColumns({"r": line("cy"), "c": line("cx")}).groupBy(*PAGE, "root").agg(F.count(F.lit(1)).alias("members"), F.sum("r").alias("rows"), F.sum("c").alias("columns"))
    return counted.filter((F.col("members") >= members) & (F.col("rows") >= rows) & (F.col("columns") >= columns))


def unreached_grounds(components: DataFrame, segments: DataFrame, reach: float = GROUND_COVERED) -> DataFrame:
    """Ground symbols without a segment end within ``reach``."""
    grounds = components.filter("kind = 'chassis_ground'")
    ends = drawn(segments).select(*PAGE, "seg", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select(*PAGE, "seg", "p.x", "p.y")
    zero = F.lit(0.0)
    met = range_join(ends, _named(grounds), (F.col("x"), F.col("y"), zero, zero), box_of("o_"), reach, PAGE, "seg", "obj", cell=160.0)
    near = met.filter(point_box2((F.col("x"), F.col("y")), box_of("o_")) <= reach * reach).select(*PAGE, F.col("obj").alias("id")).distinct()
    return grounds.join(near, [*PAGE, "id"], "left_anti")


def recognition_context(regions: DataFrame, components: DataFrame, endpoints: DataFrame, radius: float = 180.0) -> DataFrame:
    """(page, text_region_id, components, endpoints): how many objects stand around each text."""
    t = regions.select(*PAGE, F.col("id").alias("region"), (F.col("bx") + F.col("bw") / 2).alias("x"), (F.col("by") + F.col("bh") / 2).alias("y"))
    points = components.select(*PAGE, F.col("id").alias("obj"), F.lit("c").alias("what"), (F.col("bx") + F.col("bw") / 2).alias("px"), (F.col("by") + F.col("bh") / 2).alias("py")).unionByName(endpoints.select(*PAGE, F.col("id").alias("obj"), F.lit("e").alias("what"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")))
    zero = F.lit(0.0)
    met = range_join(t, points, (F.col("x"), F.col("y"), zero, zero), (F.col("px"), F.col("py"), zero, zero), radius, PAGE, "region", "obj", cell=240.0)
    near = met.filter((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")) <= radius * radius)
    got = near.groupBy(*PAGE, "region").agg(F.count(F.when(F.col("what") == "c", 1)).alias("components"), F.count(F.when(F.col("what") == "e", 1)).alias("endpoints"))
    return t.select(*PAGE, "region").join(got, [*PAGE, "region"], "left").select(*PAGE, F.col("region").alias("text_region_id"), F.coalesce("components", F.lit(0)).cast("long").alias("components"), F.coalesce("endpoints", F.lit(0)).cast("long").alias("endpoints"))


def inside_boxes(points: DataFrame, boxes: DataFrame, id: str) -> DataFrame:
    """Points (page, ``id``, x, y) that lie in some box, each once."""
    zero = F.lit(0.0)
    p = points.withColumns({"_x": F.col("x").cast("double"), "_y": F.col("y").cast("double")})
    met = range_join(p, _named(boxes), (F.col("_x"), F.col("_y"), zero, zero), box_of("o_"), 0.0, PAGE, id, "obj", cell=160.0)
    return met.filter(inside((F.col("_x"), F.col("_y")), box_of("o_"))).select(*points.columns).distinct()
