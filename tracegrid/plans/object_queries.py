"""Queries that join drawn geometry with symbols, texts and connectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrid.operators import objects as J
from tracegrid.operators import topology
from tracegrid.plans.adapters import Adapters
from tracegrid.plans.graph_queries import Drawn
from tracegrid.plans.oracle import sql

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None, **ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle, **ctes)
        return f

    return add


class View(Adapters):
    """Adapters with normalised segments."""

    def lines(self):
        return topology.normalize_conductors(self.segments())


def _pb2(px, py, b):
    return f"(pow(greatest({b}.bx - {px}, {px} - ({b}.bx + {b}.bw), 0), 2) + pow(greatest({b}.by - {py}, {py} - ({b}.by + {b}.bh), 0), 2))"


def _ps2(px, py):
    t = f"(CASE WHEN s.x1 = s.x2 AND s.y1 = s.y2 THEN 0 ELSE greatest(0, least(1, (({px} - s.x1) * (s.x2 - s.x1) + ({py} - s.y1) * (s.y2 - s.y1)) / ((s.x2 - s.x1) * (s.x2 - s.x1) + (s.y2 - s.y1) * (s.y2 - s.y1)))) END)"
    dx, dy = f"({px} - (s.x1 + {t} * (s.x2 - s.x1)))", f"({py} - (s.y1 + {t} * (s.y2 - s.y1)))"
    return f"({dx} * {dx} + {dy} * {dy})"


_LINES = {
    "lines": "SELECT *, CASE WHEN o = 'H' THEN lo ELSE axis END::DOUBLE AS x1, CASE WHEN o = 'H' THEN axis ELSE lo END::DOUBLE AS y1, CASE WHEN o = 'H' THEN hi ELSE axis END::DOUBLE AS x2, CASE WHEN o = 'H' THEN axis ELSE hi END::DOUBLE AS y2 FROM seg",
}
_OV = """CASE WHEN o = 'H' THEN CASE WHEN axis BETWEEN b.by AND b.by + b.bh THEN greatest(0, least(hi, b.bx + b.bw) - greatest(lo, b.bx)) ELSE 0 END
         ELSE CASE WHEN axis BETWEEN b.bx AND b.bx + b.bw THEN greatest(0, least(hi, b.by + b.bh) - greatest(lo, b.by)) ELSE 0 END END"""


def _own(table, share):
    return f"""SELECT page, seg, id AS owner, own FROM (SELECT s.page, s.seg, b.id, {_OV} AS ov, s.x1 > b.bx AND s.x2 < b.bx + b.bw AND s.y1 > b.by AND s.y2 < b.by + b.bh AND ({_OV})::DOUBLE / (hi - lo) >= {share} AS own
        FROM lines s JOIN {table} b ON b.page = s.page) WHERE ov > 0 QUALIFY row_number() OVER (PARTITION BY page, seg ORDER BY ov DESC, id) = 1"""


@query("""SELECT s.page, s.seg, CASE WHEN c.own THEN 'component' WHEN t.own THEN 'text' ELSE 'conductor' END AS owner_kind, CASE WHEN c.own THEN c.owner WHEN t.own THEN t.owner END AS owner_id
       FROM lines s LEFT JOIN oc c ON c.page = s.page AND c.seg = s.seg LEFT JOIN ot t ON t.page = s.page AND t.seg = s.seg""", **_LINES, oc=_own("components", 0.5), ot=_own("text_regions", 0.25))  # fmt: skip
def geometry_ownership(spark, sf_dir):
    v = View(spark, sf_dir)
    return J.geometry_ownership(v.lines(), v.components(), v.text_regions()).drop("source_id")


@query("SELECT page, seg, (hi - lo)::DOUBLE AS length, CASE WHEN hi - lo < 12 THEN 'below_minimum_length' END AS reason FROM seg")
def conductor_length_filter(spark, sf_dir):
    return J.conductor_filter(View(spark, sf_dir).lines()).select("page", "seg", "length", "reason")


_REJ = {
    **_LINES,
    "rj": "SELECT * FROM lines WHERE hi - lo < 12",
    **{k: f"""SELECT page, seg, d2, id, {kind} AS kind FROM (SELECT s.page, s.seg, b.id, b.*, least({_pb2('s.x1', 's.y1', 'b')}, {_pb2('s.x2', 's.y2', 'b')}, {_pb2('((s.x1 + s.x2) / 2)', '((s.y1 + s.y2) / 2)', 'b')},
        {_ps2('b.bx', 'b.by')}, {_ps2('(b.bx + b.bw)', 'b.by')}, {_ps2('b.bx', '(b.by + b.bh)')}, {_ps2('(b.bx + b.bw)', '(b.by + b.bh)')}) AS d2 FROM rj s JOIN {table} b ON b.page = s.page)
        WHERE d2 <= {reach * reach} QUALIFY row_number() OVER (PARTITION BY page, seg ORDER BY d2, id) = 1""" for k, table, reach, kind in (("rc", "components", 8.0, "kind"), ("rt", "text_regions", 6.0, "NULL"))},
    "ra": """SELECT s.page, s.seg, CASE WHEN c.id IS NOT NULL AND (t.id IS NULL OR c.d2 <= t.d2) THEN CASE WHEN c.kind = 'primitive_symbol' THEN 'connector_associated' ELSE 'component_associated' END WHEN t.id IS NOT NULL THEN 'text_associated' ELSE 'unresolved' END AS classification,
        CASE WHEN c.id IS NOT NULL AND (t.id IS NULL OR c.d2 <= t.d2) THEN c.id ELSE t.id END AS associated_id FROM rj s LEFT JOIN rc c ON c.page = s.page AND c.seg = s.seg LEFT JOIN rt t ON t.page = s.page AND t.seg = s.seg""",
}


def _rejected(v: View):
    return J.rejected_associations(J.conductor_filter(v.lines()).filter("reason IS NOT NULL"), v.components(), v.text_regions())


@query("SELECT * FROM ra", **_REJ)
def rejected_geometry_assoc(spark, sf_dir):
    return _rejected(View(spark, sf_dir)).drop("source_id")


@query(f"""SELECT c.page, c.id FROM components c WHERE kind <> 'circular_symbol' OR (length(c.id) * 7 % 100 < 75 AND EXISTS (SELECT 1 FROM lines s JOIN components b ON b.page = s.page WHERE b.page = c.page AND b.id = c.id
       AND (least({_pb2('s.x1', 's.y1', 'b')}, {_pb2('s.x2', 's.y2', 'b')}) <= 25 OR {_OV} > 0)))""", **_LINES)  # fmt: skip
def circle_context(spark, sf_dir):
    v = View(spark, sf_dir)
    measures = v.components().select("id", (F.length("id") * 7 % 100 / 100).alias("run_fraction"))
    return J.circle_context(v.components(), v.lines(), measures).select("page", "id")


_TL = {
    **_REJ,
    "evd": "SELECT id FROM components WHERE kind = 'primitive_symbol' UNION SELECT associated_id FROM ra WHERE classification IN ('component_associated', 'connector_associated')",
    "tl": f"""SELECT page, endpoint_id, id AS component_id, CASE kind WHEN 'chassis_ground' THEN 'ground_connection' WHEN 'enclosure' THEN 'component_boundary' WHEN 'circular_symbol' THEN 'component_boundary' WHEN 'primitive_symbol' THEN 'connector_boundary' ELSE 'unknown' END AS kind, d2,
        CASE WHEN d2 <= 6.25 THEN 'high' WHEN d2 <= 25 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT p.page, p.id AS endpoint_id, b.id, b.kind, {_pb2('p.x', 'p.y', 'b')} AS d2 FROM eps p JOIN components b ON b.page = p.page WHERE b.id IN (SELECT id FROM evd))
        WHERE d2 <= 64 QUALIFY row_number() OVER (PARTITION BY page, endpoint_id ORDER BY d2, id) = 1""",
}


def _located(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    c = d.views.components()
    rejected = J.rejected_associations(J.conductor_filter(d.segments).filter("reason IS NOT NULL"), c, d.views.text_regions())
    evidenced = c.filter("kind = 'primitive_symbol'").select("id").unionByName(rejected.filter("classification IN ('component_associated', 'connector_associated')").select(F.col("associated_id").alias("id")))
    return d, J.terminal_locations(d.endpoints, c, evidenced)


@query("SELECT * FROM tl", **_TL)
def terminal_location(spark, sf_dir):
    return _located(spark, sf_dir)[1].drop("source_id")


@query(f"""SELECT DISTINCT page, endpoint_id, component_id FROM (SELECT p.page, p.id AS endpoint_id, b.id AS component_id, {_pb2('p.x', 'p.y', 'b')} AS d2, p.x - m.x AS dx, p.y - m.y AS dy,
         greatest(b.bx, least(p.x, b.bx + b.bw)) - p.x AS tx, greatest(b.by, least(p.y, b.by + b.bh)) - p.y AS ty
         FROM eps p JOIN inc i ON i.page = p.page AND i.n = p.node_id JOIN nodes m ON m.page = p.page AND m.id = i.o JOIN components b ON b.page = p.page AND b.kind <> 'diagram_furniture')
       WHERE d2 > 0 AND d2 <= 256 AND (dx * tx + dy * ty) / sqrt((dx * dx + dy * dy)::DOUBLE * (tx * tx + ty * ty)) >= 0.85 AND (page, endpoint_id, component_id) NOT IN (SELECT (page, endpoint_id, component_id) FROM tl)""", **_TL)  # fmt: skip
def terminal_recognition(spark, sf_dir):
    d, located = _located(spark, sf_dir)
    return J.aligned_terminals(d.endpoints, d.edges, d.views.components(), located).drop("source_id")


#: Parts of components: of a component's number by 5, one is a lead at its right side, two have a lead and a disc, one a line.
_PRIMITIVES = {
    **_TL,
    "prim": """SELECT page, 'part-' || id || '-' || j AS id, id AS component_id, CASE WHEN m = 0 OR (m IN (1, 2) AND j = 0) THEN 'terminal_lead' WHEN m = 3 THEN 'line' ELSE 'circle' END AS kind, bx + bw - 2 - 4 * j AS bx, g.top + 3 * (m % 3) AS top, 6 AS bw, 4 AS bh, confidence
        FROM (SELECT page, id, bx, bw, c.by AS top, confidence, (bx + 5) // 10 * 7 % 5 AS m FROM components c) g, (SELECT unnest([0, 1]) AS j) WHERE m < 4 AND (j = 0 OR m IN (1, 2))""",
    "tkind": "SELECT page, id, CASE kind WHEN 'chassis_ground' THEN 'ground_connection' WHEN 'primitive_symbol' THEN 'connector_boundary' ELSE 'component_boundary' END AS tk, bx, c2.by AS top, bw, bh FROM components c2 WHERE kind <> 'diagram_furniture'",
    "ld": "SELECT p.page, p.id, component_id, confidence, e.id AS endpoint_id, pow(greatest(p.bx - e.x, e.x - (p.bx + p.bw), 0), 2) + pow(greatest(p.top - e.y, e.y - (p.top + p.bh), 0), 2) AS d2 FROM prim p JOIN eps e ON e.page = p.page WHERE p.kind = 'terminal_lead'",
    "ln": "SELECT page, id, component_id, confidence, min(endpoint_id) AS endpoint_id, d2 FROM (SELECT *, rank() OVER (PARTITION BY page, id ORDER BY d2) AS k FROM ld WHERE d2 <= 36) WHERE k = 1 GROUP BY ALL HAVING count(*) = 1",
    "lr": "SELECT *, least(CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END, CASE WHEN d2 <= 4 THEN 3 WHEN d2 <= 16 THEN 2 ELSE 1 END) AS r FROM ln",
    "al": """SELECT DISTINCT e.page, e.id AS endpoint_id, t.id AS component_id, tk, pow(greatest(t.bx - e.x, e.x - (t.bx + t.bw), 0), 2) + pow(greatest(t.top - e.y, e.y - (t.top + t.bh), 0), 2) AS d2, m.x - e.x AS dx, m.y - e.y AS dy, greatest(t.bx, least(e.x, t.bx + t.bw)) - e.x AS tx, greatest(t.top, least(e.y, t.top + t.bh)) - e.y AS ty
        FROM tkind t JOIN eps e ON e.page = t.page AND e.x BETWEEN t.bx - 16 AND t.bx + t.bw + 16 AND e.y BETWEEN t.top - 16 AND t.top + t.bh + 16 JOIN inc i ON i.page = e.page AND i.n = e.node_id JOIN nodes m ON m.page = i.page AND m.id = i.o
        WHERE (t.page, t.id) IN (SELECT (page, component_id) FROM prim GROUP BY page, component_id HAVING NOT bool_or(kind = 'terminal_lead'))""",
}


@query("""SELECT lr.page, endpoint_id, component_id, lr.id AS primitive_id, tk AS kind, (['low', 'medium', 'high'])[r] AS confidence FROM lr JOIN tkind t ON t.page = lr.page AND t.id = component_id WHERE r > 0 AND (lr.page, endpoint_id, component_id) NOT IN (SELECT (page, endpoint_id, component_id) FROM tl)
       QUALIFY row_number() OVER (PARTITION BY lr.page, endpoint_id, component_id ORDER BY lr.id) = 1
       UNION ALL SELECT DISTINCT page, endpoint_id, component_id, NULL, tk, CASE WHEN d2 <= 16 THEN 'medium' ELSE 'low' END FROM al WHERE d2 > 0 AND d2 <= 256 AND (dx * tx + dy * ty) / sqrt((dx * dx + dy * dy)::DOUBLE * (tx * tx + ty * ty)) >= 0.85 AND (page, endpoint_id, component_id) NOT IN (SELECT (page, endpoint_id, component_id) FROM tl)""", **_PRIMITIVES)  # fmt: skip
def terminal_candidates(spark, sf_dir):
    """Terminals by leads and, for components with parts but no lead, by the direction of conductors."""
    d, located = _located(spark, sf_dir)
    c = d.views.components()
    m, j = F.expr("(bx + 5) div 10 * 7 % 5"), F.col("j")
    parts = c.withColumn("m", m).withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).filter("m < 4 AND (j = 0 OR m IN (1, 2))")
    kind = F.when((F.col("m") == 0) | (F.col("m").isin(1, 2) & (j == 0)), "terminal_lead").when(F.col("m") == 3, "line").otherwise("circle")
    parts = parts.select(*topology.PAGE, F.concat_ws("-", F.lit("part"), "id", "j").alias("id"), F.col("id").alias("component_id"), kind.alias("kind"), (F.col("bx") + F.col("bw") - 2 - 4 * j).alias("bx"), (F.col("by") + 3 * (F.col("m") % 3)).alias("by"), F.lit(6).alias("bw"), F.lit(4).alias("bh"), "confidence")
    return J.recognized_terminals(c, parts, d.endpoints, d.edges, located).drop("source_id")


@query("""SELECT c.page, c.id, CASE count(b.id) WHEN 1 THEN 'component_attached' WHEN 0 THEN 'inline' ELSE 'unknown' END AS topology, CASE WHEN count(b.id) = 1 THEN min(b.id) END AS component_id FROM components c LEFT JOIN components b ON b.page = c.page AND b.id <> c.id AND b.kind <> 'diagram_furniture'
       AND pow(greatest(c.bx - (b.bx + b.bw), b.bx - (c.bx + c.bw), 0), 2) + pow(greatest(c.by - (b.by + b.bh), b.by - (c.by + c.bh), 0), 2) <= 4 WHERE c.kind = 'primitive_symbol' GROUP BY c.page, c.id""")  # fmt: skip
def connector_attachment(spark, sf_dir):
    c = View(spark, sf_dir).components()
    return J.connector_attachment(c.filter("kind = 'primitive_symbol'"), c).drop("source_id")


_PINS = {
    **_LINES,
    "pin0": f"""SELECT s.page, b.id AS connector_id, s.seg, ({_pb2('s.x1', 's.y1', 'b')} <= 4) AS a, ({_pb2('s.x2', 's.y2', 'b')} <= 4) AS z, s.x1, s.y1, s.x2, s.y2, (greatest(s.x1, b.bx) + least(s.x2, b.bx + b.bw)) / 2 AS mx, (greatest(s.y1, b.by) + least(s.y2, b.by + b.bh)) / 2 AS my
        FROM lines s JOIN components b ON b.page = s.page AND b.kind = 'enclosure' WHERE {_OV} >= 3""",
    "pins": """SELECT page, connector_id, seg, x, y, interaction, row_number() OVER (PARTITION BY page, connector_id ORDER BY y, x, seg) - 1 AS ordinal FROM (SELECT page, connector_id, seg, CASE WHEN a = z THEN mx WHEN a THEN x1 ELSE x2 END AS x, CASE WHEN a = z THEN my WHEN a THEN y1 ELSE y2 END AS y,
        CASE WHEN a = z THEN 'pass_through' ELSE 'termination' END AS interaction, count(*) OVER (PARTITION BY page, connector_id) AS n FROM pin0) WHERE n >= 2""",
    "pe": """SELECT p.page, p.connector_id, p.ordinal, CASE count(DISTINCT e.id) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'conflicted' END AS status, CASE WHEN count(DISTINCT e.id) = 1 THEN min(e.id) END AS endpoint_id
        FROM pins p LEFT JOIN (SELECT eps.*, i.seg FROM eps JOIN inc i ON i.page = eps.page AND i.n = eps.node_id) e ON e.page = p.page AND e.seg = p.seg AND pow(e.x - p.x, 2) + pow(e.y - p.y, 2) <= 36 GROUP BY p.page, p.connector_id, p.ordinal""",
    "rc2": "SELECT pe.page, connector_id, ordinal, CASE WHEN status <> 'resolved' THEN status WHEN e.kind IN ('geometric', 'connector_terminal') THEN 'resolved' ELSE 'conflicted' END AS status, CASE WHEN status = 'resolved' AND e.kind IN ('geometric', 'connector_terminal') THEN endpoint_id END AS endpoint_id FROM pe LEFT JOIN eps e ON e.page = pe.page AND e.id = pe.endpoint_id",
}


@query("SELECT page, connector_id, seg, x, y, interaction, ordinal::INTEGER AS ordinal FROM pins", **_PINS)
def connector_pins(spark, sf_dir):
    v = View(spark, sf_dir)
    return J.connector_pins(v.components().filter("kind = 'enclosure'"), v.lines()).drop("source_id")


def _pinned(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    pins = J.connector_pins(d.views.components().filter("kind = 'enclosure'"), d.segments)
    return d, J.pin_endpoints(pins, d.endpoints, d.edges)


@query("SELECT page, connector_id, ordinal::INTEGER AS ordinal, status, endpoint_id FROM pe", **_PINS)
def pin_endpoint_assoc(spark, sf_dir):
    return _pinned(spark, sf_dir)[1].drop("source_id")


def _reconciled(spark, sf_dir):
    d, assoc = _pinned(spark, sf_dir)
    return d, J.reconcile_associations(assoc, d.endpoints.withColumnRenamed("id", "endpoint_id"))


@query("SELECT page, connector_id, ordinal::INTEGER AS ordinal, status, endpoint_id FROM rc2", **_PINS)
def assoc_reconcile(spark, sf_dir):
    return _reconciled(spark, sf_dir)[1].drop("source_id")


@query("SELECT r.page, connector_id, ordinal::INTEGER AS ordinal, endpoint_id, e.kind FROM rc2 r JOIN eps e ON e.page = r.page AND e.id = endpoint_id WHERE status = 'resolved'", **_PINS)
def connector_terminals(spark, sf_dir):
    d, assoc = _reconciled(spark, sf_dir)
    return J.connector_terminals(assoc, d.endpoints).drop("source_id")


@query("""SELECT t.page, t.id AS truth_id, f.id AS found_id, f.d2 FROM components t LEFT JOIN (SELECT c.page, c.id AS tid, n.id, pow(c.bx + c.bw / 2.0 - n.x, 2) + pow(c.by + c.bh / 2.0 - n.y, 2) AS d2 FROM components c JOIN nodes n ON n.page = c.page AND n.type = 'splice'
       WHERE pow(c.bx + c.bw / 2.0 - n.x, 2) + pow(c.by + c.bh / 2.0 - n.y, 2) <= 144 QUALIFY row_number() OVER (PARTITION BY c.page, c.id ORDER BY pow(c.bx + c.bw / 2.0 - n.x, 2) + pow(c.by + c.bh / 2.0 - n.y, 2), n.id) = 1) f ON f.page = t.page AND f.tid = t.id""")  # fmt: skip
def ground_truth_match(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    truth = d.views.components().withColumns({"x": F.col("bx") + F.col("bw") / 2, "y": F.col("by") + F.col("bh") / 2})
    return J.match_points(truth, d.nodes.filter("type = 'splice'"), 12.0).drop("source_id")


@query("""SELECT page, root, members, "rows", "columns" FROM (SELECT page, root, count(*) AS members, sum(r)::BIGINT AS "rows", sum(c)::BIGINT AS "columns" FROM (
         SELECT f.page, f.root, CASE WHEN s.cy - lag(s.cy) OVER (PARTITION BY f.page, f.root ORDER BY s.cy, s.id) <= 6 THEN 0 ELSE 1 END AS r, CASE WHEN s.cx - lag(s.cx) OVER (PARTITION BY f.page, f.root ORDER BY s.cx, s.id) <= 6 THEN 0 ELSE 1 END AS c FROM froot f JOIN sm s ON s.page = f.page AND s.id = f.id) GROUP BY page, root)
       WHERE members >= 3 AND "rows" >= 2 AND "columns" >= 2""",
       sm="SELECT *, bx + bw / 2.0 AS cx, components.by + bh / 2.0 AS cy FROM components WHERE kind IN ('circular_symbol', 'primitive_symbol')",
       fl="SELECT a.page, a.id AS a, b.id AS b FROM sm a JOIN sm b ON a.page = b.page AND pow(greatest(a.bx - (b.bx + b.bw), b.bx - (a.bx + a.bw), 0), 2) + pow(greatest(a.by - (b.by + b.bh), b.by - (a.by + a.bh), 0), 2) <= 2025",
       fr="SELECT page, a, b FROM fl UNION SELECT r.page, r.a, l.b FROM fr r JOIN fl l ON l.page = r.page AND l.a = r.b",
       froot="SELECT page, a AS id, min(b) AS root FROM fr GROUP BY ALL")
def furniture_clusters(spark, sf_dir):
    return J.furniture_clusters(View(spark, sf_dir).components(), members=3, columns=2).drop("source_id")


@query(f"SELECT b.page, b.id FROM components b WHERE kind = 'chassis_ground' AND NOT EXISTS (SELECT 1 FROM lines s WHERE s.page = b.page AND least({_pb2('s.x1', 's.y1', 'b')}, {_pb2('s.x2', 's.y2', 'b')}) <= 64)", **_LINES)
def ground_unreached(spark, sf_dir):
    v = View(spark, sf_dir)
    return J.unreached_grounds(v.components(), v.lines()).select("page", "id")


@query("""SELECT t.page, t.id AS text_region_id, (SELECT count(*) FROM components c WHERE c.page = t.page AND pow(c.bx + c.bw / 2.0 - (t.bx + t.bw / 2.0), 2) + pow(c.by + c.bh / 2.0 - (t.by + t.bh / 2.0), 2) <= 32400) AS components,
       (SELECT count(*) FROM eps e WHERE e.page = t.page AND pow(e.x - (t.bx + t.bw / 2.0), 2) + pow(e.y - (t.by + t.bh / 2.0), 2) <= 32400) AS endpoints FROM text_regions t""")  # fmt: skip
def recognition_context(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    return J.recognition_context(d.views.text_regions(), d.views.components(), d.endpoints).drop("source_id")


@query("SELECT id, kind, CASE confidence WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, confidence FROM components)")
def component_candidates(spark, sf_dir):
    score = {"high": 0.95, "medium": 0.75, "low": 0.4, "unresolved": 0.1}
    c = View(spark, sf_dir).components()
    s = F.element_at(F.create_map(*(F.lit(x) for kv in score.items() for x in kv)), F.col("confidence"))
    return c.select("id", "kind", F.when(s >= 0.90, "high").when(s >= 0.70, "medium").when(s > 0, "low").otherwise("unresolved").alias("confidence"))


@query("SELECT id, kind AS symbol_kind, CASE WHEN kind = 'diagram_furniture' THEN 'unresolved' ELSE 'geometrically_classified' END AS status FROM components")
def symbol_recognition(spark, sf_dir):
    return View(spark, sf_dir).components().select("id", F.col("kind").alias("symbol_kind"), F.when(F.col("kind") == "diagram_furniture", "unresolved").otherwise("geometrically_classified").alias("status"))


@query("SELECT page, id FROM eps e WHERE EXISTS (SELECT 1 FROM components c WHERE c.page = e.page AND c.kind = 'enclosure' AND e.x BETWEEN c.bx AND c.bx + c.bw AND e.y BETWEEN c.by AND c.by + c.bh)")
def endpoints_in_boxes(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    return J.inside_boxes(d.endpoints, d.views.components().filter("kind = 'enclosure'"), "id").select("page", "id")
