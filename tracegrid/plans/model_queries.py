"""Queries that validate, measure and export the model, and those of the raster tier and the file formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrid.functions.shared import cut, cut_pages
from tracegrid.operators import checks as C
from tracegrid.operators import graph, nets, topology
from tracegrid.operators import raster as R
from tracegrid.operators.topology import PAGE
from tracegrid.plans.adapters import SOURCE, Adapters
from tracegrid.plans.graph_queries import _CTE2, _PASS1, Drawn
from tracegrid.plans.oracle import sql
from tracegrid.sources import formats as IO

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None, **ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle, **ctes)
        return f

    return add


class Model(Drawn):
    """A drawn graph with its unambiguous wires."""

    def __init__(self, spark, sf_dir):
        super().__init__(spark, sf_dir, reuse=True)
        self.wires = cut_pages(graph.wires(self.edges, self.nodes, self.endpoints, passes=(1,)), "wires")

    def spoiled(self):
        """Wires with a fault that depends on the page, to have something to find."""
        w = self.wires.withColumn("id", F.concat_ws("~", "start_endpoint", "end_endpoint"))
        k = F.col("page") % 6
        end = F.when(k == 0, F.col("start_endpoint")).when(k == 1, "ep-none").otherwise(F.col("end_endpoint"))
        edges = F.when(k == 2, F.array().cast("array<string>")).when(k == 3, F.array_append("edges", F.col("edges")[0])).when(k == 4, F.array_append("edges", F.lit("none"))).otherwise(F.col("edges"))
        return w.select(*PAGE, "id", "start_endpoint", end.alias("end_endpoint"), edges.alias("edges"))


_V = {
    **_CTE2,
    "w": f"""SELECT page, start_endpoint || '~' || end_endpoint AS id, start_endpoint, CASE page % 6 WHEN 0 THEN start_endpoint WHEN 1 THEN 'ep-none' ELSE end_endpoint END AS end_endpoint,
        CASE page % 6 WHEN 2 THEN [] WHEN 3 THEN list_append(path, path[1]) WHEN 4 THEN list_append(path, 'none') ELSE path END AS edges FROM ({_PASS1})""",
    "wu": "SELECT page, id, start_endpoint, end_endpoint, unnest(edges) AS edge FROM w",
    "wd": "SELECT page, id, node, count(*) AS d FROM (SELECT u.page, u.id, unnest([e.from_node, e.to_node]) AS node FROM (SELECT DISTINCT page, id, edge FROM wu) u JOIN edges e ON e.page = u.page AND e.id = u.edge) GROUP BY ALL",
    "wsh": "SELECT page, id, count(*) AS nodes, sum(d) AS twice, max(d) AS most FROM wd GROUP BY ALL",
    "wend": "SELECT q.page, q.id, p.node_id, p.kind FROM (SELECT page, id, unnest([start_endpoint, end_endpoint]) AS ep FROM w) q JOIN eps p ON p.page = q.page AND p.id = q.ep",
    "iss": """SELECT page, 'error' AS severity, 'WIRE-DUPLICATE-ID' AS code, id AS object_id FROM w GROUP BY page, id HAVING count(*) > 1
        UNION ALL SELECT page, 'error', 'WIRE-START-ENDPOINT-MISSING', id FROM w WHERE (page, start_endpoint) NOT IN (SELECT (page, id) FROM eps)
        UNION ALL SELECT page, 'error', 'WIRE-END-ENDPOINT-MISSING', id FROM w WHERE (page, end_endpoint) NOT IN (SELECT (page, id) FROM eps)
        UNION ALL SELECT page, 'error', 'WIRE-SELF-ENDPOINT', id FROM w WHERE start_endpoint = end_endpoint
        UNION ALL SELECT page, 'error', 'WIRE-NO-TOPOLOGY', id FROM w WHERE len(edges) = 0
        UNION ALL SELECT DISTINCT page, 'error', 'WIRE-DUPLICATE-EDGE', id FROM (SELECT page, id, edge FROM wu GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT DISTINCT page, 'error', 'WIRE-EDGE-MISSING', id FROM wu WHERE (page, edge) NOT IN (SELECT (page, id) FROM edges)
        UNION ALL SELECT page, 'error', 'WIRE-NONPATH-DEGREE', id FROM wsh WHERE most > 2
        UNION ALL SELECT page, 'error', 'WIRE-DISCONNECTED-TOPOLOGY', id FROM wsh WHERE most <= 2 AND twice / 2 <> nodes - 1
        UNION ALL SELECT DISTINCT e.page, 'error', 'WIRE-ENDPOINT-DEGREE-MISMATCH', e.id FROM wend e LEFT JOIN wd ON wd.page = e.page AND wd.id = e.id AND wd.node = e.node_id WHERE coalesce(d, 0) <> 1
        UNION ALL SELECT page, 'warning', 'WIRE-GEOMETRIC-ENDPOINTS', id FROM wend GROUP BY page, id HAVING bool_and(kind = 'geometric')""",
}


def _wire_issues(spark, sf_dir):
    m = Model(spark, sf_dir)
    w = m.spoiled()
    return w, C.validate_wires(w, m.endpoints, m.edges)


@query("SELECT * FROM iss", **_V)
def wire_validation(spark, sf_dir):
    return _wire_issues(spark, sf_dir)[1]


@query("SELECT severity, code, count(*) AS n FROM iss GROUP BY ALL", **_V)
def warning_histogram(spark, sf_dir):
    return _wire_issues(spark, sf_dir)[1].groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT w.page, count(*) AS wires, count(*) FILTER ((w.page, w.id) NOT IN (SELECT (page, object_id) FROM iss WHERE severity = 'error')) AS valid_wires, coalesce(any_value(n.errors), 0)::BIGINT AS errors, coalesce(any_value(n.warnings), 0)::BIGINT AS warnings
       FROM w LEFT JOIN (SELECT page, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM iss GROUP BY 1) n ON n.page = w.page GROUP BY w.page""", **_V)  # fmt: skip
def validation_report(spark, sf_dir):
    w, found = _wire_issues(spark, sf_dir)
    return C.validation_report(w, cut(found, "issues"))


_N = {
    "o": "SELECT o_orderkey // 75 AS page, o_custkey::VARCHAR AS id, list('ep-' || o_orderkey) AS endpoint_ids, list('e-' || o_orderkey) AS edges, CASE WHEN o_custkey % 3 = 0 THEN 'ep-' || min(o_orderkey) WHEN o_custkey % 3 = 1 THEN 'ep-x' END AS anchor, CASE WHEN o_custkey % 2 = 0 THEN 'ground' ELSE 'unknown' END AS role FROM orders GROUP BY 1, 2, o_custkey",
    "oe": "SELECT DISTINCT l_orderkey // 75 AS page, 'ep-' || l_orderkey AS id, 'e-' || l_orderkey AS e FROM lineitem",
}


@query("""SELECT page, 'error' AS severity, 'NET-ENDPOINT-MISSING' AS code, id AS object_id FROM (SELECT DISTINCT page, id FROM (SELECT page, id, unnest(endpoint_ids) AS ep FROM o) WHERE (page, ep) NOT IN (SELECT (page, id) FROM oe))
       UNION ALL SELECT page, 'error', 'NET-EDGE-MISSING', id FROM (SELECT DISTINCT page, id FROM (SELECT page, id, unnest(edges) AS ep FROM o) WHERE (page, ep) NOT IN (SELECT (page, e) FROM oe))
       UNION ALL SELECT page, 'error', 'NET-ANCHOR-NOT-MEMBER', id FROM o WHERE anchor IS NOT NULL AND NOT list_contains(endpoint_ids, anchor)
       UNION ALL SELECT page, 'warning', 'NET-ROLE-UNRESOLVED', id FROM o WHERE role = 'unknown'""", **_N)  # fmt: skip
def net_validation(spark, sf_dir):
    v = Adapters(spark, sf_dir)
    key, c = F.col("o_orderkey"), F.col("o_custkey")
    raw = v.table("orders").groupBy(F.expr("o_orderkey div 75").alias("page"), "o_custkey").agg(F.collect_list(F.concat(F.lit("ep-"), key)).alias("endpoint_ids"), F.collect_list(F.concat(F.lit("e-"), key)).alias("edges"), F.min("o_orderkey").alias("lo"))
    n = raw.select("page", c.cast("string").alias("id"), "endpoint_ids", "edges", F.when(c % 3 == 0, F.concat(F.lit("ep-"), F.col("lo"))).when(c % 3 == 1, "ep-x").alias("anchor"), F.when(c % 2 == 0, "ground").otherwise("unknown").alias("role"))
    known = v.table("lineitem").select(F.expr("l_orderkey div 75").alias("page"), "l_orderkey").distinct()
    return C.validate_nets(n, known.select("page", F.concat(F.lit("ep-"), "l_orderkey").alias("id")), known.select("page", F.concat(F.lit("e-"), "l_orderkey").alias("id")))


_FK = [("recognition", "text_region_id", "text_regions", "id"), ("terminal_evidence", "endpoint_id", "order_endpoints", "id"), ("terminal_evidence", "component_id", "short_components", "id"), ("text_regions", "id", "recognition", "text_region_id")]


@query(" UNION ALL ".join(f"SELECT '{a}.{k}' AS reference, count(*) FILTER ({k} IN (SELECT {pk} FROM {b})) AS valid, count(*) FILTER ({k} NOT IN (SELECT {pk} FROM {b})) AS invalid FROM {a} WHERE {k} IS NOT NULL" for a, k, b, pk in _FK),
       order_endpoints="SELECT 'ep-' || o_orderkey AS id FROM orders", short_components="SELECT 'component-' || p_partkey AS id FROM part WHERE p_partkey < 2")
def diagram_validation(spark, sf_dir):
    v = Adapters(spark, sf_dir)
    tables = {"recognition": v.recognition(), "terminal_evidence": v.terminal_evidence(), "text_regions": v.text_regions(), "order_endpoints": v.table("orders").select(F.concat(F.lit("ep-"), "o_orderkey").alias("id")), "short_components": v.table("part").filter("p_partkey < 2").select(F.concat(F.lit("component-"), "p_partkey").alias("id"))}
    return C.issues([C.reference_integrity(f"{a}.{k}", tables[a], k, tables[b], pk) for a, k, b, pk in _FK])


_COV = {
    **_CTE2,
    "pw": _PASS1,
    "wseg": "SELECT DISTINCT p.page, p.start_endpoint, p.end_endpoint, e.seg FROM (SELECT page, start_endpoint, end_endpoint, unnest(path) AS edge FROM pw) p JOIN edges e ON e.page = p.page AND e.id = p.edge",
    "cond": """SELECT page, id, edge_refs, wire_refs, CASE WHEN edge_refs = 0 AND wire_refs = 0 THEN 'unreferenced' WHEN wire_refs = 0 THEN 'topology_only' WHEN edge_refs = 0 THEN 'wire_only' WHEN wire_refs > 1 THEN 'shared' ELSE 'normal' END AS ownership
        FROM (SELECT s.page, s.seg AS id, coalesce(e.n, 0) AS edge_refs, coalesce(w.n, 0) AS wire_refs FROM seg s LEFT JOIN (SELECT page, seg, count(*) AS n FROM edges GROUP BY ALL) e ON e.page = s.page AND e.seg = s.seg LEFT JOIN (SELECT page, seg, count(*) AS n FROM wseg GROUP BY ALL) w ON w.page = s.page AND w.seg = s.seg)""",
    "epc": "SELECT e.page, e.id, count(c.id) AS wire_refs, CASE count(c.id) WHEN 0 THEN 'zero_wire' WHEN 1 THEN 'single_wire' ELSE 'multiple_wire' END AS coverage FROM eps e LEFT JOIN claimed c ON c.page = e.page AND c.id = e.id GROUP BY e.page, e.id",
    "edc": "SELECT page, id, FALSE AS dangling, (page, id) IN (SELECT (page, edge) FROM (SELECT page, unnest(path) AS edge FROM pw)) AS owned FROM edges",
    "inn": "SELECT c.page, p.id FROM facts f JOIN cc c ON c.page = f.page AND c.root = f.root JOIN eps p ON p.page = c.page AND p.node_id = c.node WHERE f.state <> 'skipped'",
    "nm": "SELECT e.page, e.id, count(i.id) AS nets, CASE count(i.id) WHEN 0 THEN 'unowned' WHEN 1 THEN 'owned' ELSE 'multi_owned' END AS membership FROM eps e LEFT JOIN inn i ON i.page = e.page AND i.id = e.id GROUP BY e.page, e.id",
}


def _conductors(m: Model):
    return C.conductor_ownership(m.topology.points.select("page", F.col("seg").alias("id")).distinct(), m.edges, m.wires)


def _membership(m: Model):
    members, facts = nets.component_facts(m.nodes, m.edges, m.endpoints)
    held = members.join(facts.filter("state <> 'skipped'").select(*PAGE, "root"), [*PAGE, "root"])
    inside = held.join(m.endpoints.select(*PAGE, F.col("node_id").alias("node"), "id"), [*PAGE, "node"]).select("page", "id")
    return C.net_membership(m.endpoints, inside)


@query("SELECT * FROM cond", **_COV)
def coverage_conductors(spark, sf_dir):
    return _conductors(Model(spark, sf_dir))


@query("SELECT * FROM epc", **_COV)
def coverage_endpoints(spark, sf_dir):
    m = Model(spark, sf_dir)
    return C.endpoint_coverage(m.endpoints, m.wires)


@query("SELECT * FROM edc", **_COV)
def coverage_edges(spark, sf_dir):
    m = Model(spark, sf_dir)
    return C.edge_coverage(m.edges, m.nodes, m.wires)


#: Sound drawings have no odd nodes; these degrees, and no endpoints on some pages, make all three kinds.
_SPOILT = "CASE WHEN page % 5 = 1 AND type = 'splice' THEN degree - 2 WHEN page % 11 = 2 AND type = 'continuation' THEN 0 ELSE degree END"


@query("SELECT page, 'node' AS category, 'TOPOLOGY-NODE-ZERO-DEGREE' AS code, id AS object_id, 'warning' AS severity FROM odd WHERE degree = 0 UNION ALL SELECT page, 'node', 'TOPOLOGY-NODE-LOW-DEGREE-SPLICE', id, 'warning' FROM odd WHERE type = 'splice' AND degree < 3 UNION ALL SELECT page, 'node', 'TOPOLOGY-NODE-CONDUCTOR-END-WITHOUT-ENDPOINT', id, 'warning' FROM odd WHERE type = 'conductor_end' AND (page % 7 = 3 OR degree <> 1)",
       odd=f"SELECT page, id, type, {_SPOILT} AS degree FROM nodes")
def coverage_nodes(spark, sf_dir):
    m = Drawn(spark, sf_dir)
    return C.node_findings(m.nodes.withColumn("degree", F.expr(_SPOILT)), m.endpoints.filter("page % 7 <> 3"))


@query("SELECT * FROM nm", **_COV)
def coverage_nets(spark, sf_dir):
    return _membership(Model(spark, sf_dir))


@query("""SELECT page, category, code, object_id, severity FROM (
         SELECT page, 'conductor' AS category, CASE ownership WHEN 'unreferenced' THEN 'CONDUCTOR-UNREFERENCED' WHEN 'topology_only' THEN 'CONDUCTOR-TOPOLOGY-ONLY' WHEN 'wire_only' THEN 'CONDUCTOR-WIRE-ONLY' WHEN 'shared' THEN 'CONDUCTOR-SHARED' END AS code, id AS object_id, CASE WHEN ownership IN ('unreferenced', 'wire_only') THEN 'warning' ELSE 'notice' END AS severity FROM cond
         UNION ALL SELECT page, 'endpoint', CASE coverage WHEN 'zero_wire' THEN 'ENDPOINT-ZERO-WIRE' WHEN 'multiple_wire' THEN 'ENDPOINT-MULTIPLE-WIRE' END, id, 'notice' FROM epc
         UNION ALL SELECT page, 'edge', CASE WHEN NOT owned THEN 'TOPOLOGY-EDGE-UNOWNED' END, id, 'notice' FROM edc
         UNION ALL SELECT page, 'node', 'TOPOLOGY-NODE-ZERO-DEGREE', id, 'warning' FROM nodes WHERE degree = 0
         UNION ALL SELECT page, 'node', 'TOPOLOGY-NODE-CONDUCTOR-END-WITHOUT-ENDPOINT', id, 'warning' FROM nodes WHERE type = 'conductor_end' AND degree <> 1
         UNION ALL SELECT page, 'net', CASE membership WHEN 'unowned' THEN 'NET-ENDPOINT-UNOWNED' WHEN 'multi_owned' THEN 'NET-ENDPOINT-MULTI-OWNED' END, id, CASE membership WHEN 'unowned' THEN 'notice' ELSE 'warning' END FROM nm) WHERE code IS NOT NULL""", **_COV)  # fmt: skip
def coverage_findings(spark, sf_dir):
    m = Model(spark, sf_dir)
    return C.coverage_findings(_conductors(m), C.endpoint_coverage(m.endpoints, m.wires), C.edge_coverage(m.edges, m.nodes, m.wires), C.node_findings(m.nodes, m.endpoints), _membership(m))


@query("""SELECT c.kind, count(*) AS components, count(*) FILTER (c.id IN (SELECT 'component-' || l_partkey || '-0' FROM lineitem WHERE l_linenumber = 1)) AS with_terminals FROM components c GROUP BY 1""")
def coverage_components(spark, sf_dir):
    v = Adapters(spark, sf_dir)
    t = v.table("lineitem").filter("l_linenumber = 1").select(F.concat(F.lit("component-"), "l_partkey", F.lit("-0")).alias("id")).distinct().withColumn("t", F.lit(1))
    return v.components().join(t, "id", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("components"), C.count_if(F.col("t").isNotNull()).alias("with_terminals"))


@query("SELECT kind, count(*) AS connectors, count(*) FILTER (confidence = 'unresolved') AS unresolved, count(*) FILTER (kind = 'diagram_furniture') AS furniture_derived FROM components WHERE kind IN ('primitive_symbol', 'diagram_furniture') GROUP BY 1")
def coverage_connectors(spark, sf_dir):
    c = Adapters(spark, sf_dir).components().filter("kind IN ('primitive_symbol', 'diagram_furniture')")
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("connectors"), C.count_if(F.col("confidence") == "unresolved").alias("unresolved"), C.count_if(F.col("kind") == "diagram_furniture").alias("furniture_derived"))


@query("""SELECT n.page, nodes, crossings, splices, conductor_ends, coalesce(e.edges, 0)::BIGINT AS edges, coalesce(p.endpoints, 0)::BIGINT AS endpoints, coalesce(p.grounds, 0)::BIGINT AS grounds, coalesce(w.wires, 0)::BIGINT AS wires
       FROM (SELECT page, count(*) AS nodes, count(*) FILTER (type = 'crossing') AS crossings, count(*) FILTER (type = 'splice') AS splices, count(*) FILTER (type = 'conductor_end') AS conductor_ends FROM nodes GROUP BY 1) n
       LEFT JOIN (SELECT page, count(*) AS edges FROM edges GROUP BY 1) e ON e.page = n.page LEFT JOIN (SELECT page, count(*) AS endpoints, count(*) FILTER (kind = 'ground') AS grounds FROM eps GROUP BY 1) p ON p.page = n.page LEFT JOIN (SELECT page, count(*) AS wires FROM pw GROUP BY 1) w ON w.page = n.page""", **_COV)  # fmt: skip
def extraction_audit(spark, sf_dir):
    m = Model(spark, sf_dir)
    n = m.nodes.groupBy("page").agg(F.count(F.lit(1)).alias("nodes"), *(C.count_if(F.col("type") == t).alias(f"{t}s" if t != "conductor_end" else "conductor_ends") for t in ("crossing", "splice", "conductor_end")))
    parts = [m.edges.groupBy("page").agg(F.count(F.lit(1)).alias("edges")), m.endpoints.groupBy("page").agg(F.count(F.lit(1)).alias("endpoints"), C.count_if(F.col("kind") == "ground").alias("grounds")), m.wires.groupBy("page").agg(F.count(F.lit(1)).alias("wires"))]
    for p in parts:
        n = n.join(p, "page", "left")
    return n.select("page", "nodes", "crossings", "splices", "conductor_ends", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("edges", "endpoints", "grounds", "wires")))


@query("SELECT page, count(*) AS n, sha256(string_agg(id, ',' ORDER BY id)) AS digest FROM nodes GROUP BY 1")
def model_fingerprint(spark, sf_dir):
    return C.fingerprint(Drawn(spark, sf_dir).nodes, ["page"], "id")


@query("SELECT page, o, axis, lo, hi, 'left' AS side FROM (SELECT * FROM a_segments EXCEPT ALL SELECT * FROM n_segments) UNION ALL SELECT *, 'right' FROM (SELECT * FROM n_segments EXCEPT ALL SELECT * FROM a_segments)")
def model_diff(spark, sf_dir):
    from tracegrid.operators.topology import normalize_conductors

    cols = ["page", "o", "axis", "lo", "hi"]
    raw = Adapters(spark, sf_dir).segments()
    return C.model_diff(raw.select(*cols), normalize_conductors(raw).select(*cols))


@query("""SELECT page, count(*) AS edges, count(*) FILTER (seg = '') AS inferred FROM (SELECT page, id, seg FROM edges UNION ALL SELECT page, id || '>', '' FROM edges WHERE x1 % 50 = 0) GROUP BY 1""")
def edges_union(spark, sf_dir):
    e = Drawn(spark, sf_dir, keep=False).edges
    more = e.filter("x1 % 50 = 0").select("page", F.concat("id", F.lit(">")).alias("id"), F.lit("").alias("seg"))
    return e.select("page", "id", "seg").unionByName(more).groupBy("page").agg(F.count(F.lit(1)).alias("edges"), C.count_if(F.col("seg") == "").alias("inferred"))


@query("""SELECT b.net, b.role AS baseline_role, a.role AS assisted_role, b.role IS DISTINCT FROM a.role AS changed FROM (SELECT page || ':' || root AS net, CASE WHEN state = 'decomposed' THEN 'ground' ELSE 'unknown' END AS role FROM facts WHERE state <> 'skipped') b
       LEFT JOIN (SELECT page || ':' || root AS net, CASE WHEN n_anchors > 0 THEN 'ground' ELSE 'unknown' END AS role FROM facts WHERE state <> 'skipped' AND page % 5 <> 0) a USING (net)""")  # fmt: skip
def semantic_resolution_report(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    _, facts = nets.component_facts(d.nodes, d.edges, d.endpoints)
    f = facts.filter("state <> 'skipped'").withColumn("net", F.concat_ws(":", "page", "root"))
    a = f.filter("page % 5 <> 0").select("net", F.when(F.col("n_anchors") > 0, "ground").otherwise("unknown").alias("assisted_role"))
    return f.select("net", F.col("role").alias("baseline_role")).join(a, "net", "left").select("net", "baseline_role", "assisted_role", (~F.col("baseline_role").eqNullSafe(F.col("assisted_role"))).alias("changed"))


#: Wires and nodes by number, so that no text column runs through the joins and unions.
@query("SELECT n.page, n.id, coalesce(k.wires, 0)::BIGINT AS wires FROM nodes n LEFT JOIN (SELECT page, x, y, count(*) AS wires FROM ends GROUP BY ALL) k ON k.page = n.page AND k.x = n.x AND k.y = n.y WHERE n.type = 'splice'", **{
    **_COV,
    "numbered": "SELECT row_number() OVER () AS w, page, path FROM pw",
    "used": "SELECT w, page, unnest(path) || '' AS edge FROM numbered",
    "drawn": "SELECT used.w, used.page, e.x1, e.y1, e.x2, e.y2 FROM used JOIN edges e ON e.page = used.page AND e.id = used.edge",
    "ends": "SELECT w, page, x1 AS x, y1 AS y FROM drawn UNION SELECT w, page, x2, y2 FROM drawn",
})
def diagram_splices(spark, sf_dir):
    m = Model(spark, sf_dir)
    at = m.wires.select(*PAGE, "start_endpoint", "end_endpoint", F.explode("edges").alias("e")).join(m.edges.select(*PAGE, F.col("id").alias("e"), F.explode(F.array("from_node", "to_node")).alias("id")), [*PAGE, "e"])
    n = at.groupBy(*PAGE, "id").agg(F.countDistinct("start_endpoint", "end_endpoint").alias("wires"))
    return m.nodes.filter("type = 'splice'").select(*PAGE, "id").join(n, [*PAGE, "id"], "left").select("page", "id", F.coalesce("wires", F.lit(0)).cast("long").alias("wires"))


@query("SELECT w.page, w.start_endpoint, w.end_endpoint, a.kind AS start_kind, b.kind AS end_kind, len(w.path) AS n_edges, string_agg(DISTINCT s.seg, ',' ORDER BY s.seg) AS segments FROM pw w JOIN eps a ON a.page = w.page AND a.id = w.start_endpoint JOIN eps b ON b.page = w.page AND b.id = w.end_endpoint JOIN wseg s ON s.page = w.page AND s.start_endpoint = w.start_endpoint AND s.end_endpoint = w.end_endpoint GROUP BY ALL", **_COV)
def diagram_wires(spark, sf_dir):
    m = Model(spark, sf_dir)
    side = lambda c, k: m.endpoints.select(*PAGE, F.col("id").alias(c), F.col("kind").alias(k))
    w = m.wires.join(side("start_endpoint", "start_kind"), [*PAGE, "start_endpoint"]).join(side("end_endpoint", "end_kind"), [*PAGE, "end_endpoint"])
    return w.select("page", "start_endpoint", "end_endpoint", "start_kind", "end_kind", F.size("edges").cast("long").alias("n_edges"), F.array_join(F.array_sort(F.array_distinct("segments")), ",").alias("segments"))


@query("SELECT t.page, t.id, min_by(r.raw_text, r.raw_text) AS label, coalesce(min(r.confidence), 'unresolved') AS confidence FROM text_regions t LEFT JOIN gated r ON r.text_region_id = t.id GROUP BY t.page, t.id")
def diagram_labels(spark, sf_dir):
    from tracegrid.operators.semantics import provider_gate

    v = Adapters(spark, sf_dir)
    seen = provider_gate(v.recognition(), v.text_regions()).groupBy(F.col("text_region_id").alias("id")).agg(F.min("raw_text").alias("label"), F.min("confidence").alias("confidence"))
    return v.text_regions().select("page", "id").join(seen, "id", "left").select("page", "id", "label", F.coalesce("confidence", F.lit("unresolved")).alias("confidence"))


@query("SELECT c.page, c.id, c.kind, c.label, (SELECT count(*) FROM text_regions t WHERE t.page = c.page) AS page_texts FROM components c")
def diagram_components(spark, sf_dir):
    v = Adapters(spark, sf_dir)
    n = v.text_regions().groupBy("page").agg(F.count(F.lit(1)).alias("page_texts"))
    return v.components().join(n, "page", "left").select("page", "id", "kind", "label", F.coalesce("page_texts", F.lit(0)).cast("long").alias("page_texts"))


@query("SELECT 'nodes' AS layer, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'endpoints', count(*) FROM eps UNION ALL SELECT 'components', count(*) FROM components UNION ALL SELECT 'text_regions', count(*) FROM text_regions")
def review_manifest(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    layers = {"nodes": d.nodes, "edges": d.edges, "endpoints": d.endpoints, "components": d.views.components(), "text_regions": d.views.text_regions()}
    return C.issues([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("layer"), "n") for k, df in layers.items()])


@query("""SELECT page, id, '<rect id="' || id || '" data-kind="' || kind || '" data-label="' || replace(label, '&', '&amp;') || '" x="' || bx || '" y="' || c.by || '" width="' || bw || '" height="' || bh || '"' || CASE WHEN kind = 'diagram_furniture' THEN ' stroke-dasharray="4 2"' ELSE '' END || '/>' AS svg FROM components c""")
def svg_fragments(spark, sf_dir):
    return IO.svg_fragments(Adapters(spark, sf_dir).components())


@query("SELECT page, 'SVG-DUPLICATE-ID' AS code, id AS detail FROM components WHERE page % 3 = 0 UNION ALL SELECT DISTINCT page, 'SVG-EMBEDDED-IMAGE', '' FROM components WHERE page % 4 = 0")
def svg_validate(spark, sf_dir):
    f = IO.svg_fragments(Adapters(spark, sf_dir).components())
    twice = f.unionByName(f.filter("page % 3 = 0"))
    odd = F.when(F.col("page") % 4 == 0, F.replace("svg", F.lit("</svg>"), F.lit("<image/></svg>"))).otherwise(F.col("svg"))
    return IO.svg_issues(IO.svg_pages(twice).select("page", odd.alias("svg")))


@query("SELECT text_region_id, raw_text, confidence FROM recognition WHERE raw_text <> '' AND confidence <> 'unresolved'")
def recognition_json_scan(spark, sf_dir):
    r = Adapters(spark, sf_dir).recognition()
    docs = r.groupBy(F.pmod(F.xxhash64("text_region_id"), F.lit(64)).alias("k")).agg(F.to_json(F.struct(F.collect_list(F.struct("text_region_id", "raw_text", "confidence")).alias("observations"))).alias("value"))
    return IO.recognition_json(docs.select("value"))


@query("SELECT text_region_id, trim(raw_text) AS raw_text, confidence FROM recognition WHERE trim(raw_text) <> '' AND confidence <> 'unresolved'")
def recognition_tsv_scan(spark, sf_dir):
    r = Adapters(spark, sf_dir).recognition()
    lines = r.select(F.concat_ws("\t", "text_region_id", "confidence", "raw_text").alias("value")).unionByName(spark.range(3).select(F.concat(F.lit("# comment "), "id").alias("value")))
    return IO.recognition_tsv(lines)


_BOXES = "SELECT 'p' || c_nationkey AS path, c_nationkey::BIGINT AS page, CASE WHEN c_custkey % 2 = 0 THEN 'include' ELSE 'exclude' END AS role, c_custkey % 900 - 50 AS x, c_custkey * 7 % 600 AS y, c_custkey % 5 * 100 AS w, 50::BIGINT AS h FROM customer"


@query(f"SELECT *, CASE WHEN w <= 0 THEN 'zero_area' WHEN x + w <= 0 OR y + h <= 0 OR x >= 800 OR y >= 600 THEN 'no_intersection' END AS issue FROM ({_BOXES})")
def scope_regions(spark, sf_dir):
    c = Adapters(spark, sf_dir).table("customer")
    k = F.col("c_custkey")
    rows = c.select(F.concat(F.lit("p"), "c_nationkey").alias("path"), F.col("c_nationkey").cast("long").alias("page"), F.when(k % 2 == 0, "include").otherwise("exclude").alias("role"), F.struct((k % 900 - 50).alias("x"), (k * 7 % 600).alias("y"), (k % 5 * 100).alias("width"), F.lit(50).cast("long").alias("height")).alias("b"))
    boxes = lambda r: F.collect_list(F.when(F.col("role") == r, F.col("b")))
    docs = rows.groupBy("path", "page").agg(boxes("include").alias("include_regions"), boxes("exclude").alias("exclusion_regions")).select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.struct("path", "page").alias("source"), "include_regions", "exclusion_regions")).alias("value"))
    return IO.scope_regions(docs, 800, 600)


@query(f"SELECT issue, count(*) AS n FROM (SELECT CASE WHEN w <= 0 THEN 'zero_area' WHEN x + w <= 0 OR y + h <= 0 OR x >= 800 OR y >= 600 THEN 'no_intersection' ELSE 'fine' END AS issue FROM ({_BOXES})) GROUP BY 1")
def scope_validation(spark, sf_dir):
    return scope_regions(spark, sf_dir).groupBy(F.coalesce("issue", F.lit("fine")).alias("issue")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM ink")
def ink_cells(spark, sf_dir):
    return Adapters(spark, sf_dir).ink().drop("source_id")


@query("SELECT l_orderkey, l_linenumber, (l_partkey * 7 % 256)::BIGINT AS value FROM lineitem WHERE l_partkey * 7 % 256 <= 180")
def ink_pixels(spark, sf_dir):
    px = Adapters(spark, sf_dir).table("lineitem").select("l_orderkey", "l_linenumber", F.expr("l_partkey * 7 % 256").alias("value"))
    return R.threshold(px)


_RLE = {
    "rl": "SELECT page, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS g FROM ink) GROUP BY page, y, g HAVING max(x) - min(x) + 1 >= 3",
    "rlt": "SELECT a.page, a.y || ':' || a.x0 AS a, b.y || ':' || b.x0 AS b FROM rl a JOIN rl b ON a.page = b.page AND abs(a.y - b.y) <= 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1",
    "rlc": "SELECT page, a, b FROM rlt UNION SELECT r.page, r.a, t.b FROM rlc r JOIN rlt t ON t.page = r.page AND t.a = r.b",
    "rlr": "SELECT page, a AS id, min(b) AS root FROM rlc GROUP BY ALL",
}


@query("SELECT r.page, c.root, min(x0) AS x0, min(y) AS y0, max(x1) AS x1, max(y) AS y1, sum(x1 - x0 + 1)::BIGINT AS area FROM rl r JOIN rlr c ON c.page = r.page AND c.id = r.y || ':' || r.x0 GROUP BY ALL", **_RLE)
def rle_open_segments(spark, sf_dir):
    return R.open_segments(cut(Adapters(spark, sf_dir).ink(), "ink"), 3).drop("source_id")


@query("SELECT * FROM ink i WHERE NOT EXISTS (SELECT 1 FROM components c WHERE c.page = i.page AND i.x * 10 BETWEEN c.bx AND c.bx + c.bw AND i.y * 10 BETWEEN c.by AND c.by + c.bh)")
def mask_exclude(spark, sf_dir):
    v = Adapters(spark, sf_dir)
    return R.exclude(v.ink(), v.components()).select("page", "y", "x")


@query("""SELECT * FROM ink i WHERE (page % 2 = 1 OR EXISTS (SELECT 1 FROM text_regions c WHERE c.page = i.page AND i.x * 10 BETWEEN c.bx AND c.bx + c.bw AND i.y * 10 BETWEEN c.by AND c.by + c.bh)) AND NOT EXISTS (SELECT 1 FROM components c WHERE c.page = i.page AND c.kind = 'enclosure' AND i.x * 10 BETWEEN c.bx AND c.bx + c.bw AND i.y * 10 BETWEEN c.by AND c.by + c.bh)""")
def scope_mask(spark, sf_dir):
    v = Adapters(spark, sf_dir)
    return R.scope_mask(v.ink(), v.text_regions().filter("page % 2 = 0"), v.components().filter("kind = 'enclosure'")).select("page", "y", "x")


@query("SELECT e.page, e.id, (SELECT count(*) FROM ink i WHERE i.page = e.page AND i.x BETWEEN e.x // 10 - 1 AND e.x // 10 + 1 AND i.y BETWEEN e.y // 10 - 1 AND e.y // 10 + 1) AS dark FROM eps e")
def endpoint_ink_evidence(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    return R.ink_near(d.endpoints, d.views.ink(), 1).drop("source_id")


_AIMED = {
    "aim": "SELECT e.page, e.id, e.x // 10 AS x, e.y // 10 AS y, CASE WHEN d.from_node = e.node_id THEN e.x - d.x2 ELSE e.x - d.x1 END AS dx, CASE WHEN d.from_node = e.node_id THEN e.y - d.y2 ELSE e.y - d.y1 END AS dy FROM eps e JOIN edges d ON d.page = e.page AND e.node_id IN (d.from_node, d.to_node)",
    "win": """SELECT page, id, which, greatest(x0, 0) AS x0, greatest(y0, 0) AS y0, least(x1, 79) AS x1, least(y1, 59) AS y1 FROM (
        SELECT page, id, 'local' AS which, x - 10 AS x0, y - 10 AS y0, x + 10 AS x1, y + 10 AS y1 FROM aim
        UNION ALL SELECT page, id, 'forward', CASE WHEN dx > 0 THEN x + 4 WHEN dx < 0 THEN x - 14 ELSE x - 4 END, CASE WHEN dy > 0 THEN y + 4 WHEN dy < 0 THEN y - 14 ELSE y - 4 END, CASE WHEN dx > 0 THEN x + 14 WHEN dx < 0 THEN x - 4 ELSE x + 4 END, CASE WHEN dy > 0 THEN y + 14 WHEN dy < 0 THEN y - 4 ELSE y + 4 END FROM aim
        UNION ALL SELECT page, id, 'transverse', CASE WHEN dx <> 0 THEN x - 7 ELSE x - 3 END, CASE WHEN dx <> 0 THEN y - 3 ELSE y - 7 END, CASE WHEN dx <> 0 THEN x + 7 ELSE x + 3 END, CASE WHEN dx <> 0 THEN y + 3 ELSE y + 7 END FROM aim)""",
}


@query("SELECT w.page, w.id, which, count(i.x) AS dark, greatest(x1 - x0 + 1, 0) * greatest(y1 - y0 + 1, 0) AS cells FROM win w LEFT JOIN ink i ON i.page = w.page AND i.x BETWEEN x0 AND x1 AND i.y BETWEEN y0 AND y1 GROUP BY w.page, w.id, which, x0, y0, x1, y1", **_AIMED)
def endpoint_directed_ink(spark, sf_dir):
    """Each end lies on one edge, which is level or upright."""
    d = Drawn(spark, sf_dir)
    ends = d.endpoints.select(*PAGE, "id", "node_id", F.col("x").alias("ex"), F.col("y").alias("ey"))
    other = lambda a, b, x, y: d.edges.select(*PAGE, F.col(a).alias("node_id"), F.col(x).alias("ox"), F.col(y).alias("oy"))
    both = other("from_node", "to_node", "x2", "y2").unionByName(other("to_node", "from_node", "x1", "y1"))
    aimed = ends.join(both, [*PAGE, "node_id"]).select(*PAGE, "id", F.expr("ex div 10").alias("x"), F.expr("ey div 10").alias("y"), (F.col("ex") - F.col("ox")).alias("dx"), (F.col("ey") - F.col("oy")).alias("dy"))
    return R.directed_ink(aimed, d.views.ink(), 80, 60).drop("source_id")


@query("""SELECT page, seg, CASE WHEN n < 3 THEN 'below_minimum_continuous_length' WHEN share < 0.08 THEN 'insufficient_supporting_ink' END AS reason, CASE WHEN n < 3 THEN n ELSE share END AS measurement FROM (
          SELECT c.page, seg, n, CASE WHEN c.x0 > c.x1 OR c.y0 > c.y1 THEN 0 ELSE count(i.x) / ((c.x1 - c.x0 + 1) * (c.y1 - c.y0 + 1)) END AS share FROM cor c LEFT JOIN (SELECT * FROM ink WHERE (x * 7 + y * 3 + page) % 5 = 0) i ON i.page = c.page AND i.x BETWEEN c.x0 AND c.x1 AND i.y BETWEEN c.y0 AND c.y1 GROUP BY c.page, seg, n, c.x0, c.y0, c.x1, c.y1)""", cor="""SELECT page, seg, ((hi - lo) // 10)::DOUBLE AS n, CASE WHEN o = 'H' THEN lo // 10 ELSE greatest(axis // 10 - 2, 0) END AS x0, CASE WHEN o = 'H' THEN greatest(axis // 10 - 2, 0) ELSE lo // 10 END AS y0,
          CASE WHEN o = 'H' THEN least(hi // 10, 79) ELSE least(axis // 10 + 2, 79) END AS x1, CASE WHEN o = 'H' THEN least(axis // 10 + 2, 59) ELSE least(hi // 10, 59) END AS y1 FROM seg""")  # fmt: skip
def conductor_ink_filter(spark, sf_dir):
    """A cell of the page stands for a pixel, and three cells for the least length."""
    v = Adapters(spark, sf_dir)
    flat, lo, hi, axis = F.col("o") == "H", F.expr("lo div 10"), F.expr("hi div 10"), F.expr("axis div 10")
    lines = topology.normalize_conductors(v.segments()).select(*PAGE, topology.segment_id().alias("seg"), F.when(flat, lo).otherwise(axis).alias("x0"), F.when(flat, axis).otherwise(lo).alias("y0"), F.when(flat, hi).otherwise(axis).alias("x1"), F.when(flat, axis).otherwise(hi).alias("y1"))
    return R.supported_lines(lines, v.ink().filter("(x * 7 + y * 3 + page) % 5 = 0"), 80, 60, min_length=3.0).select("page", "seg", "reason", "measurement")


_BARS = {"bars": "SELECT DISTINCT o_orderkey // 75 AS page, o_custkey % 4 AS col, o_orderkey % 75 * 3 AS y, 5 + o_custkey * 11 % 30 AS width FROM orders"}


@query("""SELECT page, col, y FROM (SELECT *, lead(y) OVER w AS y2, lead(y, 2) OVER w AS y3, lead(width) OVER w AS w2, lead(width, 2) OVER w AS w3 FROM bars WINDOW w AS (PARTITION BY page, col ORDER BY y, width))
       WHERE y3 IS NOT NULL AND w2 <= width * 0.85::DOUBLE AND w3 <= w2 * 0.85::DOUBLE AND y2 - y BETWEEN 2 AND 14 AND y3 - y2 BETWEEN 2 AND 14 AND greatest(y2 - y, y3 - y2) <= 2 * least(y2 - y, y3 - y2)""", **_BARS)  # fmt: skip
def ground_bar_sequences(spark, sf_dir):
    bars = Adapters(spark, sf_dir).table("orders").selectExpr(f"'{SOURCE}' AS source_id", "o_orderkey div 75 AS page", "o_custkey % 4 AS col", "o_orderkey % 75 * 3 AS y", "5 + o_custkey * 11 % 30 AS width").distinct()
    return R.ground_bar_sequences(bars).drop("source_id")


_ASPECT = "CASE WHEN bw / bh BETWEEN 2 AND 30 THEN 0.85 WHEN bw / bh BETWEEN 1.25 AND 40 THEN 0.7 ELSE 0.55 END::DOUBLE"


@query(f"SELECT page, id, {_ASPECT} AS confidence FROM glyphs")
def text_region_score(spark, sf_dir):
    return Adapters(spark, sf_dir).glyphs().select("page", "id", R.text_region_confidence(F.col("bw"), F.col("bh")).alias("confidence"))


_GROUPS = {
    "gl": "SELECT page, id, bx, g0.by AS top, bw, bh, row_number() OVER (PARTITION BY page ORDER BY g0.by, bx, bw, bh, id) AS k FROM glyphs g0",
    "gf": """SELECT page, 0::BIGINT AS k, []::STRUCT(l BIGINT, t BIGINT, r BIGINT, b BIGINT, m BIGINT)[] AS gs FROM (SELECT DISTINCT page FROM glyphs)
        UNION ALL SELECT page, k, CASE WHEN i IS NULL THEN list_append(gs, {'l': bx, 't': top, 'r': bx + bw, 'b': top + bh, 'm': 1::BIGINT})
          ELSE list_concat(gs[:i - 1], [{'l': least(gs[i].l, bx), 't': least(gs[i].t, top), 'r': greatest(gs[i].r, bx + bw), 'b': greatest(gs[i].b, top + bh), 'm': gs[i].m + 1}], gs[i + 1:]) END
        FROM (SELECT f.page, g.k, f.gs, bx, top, bw, bh, nullif(list_position(list_transform(f.gs, lambda o: abs(o.t + (o.b - o.t) // 2 - (g.top + g.bh // 2)) <= 6 AND CASE WHEN g.bx >= o.r THEN g.bx - o.r ELSE o.l - (g.bx + g.bw) END <= 12
          AND greatest(o.b, g.top + g.bh) - least(o.t, g.top) <= 40), true), 0) AS i FROM gf f JOIN gl g ON g.page = f.page AND g.k = f.k + 1)""",
    "go": "SELECT page, pos, g.l AS bx, g.t AS by, g.r - g.l AS bw, g.b - g.t AS bh, g.m AS members FROM (SELECT page, unnest(gs) AS g, generate_subscripts(gs, 1) AS pos FROM gf WHERE (page, k) IN (SELECT (page, max(k)) FROM gl GROUP BY page))",
}


@query(f"SELECT page, row_number() OVER (PARTITION BY page ORDER BY pos) - 1 AS n, bx, go.by, bw, bh, members, {_ASPECT} AS confidence, {_ASPECT} >= 0.7 AS excluded FROM go WHERE bw >= 8 AND bh >= 3", **_GROUPS)
def text_region_groups(spark, sf_dir):
    return R.text_groups(Adapters(spark, sf_dir).glyphs()).drop("source_id")


@query("SELECT page, root AS id, x0 AS bx, y0 AS by, x1 - x0 + 1 AS bw, y1 - y0 + 1 AS bh FROM (SELECT r.page, c.root, min(x0) AS x0, min(y) AS y0, max(x1) AS x1, max(y) AS y1, sum(x1 - x0 + 1) AS area FROM rl r JOIN rlr c ON c.page = r.page AND c.id = r.y || ':' || r.x0 GROUP BY ALL) WHERE area BETWEEN 2 AND 500 AND x1 - x0 < 40 AND y1 - y0 < 40", **{**_RLE, "rl": _RLE["rl"].replace("FROM ink)", "FROM ink WHERE (x * 7 + y * 3 + page) % 5 < 2)").replace(">= 3", ">= 1")})
def text_components(spark, sf_dir):
    ink = cut(Adapters(spark, sf_dir).ink().filter("(x * 7 + y * 3 + page) % 5 < 2"), "ink")
    return R.small_components(ink).drop("source_id")


_HEAVY = "greatest(least(a.bx + a.bw, b.bx + b.bw) - greatest(a.bx, b.bx), 0) * greatest(least(a.top + a.bh, b.top + b.bh) - greatest(a.top, b.top), 0) > 0.8 * least(a.bw * a.bh, b.bw * b.bh)"


@query("SELECT page, unnest(kept) AS id FROM sup WHERE (page, k) IN (SELECT (page, max(k)) FROM ord GROUP BY page)", **{
    "dn": "SELECT page, id, (bx + 5) // 10 AS bx, (g.by + 5) // 5 AS top, bw, bh FROM components g",
    "ord": "SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) AS k FROM dn",
    "hv": f"SELECT a.page, a.id AS early, b.id AS late FROM dn a JOIN dn b ON a.page = b.page AND a.id < b.id AND {_HEAVY}",
    "hl": "SELECT o.page, o.k, any_value(o.id) AS id, list(early) FILTER (early IS NOT NULL) AS early FROM ord o LEFT JOIN hv ON hv.page = o.page AND hv.late = o.id GROUP BY ALL",
    "sup": "SELECT page, 0::BIGINT AS k, []::VARCHAR[] AS kept FROM (SELECT DISTINCT page FROM dn) UNION ALL SELECT s.page, h.k, CASE WHEN list_has_any(kept, coalesce(h.early, [])) THEN kept ELSE list_append(kept, h.id) END FROM sup s JOIN hl h ON h.page = s.page AND h.k = s.k + 1",
})
def overlap_suppression(spark, sf_dir):
    return R.suppress_overlaps(Adapters(spark, sf_dir).components().withColumns({"bx": F.expr("(bx + 5) div 10"), "by": F.expr("(by + 5) div 5")})).select("page", "id")


@query("SELECT region, count(*) AS notches FROM (SELECT l_orderkey AS region, CASE WHEN l_linenumber % 2 = 0 THEN 'left' ELSE 'right' END AS side, l_quantity / 10 AS depth FROM lineitem) WHERE depth >= 2 GROUP BY 1 HAVING count(*) >= 2 AND bool_or(side = 'left') AND bool_or(side = 'right')")
def connector_notch_gate(spark, sf_dir):
    n = Adapters(spark, sf_dir).table("lineitem").select(F.col("l_orderkey").alias("region"), F.when(F.col("l_linenumber") % 2 == 0, "left").otherwise("right").alias("side"), (F.col("l_quantity") / 10).alias("depth"))
    return R.notch_gate(n)


_MEASURES = "p_partkey * 13 % 100 / 100.0 AS circularity, 1 + p_size % 50 / 100.0 AS aspect, p_size AS radius, p_partkey * 29 % 100 / 100.0 AS support, p_partkey * 41 % 100 / 100.0 AS weakest_side, p_partkey * 3 % 100 / 100.0 AS density"


@query(f"SELECT p_partkey FROM (SELECT p_partkey, {_MEASURES} FROM part) WHERE circularity >= 0.65 AND aspect <= 1.35 AND radius BETWEEN 3 AND 60 AND support >= 0.65 AND weakest_side < 0.5 AND density <= 0.30")
def circle_gate(spark, sf_dir):
    return R.circle_gate(Adapters(spark, sf_dir).table("part").selectExpr("p_partkey", *_MEASURES.split(", "))).select("p_partkey")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN fill >= 0.70 AND aspect <= 1.3 AND circ >= 0.75 THEN 'circle' WHEN aspect >= 3 AND thin <= 3 THEN 'line' WHEN fill >= 0.75 AND aspect <= 2.5 THEN 'rectangle' WHEN aspect >= 2 THEN 'terminal_lead' ELSE 'unknown' END AS kind FROM (
         SELECT *, w * h * ((l_partkey % 10 + 1) / 10) / (w * h) AS fill, greatest(w, h) / least(w, h) AS aspect, least(w, h) AS thin, l_suppkey % 10 / 10 AS circ FROM (SELECT *, (1 + l_partkey % 12)::DOUBLE AS w, (1 + l_orderkey % 9)::DOUBLE AS h FROM lineitem))""")  # fmt: skip
def blob_classify(spark, sf_dir):
    b = Adapters(spark, sf_dir).table("lineitem").selectExpr("l_orderkey", "l_linenumber", "CAST(1 + l_partkey % 12 AS DOUBLE) AS w", "CAST(1 + l_orderkey % 9 AS DOUBLE) AS h", "(l_partkey % 10 + 1) / 10 AS share", "l_suppkey % 10 / 10 AS circ")
    return b.select("l_orderkey", "l_linenumber", R.blob_kind(F.col("w"), F.col("h"), F.col("w") * F.col("h") * F.col("share"), F.col("circ")).alias("kind"))


@query("""SELECT page, id, '{"id":"' || id || '","x":' || x || ',"y":' || y || ',"type":"' || type || '","connective":' || connective || '}' AS json FROM nodes""")
def sorted_export(spark, sf_dir):
    """The nodes of all pages as JSON lines in order of page and id, the form of a model file."""
    n = Drawn(spark, sf_dir).nodes
    return n.orderBy("page", "id").select("page", "id", F.to_json(F.struct("id", "x", "y", "type", "connective")).alias("json"))


@query("SELECT 'components' AS name, count(*) AS n FROM components UNION ALL SELECT 'recognised', count(*) FROM gated UNION ALL SELECT 'segments', count(*) FROM n_segments")
def project_manifest(spark, sf_dir):
    from tracegrid.operators.semantics import provider_gate
    from tracegrid.operators.topology import normalize_conductors

    v = Adapters(spark, sf_dir)
    tables = {"components": v.components(), "recognised": provider_gate(v.recognition(), v.text_regions()), "segments": normalize_conductors(v.segments())}
    return C.issues([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, df in tables.items()])
