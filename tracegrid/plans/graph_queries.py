"""Queries over the drawn graph: conductors, nodes, edges, endpoints, components, nets and wires."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracegrid.functions.ids import fnv1a, stable_id
from tracegrid.functions.shared import page_session
from tracegrid.operators import graph, nets, topology
from tracegrid.plans.adapters import Adapters
from tracegrid.plans.oracle import sql

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None, **ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle, **ctes)
        return f

    return add


class Drawn:
    """The graph of the segment view."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep: bool = True, reuse: bool = False):
        self.views = Adapters(page_session(spark), sf_dir)
        self.segments = topology.normalize_conductors(self.views.segments())
        self.topology = topology.Topology(self.segments, keep, reuse)
        self.nodes, self.edges = self.topology.nodes, self.topology.edges
        self.endpoints = self.views.endpoint_kinds(topology.endpoints(self.nodes))


@query("SELECT page, o, axis, lo, hi FROM n_segments")
def conductor_normalize(spark, sf_dir):
    return topology.normalize_conductors(Adapters(spark, sf_dir).segments()).drop("source_id")


@query("SELECT * FROM hits")
def segment_intersections(spark, sf_dir):
    return topology.segment_intersections(topology.normalize_conductors(Adapters(spark, sf_dir).segments())).drop("source_id")


@query("SELECT page, id, x, y, type, connective, degree FROM nodes")
def topology_nodes(spark, sf_dir):
    return Drawn(spark, sf_dir).nodes.drop("source_id")


@query("SELECT * FROM edges")
def topology_edges(spark, sf_dir):
    return Drawn(spark, sf_dir, keep=False).edges.drop("source_id")


@query("SELECT page, id, degree FROM deg")
def node_degree(spark, sf_dir):
    return topology.node_degree(Drawn(spark, sf_dir, keep=False).edges).drop("source_id")


@query("SELECT page, type, count(*) AS n, count(DISTINCT degree) AS degrees FROM nodes GROUP BY ALL")
def node_type_histogram(spark, sf_dir):
    return Drawn(spark, sf_dir).nodes.groupBy("page", "type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("degree").alias("degrees"))


@query("SELECT page, id, node_id, x, y, kind FROM eps")
def endpoints(spark, sf_dir):
    return Drawn(spark, sf_dir).endpoints.drop("source_id", "confidence")


@query("SELECT * FROM cc")
def page_components(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    return graph.page_components(graph.connective_edges(d.nodes, d.edges), "from_node", "to_node").drop("source_id")


@query("SELECT * FROM cc")
def connected_components(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    return graph.connected_components(graph.connective_edges(d.nodes, d.edges), topology.PAGE, "from_node", "to_node").drop("source_id")


def _facts(spark, sf_dir):
    d = Drawn(spark, sf_dir, reuse=True)
    return d, *nets.component_facts(d.nodes, d.edges, d.endpoints)


@query("""SELECT page, root, n_nodes, n_edges, n_endpoints, n_splices, n_anchors, state, CASE WHEN state = 'decomposed' THEN anchor END AS anchor_endpoint,
       CASE WHEN state = 'decomposed' THEN 'ground' ELSE 'unknown' END AS role, CASE WHEN state = 'decomposed' THEN 'medium' ELSE 'unresolved' END AS confidence FROM facts WHERE state <> 'skipped'""")
def electrical_nets(spark, sf_dir):
    return nets.electrical_nets(_facts(spark, sf_dir)[2]).drop("source_id", "anchor_node")


@query("SELECT state, count(*) AS n FROM facts GROUP BY ALL")
def net_outcomes(spark, sf_dir):
    return _facts(spark, sf_dir)[2].groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT f.page, f.root, f.anchor AS start_endpoint, p.id AS end_endpoint, array_to_string(w.path, ',') AS edges FROM ways w JOIN facts f ON f.page = w.page AND f.root = w.root
       JOIN eps p ON p.page = w.page AND p.node_id = w.node WHERE len(path) > 0""")
def distribution_wires(spark, sf_dir):
    d, members, facts = _facts(spark, sf_dir)
    return nets.distribution_wires(members, facts, d.nodes, d.edges, d.endpoints).withColumn("edges", F.array_join("edges", ",")).drop("source_id")


_PASS1 = "SELECT w.page, w.start AS start_endpoint, p.id AS end_endpoint, w.path FROM walk w JOIN eps p ON p.page = w.page AND p.node_id = w.node WHERE w.start < p.id"


@query(f"SELECT page, start_endpoint, end_endpoint, array_to_string(path, ',') AS edges FROM ({_PASS1})")
def wires_pass1(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    w = graph.wires(d.edges, d.nodes, d.endpoints, passes=(1,))
    return w.select("page", "start_endpoint", "end_endpoint", F.array_join("edges", ",").alias("edges"))


@query("""SELECT DISTINCT w.page, w.node AS node_id FROM walk w JOIN nodes n ON n.page = w.page AND n.id = w.node AND n.type IN ('splice', 'junction')
       WHERE n.degree <> 2 OR NOT EXISTS (SELECT 1 FROM inc i WHERE i.page = w.page AND i.n = w.node AND i.id <> w.last AND i.seg = w.seg)""")
def unresolved_distribution_nodes(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    return graph.walk_stops(d.edges, d.nodes, d.endpoints).filter("reason = 'distribution'").select("page", "node_id").distinct()


@query("""SELECT page, reason, count(*) AS n FROM (
         SELECT w.page, CASE WHEN p.id IS NOT NULL THEN 'terminal' WHEN n.degree = 2 OR n.type IN ('splice', 'junction') THEN 'distribution' WHEN n.degree = 1 THEN 'dead_end' ELSE 'crossing' END AS reason
         FROM (SELECT page, start, arg_max(node, len(path)) AS node FROM walk GROUP BY ALL) w JOIN nodes n ON n.page = w.page AND n.id = w.node LEFT JOIN eps p ON p.page = w.page AND p.node_id = w.node) GROUP BY ALL""")
def walk_stop_reasons(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    return graph.walk_stops(d.edges, d.nodes, d.endpoints).groupBy("page", "reason").agg(F.count(F.lit(1)).alias("n"))


#: Where no fork is open, the second pass is a walk along one segment: from an unclaimed end through nodes of any degree.
_CTE2 = {
    "claimed": f"SELECT page, unnest([start_endpoint, end_endpoint]) AS id FROM ({_PASS1})",
    "free": "SELECT * FROM eps e WHERE NOT EXISTS (SELECT 1 FROM claimed c WHERE c.page = e.page AND c.id = e.id)",
    "walk2": """SELECT i.page, p.id AS start, i.o AS node, i.id AS last, i.seg AS seg, [i.id] AS path FROM free p JOIN inc i ON i.page = p.page AND i.n = p.node_id
        UNION ALL SELECT w.page, w.start, i.o, i.id, i.seg, list_append(w.path, i.id) FROM walk2 w JOIN nodes n ON n.page = w.page AND n.id = w.node AND n.degree >= 2
        JOIN inc i ON i.page = w.page AND i.n = w.node AND i.id <> w.last AND ((n.degree = 2 AND n.type NOT IN ('splice', 'junction')) OR i.seg = w.seg) AND NOT list_contains(w.path, i.id)""",
}


@query("SELECT DISTINCT w.page, least(w.start, p.id) AS start_endpoint, greatest(w.start, p.id) AS end_endpoint, 'resolved' AS status FROM walk2 w JOIN free p ON p.page = w.page AND p.node_id = w.node WHERE w.start <> p.id", **_CTE2)
def wires_pass2(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    return graph.wires(d.edges, d.nodes, d.endpoints, passes=(2,)).select("page", "start_endpoint", "end_endpoint", "status")


@query()
def wire_dedupe(spark, sf_dir):
    d, members, facts = _facts(spark, sf_dir)
    first = graph.wires(d.edges, d.nodes, d.endpoints).select(*topology.PAGE, "start_endpoint", "end_endpoint", "edges", "segments")
    second = nets.distribution_wires(members, facts, d.nodes, d.edges, d.endpoints).drop("root").withColumn("segments", F.array_distinct(F.transform("edges", lambda e: F.split(e, "@")[0])))
    both = nets.merge_wires(first, second)
    return both.select("page", stable_id("wire", F.concat_ws(":", "source_id", "page", "start_endpoint", "end_endpoint")).alias("id"), "producer", "start_endpoint", "end_endpoint", "wire_key")


@query(f"""SELECT page, producer, start_endpoint, end_endpoint, key AS wire_key FROM (SELECT *, concat_ws('|', least(start_endpoint, end_endpoint), greatest(start_endpoint, end_endpoint), array_to_string(list_sort(path), ','), array_to_string(list_sort(list_distinct(list_transform(path, lambda e: split_part(e, '@', 1)))), ',')) AS key FROM (
         SELECT page, 1 AS producer, start_endpoint, end_endpoint, path FROM ({_PASS1})
         UNION ALL SELECT f.page, 2, f.anchor, p.id, w.path FROM ways w JOIN facts f ON f.page = w.page AND f.root = w.root JOIN eps p ON p.page = w.page AND p.node_id = w.node WHERE len(path) > 0))
       QUALIFY row_number() OVER (PARTITION BY page, key ORDER BY producer, start_endpoint) = 1""")  # fmt: skip
def wire_merge(spark, sf_dir):
    """The wires of unambiguous walks and those of nets, of equal ones only the first producer's."""
    d, members, facts = _facts(spark, sf_dir)
    first = graph.wires(d.edges, d.nodes, d.endpoints, passes=(1,)).select(*topology.PAGE, "start_endpoint", "end_endpoint", "edges", "segments")
    second = nets.distribution_wires(members, facts, d.nodes, d.edges, d.endpoints).drop("root").withColumn("segments", F.array_distinct(F.transform("edges", lambda e: F.split(e, "@")[0])))
    return nets.merge_wires(first, second).select("page", "producer", "start_endpoint", "end_endpoint", "wire_key")


_GAPS = """SELECT a.page, a.id AS a, b.id AS b, pow(b.x - a.x, 2) + pow(b.y - a.y, 2) AS gap2 FROM t a JOIN t b ON a.page = b.page AND a.id < b.id
       WHERE pow(b.x - a.x, 2) + pow(b.y - a.y, 2) BETWEEN 2.25 AND 324 AND (
         (abs(b.y - a.y) <= 1.5 AND abs(b.x - a.x) > 1.5 AND a.dx * (b.x - a.x) > 0 AND b.dx * (a.x - b.x) > 0 AND abs(a.dy) <= 1.5 AND abs(b.dy) <= 1.5) OR
         (abs(b.x - a.x) <= 1.5 AND abs(b.y - a.y) > 1.5 AND a.dy * (b.y - a.y) > 0 AND b.dy * (a.y - b.y) > 0 AND abs(a.dx) <= 1.5 AND abs(b.dx) <= 1.5))"""
_FACING = "SELECT n.page, n.id, n.x, n.y, n.x - m.x AS dx, n.y - m.y AS dy FROM nodes n JOIN inc i ON i.page = n.page AND i.n = n.id JOIN nodes m ON m.page = n.page AND m.id = i.o WHERE n.type = 'conductor_end' AND n.degree = 1"


@query(_GAPS, t=_FACING)
def gap_candidates(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    return topology.gap_candidates(d.nodes, d.edges).withColumn("gap2", F.col("gap2").cast("double")).drop("source_id")


#: One end after the other, in order of ids, with the ends that are taken so far.
_TURNS = {
    "t": _FACING,
    "turn": f"SELECT page, a, row_number() OVER (PARTITION BY page ORDER BY a) AS k, bs FROM (SELECT page, a, list(b ORDER BY gap2, b) AS bs FROM ({_GAPS}) GROUP BY page, a)",
    "taken": """SELECT DISTINCT page, 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::VARCHAR AS a, NULL::VARCHAR AS b FROM turn
        UNION ALL SELECT page, k, CASE WHEN b IS NULL THEN used ELSE list_concat(used, [a, b]) END, a, b FROM (
          SELECT s.page, q.k, s.used, q.a, CASE WHEN NOT list_contains(s.used, q.a) THEN list_filter(q.bs, lambda x: NOT list_contains(s.used, x))[1] END AS b FROM taken s JOIN turn q ON q.page = s.page AND q.k = s.k + 1)""",
}


@query("SELECT page, a, b FROM taken WHERE b IS NOT NULL", **_TURNS)
def gap_bridges(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    return topology.bridge_gaps(topology.gap_candidates(d.nodes, d.edges)).drop("source_id")


#: Offsets of drawn points from the lattice, on both sides of the tolerances .75, 1.5 and 4.
_JITTER = (0.0, 0.5, -0.75, 1.0, -1.5, 1.75, -3.75, 4.0, 4.25)
_JX, _JY = ", ".join(map(str, _JITTER)), "l_partkey % 9 + 1"


@query("""SELECT p.page, p.seq, p.x, p.y, s.at.x AS nx, s.at.y AS ny FROM snapped s JOIN jittered p ON p.page = s.page AND p.k = s.k WHERE s.k > 0""",
       jittered=f"""SELECT *, row_number() OVER (PARTITION BY page ORDER BY seq, x, y) AS k FROM (SELECT l_orderkey // 75 AS page, l_orderkey * 8 + l_linenumber AS seq,
         10 * ((l_partkey * 7 + l_orderkey) % 12) + ([{_JX}])[l_suppkey % 9 + 1]::DOUBLE AS x, 10 * ((l_suppkey * 13 + l_orderkey * 3) % 9) + ([{_JX}])[{_JY}]::DOUBLE AS y FROM lineitem)""",
       snapped="""SELECT DISTINCT page, 0::BIGINT AS k, []::STRUCT(x DOUBLE, y DOUBLE)[] AS leaders, NULL::STRUCT(x DOUBLE, y DOUBLE) AS at FROM jittered
         UNION ALL SELECT page, k, CASE WHEN near IS NULL THEN list_append(leaders, own) ELSE leaders END, coalesce(near, own) FROM (
           SELECT s.page, p.k, s.leaders, struct_pack(x := p.x, y := p.y) AS own, list_filter(s.leaders, lambda l: (l.x - p.x) * (l.x - p.x) + (l.y - p.y) * (l.y - p.y) <= 16)[1] AS near FROM snapped s JOIN jittered p ON p.page = s.page AND p.k = s.k + 1)""")  # fmt: skip
def snapped_points(spark, sf_dir):
    """Points off the lattice, by less and by more than each tolerance, go to the first point near them."""
    return topology.snap_points(Adapters(spark, sf_dir).jittered_points(_JITTER)).drop("source_id")


_SPLICES = {
    "sp": "SELECT page, id, x, y FROM nodes WHERE type = 'splice'",
    "sl": "SELECT a.page, a.id AS a, b.id AS b FROM sp a JOIN sp b ON a.page = b.page AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 144",
    "sr": "SELECT page, a, b FROM sl UNION SELECT r.page, r.a, l.b FROM sr r JOIN sl l ON l.page = r.page AND l.a = r.b",
    "sroot": "SELECT page, a AS id, min(b) AS root FROM sr GROUP BY ALL",
}


@query("SELECT r.page, r.root, count(*) AS members, avg(x) AS cx, avg(y) AS cy FROM sroot r JOIN sp ON sp.page = r.page AND sp.id = r.id GROUP BY ALL", **_SPLICES)
def splice_clusters(spark, sf_dir):
    sp = Drawn(spark, sf_dir).nodes.filter("type = 'splice'").select(*topology.PAGE, "id", F.col("x").alias("bx"), F.col("y").alias("by"), F.lit(0).alias("bw"), F.lit(0).alias("bh"))
    tied = graph.single_linkage(sp, "id", 12.0)
    return tied.join(sp.withColumnRenamed("id", "node"), [*topology.PAGE, "node"]).groupBy("page", "root").agg(F.count(F.lit(1)).alias("members"), F.avg("bx").alias("cx"), F.avg("by").alias("cy"))


@query("SELECT e.page, e.id FROM eps e WHERE NOT EXISTS (SELECT 1 FROM claimed c WHERE c.page = e.page AND c.id = e.id)", **_CTE2)
def residual_endpoints(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    claimed = graph.wires(d.edges, d.nodes, d.endpoints, passes=(1,)).select(*topology.PAGE, F.explode(F.array("start_endpoint", "end_endpoint")).alias("id"))
    return d.endpoints.join(claimed, [*topology.PAGE, "id"], "left_anti").select("page", "id")


@query("""SELECT f.page, count(DISTINCT f.root) AS components, count(DISTINCT CASE WHEN state <> 'skipped' THEN f.root END) AS nets, count(DISTINCT CASE WHEN state = 'decomposed' THEN f.root END) AS ground_nets, any_value(n.nodes) AS nodes, any_value(n.splices) AS splices
       FROM facts f JOIN (SELECT page, count(*) AS nodes, count(*) FILTER (type = 'splice') AS splices FROM nodes GROUP BY ALL) n ON n.page = f.page GROUP BY f.page""")
def page_summary(spark, sf_dir):
    """Flagship: what was found on each page."""
    d, _, facts = _facts(spark, sf_dir)
    counted = d.nodes.groupBy("page").agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.col("type") == "splice", 1)).alias("splices"))
    per = facts.groupBy("page").agg(F.count(F.lit(1)).alias("components"), F.count(F.when(F.col("state") != "skipped", 1)).alias("nets"), F.count(F.when(F.col("state") == "decomposed", 1)).alias("ground_nets"))
    return per.join(counted, "page").select("page", "components", "nets", "ground_nets", "nodes", "splices")


_HALF = "lpad(lower(to_base(({}) ::BIGINT, 16)), 8, '0')"


@query(f"SELECT c_custkey, 'wire-' || {_HALF.format('h // 4294967296')} || {_HALF.format('h % 4294967296')} AS id FROM f",
       f=f"""SELECT c_custkey, list_reduce(list_prepend({fnv1a(b'wire' + bytes([255]))}::HUGEINT, list_transform(range(1, octet_length(encode(c_name)) + 1), lambda i: ('0x' || substr(hex(encode(c_name)), 2 * i - 1, 2))::HUGEINT)),
       lambda s, b: (xor(s, b) * 1099511628211) % 18446744073709551616) AS h FROM customer""")  # fmt: skip
def stable_ids(spark, sf_dir):
    return Adapters(spark, sf_dir).table("customer").select("c_custkey", stable_id("wire", F.col("c_name")).alias("id"))
