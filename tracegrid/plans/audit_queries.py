"""The whole audit of the lattice model, with faults by page so that its validation has something to count."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrid.functions.shared import cut
from tracegrid.operators import audit as A
from tracegrid.operators import integrity as I
from tracegrid.operators import nets
from tracegrid.operators.topology import PAGE
from tracegrid.plans.adapters import pick
from tracegrid.plans.integrity_queries import _FAULTY, Faulty
from tracegrid.plans.oracle import sql

QUERIES, ORACLE_SQL = {}, {}

_STATUS = ["resolved", "conflicted", "unresolved"]
_KINDS = ["line", "circle", "rectangle", "terminal_lead", "unknown"]
_SQL_STATUS = "(['resolved', 'conflicted', 'unresolved'])[{} % 3 + 1]"


def _sql_values(table: str, column: str, whole: str | None, by: dict[str, str]) -> str:
    n = "sum(n)" if table == "findings" else "count(*)"
    found = f"SELECT page, CASE {column} {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in by.items())} END AS measure, {n} AS n FROM a_{table} GROUP BY ALL"
    return found + (f" UNION ALL SELECT page, '{whole}', count(*) FROM a_{table} GROUP BY page" if whole else "")


_AUDIT = _FAULTY | {
    "a_nodes": "SELECT * FROM nodes", "a_endpoints": "SELECT * FROM eps", "a_components": "SELECT * FROM components", "a_conductors": "SELECT * FROM cd", "a_edges": "SELECT * FROM edges", "a_findings": "SELECT * FROM fnd",
    "a_nets": "SELECT page, CASE WHEN state = 'decomposed' THEN 'ground' ELSE 'unknown' END AS role FROM facts WHERE state <> 'skipped'",
    "a_wires": "SELECT page, heavy, CASE WHEN len(edges) = 0 THEN 'unresolved' ELSE 'high' END AS confidence, (page, id) NOT IN (SELECT (page, object_id) FROM fnd WHERE severity = 'error') AS valid, start_endpoint, end_endpoint, edges FROM w",
    "cn": "SELECT *, regexp_extract(id, '-([0-9]+)-', 1)::BIGINT AS k, id[-1]::BIGINT AS j FROM components",
    "a_primitives": "SELECT page, (['line', 'circle', 'rectangle', 'terminal_lead', 'unknown'])[(k + j) % 5 + 1] AS kind FROM cn WHERE j > 0",
    "a_geometries": "SELECT page, j AS primitives FROM cn WHERE kind <> 'diagram_furniture'",
    "ws1": "SELECT page, len(edges) AS e, length(start_endpoint) AS a, length(end_endpoint) AS b FROM a_wires",
    "a_wire_semantics": f"SELECT page, {_SQL_STATUS.format('e')} AS color_status, {_SQL_STATUS.format('(e + a)')} AS function_status, {_SQL_STATUS.format('(a + b)')} AS net_status, {_SQL_STATUS.format('a')} AS start_component, {_SQL_STATUS.format('b')} AS end_component, {_SQL_STATUS.format('(a + 1)')} AS start_connector, {_SQL_STATUS.format('(e + b)')} AS end_connector FROM ws1",
    "a_families": f"SELECT page, {_SQL_STATUS.format('k')} AS status, ([{', '.join(repr(f) for f in (*A.FAMILIES, 'unknown'))}])[(k + j) % 12 + 1] AS family FROM cn",
    "a_electrical_components": "SELECT page, CASE WHEN kind IN ('diagram_furniture', 'chassis_ground', 'primitive_symbol') THEN 'rejected' WHEN confidence = 'unresolved' THEN 'unresolved' ELSE 'resolved' END AS status, CASE WHEN kind IN ('diagram_furniture', 'chassis_ground', 'primitive_symbol') THEN kind END AS rejection FROM components",
    "a_boundaries": f"SELECT page, {_SQL_STATUS.format('((x + y) // 10)')} AS status FROM eps",
    "cnt": " UNION ALL ".join([
        *(f"SELECT page, '{m}' AS measure, count(*) AS n FROM a_{t} GROUP BY page" for t, m in A.COUNTED.items() if t in ("conductors", "edges", "wires")), *(_sql_values(*v) for v in A.BY_VALUE),
        "SELECT page, 'heavy_cable_wires', count(*) FROM a_wires WHERE heavy GROUP BY page", "SELECT page, 'unresolved_wires', count(*) FROM a_wires WHERE confidence = 'unresolved' GROUP BY page", "SELECT page, 'valid_wires', count(*) FROM a_wires WHERE valid GROUP BY page",
        "SELECT page, CASE WHEN primitives > 0 THEN 'components_with_symbol_geometry' ELSE 'components_without_symbol_geometry' END, count(*) FROM a_geometries GROUP BY ALL",
        "SELECT page, 'component_association_' || CASE WHEN 'resolved' IN (start_component, end_component) THEN 'resolved' WHEN 'conflicted' IN (start_component, end_component) THEN 'conflicted' ELSE 'unresolved' END, count(*) FROM a_wire_semantics GROUP BY ALL",
        "SELECT page, 'connector_association_resolved', count(*) FROM a_wire_semantics WHERE 'resolved' IN (start_connector, end_connector) GROUP BY page",
        "SELECT page, 'wires_fully_unresolved', count(*) FROM a_wire_semantics WHERE 'resolved' NOT IN (start_connector, end_connector, start_component, end_component, color_status, function_status, net_status) GROUP BY page",
        "SELECT page, family || '_resolved', count(*) FROM a_families WHERE status = 'resolved' AND family <> 'unknown' GROUP BY ALL",
    ]),
    "adt": f"SELECT p.page, m.measure, coalesce(sum(c.n), 0)::BIGINT AS n FROM (SELECT DISTINCT page FROM cd) p CROSS JOIN (SELECT unnest([{', '.join(repr(m) for m in A.MEASURES)}]) AS measure) m LEFT JOIN cnt c ON c.page = p.page AND c.measure = m.measure GROUP BY ALL",
}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql(oracle, **_AUDIT)
        return f

    return add


def _audited(spark, sf_dir):
    """(counts, warnings) of the lattice model; its connectors have no pins and its gaps no bridges."""
    m = Faulty(spark, sf_dir)
    found = cut(I.validate_wire_model(m.faulty, m.endpoints, m.some_nodes, m.more_edges, m.conductors).withColumn("source_id", F.lit("lattice")), "findings")
    bad = found.filter("severity = 'error'").select(*PAGE, F.col("object_id").alias("id")).distinct().withColumn("bad", F.lit(True))
    wires = m.faulty.join(bad, [*PAGE, "id"], "left").withColumns({"valid": F.col("bad").isNull(), "confidence": F.when(F.size("edges") == 0, "unresolved").otherwise("high")})
    c = m.views.components().withColumns({"k": F.split("id", "-")[1].cast("long"), "j": F.split("id", "-")[2].cast("long")})
    status = lambda n: pick(_STATUS, n % 3)
    e, a, b = F.size("edges"), F.length("start_endpoint"), F.length("end_endpoint")
    rejected = F.col("kind").isin("diagram_furniture", "chassis_ground", "primitive_symbol")
    _, facts = nets.component_facts(m.nodes, m.edges, m.endpoints)
    tables = {
        "conductors": m.conductors, "nodes": m.nodes, "edges": m.edges, "endpoints": m.endpoints, "components": c, "nets": facts.filter("state <> 'skipped'"), "findings": found, "wires": wires,
        "primitives": c.filter("j > 0").select(*PAGE, pick(_KINDS, (F.col("k") + F.col("j")) % 5).alias("kind")), "geometries": c.filter("kind <> 'diagram_furniture'").select(*PAGE, F.col("j").alias("primitives")),
        "wire_semantics": wires.select(*PAGE, status(e).alias("color_status"), status(e + a).alias("function_status"), status(a + b).alias("net_status"), status(a).alias("start_component"), status(b).alias("end_component"), status(a + 1).alias("start_connector"), status(e + b).alias("end_connector")),
        "families": c.select(*PAGE, status(F.col("k")).alias("status"), pick([*A.FAMILIES, "unknown"], (F.col("k") + F.col("j")) % 12).alias("family")),
        "electrical_components": c.select(*PAGE, F.when(rejected, "rejected").when(F.col("confidence") == "unresolved", "unresolved").otherwise("resolved").alias("status"), F.when(rejected, F.col("kind")).alias("rejection")),
        "boundaries": m.endpoints.select(*PAGE, status(F.expr("(x + y) div 10")).alias("status")),
    }
    warnings = found.filter("severity = 'warning'").groupBy(*PAGE, "code").agg(F.sum("n").alias("n"))
    return A.audit_counts(tables), warnings


@query("SELECT * FROM adt")
def audit_counts(spark, sf_dir):
    """All measures of the audit on every page, zeros too."""
    return _audited(spark, sf_dir)[0].drop("source_id")


@query("""SELECT a.page, '{"page":' || a.page || ',"counts":{' || string_agg('"' || measure || '":' || n, ',' ORDER BY measure) || '},"validation_warnings":[' || coalesce(any_value(w.j), '') || ']}' AS json FROM adt a
       LEFT JOIN (SELECT page, string_agg('{"code":"' || code || '","n":' || n || '}', ',' ORDER BY code) AS j FROM (SELECT page, code, sum(n)::BIGINT AS n FROM fnd WHERE severity = 'warning' GROUP BY ALL) GROUP BY page) w ON w.page = a.page GROUP BY a.page""")  # fmt: skip
def audit_json(spark, sf_dir):
    """A page's audit as one JSON document."""
    return A.audit_json(*_audited(spark, sf_dir)).drop("source_id")
