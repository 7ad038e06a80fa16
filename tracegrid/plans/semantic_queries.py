"""Queries over recognised texts, evidence and its resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrid.functions import text
from tracegrid.functions.evidence import resolve_or_conflict
from tracegrid.functions.shared import cut
from tracegrid.operators import graph, nets
from tracegrid.operators import semantics as S
from tracegrid.plans.adapters import Adapters, pick
from tracegrid.plans.graph_queries import _CTE2, _PASS1, Drawn
from tracegrid.plans.oracle import sql

QUERIES, ORACLE_SQL = {}, {}
_RANK = "CASE {} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_NAME = "CASE {} WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'unresolved' END"
_UP = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def query(oracle: str | None = None, **ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle, **ctes)
        return f

    return add


def _gated(v: Adapters):
    return S.provider_gate(v.recognition(), v.text_regions())


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + _UP.format("left(text, 40)") + r", '[ \t\n\x0B\f\r\-_]+', ' ', 'g'), '^ +', ''), '[.,:; ]+$', ''), ' +$', '') AS normalized FROM documents")
def text_normalize(spark, sf_dir):
    return Adapters(spark, sf_dir).table("documents").select("doc_id", text.normalize(F.substring("text", 1, 40)).alias("normalized"))


@query("SELECT text_region_id, raw_text, confidence, provider FROM gated")
def provider_gate(spark, sf_dir):
    return _gated(Adapters(spark, sf_dir)).select("text_region_id", "raw_text", "confidence", "provider")


@query("SELECT text_region_id, n AS normalized_text, kind, confidence FROM kinds")
def text_classify(spark, sf_dir):
    return S.interpret_texts(_gated(Adapters(spark, sf_dir))).select("text_region_id", "normalized_text", "kind", "confidence")


@query(r"""SELECT text_region_id, CASE WHEN l IN ('GROUND', 'GND') THEN 'ground' WHEN l IN ('B+', 'BATTERY+', 'BATTERY POSITIVE', 'POWER FEED', 'POWER SOURCE') THEN 'power_feed' WHEN l = 'SHARED FUNCTION FEED' THEN 'shared_function_feed' END AS role
       FROM (SELECT text_region_id, regexp_replace(regexp_replace(regexp_replace(""" + _UP.format("raw_text") + r""", '[ \t\n\x0B\f\r\-_]+', ' ', 'g'), '^ +', ''), ' +$', '') AS l FROM recognition)""")  # fmt: skip
def label_role(spark, sf_dir):
    return Adapters(spark, sf_dir).recognition().select("text_region_id", text.label_role(F.col("raw_text")).alias("role"))


@query("SELECT key, canonical_id, canonical_name FROM alias_index WHERE owners = 1 AND key <> ''")
def registry_alias_index(spark, sf_dir):
    return S.registry_index(Adapters(spark, sf_dir).registry())


@query(r"""SELECT i.component_id, i.identity, a.canonical_id, a.canonical_name, CASE WHEN a.canonical_id IS NULL THEN 'not_found' ELSE 'resolved' END AS status FROM (
         SELECT 'component-' || s_suppkey AS component_id, CASE WHEN s_suppkey % 10 = 0 THEN 'SHARED' WHEN s_suppkey % 3 = 0 THEN replace(n_name, '_', '-') WHEN s_suppkey % 3 = 1 THEN lower(n_name) ELSE 'NOWHERE' END AS identity
         FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey) i
       LEFT JOIN alias_index a ON a.owners = 1 AND a.key = regexp_replace(""" + _UP.format("i.identity") + r""", '[ \-_]+', '', 'g')""")  # fmt: skip
def registry_lookup(spark, sf_dir):
    v = Adapters(spark, sf_dir)
    return S.canonicalize(v.identities(), S.registry_index(v.registry()))


def _associations(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    return d, S.associate(d.views.text_regions(), d.views.components(), d.endpoints)


_AC = "CASE WHEN d2 <= 144 AND tc >= 0.85 THEN 'high' WHEN d2 <= 144 OR (d2 <= 900 AND tc >= 0.70) THEN 'medium' ELSE 'low' END"
_OBJECTS = {
    "nearest": f"SELECT *, {_AC} AS ac FROM near QUALIFY d2 = min(d2) OVER (PARTITION BY text_region_id)",
    "unique_near": "SELECT text_region_id, min(page) AS page, min(target_kind) AS target_kind, min(target_id) AS target_id, min(d2) AS d2, min(ac) AS ac FROM nearest GROUP BY 1 HAVING count(DISTINCT target_kind || ':' || target_id) = 1",
    "cand": f"SELECT k.text_region_id, k.n AS normalized_text, k.kind, u.target_kind, u.target_id, u.d2, {_NAME.format('least(' + _RANK.format('k.confidence') + ', ' + _RANK.format('u.ac') + ')')} AS confidence FROM kinds k JOIN unique_near u USING (text_region_id) WHERE k.kind <> 'unknown'",
    "topc": f"SELECT *, {_RANK.format('confidence')} AS r FROM cand QUALIFY r = max(r) OVER (PARTITION BY target_kind, target_id, kind)",
    "objects": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_kind, target_id, kind ORDER BY d2, text_region_id) AS i FROM topc WHERE (target_kind, target_id, kind) IN (SELECT (target_kind, target_id, kind) FROM topc GROUP BY target_kind, target_id, kind HAVING count(DISTINCT normalized_text) = 1)) WHERE i = 1",
    "labels": "SELECT target_id AS endpoint_id, min_by(normalized_text, text_region_id) FILTER (kind = 'wire_color') AS wire_color, min_by(normalized_text, text_region_id) FILTER (kind = 'function_label') AS function_label, min_by(normalized_text, text_region_id) FILTER (kind = 'terminal_label') AS terminal_name FROM objects WHERE target_kind = 'endpoint' GROUP BY 1",
}


@query(f"SELECT page, text_region_id, target_id, target_kind, d2::DOUBLE AS d2, {_AC} AS confidence FROM near")
def semantic_associations(spark, sf_dir):
    return _associations(spark, sf_dir)[1].drop("source_id", "tc")


@query("SELECT text_region_id, target_kind, target_id, d2::DOUBLE AS d2 FROM unique_near", **_OBJECTS)
def nearest_unique_target(spark, sf_dir):
    from tracegrid.functions.evidence import nearest_unique

    _, near = _associations(spark, sf_dir)
    return nearest_unique(near.withColumn("target", F.concat_ws(":", "target_kind", "target_id")), ["text_region_id"], "target", "d2").select("text_region_id", "target_kind", "target_id", "d2")


def _objects(spark, sf_dir):
    d, near = _associations(spark, sf_dir)
    return d, S.object_semantics(S.object_candidates(S.interpret_texts(_gated(d.views)), near))


@query("SELECT target_kind, target_id, kind, normalized_text, confidence, d2::DOUBLE AS d2, text_region_id FROM objects", **_OBJECTS)
def object_semantics(spark, sf_dir):
    return _objects(spark, sf_dir)[1].select("target_kind", "target_id", "kind", "normalized_text", "confidence", "d2", "text_region_id")


@query("SELECT id, coalesce((SELECT string_agg(DISTINCT normalized_text, ',' ORDER BY normalized_text) FROM objects o WHERE o.target_kind = 'component' AND o.target_id = c.id), '') AS labels FROM components c", **_OBJECTS)
def apply_labels(spark, sf_dir):
    d, found = _objects(spark, sf_dir)
    return S.apply_labels(d.views.components(), found)


@query("SELECT * FROM labels", **_OBJECTS)
def endpoint_labels(spark, sf_dir):
    return S.endpoint_labels(_objects(spark, sf_dir)[1])


_ROLES = {
    "rnear": f"SELECT *, {_AC} AS ac FROM near WHERE target_kind = 'endpoint' QUALIFY d2 = min(d2) OVER (PARTITION BY text_region_id)",
    "runique": "SELECT text_region_id, min(target_id) AS endpoint_id, min(d2) AS d2, min(ac) AS ac FROM rnear GROUP BY 1 HAVING count(DISTINCT target_id) = 1",
    "robs": f"SELECT endpoint_id, CASE k.kind WHEN 'ground_label' THEN 'ground' WHEN 'power_feed_label' THEN 'power_feed' ELSE 'shared_function_feed' END AS role, {_NAME.format('least(' + _RANK.format('k.confidence') + ', ' + _RANK.format('u.ac') + ')')} AS confidence, d2, text_region_id FROM kinds k JOIN runique u USING (text_region_id) WHERE k.kind IN ('ground_label', 'power_feed_label', 'shared_function_feed_label')",
    "rtop": f"SELECT *, {_RANK.format('confidence')} AS r FROM robs QUALIFY r = max(r) OVER (PARTITION BY endpoint_id)",
    "roles": "SELECT endpoint_id, min(role) AS role, min(confidence) AS confidence FROM rtop GROUP BY 1 HAVING count(DISTINCT role) = 1",
}


def _role_observations(spark, sf_dir):
    d, near = _associations(spark, sf_dir)
    return d, S.role_observations(S.interpret_texts(_gated(d.views)), near)


@query("SELECT endpoint_id, role, confidence, d2::DOUBLE AS d2, text_region_id FROM robs", **_ROLES)
def role_observations(spark, sf_dir):
    return _role_observations(spark, sf_dir)[1]


@query("SELECT * FROM roles", **_ROLES)
def role_observation_resolve(spark, sf_dir):
    return S.resolve_roles(_role_observations(spark, sf_dir)[1])


@query("""SELECT f.page || ':' || f.root AS net, CASE WHEN count(DISTINCT r.role) = 1 THEN min(r.role) ELSE 'unknown' END AS role, CASE WHEN count(DISTINCT r.role) = 1 THEN min(r.confidence) ELSE 'unresolved' END AS confidence
       FROM facts f LEFT JOIN ev r ON r.page = f.page AND r.root = f.root AND r.r = r.top WHERE f.state <> 'skipped' GROUP BY 1""",
       ev="""SELECT *, max(r) OVER (PARTITION BY page, root) AS top FROM (SELECT c.page, c.root, 'ground' AS role, 'high' AS confidence, 3 AS r FROM eps p JOIN cc c ON c.page = p.page AND c.node = p.node_id WHERE p.kind = 'ground')""")
def net_roles(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    members, facts = nets.component_facts(d.nodes, d.edges, d.endpoints)
    net = F.concat_ws(":", "page", "root")
    ep = d.endpoints.select("source_id", "page", F.col("node_id").alias("node"), F.concat_ws("@", "id", "page").alias("endpoint_id"), "kind")
    held = members.join(facts.filter("state <> 'skipped'").select("source_id", "page", "root"), ["source_id", "page", "root"]).join(ep, ["source_id", "page", "node"])
    evidence = ep.filter("kind = 'ground'").select("endpoint_id", F.lit("ground").alias("role"), F.lit("high").alias("confidence"))
    return nets.net_roles(held.select(net.alias("net"), "endpoint_id"), evidence)


@query("""SELECT o_custkey::VARCHAR AS net, string_agg(DISTINCT 'ep-' || o_orderkey, ',' ORDER BY 'ep-' || o_orderkey) AS endpoint_ids, CASE WHEN bool_or(o_orderkey = o_custkey) THEN 'ep-' || o_custkey END AS anchor,
       bool_and(o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS complete FROM orders GROUP BY o_custkey""")  # fmt: skip
def net_normalize(spark, sf_dir):
    v = Adapters(spark, sf_dir)
    raw = v.table("orders").groupBy(F.col("o_custkey").cast("string").alias("net")).agg(F.collect_list(F.concat(F.lit("ep-"), F.col("o_orderkey"))).alias("endpoint_ids")).withColumn("anchor", F.concat(F.lit("ep-"), F.col("net")))
    return nets.normalize_nets(raw, v.table("lineitem").select(F.concat(F.lit("ep-"), F.col("l_orderkey")).alias("endpoint_id")))


@query("SELECT endpoint_id, CASE WHEN count(DISTINCT component_id) = 1 THEN min(component_id) END AS component_id, CASE WHEN count(DISTINCT component_id) = 1 THEN 'resolved' ELSE 'conflicted' END AS status FROM terminal_evidence GROUP BY 1")
def resolve_or_conflict_components(spark, sf_dir):
    return resolve_or_conflict(Adapters(spark, sf_dir).terminal_evidence(), ["endpoint_id"], "component_id")


def _all_endpoints(v: Adapters):
    return v.table("orders").select(F.concat(F.lit("ep-"), F.col("o_orderkey")).alias("endpoint_id"))


_REC = {
    "g": f"SELECT endpoint_id, count(DISTINCT component_id) AS nc, count(DISTINCT kind) AS nk, min(component_id) AS component_id, min(kind) AS kind, max({_RANK.format('confidence')}) AS r FROM terminal_evidence GROUP BY 1",
    "rec": f"""SELECT e.endpoint_id, CASE WHEN r IS NULL THEN 'unresolved' WHEN nc = 1 AND nk = 1 THEN 'resolved' ELSE 'conflicted' END AS status, CASE WHEN nc = 1 AND nk = 1 THEN component_id END AS component_id,
        CASE WHEN nc = 1 AND nk = 1 THEN kind ELSE 'geometric' END AS kind, CASE WHEN nc = 1 AND nk = 1 THEN {_NAME.format('r')} ELSE 'unresolved' END AS confidence
        FROM (SELECT DISTINCT 'ep-' || o_orderkey AS endpoint_id FROM orders) e LEFT JOIN g USING (endpoint_id)""",
    "bev": """SELECT DISTINCT endpoint_id, 'terminal' AS source, CASE kind WHEN 'ground' THEN 'ground' WHEN 'connector_terminal' THEN 'connector' ELSE 'component' END AS category, component_id, 'resolved' AS status FROM terminal_evidence
        UNION SELECT endpoint_id, 'reconstruction', CASE kind WHEN 'ground' THEN 'ground' WHEN 'connector_terminal' THEN 'connector' WHEN 'component_terminal' THEN 'component' END, component_id, status FROM rec WHERE status <> 'unresolved'""",
    "bres": """SELECT endpoint_id, CASE WHEN NOT doubt AND n = 1 THEN CASE WHEN nc > 0 THEN 'component' WHEN ng > 0 THEN 'ground' ELSE 'connector' END ELSE 'unresolved' END AS boundary_kind,
        CASE WHEN n > 1 OR doubt THEN 'conflicted' WHEN n = 0 THEN 'unresolved' ELSE 'resolved' END AS boundary_status, CASE nc WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'conflicted' END AS component_status, CASE WHEN nc = 1 THEN c END AS component_id,
        CASE ng WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'conflicted' END AS ground_status, CASE nn WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'conflicted' END AS connector_status
        FROM (SELECT *, (nc > 0)::INT + (ng > 0)::INT + (nn > 0)::INT AS n FROM (SELECT e.endpoint_id, count(DISTINCT b.component_id) FILTER (category = 'component') AS nc, count(DISTINCT b.component_id) FILTER (category = 'ground') AS ng, count(DISTINCT b.component_id) FILTER (category = 'connector') AS nn,
          min(b.component_id) FILTER (category = 'component') AS c, coalesce(bool_or(b.status = 'conflicted'), FALSE) AS doubt FROM (SELECT DISTINCT 'ep-' || o_orderkey AS endpoint_id FROM orders) e LEFT JOIN bev b USING (endpoint_id) GROUP BY 1))""",
}


@query("SELECT * FROM rec", **_REC)
def endpoint_semantics(spark, sf_dir):
    v = Adapters(spark, sf_dir)
    return S.endpoint_semantics(_all_endpoints(v), v.terminal_evidence())


@query(f"""SELECT e.endpoint_id, CASE WHEN u THEN component_id END AS component_id, CASE WHEN u THEN kind ELSE 'geometric' END AS kind, CASE WHEN u THEN ec ELSE e.confidence END AS confidence FROM (
         SELECT e.*, f.component_id, f.kind, f.ec, f.ec IS NOT NULL AND NOT (e.confidence = 'high' AND {_RANK.format('f.ec')} < 3) AS u FROM (SELECT 'ep-' || o_orderkey AS endpoint_id, CASE WHEN o_orderkey % 2 = 0 THEN 'high' ELSE 'low' END AS confidence FROM orders) e
         LEFT JOIN (SELECT endpoint_id, component_id, kind, confidence AS ec FROM terminal_evidence QUALIFY row_number() OVER (PARTITION BY endpoint_id ORDER BY component_id, kind, {_RANK.format('confidence')} DESC) = 1) f USING (endpoint_id)) e""")  # fmt: skip
def terminal_semantic_first_wins(spark, sf_dir):
    v = Adapters(spark, sf_dir)
    e = v.table("orders").select(F.concat(F.lit("ep-"), F.col("o_orderkey")).alias("endpoint_id"), F.when(F.col("o_orderkey") % 2 == 0, "high").otherwise("low").alias("confidence"))
    return S.first_terminal_evidence(e, v.terminal_evidence())


@query(f"""SELECT endpoint_id AS node_id, min(kind) AS state, min(confidence) AS confidence FROM (SELECT *, {_RANK.format('confidence')} AS r FROM terminal_evidence QUALIFY r = max(r) OVER (PARTITION BY endpoint_id)) GROUP BY 1 HAVING count(DISTINCT kind) = 1""")
def topology_connection_evidence(spark, sf_dir):
    e = Adapters(spark, sf_dir).terminal_evidence().select(F.col("endpoint_id").alias("node_id"), F.col("kind").alias("state"), "confidence")
    return S.connection_evidence(e)


_IDS = {"ide": f"SELECT component_id, kind, normalized_text, confidence, d2 FROM (SELECT a.target_id AS component_id, k.kind, k.n AS normalized_text, k.confidence, a.d2, row_number() OVER (PARTITION BY a.target_id, k.kind, k.n ORDER BY {_RANK.format('k.confidence')} DESC, a.d2, k.text_region_id) AS i FROM kinds k JOIN near a USING (text_region_id) WHERE a.target_kind = 'component') WHERE i = 1"}


def _identity(spark, sf_dir):
    d, near = _associations(spark, sf_dir)
    return S.identity_evidence(S.interpret_texts(_gated(d.views)), near)


@query("SELECT component_id, kind, normalized_text, confidence, d2::DOUBLE AS d2 FROM ide", **_IDS)
def identity_evidence(spark, sf_dir):
    return _identity(spark, sf_dir)


@query(f"SELECT component_id, CASE WHEN count(DISTINCT normalized_text) = 1 THEN min(normalized_text) END AS identity, CASE WHEN count(DISTINCT normalized_text) = 1 THEN 'resolved' ELSE 'conflicted' END AS status, CASE WHEN count(DISTINCT normalized_text) = 1 THEN {_NAME.format('max(' + _RANK.format('confidence') + ')')} ELSE 'unresolved' END AS confidence FROM ide WHERE kind <> 'unknown' GROUP BY 1", **_IDS)
def identity_resolution(spark, sf_dir):
    return S.identity_resolution(cut(_identity(spark, sf_dir).filter("kind <> 'unknown'"), "identity"))


@query("SELECT * FROM bev", **_REC)
def boundary_evidence(spark, sf_dir):
    v = Adapters(spark, sf_dir)
    return S.boundary_evidence(v.terminal_evidence(), S.endpoint_semantics(_all_endpoints(v), v.terminal_evidence()))


def _boundaries(spark, sf_dir):
    v = Adapters(spark, sf_dir)
    return S.boundary_resolution(_all_endpoints(v), boundary_evidence(spark, sf_dir))


@query("SELECT * FROM bres", **_REC)
def boundary_resolution(spark, sf_dir):
    return _boundaries(spark, sf_dir)


@query("SELECT boundary_kind, boundary_status, count(*) AS n, count(*) FILTER (component_status = 'conflicted') AS component_conflicts, count(*) FILTER (ground_status = 'resolved') AS grounded FROM bres GROUP BY ALL", **_REC)
def boundary_coverage(spark, sf_dir):
    c = lambda x: F.count(F.when(x, 1))
    return _boundaries(spark, sf_dir).groupBy("boundary_kind", "boundary_status").agg(F.count(F.lit(1)).alias("n"), c(F.col("component_status") == "conflicted").alias("component_conflicts"), c(F.col("ground_status") == "resolved").alias("grounded"))


_PARTS = ["lamp", "motor", "pulse generator", "battery", "gnd strap", "relay", "fuse"]
_FAM = {
    "fc": "SELECT id, kind, (['" + "', '".join(_PARTS) + "'])[hash % 7 + 1] AS label, page FROM (SELECT *, (length(id) * 3 + c.bx + c.by + 10) % 7 AS hash FROM components c)",
    "fw": "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{w}', '{k}')" for f, ws, ks in S.FAMILY_RULES for w in ws for k in ks) + ") t(family, word, kind)",
    "fe": "SELECT id, family, 2 AS s FROM fc JOIN fw ON fw.kind = fc.kind AND contains(upper(label), word) UNION ALL SELECT id, 'ground', 3 FROM fc WHERE kind = 'chassis_ground'",
    "ff": "SELECT fc.id, fc.kind, CASE WHEN count(DISTINCT family) = 1 THEN min(family) ELSE 'unknown' END AS family, CASE count(DISTINCT family) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'conflicted' END AS status, CASE WHEN count(DISTINCT family) <> 1 THEN 'unresolved' WHEN max(s) = 3 THEN 'high' ELSE 'medium' END AS confidence FROM fc LEFT JOIN fe USING (id) GROUP BY fc.id, fc.kind",
    "el": """SELECT ff.id, CASE WHEN reason <> 'not_applicable' THEN 'rejected' WHEN t >= 1 AND status = 'resolved' THEN 'resolved' ELSE 'unresolved' END AS status, reason AS rejection_reason, t AS terminals FROM (
        SELECT ff.*, coalesce(t, 0) AS t, CASE WHEN kind = 'diagram_furniture' THEN 'diagram_furniture' WHEN kind = 'chassis_ground' OR (status = 'resolved' AND family = 'ground') THEN 'chassis_ground_reference' WHEN ends_with(ff.id, '7-3') THEN 'connector_interface' ELSE 'not_applicable' END AS reason
        FROM ff LEFT JOIN (SELECT 'component-' || l_partkey || '-0' AS id, count(DISTINCT l_orderkey) AS t FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) q USING (id)) ff""",
}


def _families(v: Adapters):
    c = v.components()
    labelled = c.withColumn("label", pick(_PARTS, (F.length("id") * 3 + F.col("bx") + F.col("by") + 10) % 7))
    return S.symbol_family(labelled)


@query("SELECT * FROM ff", **_FAM)
def symbol_family(spark, sf_dir):
    return _families(Adapters(spark, sf_dir))


@query("SELECT family, status, count(*) AS n FROM ff GROUP BY ALL", **_FAM)
def family_coverage(spark, sf_dir):
    return _families(Adapters(spark, sf_dir)).groupBy("family", "status").agg(F.count(F.lit(1)).alias("n"))


def _electrical(v: Adapters):
    terminals = v.table("lineitem").filter("l_linenumber = 1").select(F.concat(F.lit("component-"), F.col("l_partkey"), F.lit("-0")).alias("id"), F.col("l_orderkey").alias("endpoint_id"))
    return S.electrical_components(_families(v), terminals, v.components().filter(F.col("id").endswith("7-3")))


@query("SELECT * FROM el", **_FAM)
def electrical_components(spark, sf_dir):
    return _electrical(Adapters(spark, sf_dir))


@query("SELECT status, rejection_reason, count(*) AS n, count(*) FILTER (terminals > 0) AS with_terminals FROM el GROUP BY ALL", **_FAM)
def component_coverage(spark, sf_dir):
    return _electrical(Adapters(spark, sf_dir)).groupBy("status", "rejection_reason").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("terminals") > 0, 1)).alias("with_terminals"))


@query("""SELECT 'ep-' || l_orderkey AS endpoint_id, 'component-' || l_partkey AS component_id, (['component_terminal', 'connector_terminal', 'ground', 'unresolved'])[l_linenumber % 4 + 1] AS endpoint_kind,
       (['component_terminal', 'connector_terminal', 'ground_terminal', 'unknown'])[l_linenumber % 4 + 1] AS role, 'low' AS confidence FROM lineitem WHERE l_partkey % 5 <> 0""")  # fmt: skip
def terminal_semantic_evidence(spark, sf_dir):
    rows = Adapters(spark, sf_dir).table("lineitem").select(F.concat(F.lit("ep-"), F.col("l_orderkey")).alias("endpoint_id"), F.when(F.col("l_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("component-"), F.col("l_partkey"))).alias("component_id"), pick(["component_boundary", "connector_boundary", "ground_connection", "unknown"], F.col("l_linenumber") % 4).alias("kind"), F.lit("low").alias("confidence"))
    return S.terminal_semantic_evidence(rows)


@query(r"""SELECT id AS endpoint_id, 'ground' AS role, 'intrinsic' AS source FROM ce WHERE kind = 'ground'
       UNION ALL SELECT endpoint_id, min(role), 'label' FROM cl LEFT JOIN ce ON ce.id = endpoint_id WHERE role IS NOT NULL GROUP BY endpoint_id HAVING count(DISTINCT role) = 1 AND (min(kind) <> 'ground' OR min(role) = 'ground')""",
       ce="SELECT 'ep-' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'ground' ELSE 'geometric' END AS kind FROM orders",
       cl=r"SELECT 'ep-' || (event_id // 2) AS endpoint_id, CASE event_id % 16 WHEN 0 THEN 'ground' WHEN 1 THEN 'power_feed' WHEN 2 THEN 'shared_function_feed' WHEN 9 THEN 'power_feed' END AS role FROM events")
def circuit_role_evidence(spark, sf_dir):
    v = Adapters(spark, sf_dir)
    ends = v.table("orders").select(F.concat(F.lit("ep-"), F.col("o_orderkey")).alias("id"), F.when(F.col("o_orderkey") % 4 == 0, "ground").otherwise("geometric").alias("kind"))
    labels = v.recognition().select(F.concat(F.lit("ep-"), F.expr("CAST(substring(text_region_id, 13) AS BIGINT) div 2")).alias("endpoint_id"), F.col("raw_text").alias("label"))
    return S.circuit_role_evidence(ends, labels)


def _pair(v, a, b, p):
    return f"CASE WHEN {a}.{v} IS DISTINCT FROM {b}.{v} AND {a}.{v} IS NOT NULL AND {b}.{v} IS NOT NULL THEN NULL ELSE coalesce({a}.{v}, {b}.{v}) END AS {p}, CASE WHEN {a}.{v} <> {b}.{v} THEN 'conflicted' WHEN coalesce({a}.{v}, {b}.{v}) IS NULL THEN 'unresolved' ELSE 'resolved' END AS {p}_status, CASE WHEN {a}.{v} <> {b}.{v} OR coalesce({a}.{v}, {b}.{v}) IS NULL THEN 'unresolved' WHEN {a}.{v} = {b}.{v} THEN 'high' ELSE 'medium' END AS {p}_confidence"


_CUST = {"cw": "SELECT DISTINCT o_orderkey // 75 AS page, 'ep-' || (o_custkey % 16) AS start_endpoint, 'ep-' || (o_orderkey % 16) AS end_endpoint FROM orders", "clab": "SELECT 'ep-' || k AS endpoint_id, CASE WHEN k % 4 = 1 THEN 'RED' WHEN k % 4 = 2 THEN 'BLUE' END AS wire_color, CASE WHEN k % 3 = 1 THEN 'HORN' WHEN k % 3 = 2 THEN 'OIL' END AS function_label FROM (SELECT unnest(range(16)) AS k)"}
_SEM = f"SELECT w.page, w.start_endpoint, w.end_endpoint, {_pair('wire_color', 'a', 'b', 'color')}, {_pair('function_label', 'a', 'b', 'function')} FROM cw w LEFT JOIN clab a ON a.endpoint_id = w.start_endpoint LEFT JOIN clab b ON b.endpoint_id = w.end_endpoint"


def _semantics(spark, sf_dir):
    ep = lambda c: F.concat(F.lit("ep-"), F.col(c) % 16)
    wires = Adapters(spark, sf_dir).table("orders").select(F.expr("o_orderkey div 75").alias("page"), ep("o_custkey").alias("start_endpoint"), ep("o_orderkey").alias("end_endpoint")).distinct()
    k = F.col("id")
    labels = spark.range(16).select(F.concat(F.lit("ep-"), k).alias("endpoint_id"), F.when(k % 4 == 1, "RED").when(k % 4 == 2, "BLUE").alias("wire_color"), F.when(k % 3 == 1, "HORN").when(k % 3 == 2, "OIL").alias("function_label"))
    return S.wire_semantics(wires, labels)


@query(_SEM, **_CUST)
def wire_semantics(spark, sf_dir):
    return _semantics(spark, sf_dir)


@query(f"SELECT color_status, function_status, count(*) AS n FROM ({_SEM}) GROUP BY ALL", **_CUST)
def wire_semantic_coverage(spark, sf_dir):
    return _semantics(spark, sf_dir).groupBy("color_status", "function_status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT w.page, w.start_endpoint, w.end_endpoint, {_pair('wire_color', 'a', 'b', 'color')}, {_pair('function_label', 'a', 'b', 'function')} FROM ({_PASS1}) w LEFT JOIN plab a ON a.page = w.page AND a.endpoint_id = w.start_endpoint LEFT JOIN plab b ON b.page = w.page AND b.endpoint_id = w.end_endpoint",
       **_CTE2, plab="SELECT page, id AS endpoint_id, CASE WHEN (x // 10) % 3 = 0 THEN 'RED' WHEN (x // 10) % 3 = 1 THEN 'BLUE' END AS wire_color, CASE WHEN (y // 10) % 2 = 0 THEN 'HORN' END AS function_label FROM eps")
def drawn_wire_semantics(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    key = lambda c: F.concat_ws("@", c, "page")
    w = graph.wires(d.edges, d.nodes, d.endpoints, passes=(1,)).select("page", key("start_endpoint").alias("start_endpoint"), key("end_endpoint").alias("end_endpoint"))
    gx, gy = F.expr("(x div 10) % 3"), F.expr("(y div 10) % 2")
    labels = d.endpoints.select(key("id").alias("endpoint_id"), F.when(gx == 0, "RED").when(gx == 1, "BLUE").alias("wire_color"), F.when(gy == 0, "HORN").alias("function_label"))
    plain = lambda c: F.split(c, "@")[0].alias(c)
    return S.wire_semantics(w, labels).withColumns({"start_endpoint": plain("start_endpoint"), "end_endpoint": plain("end_endpoint")})
