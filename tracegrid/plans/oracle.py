"""The same views and operators as DuckDB SQL, written apart from the Spark code, to hold results against.

Only common table expressions that a query uses are evaluated.
"""

from __future__ import annotations

from tracegrid.plans.adapters import CONFIDENCE, KINDS, TEXTS

_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"

CTES = {
    "a_segments": """SELECT DISTINCT page, o, CASE WHEN o = 'H' THEN y ELSE x END AS axis, CASE WHEN o = 'H' THEN x ELSE y END AS lo, CASE WHEN o = 'H' THEN x ELSE y END + len AS hi FROM (
        SELECT l_orderkey // 75 AS page, CASE WHEN l_linenumber % 2 = 0 THEN 'V' ELSE 'H' END AS o, 10 * ((l_partkey * 7 + l_orderkey) % 80) AS x, 10 * ((l_suppkey * 13 + l_orderkey * 3) % 60) AS y,
               (10 * (1 + trunc(l_quantity)::BIGINT % 6))::BIGINT AS len FROM lineitem)""",
    "n_segments": """SELECT page, o, axis, min(lo) AS lo, max(hi) AS hi FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY page, o, axis ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM (
          SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY page, o, axis ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.75 THEN 1 ELSE 0 END AS fresh FROM a_segments))
        GROUP BY page, o, axis, run""",
    "seg": "SELECT *, o || axis || ':' || lo AS seg FROM n_segments",
    "hits": """SELECT h.page, v.axis AS x, h.axis AS y, h.seg AS h, v.seg AS v FROM seg h JOIN seg v ON h.page = v.page AND h.o = 'H' AND v.o = 'V'
        AND v.axis BETWEEN h.lo - 0.75 AND h.hi + 0.75 AND h.axis BETWEEN v.lo - 0.75 AND v.hi + 0.75""",
    "pts": """SELECT page, seg, x, y, max(e) AS is_end FROM (
        SELECT page, seg, CASE WHEN o = 'H' THEN unnest([lo, hi]) ELSE axis END AS x, CASE WHEN o = 'H' THEN axis ELSE unnest([lo, hi]) END AS y, 1 AS e FROM seg
        UNION ALL SELECT page, h, x, y, 0 FROM hits UNION ALL SELECT page, v, x, y, 0 FROM hits) GROUP BY ALL""",
    "edges": """SELECT page, seg || '@' || x || ':' || y AS id, seg, x || ':' || y AS from_node, x2 || ':' || y2 AS to_node, x AS x1, y AS y1, x2, y2 FROM (
        SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY page, seg ORDER BY x, y)) WHERE x2 IS NOT NULL""",
    "deg": "SELECT page, id, count(*) AS degree FROM (SELECT page, unnest([from_node, to_node]) AS id FROM edges) GROUP BY ALL",
    "nodes": """SELECT q.page, q.x || ':' || q.y AS id, x, y, CASE WHEN inner_n >= 2 AND ends = 0 THEN 'crossing'
          WHEN (inner_n + ends >= 3 OR (ends > 0 AND inner_n > 0)) AND degree >= 3 THEN 'splice' WHEN inner_n + ends >= 3 OR (ends > 0 AND inner_n > 0) THEN 'junction'
          WHEN inner_n + ends = 2 THEN 'continuation' ELSE 'conductor_end' END AS type, NOT (inner_n >= 2 AND ends = 0) AS connective, coalesce(degree, 0) AS degree
        FROM (SELECT page, x, y, sum(is_end) AS ends, count(*) - sum(is_end) AS inner_n FROM pts GROUP BY ALL) q LEFT JOIN deg ON deg.page = q.page AND deg.id = q.x || ':' || q.y""",
    "eps": "SELECT page, 'ep-' || id AS id, id AS node_id, x, y, CASE WHEN ((x + y) // 10) % 7 = 0 THEN 'ground' WHEN ((x + y) // 10) % 7 <= 3 THEN 'component_terminal' ELSE 'geometric' END AS kind FROM nodes WHERE type = 'conductor_end' AND degree = 1",
    "live": "SELECT e.* FROM edges e JOIN nodes a ON a.page = e.page AND a.id = from_node AND a.connective JOIN nodes b ON b.page = e.page AND b.id = to_node AND b.connective",
    "reach": """SELECT page, node, other FROM (SELECT page, from_node AS node, from_node AS other FROM live UNION SELECT page, to_node, to_node FROM live)
        UNION SELECT r.page, r.node, CASE WHEN e.from_node = r.other THEN e.to_node ELSE e.from_node END FROM reach r JOIN live e ON e.page = r.page AND (e.from_node = r.other OR e.to_node = r.other)""",
    "cc": "SELECT page, node, min(other) AS root FROM reach GROUP BY ALL",
    "facts": """SELECT *, CASE WHEN n_endpoints < 2 OR (n_anchors = 0 AND (n_endpoints = 2 OR n_splices = 0)) THEN 'skipped' WHEN n_edges + 1 <> n_nodes THEN 'cyclic' WHEN n_anchors <> 1 THEN 'unanchored' ELSE 'decomposed' END AS state FROM (
        SELECT c.page, c.root, count(DISTINCT c.node) AS n_nodes, any_value(k.n_edges) AS n_edges, count(DISTINCT p.id) AS n_endpoints, count(DISTINCT CASE WHEN n.type = 'splice' THEN n.id END) AS n_splices,
               count(DISTINCT CASE WHEN p.kind = 'ground' THEN p.id END) AS n_anchors, min(CASE WHEN p.kind = 'ground' THEN p.id END) AS anchor, min(CASE WHEN p.kind = 'ground' THEN p.node_id END) AS anchor_node
        FROM cc c JOIN nodes n ON n.page = c.page AND n.id = c.node LEFT JOIN eps p ON p.page = c.page AND p.node_id = c.node
        JOIN (SELECT l.page, root, count(DISTINCT id) AS n_edges FROM live l JOIN cc ON cc.page = l.page AND cc.node = l.from_node GROUP BY ALL) k ON k.page = c.page AND k.root = c.root
        GROUP BY c.page, c.root)""",
    "ways": """SELECT page, root, anchor_node AS node, NULL::VARCHAR AS last, []::VARCHAR[] AS path FROM facts WHERE state = 'decomposed'
        UNION ALL SELECT w.page, w.root, CASE WHEN e.from_node = w.node THEN e.to_node ELSE e.from_node END, e.id, list_append(w.path, e.id)
        FROM ways w JOIN live e ON e.page = w.page AND (e.from_node = w.node OR e.to_node = w.node) AND e.id IS DISTINCT FROM w.last""",
    "inc": "SELECT page, from_node AS n, id, seg, to_node AS o FROM edges UNION ALL SELECT page, to_node, id, seg, from_node FROM edges",
    "walk": """SELECT i.page, p.id AS start, i.o AS node, i.id AS last, i.seg AS seg, [i.id] AS path FROM eps p JOIN inc i ON i.page = p.page AND i.n = p.node_id
        UNION ALL SELECT w.page, w.start, i.o, i.id, i.seg, list_append(w.path, i.id) FROM walk w JOIN nodes n ON n.page = w.page AND n.id = w.node AND n.degree = 2
        JOIN inc i ON i.page = w.page AND i.n = w.node AND i.id <> w.last AND (n.type NOT IN ('splice', 'junction') OR i.seg = w.seg) AND NOT list_contains(w.path, i.id)""",
    "components": f"""SELECT p_partkey // 10 AS page, 'component-' || p_partkey || '-' || k AS id, ({_LIST(KINDS)})[p_size % 5 + 1] AS kind, 10 * ((p_partkey * 37 + k * 23) % 80) - 5 AS bx, 10 * ((p_partkey * 11 + k * 29) % 60) - 5 AS by,
        (10 + 10 * (p_size % 3))::BIGINT AS bw, (10 + 10 * ((p_size // 3) % 3))::BIGINT AS bh, ({_LIST(CONFIDENCE)})[p_size % 4 + 1] AS confidence, p_name AS label FROM part, (SELECT unnest([0, 1, 2, 3]) AS k)""",
    "text_regions": "SELECT o_orderkey // 75 AS page, 'text-region-' || o_orderkey AS id, 10 * ((o_custkey * 7 + o_orderkey) % 80) AS bx, 10 * ((o_orderkey * 17) % 60) AS by, 20 + 10 * (o_orderkey % 3) AS bw, 10 AS bh, ([0.55, 0.70, 0.85])[o_orderkey % 3 + 1]::DOUBLE AS confidence FROM orders",
    "glyphs": "SELECT l_orderkey // 75 AS page, 'glyph-' || l_orderkey || '-' || l_linenumber AS id, (l_partkey * 7 + l_orderkey * 5) % 400 AS bx, 12 * ((l_suppkey * 13 + l_orderkey) % 25) + l_linenumber % 5 AS by, 3 + l_partkey % 12 AS bw, 4 + l_suppkey % 9 AS bh FROM lineitem",
    "recognition": f"""SELECT 'text-region-' || event_id AS text_region_id, ({_LIST(TEXTS)})[event_id % 16 + 1] AS raw_text, CASE WHEN event_type IN ('click', 'signup') THEN 'high' WHEN event_type = 'view' THEN 'medium' WHEN event_type = 'purchase' THEN 'low' ELSE 'unresolved' END AS confidence,
        CASE WHEN user_id % 2 = 0 THEN 'json-observation' ELSE '' END AS provider FROM events""",
    "gated": "SELECT r.text_region_id, raw_text, r.confidence, CASE WHEN provider = '' THEN 'recognition' ELSE provider END AS provider FROM recognition r WHERE raw_text <> '' AND r.confidence <> 'unresolved' AND text_region_id IN (SELECT id FROM text_regions)",
    "texts": r"""SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(raw_text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[ \t\n\x0B\f\r\-_]+', ' ', 'g'), '^ +', ''), '[.,:; ]+$', ''), ' +$', '') AS n FROM gated""",
    "kinds": """SELECT *, CASE WHEN n IN ('GND', 'GROUND', 'CHASSIS GROUND') THEN 'ground_label' WHEN n IN ('B+', 'BATTERY+', 'BATTERY POSITIVE', 'POWER FEED', 'POWER SOURCE') THEN 'power_feed_label' WHEN n = 'SHARED FUNCTION FEED' THEN 'shared_function_feed_label'
        WHEN n IN ('RED', 'BLACK', 'WHITE', 'GREEN', 'BLUE', 'YELLOW', 'BROWN', 'ORANGE', 'PINK', 'GRAY', 'GREY', 'PURPLE') THEN 'wire_color'
        WHEN n IN ('IGN', 'IGNITION', 'START', 'STARTER', 'LIGHT', 'LIGHTING', 'HEADLIGHT', 'BRAKE', 'TURN', 'HORN', 'NEUTRAL', 'OIL', 'CHARGE') THEN 'function_label'
        WHEN starts_with(n, 'CONNECTOR ') OR starts_with(n, 'CONN ') THEN 'connector_label' WHEN starts_with(n, 'TERMINAL ') OR starts_with(n, 'PIN ') THEN 'terminal_label' ELSE 'unknown' END AS kind FROM texts""",
    "assoc": """SELECT t.page, t.id AS text_region_id, c.id AS target_id, 'component' AS target_kind, t.confidence AS tc,
          pow(greatest(t.bx - (c.bx + c.bw), c.bx - (t.bx + t.bw), 0), 2) + pow(greatest(t.by - (c.by + c.bh), c.by - (t.by + t.bh), 0), 2) AS d2 FROM text_regions t JOIN components c ON c.page = t.page
        UNION ALL SELECT t.page, t.id, p.id, 'endpoint', t.confidence, pow(greatest(t.bx - p.x, p.x - (t.bx + t.bw), 0), 2) + pow(greatest(t.by - p.y, p.y - (t.by + t.bh), 0), 2) FROM text_regions t JOIN eps p ON p.page = t.page""",
    "near": "SELECT * FROM assoc WHERE d2 <= 6400",
    "terminal_evidence": """SELECT 'ep-' || l_orderkey AS endpoint_id, 'component-' || (l_partkey % 3) AS component_id, (['component_terminal', 'connector_terminal', 'ground'])[l_partkey % 3 + 1] AS kind,
        CASE WHEN l_returnflag = 'A' THEN 'high' WHEN l_returnflag = 'N' THEN 'medium' ELSE 'low' END AS confidence FROM lineitem WHERE l_linenumber <= 3""",
    "registry": "SELECT 'R' || r_regionkey AS canonical_id, r_name AS canonical_name, unnest(list_concat((SELECT list(n_name) FROM nation WHERE n_regionkey = r_regionkey), CASE WHEN r_regionkey <= 1 THEN ['SHARED'] ELSE [] END)) AS alias FROM region",
    "alias_index": r"SELECT regexp_replace(translate(alias, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[ \-_]+', '', 'g') AS key, min(canonical_id) AS canonical_id, min(canonical_name) AS canonical_name, count(DISTINCT canonical_id) AS owners FROM (SELECT * FROM registry UNION ALL SELECT 'R' || r_regionkey, r_name, r_name FROM region) GROUP BY 1",
    "ink": """SELECT DISTINCT page, CASE WHEN o = 'H' THEN axis // 10 ELSE c END AS y, CASE WHEN o = 'H' THEN c ELSE axis // 10 END AS x FROM (SELECT *, unnest(range(lo // 10, hi // 10 + 1)) AS c FROM a_segments)""",
}


def sql(body: str, first: dict[str, str] | None = None, **more: str) -> str:
    """``body`` after the common table expressions; ``first`` come before them, also in the place of some of them."""
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS ({v})" for k, v in {**(first or {}), **{k: v for k, v in CTES.items() if k not in (first or {})}, **more}.items()) + "\n" + body
