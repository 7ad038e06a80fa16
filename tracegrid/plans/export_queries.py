"""Queries that write whole pages: the model as JSON and the drawing as SVG."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrid.operators.topology import PAGE
from tracegrid.plans.adapters import pick
from tracegrid.plans.graph_queries import Drawn
from tracegrid.plans.oracle import sql
from tracegrid.sources import drawings, review

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str, **ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql(oracle, **ctes)
        return f

    return add


_ROWS = """SELECT page, 'nodes' AS c, id, '{"id":"' || id || '","x":' || x || ',"y":' || y || ',"type":"' || type || '"}' AS j FROM nodes
    UNION ALL SELECT page, 'edges', id, '{"id":"' || id || '","from_node":"' || from_node || '","to_node":"' || to_node || '"}' FROM edges
    UNION ALL SELECT page, 'endpoints', id, '{"id":"' || id || '","node_id":"' || node_id || '","kind":"' || kind || '"}' FROM eps
    UNION ALL SELECT page, 'components', id, '{"id":"' || id || '","kind":"' || kind || '","confidence":"' || confidence || '"}' FROM components
    UNION ALL SELECT page, 'text_regions', id, '{"id":"' || id || '","confidence":' || confidence || '}' FROM text_regions"""
_LISTS = " || ',' || ".join(f"""'"{c}":[' || coalesce(string_agg(j, ',' ORDER BY id) FILTER (c = '{c}'), '') || ']'""" for c in ("nodes", "edges", "endpoints", "components", "text_regions"))


@query(f"""SELECT page, '{{"source_id":"lattice","page":' || page || ',' || {_LISTS} || '}}' AS json FROM ({_ROWS}) GROUP BY page""")
def topology_json(spark, sf_dir):
    d = Drawn(spark, sf_dir)
    tables = {
        "nodes": d.nodes.select(*PAGE, "id", "x", "y", "type"), "edges": d.edges.select(*PAGE, "id", "from_node", "to_node"), "endpoints": d.endpoints.select(*PAGE, "id", "node_id", "kind"),
        "components": d.views.components().select(*PAGE, "id", "kind", "confidence"), "text_regions": d.views.text_regions().select(*PAGE, "id", "confidence"),
    }
    return drawings.page_json(tables).select("page", "json")


_ESC = "replace(replace(replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&apos;')"
_HUE = "CASE " + " ".join(f"WHEN contains(upper(colour), '{k}') THEN '{v}'" for k, v in drawings.WIRE_COLOURS.items()) + " ELSE '#888' END"
_DRAWN = f"""SELECT page, 'components' AS c, id, '<rect id="component-' || id || '" data-component-kind="' || kind || '" data-source-label="' || {_ESC} || '" x="' || bx || '" y="' || b.by || '" width="' || bw || '" height="' || bh || '" fill="none"/>' AS j FROM components b WHERE kind <> 'diagram_furniture'
    UNION ALL SELECT page, 'wires', id, '<line id="edge-' || id || '" data-wire-id="' || seg || '" x1="' || x1 || '" y1="' || y1 || '" x2="' || x2 || '" y2="' || y2 || '" stroke="' || CASE WHEN status = 'resolved' THEN {_HUE} ELSE '#888' END || '"' || CASE status WHEN 'conflicted' THEN ' stroke-dasharray="2,2"' WHEN 'resolved' THEN ' data-wire-color="' || colour || '"' ELSE '' END || ' data-wire-color-status="' || status || '"/>'
      FROM (SELECT *, (['red', 'Light Blue', 'mauve', 'GREY'])[page % 4 + 1] AS colour, (['resolved', 'conflicted', 'unresolved'])[(x1 // 10) % 3 + 1] AS status FROM edges)
    UNION ALL SELECT page, 'splices', id, '<circle id="splice-' || id || '" cx="' || x || '" cy="' || y || '" r="2.2" fill="#111"/>' FROM nodes WHERE type = 'splice'
    UNION ALL SELECT page, 'crossings', id, '<circle id="crossing-' || id || '" cx="' || x || '" cy="' || y || '" r="1.8" fill="none" stroke="#aaa"/>' FROM nodes WHERE type = 'crossing'
    UNION ALL SELECT page, 'grounds', id, '<g id="ground-' || id || '" transform="translate(' || x || ',' || y || ')"><path d="M0 0V6M-4 6H4M-2.5 8.5H2.5" stroke="#2e7d32"/></g>' FROM eps WHERE kind = 'ground'
    UNION ALL SELECT page, w || 's', id, CASE WHEN label = '' THEN '<rect id="' || w || '-' || id || '" x="' || bx || '" y="' || top || '" width="' || greatest(bw, 4) || '" height="' || greatest(bh, 4) || '" fill="none" stroke-dasharray="1,1"/>'
      ELSE '<text id="' || w || '-' || id || '" x="' || bx || '" y="' || (top + bh) || '" font-size="7">' || {_ESC} || '</text>' END
      FROM (SELECT page, id, bx, t.by AS top, bw, bh, CASE k WHEN 0 THEN '' WHEN 1 THEN 'A<B & "C"' ELSE 'GND' END AS label, CASE WHEN k >= 2 THEN 'label' ELSE 'annotation' END AS w FROM (SELECT *, substr(id, 13)::BIGINT % 4 AS k FROM text_regions) t)"""
_SHOWN = ["components", "wires", "splices", "crossings", "grounds", "labels", "annotations"]
_GROUPS = " || chr(10) || ".join(f"""'<g id="{c}">' || coalesce(string_agg(j, chr(10) ORDER BY id) FILTER (c = '{c}'), '') || '</g>'""" for c in drawings.SVG_LAYERS[:-1])
_META = " || ".join(f"""' data-{c}-count="' || count(*) FILTER (c = '{c}') || '"'""" for c in _SHOWN)


@query(f"""SELECT page, '<svg xmlns="http://www.w3.org/2000/svg" width="900" height="700" viewBox="0 0 900 700">' || chr(10) || {_GROUPS} || chr(10) || '<g id="metadata" data-page="' || page || '"' || {_META} || '/>' || chr(10) || '</svg>' AS svg FROM ({_DRAWN}) GROUP BY page""")
def layered_svg(spark, sf_dir):
    """Colours follow the page and texts the number of their region, so that every kind of element occurs."""
    d = Drawn(spark, sf_dir)
    edges = d.edges.withColumns({"wire": F.col("seg"), "colour": pick(["red", "Light Blue", "mauve", "GREY"], F.col("page") % 4), "status": pick(["resolved", "conflicted", "unresolved"], F.expr("(x1 div 10) % 3"))})
    k = F.substring("id", 13, 20).cast("long") % 4
    labels = d.views.text_regions().withColumns({"label": F.when(k == 0, "").when(k == 1, 'A<B & "C"').otherwise("GND"), "kind": F.when(k >= 2, "ground_label").otherwise("unknown")})
    layers = {
        "components": drawings.component_boxes(d.views.components()), "wires": drawings.wire_lines(edges), "splices": drawings.node_dots(d.nodes, "splice"), "crossings": drawings.node_dots(d.nodes, "crossing"),
        "grounds": drawings.ground_marks(d.endpoints), "labels": drawings.label_texts(labels), "annotations": drawings.label_texts(labels, annotations=True),
    }
    return drawings.layered_svg(layers, 900, 700).select("page", "svg")


#: Width and height of a review image, in which all lattice lines lie.
REVIEW_PAGE = (900, 700)
_LAYERS = {
    "obj": """SELECT page, 'topology_edges' AS layer, id FROM edges UNION ALL SELECT page, 'component_bounds', id FROM components UNION ALL SELECT page, 'labels', id FROM text_regions
        UNION ALL SELECT page, 'splices', id FROM nodes WHERE type = 'splice' UNION ALL SELECT page, 'endpoint_debug', id FROM eps UNION ALL SELECT page, 'grounds', id FROM eps WHERE kind = 'ground'""",
    "bx4": "SELECT page, 'component_bounds' AS layer, bx, c.by AS top, bw, bh FROM components c UNION ALL SELECT page, 'labels', bx, t.by, bw, bh FROM text_regions t",
    "dts": "SELECT page, 'splices' AS layer, x, y, 4 AS r FROM nodes WHERE type = 'splice' UNION ALL SELECT page, 'endpoint_debug', x, y, 3 FROM eps UNION ALL SELECT page, 'grounds', x, y, 5 FROM eps WHERE kind = 'ground'",
    "cel": """SELECT page, 'topology_edges' AS layer, x1 + unnest(range(0, x2 - x1 + 1)) AS x, y1 AS y FROM edges WHERE y1 = y2 UNION SELECT page, 'topology_edges', x1, y1 + unnest(range(0, y2 - y1 + 1)) FROM edges WHERE x1 = x2
        UNION SELECT page, layer, bx + unnest(range(bw)), top FROM bx4 UNION SELECT page, layer, bx + unnest(range(bw)), top + bh - 1 FROM bx4 UNION SELECT page, layer, bx, top + unnest(range(bh)) FROM bx4 UNION SELECT page, layer, bx + bw - 1, top + unnest(range(bh)) FROM bx4
        UNION SELECT page, layer, x + i, y + j FROM dts, (SELECT unnest(range(-5, 6)) AS i), (SELECT unnest(range(-5, 6)) AS j) WHERE i * i + j * j <= r * r""",
}


@query(f"SELECT o.page, o.layer, objects, coalesce(pixels, 0) AS pixels, {REVIEW_PAGE[0]} AS width, {REVIEW_PAGE[1]} AS height FROM (SELECT page, layer, count(*) AS objects FROM obj GROUP BY ALL) o LEFT JOIN (SELECT page, layer, count(*) AS pixels FROM cel WHERE x BETWEEN 0 AND {REVIEW_PAGE[0] - 1} AND y BETWEEN 0 AND {REVIEW_PAGE[1] - 1} GROUP BY ALL) p ON p.page = o.page AND p.layer = o.layer", **_LAYERS)
def review_layers(spark, sf_dir):
    """Review images of six layers, written as PNG and counted again from their bytes, beside the objects they show."""
    d = Drawn(spark, sf_dir)
    boxes, texts, ends = d.views.components(), d.views.text_regions(), d.endpoints
    splices, grounds = d.nodes.filter("type = 'splice'"), ends.filter("kind = 'ground'")
    objects = {"topology_edges": d.edges, "component_bounds": boxes, "labels": texts, "splices": splices, "endpoint_debug": ends, "grounds": grounds}
    runs = {"topology_edges": review.line_runs(d.edges), "component_bounds": review.box_runs(boxes), "labels": review.box_runs(texts), "splices": review.dot_runs(splices, 4), "endpoint_debug": review.dot_runs(ends, 3), "grounds": review.dot_runs(grounds, 5)}
    seen = review.read_back(review.review_images(runs, *REVIEW_PAGE))
    return review.manifest(seen, objects).select("page", "layer", "objects", "pixels", F.lit(REVIEW_PAGE[0]).alias("width"), F.lit(REVIEW_PAGE[1]).alias("height"))
