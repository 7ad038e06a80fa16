"""Queries that run a drawing again with the insides of its enclosures masked."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracegrid.operators import counterfactual as W
from tracegrid.operators import graph, topology
from tracegrid.plans.adapters import Adapters
from tracegrid.plans.graph_queries import _PASS1
from tracegrid.plans.oracle import CTES, sql

QUERIES, ORACLE_SQL = {}, {}

#: In the SQL the masked variant has pages of its own, 10 million further on.
_VARIANT = {
    "b_segments": CTES["a_segments"],
    "m_boxes": CTES["components"].replace("FROM part,", "FROM (SELECT * FROM part WHERE p_size % 5 = 0),"),
    "m_in": """SELECT s.*, greatest(lo, CASE WHEN o = 'H' THEN b.bx ELSE b.by END) AS a, least(hi, CASE WHEN o = 'H' THEN b.bx + b.bw ELSE b.by + b.bh END) AS b FROM b_segments s JOIN m_boxes b ON b.page = s.page
        AND CASE WHEN o = 'H' THEN axis BETWEEN b.by AND b.by + b.bh AND lo <= b.bx + b.bw AND hi >= b.bx ELSE axis BETWEEN b.bx AND b.bx + b.bw AND lo <= b.by + b.bh AND hi >= b.by END""",
    "m_all": "SELECT * FROM m_in UNION ALL SELECT *, hi, hi FROM b_segments",
    "m_segments": "SELECT page, o, axis, f AS lo, a AS hi FROM (SELECT *, coalesce(max(b) OVER (PARTITION BY page, o, axis, lo, hi ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo) AS f FROM m_all) WHERE a > f",
    "a_segments": "SELECT page, o, axis, lo, hi FROM b_segments UNION ALL SELECT DISTINCT page + 10000000, o, axis, lo, hi FROM m_segments",
}
_OUTCOME = {
    "held": f"SELECT DISTINCT page, unnest([start_endpoint, end_endpoint]) AS id FROM ({_PASS1})",
    "ends": "SELECT e.page, e.id, e.x, e.y, h.id IS NOT NULL AS wired FROM eps e LEFT JOIN held h ON h.page = e.page AND h.id = e.id",
    "close": "SELECT a.page, a.id, b.id AS match_id, b.wired, (pow(a.x - b.x, 2) + pow(a.y - b.y, 2))::DOUBLE AS d2 FROM ends a JOIN ends b ON b.page = a.page + 10000000 AND abs(a.x - b.x) <= 12 AND abs(a.y - b.y) <= 12",
    "mutual": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY d2, match_id) AS mine, row_number() OVER (PARTITION BY page, match_id ORDER BY d2, id) AS theirs FROM close WHERE d2 <= 144) WHERE mine = 1 AND theirs = 1",
}


def query(oracle: str, **ctes: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql(oracle, _VARIANT, **ctes)
        return f

    return add


def _boxes(v: Adapters):
    return v.components().filter("kind = 'enclosure'").select(*topology.PAGE, "bx", "by", "bw", "bh")


@query("SELECT DISTINCT page, o, axis, lo, hi FROM m_segments")
def masked_segments(spark, sf_dir):
    """Drawn segments less what lies inside enclosures."""
    v = Adapters(spark, sf_dir)
    return W.masked_segments(v.segments(), _boxes(v)).drop("source_id").distinct()


@query("SELECT e.page, e.id, match_id, d2, CASE WHEN match_id IS NULL THEN 'gone' WHEN m.wired THEN 'wired' ELSE 'open' END AS outcome FROM ends e LEFT JOIN mutual m ON m.page = e.page AND m.id = e.id WHERE e.page < 10000000 AND NOT e.wired", **_OUTCOME)
def open_ends_after_masking(spark, sf_dir):
    """What becomes of each end without a wire when enclosures' insides are masked."""
    v = Adapters(spark, sf_dir)
    both = topology.normalize_conductors(W.with_variant(v.segments(), _boxes(v)))
    t = topology.Topology(both, reuse=True)
    ends = v.endpoint_kinds(topology.endpoints(t.nodes))
    return W.open_ends_after(ends, graph.wires(t.edges, t.nodes, ends, passes=(1,))).drop("source_id")
