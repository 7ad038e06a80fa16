from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracegrid.operators import graph, nets, topology


def build(spark, segments):
    df = spark.createDataFrame([("s", 0, *x) for x in segments], "source_id string, page long, o string, axis long, lo long, hi long")
    return topology.Topology(topology.normalize_conductors(df))


def frames(spark, nodes, edges, ends):
    n = spark.createDataFrame([("s", 0, i, t, t != "crossing", 0) for i, t in nodes], "source_id string, page long, id string, type string, connective boolean, degree long")
    e = spark.createDataFrame([("s", 0, *x) for x in edges], "source_id string, page long, id string, seg string, from_node string, to_node string")
    p = spark.createDataFrame([("s", 0, *x) for x in ends], "source_id string, page long, id string, node_id string, kind string")
    return n, e, p


def test_crossing_does_not_connect(spark):
    t = build(spark, [("H", 10, 0, 20), ("V", 10, 0, 20)])
    kinds = Counter(r.type for r in t.nodes.collect())
    assert kinds == {"conductor_end": 4, "crossing": 1} and t.edges.count() == 4
    assert not t.nodes.filter("type = 'crossing'").first().connective


def test_t_joint_is_a_splice(spark):
    t = build(spark, [("H", 10, 0, 20), ("V", 10, 10, 20)])
    kinds = Counter(r.type for r in t.nodes.collect())
    assert kinds == {"conductor_end": 3, "splice": 1} and t.edges.count() == 3


def test_order_of_input_does_not_matter(spark):
    segments = [("H", 10, 0, 30), ("V", 10, 0, 20), ("V", 20, 10, 40), ("H", 30, 20, 50)]
    a, b = build(spark, segments), build(spark, segments[::-1])
    assert sorted(map(tuple, a.nodes.collect())) == sorted(map(tuple, b.nodes.collect()))
    assert sorted(map(tuple, a.edges.collect())) == sorted(map(tuple, b.edges.collect()))


@pytest.mark.parametrize(
    "segments, expected",
    [([("H", 10, 0, 10), ("H", 10, 10, 20), ("H", 10, 0, 10)], {(10, 0, 20)}), ([("H", 10, 0, 10), ("H", 20, 0, 10)], {(10, 0, 10), (20, 0, 10)}), ([("H", 10, 0, 10), ("H", 10, 12, 20)], {(10, 0, 10), (10, 12, 20)})],
)
def test_merging_conductors(spark, segments, expected):
    df = spark.createDataFrame([("s", 0, *x) for x in segments], "source_id string, page long, o string, axis long, lo long, hi long")
    assert {(r.axis, r.lo, r.hi) for r in topology.normalize_conductors(df).collect()} == expected


def test_facing_gap_is_a_candidate(spark):
    t = build(spark, [("H", 10, 0, 30), ("H", 10, 49, 80), ("H", 10, 90, 120)])
    got = topology.gap_candidates(t.nodes, t.edges).select("a", "b").collect()
    assert [tuple(r) for r in got] == [("80:10", "90:10")]
    assert [(r.a, r.b) for r in topology.bridge_gaps(topology.gap_candidates(t.nodes, t.edges)).collect()] == [("80:10", "90:10")]


def test_chain_is_one_wire(spark):
    n, e, p = frames(spark, [("a", "conductor_end"), ("m", "continuation"), ("b", "conductor_end")], [("e1", "s1", "a", "m"), ("e2", "s2", "m", "b")], [("A", "a", "geometric"), ("B", "b", "geometric")])
    w = graph.wires(e, n, p).collect()
    assert [(r["pass"], r.start_endpoint, r.end_endpoint, r.edges, r.segments) for r in w] == [(1, "A", "B", ["e1", "e2"], ["s1", "s2"])]


def splice(spark, segs):
    return frames(spark, [("a", "conductor_end"), ("b", "conductor_end"), ("c", "conductor_end"), ("s", "splice")], [(f"e{i}", seg, x, "s") for i, (seg, x) in enumerate(zip(segs, "abc"))], [("A", "a", "geometric"), ("B", "b", "geometric"), ("C", "c", "geometric")])


def test_splice_of_three_segments_makes_no_wire(spark):
    n, e, p = splice(spark, ["s1", "s2", "s3"])
    assert graph.wires(e, n, p).count() == 0
    assert {r.reason for r in graph.walk_stops(e, n, p).collect()} == {"distribution"}


def test_segment_carries_a_wire_through_a_splice(spark):
    n, e, p = splice(spark, ["s1", "s1", "s2"])
    assert [(r["pass"], r.start_endpoint, r.end_endpoint, r.status) for r in graph.wires(e, n, p).collect()] == [(2, "A", "B", "resolved")]


def test_conductor_that_crosses_itself_is_a_wire(spark):
    t = build(spark, [("H", 10, 0, 40), ("V", 40, 10, 30), ("H", 30, 20, 40), ("V", 20, 0, 30)])
    got = graph.wires(t.edges, t.nodes, topology.endpoints(t.nodes)).collect()
    assert [(r["pass"], r.start_endpoint, r.end_endpoint, r.status, len(r.edges)) for r in got] == [(2, "ep-0:10", "ep-20:0", "resolved", 6)]


def test_fork_of_one_segment_is_conflicted(spark):
    n, e, p = splice(spark, ["s1", "s1", "s1"])
    got = graph.wires(e, n, p).collect()
    assert {(r.start_endpoint, r.end_endpoint) for r in got} == {("A", "B"), ("A", "C")} and {r.status for r in got} == {"conflicted"}


def test_splice_of_two_segments_stops(spark):
    n, e, p = frames(spark, [("a", "conductor_end"), ("m", "splice"), ("b", "conductor_end")], [("e1", "s1", "a", "m"), ("e2", "s2", "m", "b")], [("A", "a", "geometric"), ("B", "b", "geometric")])
    assert graph.wires(e, n, p).count() == 0


def decomposed(spark, nodes, edges, ends):
    n, e, p = frames(spark, nodes, edges, ends)
    members, facts = nets.component_facts(n, e, p)
    return nets.electrical_nets(facts).collect(), nets.distribution_wires(members, facts, n, e, p).collect()


STAR = [("g", "conductor_end"), ("b", "conductor_end"), ("c", "conductor_end"), ("s", "splice")]
ARMS = [("e1", "s1", "g", "s"), ("e2", "s2", "s", "b"), ("e3", "s3", "s", "c")]


def test_ground_star(spark):
    found, wires = decomposed(spark, STAR, ARMS, [("G", "g", "ground"), ("B", "b", "component_terminal"), ("C", "c", "component_terminal")])
    assert [(r.role, r.anchor_endpoint, r.state) for r in found] == [("ground", "G", "decomposed")]
    assert sorted((r.start_endpoint, r.end_endpoint, len(r.edges)) for r in wires) == [("G", "B", 2), ("G", "C", 2)]


def test_ground_to_terminal(spark):
    found, wires = decomposed(spark, STAR[:2], [("e1", "s1", "g", "b")], [("G", "g", "ground"), ("B", "b", "component_terminal")])
    assert len(found) == 1 and len(wires) == 1


def test_two_terminals_without_anchor(spark):
    found, wires = decomposed(spark, [("b", "conductor_end"), ("s", "splice"), ("c", "conductor_end")], [("e2", "s2", "s", "b"), ("e3", "s3", "s", "c")], [("B", "b", "component_terminal"), ("C", "c", "component_terminal")])
    assert not found and not wires


def test_three_terminals_without_anchor(spark):
    found, wires = decomposed(spark, STAR, ARMS, [(x.upper(), x, "component_terminal") for x in "gbc"])
    assert [r.state for r in found] == ["unanchored"] and not wires


def test_cycle_with_ground(spark):
    ring = ARMS + [("e4", "s4", "g", "b")]
    found, wires = decomposed(spark, STAR, ring, [("G", "g", "ground"), ("C", "c", "component_terminal"), ("B", "b", "component_terminal")])
    assert [r.state for r in found] == ["cyclic"] and not wires


def test_components_agree(spark):
    import random

    r = random.Random(5)
    pairs = [("s", r.randrange(3), str(r.randrange(60)), str(r.randrange(60))) for _ in range(90)]
    df = spark.createDataFrame(pairs, "source_id string, page long, x string, y string")
    a = graph.connected_components(df, topology.PAGE, "x", "y")
    b = graph.page_components(df, "x", "y")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_snap_takes_first_leader(spark):
    df = spark.createDataFrame([("s", 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (3.0, 0.0), (6.0, 0.0), (50.0, 50.0)])], "source_id string, page long, seq long, x double, y double")
    got = {r.seq: (r.nx, r.ny) for r in topology.snap_points(df).collect()}
    assert got == {0: (0.0, 0.0), 1: (0.0, 0.0), 2: (6.0, 0.0), 3: (50.0, 50.0)}


def test_merged_wires_keep_the_first(spark):
    df = spark.createDataFrame([("s", 0, "A", "B", ["e1", "e2"], ["s1"])], "source_id string, page long, start_endpoint string, end_endpoint string, edges array<string>, segments array<string>")
    back = df.select("source_id", "page", F.col("end_endpoint").alias("start_endpoint"), F.col("start_endpoint").alias("end_endpoint"), F.reverse("edges").alias("edges"), "segments")
    assert [(r.producer, r.start_endpoint) for r in nets.merge_wires(df, back).collect()] == [(1, "A")]


def test_page_tables_are_joined_as_they_lie(spark, small):
    from tracegrid.plans.graph_queries import Drawn

    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    d = Drawn(spark, small, reuse=True)
    live = graph.connective_edges(d.nodes, d.edges).hint("merge").join(topology.node_degree(d.edges).withColumnRenamed("id", "from_node"), [*topology.PAGE, "from_node"])
    assert "hashpartitioning" not in live._jdf.queryExecution().executedPlan().toString()
    assert 0 < live.count() == graph.connective_edges(d.nodes, d.edges).count()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before and not [t for t in spark.catalog.listTables() if t.name.startswith("cut_")]
