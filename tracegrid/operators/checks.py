"""Constraint queries: wire and net validation, reference integrity, coverage and audit roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegrid.operators.topology import PAGE


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def issues(frames: list[DataFrame]) -> DataFrame:
    """The union of (page, severity, code, object_id) frames."""
    return reduce(DataFrame.unionByName, frames)


def _issue(df: DataFrame, code: str, object_id: str = "id", severity: str = "error") -> DataFrame:
    return df.select("page", F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(object_id).alias("object_id"))


def validate_wires(wires: DataFrame, endpoints: DataFrame, edges: DataFrame) -> DataFrame:
    """(page, severity, code, object_id): what is wrong with wires (page, id, start_endpoint, end_endpoint, edges).

    A wire must be a path between two endpoints that exist: with edges n and nodes n + 1, no node above degree 2.
    """
    eps = endpoints.select(*PAGE, F.col("id").alias("ep"), F.col("node_id").alias("ep_node"), "kind")
    known = lambda c: wires.join(eps.select(*PAGE, F.col("ep").alias(c)), [*PAGE, c], "left_anti")
    used = wires.select(*PAGE, "id", "start_endpoint", "end_endpoint", F.explode("edges").alias("edge"))
    real = used.distinct().join(edges.select(*PAGE, F.col("id").alias("edge"), "from_node", "to_node"), [*PAGE, "edge"])
    degree = real.select(*PAGE, "id", F.explode(F.array("from_node", "to_node")).alias("node")).groupBy(*PAGE, "id", "node").agg(F.count(F.lit(1)).alias("d"))
    shape = degree.groupBy(*PAGE, "id").agg(F.count(F.lit(1)).alias("nodes"), F.sum("d").alias("twice"), F.max("d").alias("most"))
    ends = wires.select(*PAGE, "id", F.explode(F.array("start_endpoint", "end_endpoint")).alias("ep")).join(eps, [*PAGE, "ep"])
    at_ends = ends.join(degree.withColumnRenamed("node", "ep_node"), [*PAGE, "id", "ep_node"], "left")
    geometric = ends.groupBy(*PAGE, "id").agg(F.min(F.col("kind") == "geometric").alias("all"))
    return issues([
        _issue(wires.groupBy(*PAGE, "id").count().filter("count > 1"), "WIRE-DUPLICATE-ID"),
        _issue(known("start_endpoint"), "WIRE-START-ENDPOINT-MISSING"),
        _issue(known("end_endpoint"), "WIRE-END-ENDPOINT-MISSING"),
        _issue(wires.filter("start_endpoint = end_endpoint"), "WIRE-SELF-ENDPOINT"),
        _issue(wires.filter(F.size("edges") == 0), "WIRE-NO-TOPOLOGY"),
        _issue(used.groupBy(*PAGE, "id", "edge").count().filter("count > 1").select(*PAGE, "id").distinct(), "WIRE-DUPLICATE-EDGE"),
        _issue(used.join(edges.select(*PAGE, F.col("id").alias("edge")), [*PAGE, "edge"], "left_anti").select(*PAGE, "id").distinct(), "WIRE-EDGE-MISSING"),
        _issue(shape.filter("most > 2"), "WIRE-NONPATH-DEGREE"),
        _issue(shape.filter("most <= 2 AND twice / 2 <> nodes - 1"), "WIRE-DISCONNECTED-TOPOLOGY"),
        _issue(at_ends.filter(F.coalesce("d", F.lit(0)) != 1).select(*PAGE, "id").distinct(), "WIRE-ENDPOINT-DEGREE-MISMATCH"),
        _issue(geometric.filter("all"), "WIRE-GEOMETRIC-ENDPOINTS", severity="warning"),
    ])


def validation_report(wires: DataFrame, found: DataFrame) -> DataFrame:
    """(page, wires, valid_wires, errors, warnings)."""
    bad = found.filter("severity = 'error'").select("page", F.col("object_id").alias("id")).distinct().withColumn("bad", F.lit(1))
    per = wires.select("page", "id").join(bad, ["page", "id"], "left").groupBy("page").agg(F.count(F.lit(1)).alias("wires"), count_if(F.col("bad").isNull()).alias("valid_wires"))
    n = found.groupBy("page").agg(count_if(F.col("severity") == "error").alias("errors"), count_if(F.col("severity") == "warning").alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return per.join(n, "page", "left").select("page", "wires", "valid_wires", zero("errors"), zero("warnings"))


def validate_nets(nets: DataFrame, endpoints: DataFrame, edges: DataFrame) -> DataFrame:
    """Issues of nets (page, id, endpoint_ids, edges, anchor, role)."""
    items = nets.select("page", "id", F.explode("endpoint_ids").alias("ep"))
    used = nets.select("page", "id", F.explode("edges").alias("edge"))
    return issues([
        _issue(nets.groupBy("page", "id").count().filter("count > 1"), "NET-DUPLICATE-ID"),
        _issue(items.join(endpoints.select("page", F.col("id").alias("ep")), ["page", "ep"], "left_anti").select("page", "id").distinct(), "NET-ENDPOINT-MISSING"),
        _issue(used.join(edges.select("page", F.col("id").alias("edge")), ["page", "edge"], "left_anti").select("page", "id").distinct(), "NET-EDGE-MISSING"),
        _issue(nets.filter(F.col("anchor").isNotNull() & ~F.array_contains("endpoint_ids", F.col("anchor"))), "NET-ANCHOR-NOT-MEMBER"),
        _issue(nets.filter("role = 'unknown'"), "NET-ROLE-UNRESOLVED", severity="warning"),
    ])


def reference_integrity(name: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(reference, valid, invalid): how many of the child's keys exist in the parent; null keys count as neither."""
    known = parent.select(F.col(parent_key).alias("_k")).distinct().withColumn("_ok", F.lit(1))
    met = child.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k")).join(known, "_k", "left")
    return met.agg(count_if(F.col("_ok").isNotNull()).alias("valid"), count_if(F.col("_ok").isNull()).alias("invalid")).select(F.lit(name).alias("reference"), "valid", "invalid")


def references(items: DataFrame, used: DataFrame, name: str) -> DataFrame:
    """``items`` (page, id) with ``name``, how often ``used`` (page, id) refers to each."""
    n = used.groupBy("page", "id").agg(F.count(F.lit(1)).alias(name))
    return items.join(n, ["page", "id"], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def conductor_ownership(segments: DataFrame, edges: DataFrame, wires: DataFrame) -> DataFrame:
    """(page, id, edge_refs, wire_refs, ownership) of segments (page, id)."""
    held = references(segments, edges.select("page", F.col("seg").alias("id")), "edge_refs")
    held = references(held, wires.select("page", F.explode("segments").alias("id")), "wire_refs")
    e, w = F.col("edge_refs"), F.col("wire_refs")
    return held.withColumn("ownership", F.when((e == 0) & (w == 0), "unreferenced").when(w == 0, "topology_only").when(e == 0, "wire_only").when(w > 1, "shared").otherwise("normal"))


def endpoint_coverage(endpoints: DataFrame, wires: DataFrame) -> DataFrame:
    """(page, id, wire_refs, coverage) of endpoints (page, id)."""
    held = references(endpoints.select("page", "id"), wires.select("page", F.explode(F.array("start_endpoint", "end_endpoint")).alias("id")), "wire_refs")
    return held.withColumn("coverage", F.when(F.col("wire_refs") == 0, "zero_wire").when(F.col("wire_refs") == 1, "single_wire").otherwise("multiple_wire"))


def edge_coverage(edges: DataFrame, nodes: DataFrame, wires: DataFrame) -> DataFrame:
    """(page, id, dangling, owned) of edges."""
    held = references(edges.select("page", "id", "from_node", "to_node"), wires.select("page", F.explode("edges").alias("id")), "refs")
    for side in ("from_node", "to_node"):
        held = held.join(nodes.select("page", F.col("id").alias(side), F.lit(True).alias(f"_{side}")), ["page", side], "left")
    return held.select("page", "id", (F.col("_from_node").isNull() | F.col("_to_node").isNull()).alias("dangling"), (F.col("refs") > 0).alias("owned"))


def node_findings(nodes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(page, category, code, object_id, severity) of odd nodes."""
    bare = nodes.filter("type = 'conductor_end'").join(endpoints.select("page", F.col("node_id").alias("id")), ["page", "id"], "left_anti")
    made = [(nodes.filter("degree = 0"), "TOPOLOGY-NODE-ZERO-DEGREE"), (nodes.filter("type = 'splice' AND degree < 3"), "TOPOLOGY-NODE-LOW-DEGREE-SPLICE"), (bare, "TOPOLOGY-NODE-CONDUCTOR-END-WITHOUT-ENDPOINT")]
    return issues([df.select("page", F.lit("node").alias("category"), F.lit(code).alias("code"), F.col("id").alias("object_id"), F.lit("warning").alias("severity")) for df, code in made])


def net_membership(endpoints: DataFrame, members: DataFrame) -> DataFrame:
    """(page, id, nets, membership): ``members`` is (page, id) of endpoints in nets."""
    held = references(endpoints.select("page", "id"), members, "nets")
    return held.withColumn("membership", F.when(F.col("nets") == 0, "unowned").when(F.col("nets") == 1, "owned").otherwise("multi_owned"))


def coverage_findings(conductors: DataFrame, endpoints: DataFrame, edges: DataFrame, nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """All findings of the coverage tables, as (page, category, code, object_id, severity)."""

    def of(df: DataFrame, category: str, code: Column, severity: Column) -> DataFrame:
        return df.select("page", F.lit(category).alias("category"), code.alias("code"), F.col("id").alias("object_id"), severity.alias("severity")).filter("code IS NOT NULL")

    notice, warning = F.lit("notice"), F.lit("warning")
    o, c, m = F.col("ownership"), F.col("coverage"), F.col("membership")
    return issues([
        of(conductors, "conductor", F.when(o == "unreferenced", "CONDUCTOR-UNREFERENCED").when(o == "topology_only", "CONDUCTOR-TOPOLOGY-ONLY").when(o == "wire_only", "CONDUCTOR-WIRE-ONLY").when(o == "shared", "CONDUCTOR-SHARED"), F.when(o.isin("unreferenced", "wire_only"), warning).otherwise(notice)),
        of(endpoints, "endpoint", F.when(c == "zero_wire", "ENDPOINT-ZERO-WIRE").when(c == "multiple_wire", "ENDPOINT-MULTIPLE-WIRE"), notice),
        of(edges, "edge", F.when(F.col("dangling"), "TOPOLOGY-EDGE-DANGLING-REFERENCE").when(~F.col("owned"), "TOPOLOGY-EDGE-UNOWNED"), F.when(F.col("dangling"), warning).otherwise(notice)),
        nodes,
        of(membership, "net", F.when(m == "unowned", "NET-ENDPOINT-UNOWNED").when(m == "multi_owned", "NET-ENDPOINT-MULTI-OWNED"), F.when(m == "unowned", notice).otherwise(warning)),
    ])


def fingerprint(df: DataFrame, keys: list[str], id: str) -> DataFrame:
    """(keys, n, digest): a digest of a group's ids that does not depend on their order."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(id)), ","), 256).alias("digest"))


def model_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two tables has more often than the other, with ``side``."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
