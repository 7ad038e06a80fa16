"""Graphs as edge tables: connected components, conductors walked end to end, single linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.functions.geometry import box_gap2, box_of
from tracegrid.functions.shared import cut
from tracegrid.operators.spatial import range_join
from tracegrid.operators.topology import PAGE


def connected_components(edges: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, node, root): the smallest node that each node reaches.

    Rounds of large-star and small-star (Kiveris et al., SoCC 2014); every round is one written table, and the number
    of rounds grows with the logarithm of the longest path.
    """
    ends = edges.select(*keys, F.col(a).alias("a"), F.col(b).alias("b"))
    links = cut(ends.filter("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    nodes = ends.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct()
    state = None
    while True:
        both = links.unionByName(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        pairs = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y"))))
        links = cut(large.join(low, [*keys, "a"]).select(*keys, pairs.alias("e")).select(*keys, F.col("e.x").alias("a"), F.col("e.y").alias("b")).filter("a <> b").distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    tied = links.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.join(tied, [*keys, "node"], "left").select(*keys, "node", F.coalesce("root", "node").alias("root"))


def page_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(page, node, root) as ``connected_components`` gives them, in one shuffle: a page's graph is bounded by the sheet
    it was drawn on, so each page is joined up in memory. Graphs that grow with the data take the rounds above."""
    import pyarrow as pa

    def join_up(table):
        tails, heads = table.column("a").to_pylist(), table.column("b").to_pylist()
        # numbered in order of their names, so that the least name of a component is its least number
        nodes = sorted({*tails, *heads})
        at = {n: i for i, n in enumerate(nodes)}
        up = list(range(len(nodes)))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        for x, y in zip(tails, heads):
            x, y = top(at[x]), top(at[y])
            if x != y:
                up[max(x, y)] = min(x, y)
        return _rows(table, [(nodes[i], nodes[top(i)]) for i in range(len(nodes))], node=pa.string(), root=pa.string())

    ends = edges.select(*PAGE, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"))
    return ends.groupBy(*PAGE).applyInArrow(join_up, "source_id string, page long, node string, root string")


def connective_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between connective nodes."""
    crossing = nodes.filter("NOT connective").select(*PAGE, F.col("id").alias("_n"))
    for side in ("from_node", "to_node"):
        edges = edges.join(crossing.withColumnRenamed("_n", side), [*PAGE, side], "left_anti")
    return edges


def single_linkage(boxes: DataFrame, id: str, radius: float) -> DataFrame:
    """(page, node, root): clusters of boxes (bx, by, bw, bh) whose gaps are at most ``radius``."""
    side = lambda p: boxes.select(*PAGE, *(F.col(c).cast("double").alias(f"{p}{c}") for c in ("bx", "by", "bw", "bh")), F.col(id).alias(f"{p}id"))
    near = range_join(side("l"), side("r"), box_of("l"), box_of("r"), radius, PAGE, "lid", "rid").filter("lid <= rid").filter(box_gap2(box_of("l"), box_of("r")) <= radius * radius)
    return page_components(near, "lid", "rid")


WIRE_SCHEMA = "source_id string, page long, pass int, start_endpoint string, end_endpoint string, edges array<string>, segments array<string>, status string"
STOP_SCHEMA = "source_id string, page long, endpoint_id string, node_id string, reason string"


#: Types of nodes at which a conductor spreads.
SPREAD = ["splice", "junction"]


class PageGraph:
    """The graph of one page in memory (a page has some hundreds of edges); ``nodes`` are those that spread."""

    def __init__(self, edges, nodes, endpoints):
        self.ends = {e: (a, b) for e, a, b in zip(edges["id"], edges["from_node"], edges["to_node"])}
        self.segment = dict(zip(edges["id"], edges["seg"]))
        self.at: dict[str, list[str]] = {}
        for e, pair in sorted(self.ends.items()):
            for n in pair:
                self.at.setdefault(n, []).append(e)
        self.spread = set(nodes["id"])
        usable = [(i, n) for i, n, kind in zip(endpoints["id"], endpoints["node_id"], endpoints["kind"]) if kind not in ("splice", "unresolved")]
        self.terminal = {n: i for i, n in sorted(usable, reverse=True)}

    def far(self, edge: str, node: str) -> str:
        a, b = self.ends[edge]
        return b if a == node else a

    def onward(self, node: str, edge: str) -> list[str]:
        """Edges that carry the conductor on beyond ``node``: the only other one at a plain node of degree 2, else
        those of the same segment."""
        others = [e for e in self.at[node] if e != edge]
        if len(self.at[node]) == 2 and node not in self.spread:
            return others
        return [e for e in others if self.segment[e] and self.segment[e] == self.segment[edge]]

    def pieces(self, path: list[str]) -> list[str]:
        return list(dict.fromkeys(self.segment[e] for e in path if self.segment[e]))

    def seeds(self) -> list[tuple[str, str]]:
        return sorted((i, n) for n, i in self.terminal.items() if len(self.at.get(n, ())) == 1)

    def plain_walk(self, seed: str, terminal: dict[str, str]) -> tuple[str | None, str, list[str], str]:
        """(other endpoint, last node, path, why it ended) of a walk through nodes of degree 2 only."""
        edge = self.at[seed][0]
        node, path, seen = self.far(edge, seed), [edge], {seed}
        while True:
            if node in seen:
                return None, node, path, "cycle"
            seen.add(node)
            if node in terminal:
                return terminal[node], node, path, "terminal"
            if len(self.at[node]) != 2:
                return None, node, path, "distribution" if node in self.spread else "dead_end" if len(self.at[node]) == 1 else "crossing"
            on = self.onward(node, edge)
            if not on:
                return None, node, path, "distribution"
            edge = on[0]
            node = self.far(edge, node)
            path.append(edge)

    def plain_wires(self) -> list[tuple[str, str, list[str]]]:
        """Unambiguous wires, once each: from the smaller endpoint."""
        found = []
        for i, n in self.seeds():
            other, _, path, _ = self.plain_walk(n, self.terminal)
            if other is not None and i <= other and other != i:
                found.append((i, other, path))
        return found

    def segment_wires(self, claimed: set[str]) -> dict[tuple[str, str], tuple[list[str], list[str], bool]]:
        """Wires among unclaimed endpoints that follow one segment through nodes of any degree. A fork of equal
        claims is opened once, by the first walk to reach it, and marks all that comes of it as conflicted. No edge is
        walked twice, but a conductor that crosses itself passes that node twice."""
        free = {n: i for n, i in self.terminal.items() if i not in claimed and len(self.at.get(n, ())) == 1}
        opened: set[tuple[str, str]] = set()
        found: dict[tuple[str, str], tuple[list[str], list[str], bool]] = {}
        for i, seed in sorted((i, n) for n, i in free.items()):
            edge = self.at[seed][0]
            todo = [(self.far(edge, seed), edge, (edge,), (), False)]
            while todo:
                node, edge, path, proof, doubt = todo.pop()
                if node in free:
                    pair = (min(i, free[node]), max(i, free[node]))
                    if pair[0] != pair[1]:
                        old = found.get(pair)
                        found[pair] = (old[0], old[1], old[2] or doubt) if old else (list(path), list(proof), doubt)
                    continue
                on = self.onward(node, edge)
                fork = len(self.at[node]) != 2
                if len(on) > 1:
                    if (node, self.segment[edge]) in opened:
                        continue
                    opened.add((node, self.segment[edge]))
                todo += [(self.far(e, node), e, (*path, e), (*proof, self.segment[edge]) if fork else proof, doubt or len(on) > 1) for e in reversed(on) if e not in path]
        return found


def _by_page(edges: DataFrame, nodes: DataFrame, endpoints: DataFrame):
    """The three tables of a page side by side, tagged by ``t``; of the nodes only those that spread, as walks ask for no
    others."""
    blank = lambda *cs: [F.lit(None).cast("string").alias(c) for c in cs]
    e = edges.select(*PAGE, F.lit("e").alias("t"), "id", "from_node", "to_node", "seg", *blank("type", "node_id", "kind"))
    n = nodes.filter(F.col("type").isin(*SPREAD)).select(*PAGE, F.lit("n").alias("t"), "id", *blank("from_node", "to_node", "seg"), "type", *blank("node_id", "kind"))
    p = endpoints.select(*PAGE, F.lit("p").alias("t"), "id", *blank("from_node", "to_node", "seg", "type"), "node_id", "kind")
    return e.unionByName(n).unionByName(p).groupBy(*PAGE)


def _graph(table) -> PageGraph:
    import pyarrow.compute as pc

    each = lambda part: {c: part.column(c).to_pylist() for c in ("id", "from_node", "to_node", "seg", "node_id", "kind")}
    return PageGraph(*(each(table.filter(pc.equal(table.column("t"), t))) for t in "enp"))


def _rows(table, rows: list[tuple], **kinds):
    """The Arrow table of ``rows``, columns of ``kinds``, with the page of ``table`` before them."""
    import pyarrow as pa

    n, columns = len(rows), zip(*rows) if rows else [()] * len(kinds)
    whose = {"source_id": pa.array([table.column("source_id")[0].as_py()] * n, pa.string()), "page": pa.array([table.column("page")[0].as_py()] * n, pa.int64())}
    return pa.table(whose | {name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), columns)})


def wires(edges: DataFrame, nodes: DataFrame, endpoints: DataFrame, passes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(page, pass, start_endpoint, end_endpoint, edges in order, segments, status): pass 1 are unambiguous conductors,
    pass 2 those that one segment carries through distribution nodes and crossings. Only ``passes`` are given, and a pass
    that they do not need is not walked."""
    import pyarrow as pa

    def walk(table):
        g, text = _graph(table), pa.string()
        first = g.plain_wires()
        rows = [(1, a, b, path, g.pieces(path), "resolved") for a, b, path in first] if 1 in passes else []
        second = g.segment_wires({x for a, b, _ in first for x in (a, b)}) if 2 in passes else {}
        rows += [(2, a, b, path, g.pieces(path), "conflicted" if doubt else "resolved") for (a, b), (path, _, doubt) in sorted(second.items())]
        return _rows(table, rows, **{"pass": pa.int32(), "start_endpoint": text, "end_endpoint": text, "edges": pa.list_(text), "segments": pa.list_(text), "status": text})

    return _by_page(edges, nodes, endpoints).applyInArrow(walk, WIRE_SCHEMA)


def walk_stops(edges: DataFrame, nodes: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(page, endpoint_id, node_id, reason): where and why the plain walk from each endpoint ends."""
    import pyarrow as pa

    def walk(table):
        g, text = _graph(table), pa.string()
        rows = [(i, *(lambda w: (w[1], w[3]))(g.plain_walk(n, g.terminal))) for i, n in g.seeds()]
        return _rows(table, rows, endpoint_id=text, node_id=text, reason=text)

    return _by_page(edges, nodes, endpoints).applyInArrow(walk, STOP_SCHEMA)


def tree_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(page, root, start, node, path): the edges on the way from each component's ``start`` to every other node, or to those
    of ``targets`` (page, node) only.

    ``edges`` (page, root, id, from_node, to_node) are trees, ``starts`` (page, root, start) one node of each. Nodes know
    the edge that they were reached by, and only the nodes asked for walk back to the start.
    """
    import pandas as pd

    every = targets is None
    asked = starts.select(*PAGE, "root", F.col("start").alias("node"), F.lit(True).alias("begins"))
    if not every:
        asked = asked.unionByName(targets.select(*PAGE, F.lit(None).cast("string").alias("root"), "node", F.lit(False).alias("begins")))

    def spread(key, e, s):
        at: dict[str, list[tuple[str, str]]] = {}
        for i, a, b in zip(e["id"], e["from_node"], e["to_node"]):
            at.setdefault(a, []).append((i, b))
            at.setdefault(b, []).append((i, a))
        begins = s["begins"].astype(bool)
        wanted = set(s["node"][~begins])
        rows = []
        for root, start in zip(s["root"][begins], s["node"][begins]):
            back: dict[str, tuple[str, str] | None] = {start: None}
            todo = [start]
            while todo:
                node = todo.pop()
                for i, other in at.get(node, ()):
                    if other not in back:
                        back[other] = (i, node)
                        todo.append(other)
                        if every or other in wanted:
                            path, step = [], back[other]
                            while step:
                                path.append(step[0])
                                step = back[step[1]]
                            rows.append((key[0], key[1], root, start, other, path[::-1]))
        return pd.DataFrame(rows, columns=["source_id", "page", "root", "start", "node", "path"])

    return edges.groupBy(*PAGE).cogroup(asked.groupBy(*PAGE)).applyInPandas(spread, "source_id string, page long, root string, start string, node string, path array<string>")
