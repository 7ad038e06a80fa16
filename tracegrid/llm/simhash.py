"""Near-duplicates by SimHash fingerprints, with pivot distance tables that discard pairs.

A fingerprint has a bit set where over half the hashes of the text's 3-word shingles have it. Two fingerprints link
at 3 or fewer differing bits. The Hamming distances of every distinct fingerprint to ``N_PIVOTS`` reference fingerprints
(pivots) are computed once and written with it. By the triangle inequality a pair whose distances to any pivot differ by
more than 3 cannot link; all pairs that meet are held against all pivots, and only survivors are compared bit by bit.

Pivot coordinates are part of the join's key, too: a fingerprint goes to the cell of its distance to a pivot, and to the
cell below if it is near the border, so that fingerprints meet only if that coordinate lets them link. Coordinates alone
cannot keep pairs apart at scale (each lets about 46 % of random pairs pass), hence the other part of the key: of 5
blocks of bits, 3 differing bits leave 2 untouched, so linked fingerprints agree on at least one of the 10 pairs of
blocks. Large groups take the cells of more pivots, and what is still above ``CHUNK`` is dealt out as pairs of chunks.
Work within a group gives the group's components as stars, one row for each member at most.

Defined results: null and blank texts have fingerprint zero; texts of one or two words are one shingle; repeated rows
share a component; a null doc_id never names a component if another does; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tracegrid.operators.graph import connected_components

from .common import cut

SHINGLE, SEED, MAX_BITS = 3, 42, 3
BLOCKS = (13, 13, 13, 13, 12)
#: Reference fingerprints: hashes of 0, 1, 2, ...
N_PIVOTS = 32
#: Distances to a pivot in a cell of the join's key, and pivots that a group takes at most.
CELL, MOST_PIVOTS = 8, 6
#: Members of a group from which it takes one more pivot, and members that are compared at once.
CROWD, CHUNK = 64, 2048


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, as a signed long."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint_of(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def block_masks() -> list[int]:
    """For each pair of blocks, the mask of their bits as a signed long."""
    ends = np.cumsum((0, *BLOCKS))
    blocks = [((1 << b) - 1) << int(a) for a, b in zip(ends, BLOCKS)]
    masks = [x | y for x, y in combinations(blocks, len(BLOCKS) - MAX_BITS)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), SEED) for i in range(n)], dtype=np.uint64)


def distances(fp: Column) -> Column:
    """The row of the pivot table for one fingerprint: its Hamming distances to all pivots."""
    return F.array(*(F.bit_count(fp.bitwiseXOR(F.lit(int(p)))).cast("tinyint") for p in pivots().view(np.int64)))


def near_pairs(rows: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of ``rows``, of ``table``) whose largest difference of coordinates is ``MAX_BITS`` at most.

    Both hold one pivot's distances in a row.
    """
    return np.nonzero(np.abs(rows[:, :, None] - table[:, None, :]).max(axis=0) <= MAX_BITS)


def linked_stars(fps: np.ndarray, table: np.ndarray) -> list[tuple[int, int]]:
    """(member, smallest member of its component) for members other than the smallest, of one group.

    ``table`` holds a member's distances to the pivots in a row.
    """
    n, columns = len(fps), np.ascontiguousarray(table.T)
    adjacent = np.zeros((n, n), dtype=bool)
    step = max(1, (1 << 20) // columns.size)
    for at in range(0, n, step):
        i, j = near_pairs(columns[:, at : at + step], columns)
        near = np.bitwise_count(fps[i + at] ^ fps[j]) <= MAX_BITS
        adjacent[i[near] + at, j[near]] = True
    order, left, out = np.argsort(fps), np.ones(n, dtype=bool), []
    for root in order:
        if not left[root]:
            continue
        left[root] = False
        frontier = np.array([root])
        while len(frontier):
            frontier = np.nonzero(adjacent[frontier].any(axis=0) & left)[0]
            left[frontier] = False
            out += [(int(fps[x]), int(fps[root])) for x in frontier]
    return out


GROUP = ("c", "key", "cell", "i", "j")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: (c, key, cell, i, j, fp, pivots). A group is bounded by 2 * CHUNK or so; it may span batches."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    name, out = None, []

    def close() -> None:
        fps, first = np.unique(np.concatenate([x for x, _ in held]), return_index=True)
        if len(fps) > 1:
            out.extend(linked_stars(fps, np.concatenate([t for _, t in held])[first]))

    def made() -> pa.RecordBatch:
        pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in GROUP]
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(fps):
            continue
        table = batch.column("pivots").flatten().to_numpy(zero_copy_only=False).reshape(len(fps), -1)
        change = np.zeros(len(fps), dtype=bool)
        for col in cols:
            change[1:] |= col[1:] != col[:-1]
        starts = np.concatenate(([0], np.nonzero(change)[0], [len(fps)]))
        for a, b in zip(starts[:-1], starts[1:]):
            group = tuple(int(col[a]) for col in cols)
            if group != name and held:
                close()
                held = []
            name = group
            held.append((fps[a:b], table[a:b]))
        if len(out) > 10_000:
            yield made()
    if held:
        close()
    yield made()


def cells_of(pivot_distances: Column, first: Column, depth: Column) -> Column:
    """The cells, as hashes, in which a fingerprint meets others by ``depth`` pivots from number ``first`` on.

    A fingerprint goes to the cell of its distance and, if that is within ``MAX_BITS`` of the cell's start, to the cell
    below; two that can link share one of them for every pivot.
    """
    return F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(MOST_PIVOTS - 1)), lambda x: F.struct(x.alias("x"), F.element_at(pivot_distances, F.pmod(first + x, F.lit(N_PIVOTS)).cast("int") + 1).cast("int").alias("d"))),
        F.array(F.lit(0).cast("long")),
        lambda cells, p: F.when(p.x >= depth, cells).otherwise(F.flatten(F.transform(cells, lambda c: F.when(p.d % CELL < MAX_BITS, F.array(F.xxhash64(c, F.floor(p.d / CELL)), F.xxhash64(c, F.floor(p.d / CELL) - 1))).otherwise(F.array(F.xxhash64(c, F.floor(p.d / CELL))))))),
    )


def fingerprint_links(nodes: DataFrame, chunk: int = CHUNK, crowd: int = CROWD) -> DataFrame:
    """(a, b) pairs of distinct fingerprints that tie together all that link, from ``nodes`` (fp, distinct, and its
    ``pivots`` if they are there already)."""
    if "pivots" not in nodes.columns:
        nodes = nodes.withColumn("pivots", distances(F.col("fp")))
    keys = nodes.select("fp", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for c, m in enumerate(block_masks())))).alias("k")).select("fp", "k.c", "k.key")
    many = keys.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # one pivot more for each doubling of the group: it halves the pairs, and sends a member 1.4 times
    depth = F.least(F.greatest(F.ceil(F.log2(F.col("n") / crowd)), F.lit(0)), F.lit(MOST_PIVOTS))
    members = keys.join(many, ["c", "key"]).join(nodes.select("fp", "pivots"), "fp")
    placed = members.select("c", "key", "fp", "pivots", F.explode(cells_of(F.col("pivots"), F.col("c") * 3, depth)).alias("cell"), "n")
    crowds = placed.filter(F.col("n") > chunk).groupBy("c", "key", "cell").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"))
    met = placed.join(crowds, ["c", "key", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda x: F.struct(F.least(x, F.col("mine")).alias("i"), F.greatest(x, F.col("mine")).alias("j")))
    dealt = met.withColumn("mine", mine).select("c", "key", "cell", F.explode(pairs).alias("p"), "fp", "pivots").select("c", "key", "cell", "p.i", "p.j", "fp", "pivots")
    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(_stars, "a long, b long").distinct()


def components(prints: DataFrame) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of ``prints`` (doc_id, fp)."""
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("pivots", distances(F.col("fp"))), "nodes")
    # a node is ordered by its first document, so a component's root names it without another join
    key = F.struct(F.col("first").isNull().alias("none"), "first", "fp")
    side = lambda x: nodes.select(F.col("fp").alias(x), key.alias(f"{x}_key"))
    links = cut(fingerprint_links(nodes.select("fp", "pivots")), "links")  # read twice: for the ties and for their ends
    named = links.join(side("a"), "a").join(side("b"), "b")
    tied = connected_components(named, [], "a_key", "b_key").select(F.col("node.fp").alias("fp"), F.col("root.first").alias("named"), F.lit(True).alias("tied"))
    named = F.when(F.col("tied"), F.col("named")).otherwise(F.col("first")).alias("component_id")
    # written, so that joins with it deal both sides anew and Spark can split those of a fingerprint with many copies
    return cut(nodes.join(tied, "fp", "left").select("fp", named), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) of every document."""
    prints = cut(docs.select("doc_id", fingerprint_of("text").alias("fp")), "prints")
    return prints.join(components(prints), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id (null last; of repeated rows, one)."""
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    held = cut(docs.select(row, F.monotonically_increasing_id().alias("uid"), fingerprint_of("text").alias("fp")), "prints")
    thin = held.select(F.col("row.doc_id").alias("doc_id"), "uid", "fp")
    best = thin.join(components(thin), "fp").groupBy(F.coalesce("component_id", "fp").alias("c"), F.col("component_id").isNull()).agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid")).alias("best"))
    return held.join(best.select(F.col("best.uid").alias("uid")), "uid", "left_semi").select("row.*")
