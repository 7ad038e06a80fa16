"""Product codes of vectors: weighted Lloyd rounds over the distinct integer parts of each position.

Components become whole numbers, floor(4096 x), and a vector is cut into ``PARTS`` consecutive parts. Equal parts of a
position become one row with a weight. These rows are packed into blocks once; in each round a block meets its position's
codebook (a table of 16 entries a position), is assigned in numpy and gives sums and counts for each entry, which add up
to the next codebook. Codes and errors of the distinct parts then go back to the vectors by a join on the part itself.
No part, vector or label meets in one task whole: blocks are dealt by the part's hash, sums are partial, and the joins
are equi-joins that adaptive execution may split.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; rows without an id are
kept, last in the order of seeds; rows that share an id are rows of their own, in order of their components; vectors of
each length have codebooks of their own (and so a digest of their own); a length that 8 does not divide is cut at
floor(i length / 8), and an empty part has the empty entry, at distance 0; with fewer than 16 rows a codebook has as many
entries as rows; components beyond 2**62 count as 2**62 and errors beyond a long as the greatest long; an empty table
gives an empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Parts of a block, about.
BLOCK = 4096
MOST = 2**63 - 1
_KEY = ["dim", "part"]


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(uid, vec_id, label, dim, code) of the rows that are kept, written once."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = lambda e: F.floor(F.greatest(F.least(e.cast("double") * SCALE, F.lit(2.0**62)), F.lit(-(2.0**62)))).cast("long")
    rows = vectors.filter(x.isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", "label", F.size(x).alias("dim"), F.transform(x, whole).alias("code"))
    return cut(rows.withColumn("uid", F.monotonically_increasing_id()), "coded-vectors")


def parts_of(rows: DataFrame, *keep: str) -> DataFrame:
    """(dim, ``keep``, part, value): the consecutive parts of ``code``."""
    begin = lambda i: F.floor(F.col("dim") * i / PARTS).cast("int")
    cells = F.array(*(F.struct(F.lit(i).alias("part"), F.slice("code", begin(i) + 1, begin(i + 1) - begin(i)).alias("value")) for i in range(PARTS)))
    return rows.select("dim", *keep, F.explode(cells).alias("p")).select("dim", *keep, "p.part", "p.value")


def seeds(rows: DataFrame) -> DataFrame:
    """The first codebooks (dim, part, entries): parts of the rows with the smallest ids, an array in order of index."""
    order = Window.partitionBy("dim").orderBy(F.col("vec_id").asc_nulls_last(), "code")
    first = rows.select("dim", "vec_id", "code").withColumn("e", F.row_number().over(order)).filter(F.col("e") <= ENTRIES)
    listed = parts_of(first, "e").groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("e", "value"))).alias("s"))
    return listed.select(*_KEY, F.transform("s", lambda s: s["value"]).alias("entries"))


def blocks(rows: DataFrame) -> DataFrame:
    """(dim, part, b, weights, values): the distinct parts of each position, about ``BLOCK`` in a row; written once."""
    distinct = parts_of(rows).groupBy(*_KEY, "value").agg(F.count(F.lit(1)).alias("weight"))
    n = max(1, -(-rows.count() // BLOCK))
    packed = distinct.groupBy(*_KEY, F.pmod(F.xxhash64("value"), F.lit(n)).alias("b")).agg(F.collect_list(F.struct("weight", "value")).alias("m"))
    return cut(packed.select(*_KEY, "b", F.col("m.weight").alias("weights"), F.col("m.value").alias("values")), "part-blocks")


def distances(values: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (values, entries), exact: in integers of 64 bits, or in Python's beyond them."""
    top = max((int(np.abs(x).max()) for x in (values, entries) if x.size), default=0)
    kind = np.int64 if max(values.shape[1], 1) * (2 * top) ** 2 < 2**63 else object
    total = np.zeros((len(values), len(entries)), dtype=kind)
    for i in range(values.shape[1]):
        off = values[:, i, None].astype(kind) - entries[None, :, i].astype(kind)
        total += off * off
    return total


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each block (dim, part, weights, values, entries): its values, weights, nearest entries and squared distances."""
    for batch in batches:
        for i in range(batch.num_rows):
            dim, part = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            width = dim * (part + 1) // PARTS - dim * part // PARTS
            weights, values, entries = batch.column(2)[i].values.to_numpy(), _matrix(batch.column(3)[i].values, width), _matrix(batch.column(4)[i].values, width)
            far = distances(values, entries)
            near = far.argmin(axis=1)
            yield dim, part, len(entries), values, weights, near, far[np.arange(len(near)), near]


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, part, e, weight, totals) of each block; totals as text, as they may pass a long."""
    for dim, part, k, values, weights, near, _ in assigned(batches):
        big = np.abs(values).max(initial=0) >= 2.0**62 / max(int(weights.sum()), 1)
        scaled = values.astype(object) * weights.astype(object)[:, None] if big else values * weights[:, None]
        used = np.unique(near)
        totals = [[str(t) for t in scaled[near == e].sum(axis=0)] for e in used]
        cols = (pa.array([dim] * len(used), pa.int32()), pa.array([part] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array([int(weights[near == e].sum()) for e in used], pa.int64()), pa.array(totals, pa.list_(pa.string())))
        yield pa.RecordBatch.from_arrays(list(cols), names=["dim", "part", "e", "weight", "totals"])


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, part, value, entry, error) of each distinct part."""
    for dim, part, _, values, _, near, error in assigned(batches):
        error = np.minimum(error, MOST).astype(np.int64)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1), pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([dim] * len(near), pa.int32()), pa.array([part] * len(near), pa.int32()), rows, pa.array(near, pa.int32()), pa.array(error, pa.int64())], names=["dim", "part", "value", "entry", "error"])


def lloyd_round(packed: DataFrame, codebooks: DataFrame) -> DataFrame:
    """The next codebooks: each entry the floor of its parts' mean; entries that no part is nearest to stay."""
    met = packed.join(codebooks, _KEY).select(*_KEY, "weights", "values", "entries")
    partial = met.mapInArrow(sums, "dim int, part int, e int, weight long, totals array<string>")
    at = partial.select(*_KEY, "e", "weight", F.posexplode_outer("totals").alias("pos", "total"))
    added = at.groupBy(*_KEY, "e", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("weight").alias("n")).filter("pos IS NOT NULL")
    moved = added.select(*_KEY, "e", "pos", F.expr("CAST((total - pmod(total, CAST(n AS DECIMAL(38,0)))) div n AS BIGINT)").alias("c"))
    listed = moved.groupBy(*_KEY, "e").agg(F.sort_array(F.collect_list(F.struct("pos", "c"))).alias("s")).select(*_KEY, "e", F.transform("s", lambda s: s["c"]).alias("new"))
    old = codebooks.select(*_KEY, F.posexplode("entries").alias("e", "old"))
    both = old.join(listed, [*_KEY, "e"], "left").groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("e", F.coalesce("new", "old").alias("value")))).alias("s"))
    return both.select(*_KEY, F.transform("s", lambda s: s["value"]).alias("entries"))


def trained(rows: DataFrame, packed: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The codebooks (dim, part, entries) after ``rounds``; each round is written, so that the next does not repeat it."""
    codebooks = cut(seeds(rows), "codebook")
    for _ in range(rounds):
        codebooks = cut(lloyd_round(packed, codebooks), "codebook")
    return codebooks


def compressed(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256)."""
    rows = whole_vectors(vectors)
    packed = blocks(rows)
    codebooks = trained(rows, packed)
    known = packed.join(codebooks, _KEY).select(*_KEY, "weights", "values", "entries").mapInArrow(coded, "dim int, part int, value array<bigint>, entry int, error long")
    met = parts_of(rows, "uid").join(known, [*_KEY, "value"])
    exact = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    cells = met.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("part", "entry"))).alias("c"), exact("error").alias("error"))
    code = F.array_join(F.transform("c", lambda c: F.lower(F.lpad(F.hex(c["entry"].cast("long")), 2, "0"))), "")
    text = F.sort_array(F.collect_list(F.struct("part", F.array_join(F.flatten("entries").cast("array<string>"), ",").alias("t"))))
    digest = F.sha2(F.array_join(F.filter(F.transform(text, lambda p: p["t"]), lambda t: t != ""), ","), 256)
    digests = codebooks.groupBy("dim").agg(digest.alias("codebooks_sha256"))
    done = cut(rows.select("uid", "vec_id", "label", "dim").join(cells.select("uid", code.alias("code"), "error"), "uid").join(digests, "dim"), "codes")
    labels = done.groupBy(F.col("label").alias("of")).agg(exact("error").alias("label_error"))
    return done.join(labels, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def oracle() -> str:
    """The whole method as SQL, for vectors of one length that 8 divides."""
    rounds = "".join(
        f""", b{i} AS MATERIALIZED (SELECT d.part, d.v, d.w, min(struct_pack(dist := list_sum(list_transform(range(1, len(d.v) + 1), lambda i: (d.v[i] - k.v[i]) * (d.v[i] - k.v[i]))), e := k.e)) AS best FROM d JOIN k{i} k ON k.part = d.part GROUP BY ALL)"""
        + (
            f""", m{i} AS (SELECT part, e, list(c ORDER BY i) AS v FROM (SELECT part, best.e AS e, i, ((sum(v[i]::HUGEINT * w) - ((sum(v[i]::HUGEINT * w) % sum(w)) + sum(w)) % sum(w)) // sum(w))::BIGINT AS c FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM b{i}) GROUP BY ALL) GROUP BY ALL)
, k{i + 1} AS MATERIALIZED (SELECT k.part, k.e, coalesce(m.v, k.v) AS v FROM k{i} k LEFT JOIN m{i} m ON m.part = k.part AND m.e = k.e)"""
            if i < ROUNDS
            else ""
        )
        for i in range(ROUNDS + 1)
    )
    return f"""
WITH r AS MATERIALIZED (
  SELECT row_number() OVER () AS u, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS c FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (SELECT u, vec_id, c, part, c[part * (len(c) // {PARTS}) + 1 : (part + 1) * (len(c) // {PARTS})] AS v FROM r, (SELECT unnest(range({PARTS})) AS part))
, d AS MATERIALIZED (SELECT part, v, count(*) AS w FROM p GROUP BY ALL)
, k0 AS MATERIALIZED (SELECT part, e, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, c) - 1 AS e FROM p) WHERE e < {ENTRIES}){rounds}
, f AS (SELECT p.u, string_agg(printf('%02x', b.best.e), '' ORDER BY p.part) AS code, sum(b.best.dist)::BIGINT AS error FROM p JOIN b{ROUNDS} b ON b.part = p.part AND b.v = p.v GROUP BY p.u)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) FROM k{ROUNDS}) AS codebooks_sha256 FROM f JOIN r ON r.u = f.u
"""


ORACLE = oracle()
