"""Nearest neighbours by a block matrix join with int8 products and error bounds; the result is exact.

Vectors are packed into blocks. A block of queries meets each block of candidates once (a join on the candidate
block's number and the group of the query block, so that a key holds ``QUERY_GROUP`` tiles at most). For such a tile the
product of int8 codes gives each inner product up to a bound from the codes' residuals,
|qc - q'c'| <= |q - q'||c| + |q'||c - c'|. Pairs whose upper bound is below the k-th largest lower bound are out; the
others are computed again from the original vectors, and each query's heap keeps the best. Heaps of different tiles
merge by rank.

Every row is a query and a candidate of its own, whatever its id: a query's own row, that is one row with its id and
its vector, is no candidate, and other rows with the same id are. Tiles keep one row more than asked for, and the
best-placed twin of a query leaves after the merge.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without an id; rows that share an id are ranked apart, so an id that is repeated among the queries has as many lists;
vectors of different length never meet; ties go to the smaller id; sums beyond the range of doubles count as infinite; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NEAREST = 20
#: Every row whose id is divisible by this is a query.
QUERY_EVERY = 20
QUERY_BLOCK, CANDIDATE_BLOCK, QUERY_GROUP = 1024, 8192, 32


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the vectors that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda e: e != 0)
    return vectors.filter(F.coalesce(fine, F.lit(False))).select("vec_id", "embedding", F.size("embedding").alias("dim"))


def blocks(vectors: DataFrame, n: int, name: str) -> DataFrame:
    """(dim, name, uids, ids, vectors) with about ``count / n`` vectors in a row. Rows are dealt by number, so that copies
    of an id or a vector do not meet in one block."""
    numbered = vectors.withColumn("uid", F.monotonically_increasing_id())
    packed = numbered.groupBy("dim", F.pmod(F.xxhash64("uid"), F.lit(n)).alias(name)).agg(F.collect_list(F.struct("uid", "vec_id", "embedding")).alias("m"))
    return packed.select("dim", name, F.col("m.uid").alias(f"{name}_uids"), F.col("m.vec_id").alias(f"{name}_ids"), F.col("m.embedding").alias(f"{name}_vectors"))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32, in which their products are exact), scales, lengths of the decoded and of the residuals."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    scale[scale < np.finfo(np.float64).tiny] = 1.0  # codes of zero; the residual is the vector itself
    codes = np.clip(np.rint(x / scale), -127, 127).astype(np.int8)
    decoded = codes * scale
    return codes.astype(np.float32 if x.shape[1] <= 1040 else np.float64), scale, np.linalg.norm(decoded, axis=1), np.linalg.norm(x - decoded, axis=1)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the components."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def tile(qids: np.ndarray, q: np.ndarray, cids: np.ndarray, c: np.ndarray, k: int) -> Iterator[list[tuple[float, int, bool]]]:
    """For each query its k best of the tile as (-score, id, is no twin); a twin has the query's id and vector."""
    with np.errstate(over="ignore", invalid="ignore"):
        ccodes, cscale, _, cres = quantised(c)
        clen = np.linalg.norm(c, axis=1)
    for at in range(0, len(q), 256):
        part, ids = q[at : at + 256], qids[at : at + 256]
        with np.errstate(over="ignore", invalid="ignore"):
            qcodes, qscale, qlen, qres = quantised(part)
            near = (qcodes @ ccodes.T).astype(np.float64) * qscale * cscale.T
            # the last terms cover rounding in these sums themselves, and products too small for a double
            slack = qres[:, None] * clen + qlen[:, None] * cres + 1e-12 * (qlen[:, None] + qres[:, None]) * clen + 1e-300
            low, high = near - slack, near + slack
            kth = np.partition(np.where(np.isnan(low), -np.inf, low), -k, axis=1)[:, -k] if len(cids) > k else np.full(len(ids), -np.inf)
            rows, cols = np.nonzero(~(high < kth[:, None]))  # a bound that is no number keeps its pair
            scores = inner(part[rows], c[cols])
            scores[np.isnan(scores)] = np.inf
        other = (ids[rows] != cids[cols]) | (part[rows] != c[cols]).any(axis=1)
        ends = np.searchsorted(rows, np.arange(len(ids) + 1))
        for a, b in zip(ends[:-1], ends[1:]):
            yield heapq.nsmallest(k, zip((-scores[a:b]).tolist(), cids[cols[a:b]].tolist(), other[a:b].tolist()))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query of ``queries`` among ``vectors``."""
    vectors, queries = usable(vectors), usable(queries)
    nq, nc = max(1, -(-queries.count() // query_block)), max(1, -(-vectors.count() // candidate_block))
    groups = -(-nq // QUERY_GROUP)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    asked = blocks(queries, nq, "q").withColumn("g", F.pmod(F.col("q"), F.lit(groups))).withColumn("c", numbers(nc))
    tiles = asked.join(blocks(vectors, nc, "c").withColumn("g", numbers(groups)), ["dim", "c", "g"]).select("dim", "q_uids", "q_ids", "q_vectors", "c_ids", "c_vectors")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                uids, qids, cids = (batch.column(x)[i].values.to_numpy() for x in (1, 2, 4))
                q, c = (batch.column(x)[i].values.flatten().to_numpy().astype(np.float64).reshape(-1, dim) for x in (3, 5))
                found = [(u, n, v, -s, not other) for u, n, best in zip(uids.tolist(), qids.tolist(), tile(qids, q, cids, c, k + 1)) for s, v, other in best]
                cols = list(zip(*found)) if found else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=["uid", "query_id", "vec_id", "score", "twin"])

    found = tiles.mapInArrow(search, "uid long, query_id long, vec_id long, score double, twin boolean")
    best = Window.partitionBy("uid").orderBy(F.col("score").desc(), "vec_id", F.col("twin").desc())
    ranked = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    own = F.coalesce(F.min(F.when(F.col("twin"), F.col("place"))).over(Window.partitionBy("uid")), F.lit(k + 2))
    ranked = ranked.withColumn("own", own).filter("place <> own").withColumn("rank", F.col("place") - (F.col("place") > F.col("own")).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER () AS u, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.u AS u, q.vec_id AS query_id, c.vec_id AS vec_id, list_reduce(list_prepend(0::DOUBLE, list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND c.u <> q.u AND len(c.e) = len(q.e)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {NEAREST}
"""
