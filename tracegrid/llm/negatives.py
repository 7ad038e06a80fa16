"""Hard negatives by blocked dense products in float64, exact below 2**53.

Components become whole numbers, floor(256 x). Anchors go to blocks and rows to groups; a block of anchors is sent to
every group, where it is a matrix in the task's memory, and the group's rows stream past it in batches. A first pass
keeps each anchor's best ``POSITIVES`` rows of its label; these lists merge across groups by rank. A second pass, in the
same grid, takes the anchors with their positives and keeps, for each positive, the first ``NEGATIVES`` rows of other
labels whose score lies in the positive's window. Blocks hold a fixed number of values, so a task's memory does not grow
with the data; anchors travel once for a group and rows once for a block of anchors. Rows are dealt by number, so no
label, id or repeated vector gathers in one task.

Defined results: rows without an id, label or vector, or with a null or non-finite component, take no part; empty
vectors score 0; vectors of different length never meet; rows that share an id are rows of their own, so an id that is
repeated among the anchors has as many lists, and a row is never its own positive but another row with its id is; ties go
to the smaller id; scores of 2**53 or more are rounded and held within a long; an empty table gives an empty result.
Other columns play no part, whatever their names.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

ANCHOR_EVERY, SHIFT_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is 50 to 95 hundredths of the positive's.
LOW, HIGH = 50, 95
#: Values of a block of anchors and of a group of rows: 16,384 vectors of 64 components.
BLOCK_VALUES = GROUP_VALUES = 1 << 20
#: Rows and anchors of one product.
ROWS, ANCHORS = 1024, 2048
NONE = -np.inf


def whole_rows(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(uid, vec_id, label, code, dim) of the rows that take part, with code = floor(scale x), written once."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))
    label = F.when(F.col("vec_id") % SHIFT_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).cast("long")
    whole = lambda e: F.when(F.abs(e) < 2.0**52, F.floor(e).cast("double")).otherwise(e)
    code = F.transform(x, lambda e: whole(e.cast("double") * scale))
    rows = vectors.filter(fine).select("vec_id", label.alias("label"), code.alias("code"), F.size(x).alias("dim"))
    return cut(rows.withColumn("uid", F.monotonically_increasing_id()), "whole-vectors")


def grid(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Anchors (uid, vec_id, label, code, dim, positives) and rows in the order in which ``mine`` takes them."""
    values = F.coalesce(F.sum(F.greatest("dim", F.lit(1))), F.lit(0)).alias("n")
    blocks, groups = (max(1, -(-df.agg(values).first()["n"] // size)) for df, size in ((anchors, BLOCK_VALUES), (rows, GROUP_VALUES)))
    own = lambda n, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    none = F.array().cast("array<double>")
    a = anchors.withColumns({"block": own(blocks, 1), "group": every(groups), "side": F.lit(0)})
    r = rows.withColumns({"positives": none, "block": every(blocks), "group": own(groups, 2), "side": F.lit(1)})
    met = a.unionByName(r).repartition("dim", "block", "group").sortWithinPartitions("dim", "block", "group", "side")
    return met.select("dim", "block", "group", "side", "uid", "vec_id", "label", "code", "positives")


class Best:
    """The k best (score, id) of each anchor and list, held as arrays; ties go to the smaller id."""

    def __init__(self, lists: tuple[int, ...], k: int):
        self.k = k
        self.scores, self.ids = np.full((*lists, k), NONE), np.zeros((*lists, k), dtype=np.int64)

    def add(self, at: tuple, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (anchors, rows), of rows in order of ``ids``, which this overwrites."""
        n = np.arange(len(scores))
        found, names = np.full((len(scores), self.k), NONE), np.zeros((len(scores), self.k), dtype=np.int64)
        for j in range(min(self.k, scores.shape[1])):
            col = scores.argmax(axis=1)  # the first of equal scores, so the smallest id
            found[:, j], names[:, j] = scores[n, col], ids[col]
            if (found[:, j] == NONE).all():
                break
            scores[n, col] = NONE
        found, names = np.concatenate([self.scores[at], found], axis=1), np.concatenate([self.ids[at], names], axis=1)
        order = np.lexsort((names, -found), axis=1)[:, : self.k]
        self.scores[at], self.ids[at] = np.take_along_axis(found, order, 1), np.take_along_axis(names, order, 1)


def windows(positives: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score of a negative, for scores of positives; an empty window where there is none."""
    real = np.isfinite(positives)
    p = np.where(real, positives, 0)
    lo, hi = np.ceil(p * LOW / 100), np.floor(p * HIGH / 100)
    exact = np.abs(p) < 2.0**46
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.where(exact, p, 0).astype(np.int64)
    lo, hi = np.where(exact, -((-whole * LOW) // 100), lo), np.where(exact, whole * HIGH // 100, hi)
    return np.where(real, lo, np.inf), np.where(real, hi, NONE)


def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of ``grid``: (uid, vec_id, list, score, found) for each block, group and anchor.

    Anchors with positives look for negatives, one list for each positive; the others look for positives.
    """
    key, held, best = None, [], None

    def gather():
        """Arrays of the anchors held, in order of uid."""
        uid, ids, label, code, pos = (np.concatenate([h[i] for h in held]) if i != 4 else [p for h in held for p in h[4]] for i in range(5))
        order = np.argsort(uid, kind="stable")
        width = max((len(p) for p in pos), default=0)
        table = np.full((len(uid), width), np.nan)
        for i, p in enumerate(pos):
            table[i, : len(p)] = p
        return uid[order], ids[order], label[order], code[order], table[order]

    def done():
        if best is not None:
            uid, ids = anchors[0], anchors[1]
            at = np.nonzero(best.scores > NONE)
            lists = at[1] if best.scores.ndim == 3 else np.zeros(len(at[0]), dtype=np.int64)
            score = np.clip(best.scores[at], -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
            kinds = (uid[at[0]], ids[at[0]], lists, score, best.ids[at])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in kinds], names=["uid", "anchor_id", "list", "score", "found"])

    for batch in batches:
        head = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1).astype(np.int64)
        uid, ids, label = (batch.column(i).to_numpy() for i in (4, 5, 6))
        cuts = np.nonzero((head[1:] != head[:-1]).any(axis=1))[0] + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(head)]):
            if a == b:
                continue
            now, side = tuple(head[a, :3].tolist()), head[a, 3]
            if now != key:
                yield from done()
                key, held, best, anchors = now, [], None, None
            dim = now[0]
            code = batch.column(7)[a:b].flatten().to_numpy().reshape(b - a, dim)
            if side == 0:
                held.append((uid[a:b], ids[a:b], label[a:b], code, batch.column(8)[a:b].to_pylist()))
                continue
            if not held:
                continue
            if best is None:
                anchors = gather()
                width = anchors[4].shape[1]
                best = Best((len(anchors[0]), width), NEGATIVES) if width else Best((len(anchors[0]),), POSITIVES)
            for c in range(a, b, ROWS):
                d = min(c + ROWS, b)
                order = np.argsort(ids[c:d], kind="stable")
                meet(anchors, best, uid[c:d][order], ids[c:d][order], label[c:d][order], code[c - a : d - a][order])
    yield from done()


def meet(anchors: tuple, best: Best, uid: np.ndarray, ids: np.ndarray, label: np.ndarray, code: np.ndarray) -> None:
    """Hold a batch of rows, in order of id, against all anchors of the block."""
    for at in range(0, len(anchors[0]), ANCHORS):
        part = slice(at, at + ANCHORS)
        a_uid, _, a_label, a_code, positives = (x[part] for x in anchors)
        with np.errstate(over="ignore", invalid="ignore"):
            scores = np.nan_to_num(a_code @ code.T, nan=np.finfo(float).max, posinf=np.finfo(float).max, neginf=-np.finfo(float).max)
        same = a_label[:, None] == label[None, :]
        if positives.shape[1]:
            lo, hi = windows(positives)
            scores[same] = NONE
            for j in range(positives.shape[1]):
                best.add((part, j), np.where((scores >= lo[:, j, None]) & (scores <= hi[:, j, None]), scores, NONE), ids)
        else:
            scores[~same] = NONE
            i = np.searchsorted(a_uid, uid)
            own = (i < len(a_uid)) & (a_uid[np.minimum(i, len(a_uid) - 1)] == uid)
            scores[i[own], np.nonzero(own)[0]] = NONE
            best.add((part,), scores, ids)


_FOUND = "uid long, anchor_id long, list long, score long, found long"


def hard_negatives(vectors: DataFrame, every: int = ANCHOR_EVERY) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = whole_rows(vectors)
    anchors = rows.filter(F.col("vec_id") % every == 0)
    first = lambda *by: Window.partitionBy("uid", *by).orderBy(F.col("score").desc(), "found")
    near = grid(anchors.withColumn("positives", F.array().cast("array<double>")), rows).mapInArrow(mine, _FOUND)
    near = near.withColumn("place", F.row_number().over(first())).filter(F.col("place") <= POSITIVES)
    # at most five pairs an anchor, in order of rank; written as both the second pass and its result need them
    known = cut(near.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("place", F.col("found").alias("id"), "score"))).alias("best")), "positives")
    asked = anchors.join(known.select("uid", F.transform("best", lambda b: b["score"].cast("double")).alias("positives")), "uid")
    far = grid(asked.select(*rows.columns, "positives"), rows).mapInArrow(mine, _FOUND)
    far = far.withColumn("rank", F.row_number().over(first("list"))).filter(F.col("rank") <= NEGATIVES)
    positive = known.select("uid", F.posexplode("best").alias("list", "p")).select("uid", F.col("list").cast("long").alias("list"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return far.join(positive, ["uid", "list"]).select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS u, vec_id, CASE WHEN vec_id % {SHIFT_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.u, a.vec_id AS anchor_id, a.label AS mine, c.vec_id, c.label AS other,
         list_reduce(list_prepend(0::BIGINT, list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])), lambda x, y: x + y) AS score
  FROM v a JOIN v c ON a.vec_id % {ANCHOR_EVERY} = 0 AND c.u <> a.u AND len(c.e) = len(a.e)
), p AS (
  SELECT * FROM (SELECT u, anchor_id, mine, vec_id AS positive_id, score AS ps, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id) AS place FROM s WHERE other = mine) WHERE place <= {POSITIVES}
), n AS (
  SELECT p.u, place, p.anchor_id, positive_id, ps, s.vec_id, score, row_number() OVER (PARTITION BY p.u, place ORDER BY score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.u = p.u AND other <> p.mine AND {LOW} * ps <= 100 * score AND 100 * score <= {HIGH} * ps
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, vec_id AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE rank <= {NEGATIVES}
"""
