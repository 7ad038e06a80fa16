import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tracegrid.llm import codes, negatives, registry

#: Columns with the operators' own names come along.
VECTORS = "vec_id long, embedding array<float>, label int, uid long, dim int, code string, block int, group string, part int, entries string"


def odd_vectors():
    """Nulls in every column, vectors that are empty, of other lengths, equal or not finite, repeated ids and rows, ties."""
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.3, 1.0]) for _ in range(8)], i % 3) for i in range(0, 260)]
    rows += [(i, [0.5] * 8, 1) for i in range(300, 420)] + [(50, [0.3] * 8, 2), (50, [0.3] * 8, 2), (100, [1.0] * 8, None)]
    rows += [(None, [0.1] * 8, 1), (7, None, 1), (8, [], 1), (350, [], 1), (400, [], 0), (9, [1.0, None] * 4, 1), (10, [float("nan")] * 8, 1), (11, [float("inf")] + [0.0] * 7, 1), (None, None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, 4, "c", 5, "g", 6, "e") for r in rows], VECTORS)


def as_table(rows):
    con = duckdb.connect()
    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())})
    con.register("embeddings", table)
    return con


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_vector_codes"])
def test_query_against_sql(spark, small, duck, same, name):
    same(registry.QUERIES[name](spark, small), duck, registry.ORACLE_SQL[name])


def test_hard_negatives_of_odd_rows(spark, same):
    rows = odd_vectors() + [(i, [0.7, -0.2, 0.1], i % 2) for i in range(500, 530)]
    same(negatives.hard_negatives(frame(spark, rows)), as_table(rows), negatives.ORACLE)


@pytest.mark.parametrize("values", [64, 320])
def test_hard_negatives_over_many_blocks(spark, same, monkeypatch, values):
    """Blocks and groups of few rows, batches of three: lists merge across all of them."""
    for name, value in {"BLOCK_VALUES": values, "GROUP_VALUES": values, "ROWS": 3, "ANCHORS": 2}.items():
        monkeypatch.setattr(negatives, name, value)
    rows = odd_vectors()
    same(negatives.hard_negatives(frame(spark, rows)), as_table(rows), negatives.ORACLE)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert negatives.hard_negatives(none).collect() == [] and codes.compressed(none).collect() == []
    assert negatives.hard_negatives(frame(spark, [(None, None, None)])).count() == 0


def test_huge_components_do_not_break(spark):
    rows = [(i, [3e38 * (-1) ** i, 1.0], i % 2) for i in range(0, 120, 10)]
    found = negatives.hard_negatives(frame(spark, rows)).collect()
    assert all(-(2**63) <= r.positive_score < 2**63 for r in found)
    assert {r.error >= 0 for r in codes.compressed(frame(spark, rows)).collect()} == {True}


def lloyd(rows):
    """(vec_id, code, error, label_error, digest) of all kept rows, one vector after another."""
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * codes.SCALE)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, by_label = [], {}
    for dim in {len(v) for _, v, _ in kept}:
        mine = [r for r in kept if len(r[1]) == dim]
        first = sorted(mine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[: codes.ENTRIES]
        at = [dim * p // codes.PARTS for p in range(codes.PARTS + 1)]
        cut = lambda v, p: v[at[p] : at[p + 1]]
        books = [[cut(r[1], p) for r in first] for p in range(codes.PARTS)]
        far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
        near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
        for _ in range(codes.ROUNDS):
            held = [[[] for _ in first] for _ in books]
            for _, v, _ in mine:
                for p in range(codes.PARTS):
                    held[p][near(v, p)].append(cut(v, p))
            books = [[[sum(c) // len(parts) for c in zip(*parts)] if parts else old for parts, old in zip(h, b)] for h, b in zip(held, books)]
        digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
        for i, v, lab in mine:
            code = [near(v, p) for p in range(codes.PARTS)]
            error = sum(far(cut(v, p), books[p][e]) for p, e in enumerate(code))
            by_label[lab] = by_label.get(lab, 0) + error
            out.append((i, "".join(f"{e:02x}" for e in code), error, lab, digest))
    return sorted(((i, c, e, by_label[lab], d) for i, c, e, lab, d in out), key=repr)


@pytest.mark.parametrize("block", [4096, 20])
def test_vector_codes_of_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(codes, "BLOCK", block)
    rng = random.Random(6)
    rows = odd_vectors() + [(i, [rng.gauss(0, 1) for _ in range(11)], None) for i in range(40)] + [(1000 + i, [0.5, -0.5, 2.0], 1) for i in range(5)]
    found = codes.compressed(frame(spark, rows)).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found), key=repr) == lloyd(rows)


def test_distances_beyond_64_bits():
    a, b = np.array([[2**62, -(2**62)]]), np.array([[-(2**62), 2**62], [2**62, -(2**62)]])
    assert codes.distances(a, b).tolist() == [[2 * 2**126, 0]]
