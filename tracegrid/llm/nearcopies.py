"""One document of each family of near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Two such texts have SimHash fingerprints that usually differ by 4 to 11 bits, and blocks of a 64-bit fingerprint that stay
whole under 11 differing bits hold too few bits to keep pairs apart. Candidates therefore come from MinHash bands: texts
that share one of ``BANDS`` keys of ``ROWS`` minima meet, which finds a pair of similarity 0.8 with probability 0.9996 and
one of 0.85 with 0.99999. Candidates are tied to families, and within a family all pairs are held against their
real shingles; only pairs at 0.8 or more link, and their components are the groups of near copies.

Copies with the same words are one node, so they never make pairs. Each node's text goes to its family once; families
above ``CHUNK`` texts or ``CHUNK_WORDS`` words are dealt out as pairs of chunks.

Defined results: null and blank texts are copies of each other; texts of fewer than five words are one shingle; letters
A to Z count as a to z; a null doc_id stays only if no other document of its group has one.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tracegrid.operators.graph import connected_components

from .common import cut

#: Words of a shingle, and the share of shingles (in tenths) that near copies have in common.
SHINGLE, TENTHS = 5, 8
BANDS, ROWS = 20, 5
#: Texts and words of a family that are held at once (twice that, as chunks meet in pairs).
CHUNK, CHUNK_WORDS = 512, 1 << 20

_ODD = np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 7) | 1 for i in range(BANDS * ROWS)], dtype=np.uint64)
_ADD = np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 8) for i in range(BANDS * ROWS)], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Words to hashes, computed once each while the table is small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 1)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes], hashes: dict[bytes, int]) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n, width = max(1, len(h) - SHINGLE + 1), min(SHINGLE, len(h))
    x = np.full(n, width, dtype=np.uint64)
    for d in range(width):
        x = _mixed(x * _STEP + h[d : d + n])
    return np.unique(x)


def band_keys(found: np.ndarray) -> list[int]:
    """``BANDS`` keys of a set of shingles; none for an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 2048):
        np.minimum(least, (_ODD[:, None] * found[None, at : at + 2048] + _ADD[:, None]).min(axis=1), out=least)
    least, key = least.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mixed(key * _STEP + least[:, r])
    return key.view(np.int64).tolist()


@F.pandas_udf(StructType([StructField("d1", LongType()), StructField("d2", LongType()), StructField("words", LongType()), StructField("keys", ArrayType(LongType()))]))
def sketch_of(texts: pd.Series) -> pd.DataFrame:
    """128 bits that name the words of a text, their number and the keys of its bands."""
    hashes, rows = _Hashes(), []
    for text in texts:
        words = _words(text)
        name = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), dtype="<i8")
        rows.append((int(name[0]), int(name[1]), len(words), band_keys(shingles(words, hashes))))
    return pd.DataFrame(rows, columns=["d1", "d2", "words", "keys"])


def similar_pairs(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs (x, y) that tie together all sets that similar pairs tie together; each is a similar pair itself."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    holders = owner[np.argsort(ids, kind="stable")]
    from_ = np.concatenate(([0], np.cumsum(np.bincount(ids))))
    left, out = np.ones(len(sets), dtype=bool), []
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        frontier = [root]
        while frontier and left.any():
            x = frontier.pop()
            mine = ids[ends[x] - sizes[x] : ends[x]]
            common = np.zeros(len(sets), dtype=np.int64)
            for at in range(0, len(mine), 1024):
                common += np.bincount(np.concatenate([holders[from_[i] : from_[i + 1]] for i in mine[at : at + 1024]]), minlength=len(sets))
            near = np.nonzero(left & (10 * common >= TENTHS * (sizes + sizes[x] - common)))[0]
            left[near] = False
            frontier += near.tolist()
            out += [(x, y) for y in near.tolist()]
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) ids of similar texts. Rows are sorted by group (family, i, j); a group may span batches."""
    hashes = _Hashes()
    group, held, out = None, {}, []

    def close() -> None:
        if len(held) > 1:
            names = list(held)
            out.extend((names[x], names[y]) for x, y in similar_pairs(list(held.values())))
        held.clear()

    def made() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
        out.clear()
        return batch

    for batch in batches:
        family, i, j, uid = (batch.column(k).to_pylist() for k in ("family", "i", "j", "uid"))
        for now, name, text in zip(zip(family, i, j), uid, batch.column("text")):
            if now != group:
                close()
                group = now
            held[name] = shingles(_words(text.as_py()), hashes)
        yield made()
    close()
    yield made()


def verified_links(nodes: DataFrame, texts: DataFrame, chunk: int = CHUNK, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(a, b) pairs of uids with similar texts, from ``nodes`` (uid, words, keys) and ``texts`` (uid, text)."""
    banded = nodes.select("uid", F.posexplode("keys").alias("band", "key"))
    met = banded.groupBy("band", "key").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    near = cut(banded.join(met, ["band", "key"]).filter("uid <> first").select("uid", "first").distinct(), "candidates")
    families = connected_components(near, [], "uid", "first").select(F.col("node").alias("uid"), F.col("root").alias("family"))
    families = cut(families.join(nodes.select("uid", "words"), "uid"), "families")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("words") / chunk_words)).alias("chunks")
    mine = F.pmod(F.xxhash64("uid"), F.col("chunks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda x: F.struct(F.least(x, F.col("mine")).alias("i"), F.greatest(x, F.col("mine")).alias("j")))
    dealt = families.join(families.groupBy("family").agg(parts), "family").withColumn("mine", mine).select("uid", "family", F.explode(pairs).alias("p"))
    dealt = dealt.join(texts, "uid").select("family", "p.i", "p.j", "uid", "text")
    return dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(_verified, "a long, b long").distinct()


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id (null last; of repeated rows, one)."""
    names = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")
    held = cut(docs.select(row, F.monotonically_increasing_id().alias("uid"), sketch_of(F.col("text")).alias("s")), "sketches")
    first = F.min(F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), "uid", F.col("s.words").alias("words"), F.col("s.keys").alias("keys"))).alias("f")
    nodes = cut(held.groupBy("s.d1", "s.d2").agg(first).select("f.*"), "nodes")
    links = cut(verified_links(nodes.select("uid", "words", "keys"), held.select("uid", F.col("row.text").alias("text"))), "links")  # read twice: for the ties and for their ends
    # a node is ordered by its document, so a group's root is the row that stays
    side = lambda x: nodes.select(F.col("uid").alias(x), F.struct("none", "doc_id", "uid").alias(f"{x}_key"))
    tied = connected_components(links.join(side("a"), "a").join(side("b"), "b"), [], "a_key", "b_key")
    gone = tied.filter("node <> root").select(F.col("node.uid").alias("uid"))
    kept = cut(nodes.select("uid").join(gone, "uid", "left_anti"), "kept")
    return held.join(kept, "uid", "left_semi").select("row.*")
