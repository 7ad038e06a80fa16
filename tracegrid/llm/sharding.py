"""Sharding by fixed virtual slots with a versioned slot-to-shard map (built-in functions only).

A record's slot is a hash of its id, its text and its number among records that agree in both, and never changes. So
neither many texts under one id nor many copies of one record share a slot that no edit of the map could split. Bytes
are summed per slot; version 0 of the map deals slots round robin, and each rebalancing writes a new version in which
single slots have moved from the fullest shard to the emptiest. The map has ``SLOTS`` rows at any size of the data, so
the driver edits it and joins broadcast it. Places within a slot are counted in parts of about ``PART_ROWS`` records, so
tasks do not grow with the data.

Defined results: a null text has 0 bytes and the CRC of the empty string; a null id is an id of its own; repeated
rows are records of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from bisect import bisect_right, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import copy_numbers, cut, fresh_path

SLOTS = 8192
SHARDS = 40
#: Bytes that a record takes besides its text.
OVERHEAD = 16


#: Records whose places are counted together.
PART_ROWS = 65_536


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(uid, doc_id, size, text_crc32, h, vslot) of every document; ``h`` is a hash that records of one slot differ in."""
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.lit(1), F.col("doc_id").isNull(), "doc_id", text).alias("h"),
    )
    same = ["h", "size", "text_crc32", "doc_id"]
    copies = copy_numbers(cut(thin.select("uid", "h", "size", "text_crc32", F.struct("doc_id").alias("doc_id")), "records"), same)
    each = copies.select(*same, "before", F.posexplode("uids").alias("i", "uid")).withColumn("h", F.xxhash64("h", F.col("before") + F.col("i")))
    return each.select("uid", "doc_id.doc_id", "size", "text_crc32", "h", F.pmod("h", F.lit(slots)).cast("int").alias("vslot"))


def rebalanced(owner: list[int], weight: list[int], shards: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The map after moving slots from the fullest to the emptiest shard while that narrows the gap, and the moves."""
    owner, moves = list(owner), []
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        load[shard] += weight[slot]
        if weight[slot]:
            insort(held[shard], (weight[slot], slot))
    for _ in range(4 * len(owner)):
        full, empty = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[full] - load[empty]
        at = bisect_right(held[full], (gap // 2, len(owner))) - 1
        if at < 0 and held[full] and held[full][0][0] < gap:
            at = 0
        if at < 0:
            break
        size, slot = held[full].pop(at)
        insort(held[empty], (size, slot))
        load[full] -= size
        load[empty] += size
        owner[slot] = empty
        moves.append((slot, full, empty))
    return owner, moves


def map_rows(spark: SparkSession, owner: list[int]) -> DataFrame:
    """(vslot, shard) of one version of the map."""
    told = F.explode(F.from_json(F.lit(json.dumps([{"vslot": i, "shard": s} for i, s in enumerate(owner)])), "array<struct<vslot:int,shard:int>>")).alias("m")
    return spark.range(1).select(told).select("m.vslot", "m.shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, str]:
    """(doc_id, size, text_crc32, vslot, shard, slot) of every document, and the path of the map's versions.

    ``slot`` is the record's place in its shard. Places are counted within parts of a virtual slot and then added up over
    the slot's parts and the shard's slots, so no task sorts a whole shard or slot.
    """
    spark = docs.sparkSession
    thin = cut(records(docs, slots), "slots")
    sums = cut(thin.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "sums")
    weight, count = [0] * slots, [0] * slots
    for r in sums.collect():  # at most ``slots`` rows
        weight[r.vslot], count[r.vslot] = r.bytes, r.n
    path = fresh_path(spark, "slot-map")
    first = [s % shards for s in range(slots)]
    owner, moves = rebalanced(first, weight, shards)
    map_rows(spark, first).write.parquet(f"{path}/version=0")
    if moves:
        map_rows(spark, owner).write.parquet(f"{path}/version=1")
    latest = spark.read.parquet(f"{path}/version={int(bool(moves))}").select("vslot", "shard")
    counted = latest.join(F.broadcast(sums.select("vslot", "n")), "vslot", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    places = counted.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("vslot")) - F.col("n")).select("vslot", "shard", "before")
    # the hash's upper bits deal a slot's records to parts
    parts = max(1, sum(count) // (slots * PART_ROWS))
    dealt = thin.withColumn("part", F.pmod(F.shiftright("h", 24), F.lit(parts)))
    inside = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size", "h", "uid")) - 1
    dealt = dealt.withColumn("inside", inside)
    if parts > 1:
        upto = Window.partitionBy("vslot").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        held = dealt.groupBy("vslot", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("earlier", F.sum("n").over(upto) - F.col("n")).drop("n")
        dealt = dealt.join(held, ["vslot", "part"]).withColumn("inside", F.col("earlier") + F.col("inside"))
    # the map has ``slots`` rows at any size of the data
    return dealt.join(F.broadcast(places), "vslot").select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("before") + F.col("inside")).cast("long").alias("slot")), path
