"""Pages as a stream: every micro-batch of drawings goes through the same operators."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracegrid.operators.topology import Topology, normalize_conductors


def reconstruct_stream(segments: DataFrame, path: str, checkpoint: str, also: Callable[[Topology, int], None] | None = None) -> StreamingQuery:
    """Nodes and edges of arriving segments, appended under ``path``; a batch that runs again overwrites its own folder."""

    def batch(df: DataFrame, epoch: int) -> None:
        t = Topology(normalize_conductors(df))
        t.nodes.write.mode("overwrite").parquet(f"{path}/nodes/batch={epoch}")
        t.edges.write.mode("overwrite").parquet(f"{path}/edges/batch={epoch}")
        if also:
            also(t, epoch)

    return segments.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def type_counts(nodes: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Windowed counts of node types of a stream (ts, type)."""
    return nodes.withWatermark("ts", late).groupBy(F.window("ts", every), "type").agg(F.count(F.lit(1)).alias("n"))
