"""Tables written to the folder that driver and executors share, to end their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it gets a temporary folder."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = tempfile.mkdtemp(prefix="spark-shared-")
    return _LOCAL[key]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def page_session(spark: SparkSession) -> SparkSession:
    """``spark`` with its settings, in which tables that lie page by page are joined as they lie, whatever else their keys
    have. The caller's own session stays as it is."""
    session = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    session.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return session


def lay_pages(df: DataFrame) -> DataFrame:
    """``df`` with the rows of a page in one partition, so that what groups by page and more takes them as they lie."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page")


def cut_pages(df: DataFrame, name: str = "cut", laid: bool = False) -> DataFrame:
    """``cut`` for tables of pages: the rows of a page lie in one bucket, so that what is joined, counted or walked page by
    page afterwards needs no exchange. ``laid`` says that ``df`` is made of such tables and lies so already, which holds in
    a ``page_session`` only. The table's name goes at once; its files stay until ``release``."""
    spark = df.sparkSession
    path, table = fresh_path(spark, name), f"cut_{uuid.uuid4().hex}"
    if not laid or spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") != "false":
        df = lay_pages(df)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, "page").option("compression", "zstd").option("path", path).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``release`` deletes what was written there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the tables that this application has cut; for jobs that have written their results. Says how many."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)
