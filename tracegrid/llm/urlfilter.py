"""URL filters by a sort-merge range join.

Hosts are reversed label by label ("www.example.net" is "net.example.www."), so that a rule's host is a prefix of the
keys of its subdomains, hence an interval of the sorted keys, and intervals nest or are apart. Rules and urls are
dealt to ranges of keys and sorted together; one sweep over a range keeps a stack of the rules whose interval holds
the current key. A url takes the longest rule on the stack whose path its own path starts with: the longest host
first, then the longest path.

Ranges are cut at the first ``HEAD`` characters of keys (host and path), so a hot host spans many of them, and a head that
is a large part of all rows spans several too: between equal bounds its rows are dealt round robin. A rule goes to each
range that its interval meets. Bounds are quantiles of a sample of heads (``PER_RANGE`` for each range, at most
``MOST_RANGES`` ranges, so 400,000 heads at any size of the data); the sample only decides where rows go. A key finds its
range by bisection. Sweeps sort and compare whole keys.

Defined results: a null url, or one without "://", has empty host and path and meets no rule; a url that no rule fits
is allowed; repeated rows are judged alike; an empty table gives an empty result; without rules all is allowed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from typing import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"
#: Urls in a range, keys that are looked at for each range to cut them, and ranges at most (they grow beyond).
RANGE_ROWS, PER_RANGE, MOST_RANGES = 200_000, 20, 20_000
#: Characters of a key that decide its range.
HEAD = 256
#: Sorts after all that a key holds.
LAST = "\U0010ffff"


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by U+0001; empty for an empty host. In a label U+0001 and U+0002 are written as U+0002
    with U+0003 or U+0002 after it, so U+0001 ends labels only and keys of different hosts differ."""
    plain = F.replace(F.replace(host, F.lit("\x02"), F.lit("\x02\x02")), F.lit("\x01"), F.lit("\x02\x03"))
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), "\x01"), F.lit("\x01")))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(verdict, host, path) rows."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, key, kind): rules (kind 0) before the urls that start with their key."""
    stack: list[tuple[str, list[tuple[str, str, str]]]] = []
    cell = None
    for batch in batches:
        rows = batch.to_pydict()
        keep = {k: [] for k in ("page_id", "host", "path", "rule", "verdict")}
        for c, key, kind, page_id, host, path, verdict in zip(*(rows[k] for k in ("cell", "key", "kind", "page_id", "host", "path", "verdict"))):
            if c != cell:
                cell, stack = c, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][0] != key:
                    stack.append((key, []))
                stack[-1][1].append((path, host, verdict))
                continue
            found = None
            for _, held in reversed(stack):
                if fits := [r for r in held if path.startswith(r[0])]:
                    found = max(fits, key=lambda r: (len(r[0]), r[2]))
                    break
            keep["page_id"].append(page_id)
            keep["host"].append(host)
            keep["path"].append(path)
            keep["rule"].append(found[1] + found[0] if found else None)
            keep["verdict"].append(found[2] if found else DEFAULT)
        yield pa.RecordBatch.from_arrays([pa.array(keep["page_id"], pa.int64()), *(pa.array(keep[k], pa.string()) for k in ("host", "path", "rule", "verdict"))], names=list(keep))


def range_bounds(urls: DataFrame, ranges: int, n: int) -> list[str]:
    """Keys that cut ``urls`` (key) into about equal ranges; a key that is a large part of all comes several times."""
    if ranges < 2:
        return []
    share = min(1.0, PER_RANGE * ranges / n)
    drawn = sorted(r.key for r in urls.sample(fraction=share, seed=7).select(F.substring("key", 1, HEAD).alias("key")).collect())  # about PER_RANGE * ranges
    return [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if drawn else []


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    spark = pages.sparkSession
    rules = rule_table(spark) if rules is None else rules
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = urls.withColumn("key", F.concat(host_key(F.col("host")), F.col("path")))
    n = urls.count()
    ranges = min(MOST_RANGES, max(1, -(-n // range_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1000)))
    bounds = spark.sparkContext.broadcast(range_bounds(urls, ranges, n))  # at most MOST_RANGES keys

    @F.pandas_udf("int")
    def dealt_to(keys: pd.Series) -> pd.Series:
        cuts = bounds.value
        heads = [k[:HEAD] for k in keys]
        first = [bisect_left(cuts, k) for k in heads]
        last = [bisect_right(cuts, k, a) for k, a in zip(heads, first)]
        return pd.Series([a + i % (b - a + 1) for i, (a, b) in enumerate(zip(first, last))], dtype="int32")

    @F.pandas_udf("array<int>")
    def met_in(keys: pd.Series) -> pd.Series:
        cuts = bounds.value
        return pd.Series([list(range(bisect_left(cuts, k[:HEAD]), bisect_right(cuts, k[:HEAD] + LAST) + 1)) for k in keys], dtype=object)

    dealt = urls.select(dealt_to("key").alias("cell"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    hosts = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ruled = rules.select(hosts.alias("host"), "path", "verdict").withColumn("key", host_key(F.col("host")))
    ruled = ruled.select(F.explode(met_in("key")).alias("cell"), "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
    return dealt.unionByName(ruled).repartition(ranges, "cell").sortWithinPartitions("cell", "key", "kind").mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")


ORACLE = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT page_id, host, path, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(p) DESC) AS k
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m ON m.page_id = u.page_id AND k = 1
"""
