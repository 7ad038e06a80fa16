"""Content-addressed WARC archive: payloads once by digest, exact record headers apart, records back by joins.

``write_archive`` stores each distinct payload under its SHA-256 and one header block for every page. All payloads
that share a digest must also share SHA-1 and length, or the write fails. ``read_archive`` joins the two again and
checks every payload against its digest; ``record_bytes`` puts the bytes of WARC records together, and
``parsed_records`` reads such bytes as any WARC reader would: header lines, lengths and payload come from the bytes
alone, and a block or payload that does not fit its Content-Length or WARC-Payload-Digest fails the read.

Payloads are shuffled once, when they are stored: the store and the headers of the records that carry a payload are
bucketed by its digest, so the join that gives the records back needs no exchange. Revisits carry no payload; how long
theirs is, they learn from the record that they refer to. So a payload that many pages share is read once.

Defined results: a null html is an empty payload; a null url has no target line; repeated rows are records of their
own (one of them is the response); an empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path

#: Payloads of at least so many bytes are stored as revisits when seen before.
MIN_REVISIT_BYTES = 0
#: Written to every record; archives of the same pages are then the same bytes.
DATE = "2026-01-01T00:00:00Z"


PAYLOADS, HEADERS = "key string, payload binary", "header string, http string, key string"


def base32(hex40: Column) -> Column:
    """RFC 4648 base 32 of a SHA-1 in hexadecimal: 5 hex digits are 4 base-32 digits."""
    parts = [F.lpad(F.conv(F.substring(hex40, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _lines(*lines: Column) -> Column:
    """Lines ended by CRLF; null lines are left out."""
    return F.concat(*(F.coalesce(F.concat(x, F.lit("\r\n")), F.lit("")) for x in lines))


#: Bytes of payloads in a bucket of the store, and buckets at most.
BUCKET_BYTES, MOST_BUCKETS = 64 << 20, 50_000
#: Kinds of headers: of records that carry the stored payload, of other responses with short payloads, of revisits.
CARRIES, SHORT, REVISIT = "carries", "short", "revisit"


def _bucketed(spark: SparkSession, path: str, schema: str, buckets: int, fill: DataFrame | None = None) -> DataFrame:
    """The bucketed files of ``path``, after ``fill`` is added to them, if given.

    Only a table of the catalog tells Spark how rows are dealt, so one stands for the files while they are written or
    looked up. It is dropped at once: the files stay, and so does what the returned rows know of their buckets.
    """
    name = f"store_{hashlib.blake2b(path.encode(), digest_size=12).hexdigest()}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{path}'")
    try:
        if fill is not None:
            fill.write.insertInto(name)
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write ``path``/payloads (key, payload), ``path``/headers (kind, header, http, key), and ``path``/layout."""
    spark = pages.sparkSession
    base = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    facts = {"key": F.sha2("payload", 256), "sha1": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")}
    thin = cut(base.withColumns(facts).select(F.monotonically_increasing_id().alias("uid"), "page_id", "url", "key", "sha1", "bytes"), "records")
    first = cut(thin.groupBy("key").agg(F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id", "uid")).alias("first"), F.max("bytes").alias("bytes")).select("key", F.col("first.page_id").alias("first_page"), F.col("first.uid").alias("first_uid"), "bytes"), "first")
    total = first.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a multiple of the partitions of a shuffle, whose tasks then hold whole buckets
    buckets = parts * min(max(1, MOST_BUCKETS // parts), max(1, -(-total // (BUCKET_BYTES * parts))))
    spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{path}/layout")

    same = (F.min("sha1") == F.max("sha1")) & (F.min("bytes") == F.max("bytes"))
    # copies within a task become one before the exchange, so a payload that many pages share crosses it once a task
    stored = base.withColumns(facts).groupBy("key").agg(F.first("payload").alias("payload"), same.alias("same"))
    stored = stored.select("key", F.when(F.col("same"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256"))).alias("payload"))
    _bucketed(spark, f"{path}/payloads", PAYLOADS, buckets, stored)

    known = thin.join(first.drop("bytes"), "key")
    own, short = F.col("uid") == F.col("first_uid"), F.col("bytes") < min_revisit_bytes
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.format_string("Content-Length: %d", "bytes"), F.lit(""))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    known = known.withColumns({"kind": F.when(own, CARRIES).when(short, SHORT).otherwise(REVISIT), "http": http})
    response = F.col("kind") != REVISIT
    header = _lines(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first_page")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.length("http") + F.when(response, F.col("bytes")).otherwise(0)).cast("string")),
        F.lit(""),
    )
    headers = cut(known.select("kind", header.alias("header"), "http", "key"), "headers")
    _bucketed(spark, f"{path}/headers/kind={CARRIES}", HEADERS, buckets, headers.filter(F.col("kind") == CARRIES).select("header", "http", "key").repartition(buckets, "key"))
    for kind in (SHORT, REVISIT):
        headers.filter(F.col("kind") == kind).select("header", "http", "key").write.option("compression", "zstd").parquet(f"{path}/headers/kind={kind}")


def field(name: str) -> Column:
    """The value of a header line, null if there is none."""
    x = F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(x != "", x)


def checked(stored: DataFrame) -> DataFrame:
    """(key, payload) of ``stored``; a payload that does not match its digest fails the read."""
    return stored.select("key", F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest"))).alias("payload"))


def _met(headers: DataFrame, stored: DataFrame) -> DataFrame:
    joined = headers.join(checked(stored), "key", "left")
    return joined.select("header", "http", F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(F.raise_error(F.lit("a payload is missing")).cast("binary")).alias("payload"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, http, payload) of every record, a revisit's payload too; payloads are checked against their digest."""
    return _met(spark.read.schema(HEADERS).parquet(f"{path}/headers"), spark.read.schema(PAYLOADS).parquet(f"{path}/payloads"))


def archived_records(spark: SparkSession, path: str) -> DataFrame:
    """(header, http, payload) of every record as the archive holds it: a revisit's payload is empty."""
    buckets = spark.read.parquet(f"{path}/layout").first().buckets
    carrying = _met(_bucketed(spark, f"{path}/headers/kind={CARRIES}", HEADERS, buckets), _bucketed(spark, f"{path}/payloads", PAYLOADS, buckets))
    plain = lambda kind: spark.read.schema(HEADERS).parquet(f"{path}/headers/kind={kind}")
    others = plain(REVISIT).select("header", "http", F.lit(b"").alias("payload"))
    if not plain(SHORT).isEmpty():
        others = others.unionByName(_met(plain(SHORT), spark.read.schema(PAYLOADS).parquet(f"{path}/payloads")))
    return carrying.unionByName(others)


def record_bytes(records: DataFrame) -> DataFrame:
    """``records`` with ``record``, the bytes of the WARC record: header, HTTP header and, in a response, the payload."""
    body = F.when(field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.withColumn("record", F.concat(F.encode("header", "UTF-8"), F.encode("http", "UTF-8"), body, F.lit(b"\r\n\r\n")))


def parsed_records(records: DataFrame) -> DataFrame:
    """(header, http, payload) from the bytes of ``record`` alone.

    Bytes are read as Latin-1, in which each is one character. The header ends at the first empty line, the block has
    the length that the header tells, its HTTP header ends at the block's first empty line, and the rest is the payload.
    """
    text = F.decode("record", "ISO-8859-1")
    at = records.select(text.alias("_r")).withColumn("_h", F.instr("_r", "\r\n\r\n"))
    at = at.withColumn("header", F.substring("_r", F.lit(1), F.col("_h") + 3)).withColumn("_block", field("Content-Length").try_cast("int"))
    fits = F.col("_r").startswith("WARC/1.1\r\n") & (F.col("_h") > 0) & (F.length("_r") == F.col("_h") + 3 + F.col("_block") + 4) & F.col("_r").endswith("\r\n\r\n")
    at = at.withColumn("_b", F.when(F.coalesce(fits, F.lit(False)), F.substring("_r", F.col("_h") + 4, F.col("_block"))).otherwise(F.raise_error(F.lit("the bytes of a record do not fit its header"))))
    at = at.select("header", "_b", F.instr("_b", "\r\n\r\n").alias("_e"))
    at = at.select(F.decode(F.encode("header", "ISO-8859-1"), "UTF-8").alias("header"), F.substring("_b", F.lit(1), F.col("_e") + 3).alias("http"), F.encode(F.expr("substring(_b, _e + 4)"), "ISO-8859-1").alias("payload"))
    told = F.substring_index(field("WARC-Payload-Digest"), "sha1:", -1)
    good = (field("WARC-Type") == "revisit") | (base32(F.sha1("payload")) == told)
    return at.select("header", "http", F.when(F.coalesce(good, F.lit(False)), F.col("payload")).otherwise(F.raise_error(F.lit("a payload does not match its record's digest")).cast("binary")).alias("payload"))


def page_of(column: Column) -> Column:
    return F.regexp_extract(column, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def archived_pages(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write an archive of ``pages``, put the bytes of its records together, parse them, and give one row for each."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archive(pages, path, min_revisit_bytes)
    back = parsed_records(record_bytes(archived_records(spark, path)))
    back = cut(back.select(
        page_of(field("WARC-Record-ID")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.substring_index(field("WARC-Payload-Digest"), "sha1:", -1).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        page_of(F.coalesce(field("WARC-Refers-To"), F.lit(""))).alias("refers_to"),
    ), "parsed")
    response = back.filter("record_type = 'response'")
    full = response.groupBy("payload_digest").agg(F.max("payload_bytes").alias("full"))
    revisit = back.filter("record_type = 'revisit'").join(full, "payload_digest").select(*(F.col("full").alias(c) if c == "payload_bytes" else c for c in back.columns))
    return response.unionByName(revisit)


_PART = "lpad(to_base(('0x' || h[{a}:{b}])::BIGINT, 32), 4, '0')"
ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
       translate({' || '.join(_PART.format(a=1 + 5 * i, b=5 + 5 * i) for i in range(8))}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM q
"""
