"""Sources and sinks: scope and recognition files, images, model export and drawings as SVG."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "STRUCT<x: BIGINT, y: BIGINT, width: BIGINT, height: BIGINT>"
SCOPE = f"schema_version INT, source STRUCT<path: STRING, page: BIGINT>, include_regions ARRAY<{BOX}>, exclusion_regions ARRAY<{BOX}>, metadata MAP<STRING, STRING>"
OBSERVATIONS = "observations ARRAY<STRUCT<text_region_id: STRING, raw_text: STRING, confidence: STRING>>"


def scope_regions(texts: DataFrame, width: int, height: int) -> DataFrame:
    """(path, page, role, x, y, w, h, issue) of scope documents (value: JSON); ``issue`` says what is wrong."""
    d = texts.select(F.from_json("value", SCOPE).alias("d"))
    named = lambda field, role: d.select(F.col("d.source.path").alias("path"), F.col("d.source.page").alias("page"), F.col("d.schema_version").alias("v"), F.lit(role).alias("role"), F.explode_outer(f"d.{field}").alias("b"))
    both = named("include_regions", "include").unionByName(named("exclusion_regions", "exclude")).filter("b IS NOT NULL")
    x, y, w, h = (F.col(f"b.{c}") for c in ("x", "y", "width", "height"))
    issue = F.when(F.coalesce("v", F.lit(0)) != 1, "unsupported_schema_version").when((w <= 0) | (h <= 0), "zero_area").when((x + w <= 0) | (y + h <= 0) | (x >= width) | (y >= height), "no_intersection")
    return both.select("path", "page", "role", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), issue.alias("issue"))


def write_scopes(regions: DataFrame, path: str) -> None:
    """Scope documents of (path, page, role, x, y, w, h), one JSON line each."""
    box = F.struct("x", "y", F.col("w").alias("width"), F.col("h").alias("height"))
    rows = regions.groupBy("path", "page").agg(F.collect_list(F.when(F.col("role") == "include", box)).alias("include_regions"), F.collect_list(F.when(F.col("role") == "exclude", box)).alias("exclusion_regions"))
    rows.select(F.lit(1).alias("schema_version"), F.struct("path", "page").alias("source"), "include_regions", "exclusion_regions").write.json(path)


def recognition_json(texts: DataFrame) -> DataFrame:
    """(text_region_id, raw_text, confidence) of recognition documents (value: JSON).

    Rows without id or text, or of unresolved confidence, drop; a document without observations is an error.
    """
    d = texts.select(F.from_json("value", OBSERVATIONS).alias("d"))
    found = F.when(F.col("d.observations").isNull(), F.raise_error(F.lit("no observations in a recognition document")).cast("array<struct<text_region_id:string,raw_text:string,confidence:string>>")).otherwise(F.col("d.observations"))
    rows = d.select(F.explode(found).alias("o")).select("o.*")
    return rows.filter("text_region_id <> '' AND raw_text <> '' AND confidence IN ('high', 'medium', 'low')")


def recognition_tsv(lines: DataFrame) -> DataFrame:
    """(text_region_id, confidence, raw_text) of lines (value): region, confidence and text, which may hold tabs."""
    p = F.split("value", "\t", 3)
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "") & (F.size(p) == 3))
    named = rows.select(F.trim(p[0]).alias("text_region_id"), F.trim(p[1]).alias("confidence"), F.trim(p[2]).alias("raw_text"))
    return named.filter("text_region_id <> '' AND raw_text <> '' AND confidence IN ('high', 'medium', 'low')")


def xml_escape(x):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def svg_fragments(components: DataFrame) -> DataFrame:
    """(page, id, svg): one element for each component."""
    dash = F.when(F.col("kind") == "diagram_furniture", ' stroke-dasharray="4 2"').otherwise("")
    svg = F.concat(F.lit('<rect id="'), xml_escape(F.col("id")), F.lit('" data-kind="'), F.col("kind"), F.lit('" data-label="'), xml_escape(F.col("label")), F.format_string('" x="%d" y="%d" width="%d" height="%d"', "bx", "by", "bw", "bh"), dash, F.lit("/>"))
    return components.select("page", "id", svg.alias("svg"))


def svg_pages(fragments: DataFrame) -> DataFrame:
    """(page, svg): a page's elements in order of id (a page has some hundreds)."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "svg"))), lambda e: e["svg"]), "\n")
    return fragments.groupBy("page").agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">\n'), body, F.lit("\n</svg>")).alias("svg"))


def svg_issues(pages: DataFrame) -> DataFrame:
    """(page, code, detail): missing root, embedded images, ids that repeat."""
    ids = pages.select("page", F.explode(F.regexp_extract_all("svg", F.lit(r' id="([^"]*)"'), 1)).alias("detail"))
    twice = ids.groupBy("page", "detail").count().filter("count > 1").select("page", F.lit("SVG-DUPLICATE-ID").alias("code"), "detail")
    rootless = pages.filter(~F.contains("svg", F.lit("<svg")) | ~F.rtrim("svg").endswith("</svg>")).select("page", F.lit("SVG-NO-ROOT").alias("code"), F.lit("").alias("detail"))
    image = pages.filter(F.contains("svg", F.lit("<image"))).select("page", F.lit("SVG-EMBEDDED-IMAGE").alias("code"), F.lit("").alias("detail"))
    return twice.unionByName(rootless).unionByName(image)


def export_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Every table of a model as JSON lines in a folder of its own; Spark's committer makes each write atomic."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def decode_gray(content: bytes) -> tuple[int, int, bytes]:
    """(width, height, one byte a pixel) of PGM, PPM or 8-bit PNG without interlace."""
    if content[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            while content[at : at + 1].isspace():
                at += 1
            if content[at : at + 1] == b"#":
                at = content.index(b"\n", at)
                continue
            end = at
            while not content[end : end + 1].isspace():
                end += 1
            fields.append(int(content[at:end]))
            at = end
        width, height, _ = fields
        return _gray(width, height, content[at + 1 :], 1 if content[:2] == b"P5" else 3)
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at, data, head = 8, b"", None
        while at < len(content):
            size, kind = struct.unpack(">I4s", content[at : at + 8])
            body = content[at + 8 : at + 8 + size]
            head = body if kind == b"IHDR" else head
            data += body if kind == b"IDAT" else b""
            at += 12 + size
        width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", head)
        channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
        if depth != 8 or interlace or channels is None:
            raise ValueError("unsupported PNG")
        return _gray(width, height, _unfiltered(zlib.decompress(data), width * channels, height, channels), channels)
    raise ValueError("unsupported source")


def _unfiltered(raw: bytes, stride: int, height: int, step: int) -> bytes:
    out, above = bytearray(), bytearray(stride)
    for row in range(height):
        kind, line = raw[row * (stride + 1)], bytearray(raw[row * (stride + 1) + 1 : (row + 1) * (stride + 1)])
        for i in range(stride if kind else 0):
            left, up, corner = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            guess = left + up - corner
            best = min((left, up, corner), key=lambda v: abs(guess - v))
            line[i] = (line[i] + (0, left, up, (left + up) // 2, best)[kind]) & 255
        out += line
        above = line
    return bytes(out)


def _gray(width: int, height: int, raw: bytes, channels: int) -> tuple[int, int, bytes]:
    import numpy as np

    x = np.frombuffer(raw[: width * height * channels], np.uint8).reshape(-1, channels).astype(float)
    one = x[:, 0] if channels < 3 else x[:, :3] @ [0.299, 0.587, 0.114]
    return width, height, np.rint(one).astype(np.uint8).tobytes()


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, y, x, value) of all images under ``path``."""
    import pandas as pd

    def decode(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                w, h, raw = decode_gray(content)
                yield pd.DataFrame({"path": name, "y": [i // w for i in range(w * h)], "x": [i % w for i in range(w * h)], "value": list(raw)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, y int, x int, value int")
