"""Review images: one gray PNG for each page and layer of a model, drawn from runs of pixels, and a manifest of them.

Shapes become runs (page, y, x0, x1) by built-in functions; a task writes one image row by row from its runs in order, so
it holds a row and the compressed bytes, whatever the page's height. Paper is white and what is drawn black.
"""

from __future__ import annotations

import struct
import zlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.sources.formats import decode_gray

PAGE = ("source_id", "page")


def box_runs(boxes: DataFrame) -> DataFrame:
    """The outlines of boxes (page, bx, by, bw, bh), a pixel wide."""
    right, low = F.col("bx") + F.col("bw") - 1, F.col("by") + F.col("bh") - 1
    run = lambda y, x0, x1: F.struct(y.cast("long").alias("y"), x0.cast("long").alias("x0"), x1.cast("long").alias("x1"))
    sides = F.flatten(F.transform(F.sequence(F.col("by"), low), lambda y: F.array(run(y, F.col("bx"), F.col("bx")), run(y, right, right))))
    return boxes.filter("bw > 0 AND bh > 0").select(*PAGE, F.explode(F.concat(sides, F.array(run(F.col("by"), F.col("bx"), right), run(low, F.col("bx"), right)))).alias("r")).select(*PAGE, "r.*")


def line_runs(lines: DataFrame) -> DataFrame:
    """Level and upright lines (page, x1, y1, x2, y2), a pixel wide; ends belong to them."""
    whole = lambda f, a, b: f(F.round(a), F.round(b)).cast("long")
    corners = lines.select(*PAGE, whole(F.least, "x1", "x2").alias("x0"), whole(F.greatest, "x1", "x2").alias("x1"), whole(F.least, "y1", "y2").alias("top"), whole(F.greatest, "y1", "y2").alias("low"))
    return corners.select(*PAGE, F.explode(F.sequence("top", "low")).alias("y"), "x0", "x1")


def dot_runs(points: DataFrame, radius: int) -> DataFrame:
    """Discs around points (page, x, y)."""
    rows = points.withColumn("d", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn("half", F.floor(F.sqrt(radius * radius - F.col("d") * F.col("d"))))
    x, y = F.round("x").cast("long"), F.round("y").cast("long")
    return rows.select(*PAGE, (y + F.col("d")).alias("y"), (x - F.col("half")).alias("x0"), (x + F.col("half")).alias("x1"))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width: int, height: int, runs) -> tuple[bytes, int]:
    """(the bytes of a gray PNG, its black pixels) of ``runs`` (y, x0, x1) in order of y, within the page."""
    packed, white, black, parts = zlib.compressobj(6), b"\x00" + b"\xff" * width, 0, []
    runs, at = iter(runs), None
    at = next(runs, None)
    for y in range(height):
        row = white
        if at is not None and at[0] == y:
            line = bytearray(white)
            while at is not None and at[0] == y:
                line[1 + at[1] : 2 + at[2]] = bytes(at[2] - at[1] + 1)
                at = next(runs, None)
            row, black = bytes(line), black + line.count(0, 1)
        parts.append(packed.compress(row))
    parts.append(packed.flush())
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", b"".join(parts)) + _chunk(b"IEND", b""), black


def review_images(layers: dict[str, DataFrame], width: int, height: int) -> DataFrame:
    """(page, layer, width, height, png, pixels) of ``layers``, runs (page, y, x0, x1) by name; runs are cut at the borders
    of the page. A layer without runs on a page has no image there."""

    def draw(pdf):
        import pandas as pd

        ordered = pdf.sort_values(["y", "x0", "x1"])
        image, black = png(width, height, zip(ordered["y"].tolist(), ordered["x0"].tolist(), ordered["x1"].tolist()))
        first = pdf.iloc[0]
        return pd.DataFrame([(first["source_id"], first["page"], first["layer"], width, height, image, black)], columns=["source_id", "page", "layer", "width", "height", "png", "pixels"])

    tagged = reduce(DataFrame.unionByName, [df.select(*PAGE, F.lit(name).alias("layer"), "y", "x0", "x1") for name, df in layers.items()])
    within = tagged.withColumns({"x0": F.greatest("x0", F.lit(0)), "x1": F.least("x1", F.lit(width - 1))}).filter(F.col("y").between(0, height - 1) & (F.col("x0") <= F.col("x1")))
    return within.groupBy(*PAGE, "layer").applyInPandas(draw, "source_id string, page long, layer string, width int, height int, png binary, pixels long")


def black_pixels(image: bytes) -> tuple[int, int, int]:
    """(width, height, black pixels) of a PNG. Its pixels go at once: a batch may have thousands of images."""
    width, height, gray = decode_gray(bytes(image))
    return width, height, gray.count(0)


def read_back(images: DataFrame) -> DataFrame:
    """(page, layer, width, height, pixels): what the PNG bytes themselves hold."""

    def decode(frames):
        for pdf in frames:
            yield pdf[["source_id", "page", "layer"]].assign(**dict(zip(("width", "height", "pixels"), zip(*map(black_pixels, pdf["png"])))) if len(pdf) else {"width": [], "height": [], "pixels": []})

    return images.select(*PAGE, "layer", "png").mapInPandas(decode, "source_id string, page long, layer string, width int, height int, pixels long")


def manifest(images: DataFrame, objects: dict[str, DataFrame]) -> DataFrame:
    """(page, layer, objects, pixels): how many objects (page) a layer shows and how many pixels its image has."""
    counted = reduce(DataFrame.unionByName, [df.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("objects")).select(*PAGE, F.lit(name).alias("layer"), "objects") for name, df in objects.items()])
    return counted.join(images.select(*PAGE, "layer", "pixels"), [*PAGE, "layer"], "left").select(*PAGE, "layer", "objects", F.coalesce("pixels", F.lit(0)).cast("long").alias("pixels"))


def write_review(images: DataFrame, listed: DataFrame, path: str) -> None:
    """Images and manifest under ``path``; Spark's committer makes each of the two whole or absent."""
    images.write.mode("overwrite").parquet(f"{path}/images")
    listed.write.mode("overwrite").json(f"{path}/manifest")
