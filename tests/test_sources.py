import struct
import zlib

import pytest
from pyspark.errors import PySparkException

from tracegrid.sources import formats as IO
from tracegrid.streaming.pages import reconstruct_stream


def png(width, height, raw, color=0):
    step = {0: 1, 2: 3}[color]
    lines = b"".join(b"\0" + raw[i * width * step : (i + 1) * width * step] for i in range(height))
    chunk = lambda k, b: struct.pack(">I4s", len(b), k) + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_decoding():
    raw = bytes(range(12))
    assert IO.decode_gray(b"P5\n# made\n4 3\n255\n" + raw) == (4, 3, raw)
    assert IO.decode_gray(png(4, 3, raw)) == (4, 3, raw)
    assert IO.decode_gray(b"P6 1 1 255\n" + bytes([255, 255, 255])) == (1, 1, b"\xff")
    with pytest.raises(ValueError):
        IO.decode_gray(b"%PDF-1.4")


def test_image_rows(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5 2 2 255\n" + bytes([0, 255, 180, 181]))
    got = {(r.y, r.x): r.value for r in IO.image_pixels(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 0, (0, 1): 255, (1, 0): 180, (1, 1): 181}


def test_recognition(spark):
    json_rows = spark.createDataFrame([('{"observations":[{"text_region_id":"r1","raw_text":"GND","confidence":"high"},{"text_region_id":"","raw_text":"x","confidence":"high"},{"text_region_id":"r2","raw_text":"y","confidence":"unresolved"}]}',)], "value string")
    assert [r.text_region_id for r in IO.recognition_json(json_rows).collect()] == ["r1"]
    with pytest.raises(PySparkException):
        IO.recognition_json(spark.createDataFrame([("{}",)], "value string")).collect()
    lines = spark.createDataFrame([("# c",), ("r1\thigh\ta\tb",), ("",), ("r2\tunresolved\tx",)], "value string")
    assert [tuple(r) for r in IO.recognition_tsv(lines).collect()] == [("r1", "high", "a\tb")]


def test_scope_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, "include", 0, 0, 10, 10), ("p", 1, "exclude", 2, 2, 0, 5)], "path string, page long, role string, x long, y long, w long, h long")
    IO.write_scopes(rows, str(tmp_path / "s"))
    got = IO.scope_regions(spark.read.text(str(tmp_path / "s")), 100, 100)
    assert {(r.role, r.w, r.issue) for r in got.collect()} == {("include", 10, None), ("exclude", 0, "zero_area")}


def test_stream_equals_batch(spark, tmp_path):
    from tracegrid.operators.topology import Topology, normalize_conductors

    schema = "source_id string, page long, o string, axis long, lo long, hi long"
    df = spark.createDataFrame([("s", 0, "H", 10, 0, 20), ("s", 0, "V", 10, 0, 20)], schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    reconstruct_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    nodes = spark.read.parquet(str(tmp_path / "out/nodes")).drop("batch")
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, Topology(normalize_conductors(df)).nodes.collect()))


def test_images_are_read_back_one_at_a_time():
    import tracemalloc

    from tracegrid.sources import review

    image, black = review.png(900, 700, [(5, 10, 19), (6, 10, 19)])
    tracemalloc.start()
    found = list(map(review.black_pixels, [image] * 50))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(900, 700, black)] * 50 and black == 20 and peak < 25 * 900 * 700
