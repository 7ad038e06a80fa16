import zlib

from tracegrid.sources import review
from tracegrid.sources.formats import decode_gray


def test_png_holds_its_runs():
    runs = [(0, 0, 3), (2, 1, 1), (2, 1, 4), (4, 6, 6)]
    image, black = review.png(7, 5, runs)
    width, height, raw = decode_gray(image)
    dark = {(i // 7, i % 7) for i, v in enumerate(raw) if v == 0}
    assert (width, height, black) == (7, 5, 9) and dark == {(y, x) for y, a, b in runs for x in range(a, b + 1)}
    assert set(raw) == {0, 255} and zlib.crc32(image[12:29]) == int.from_bytes(image[29:33], "big")


def test_layers_are_cut_at_the_page(spark):
    boxes = spark.createDataFrame([("s", 1, -2, -2, 6, 5), ("s", 1, 8, 3, 4, 4), ("s", 2, 0, 0, 0, 3)], "source_id string, page long, bx long, by long, bw long, bh long")
    points = spark.createDataFrame([("s", 1, 5.0, 5.0), ("s", 3, 99.0, 99.0)], "source_id string, page long, x double, y double")
    lines = spark.createDataFrame([("s", 1, 0.0, 2.0, 20.0, 2.0), ("s", 1, 4.0, 1.0, 4.0, 3.0)], "source_id string, page long, x1 double, y1 double, x2 double, y2 double")
    images = review.review_images({"boxes": review.box_runs(boxes), "dots": review.dot_runs(points, 2), "lines": review.line_runs(lines)}, 10, 8)
    told = {(r.page, r.layer): r.pixels for r in review.read_back(images).collect()}
    # the first box shows its right and lower side, the second is cut on its right
    assert told == {(1, "boxes"): 6 + 6, (1, "dots"): 13, (1, "lines"): 10 + 2}
    assert told == {(r.page, r.layer): r.pixels for r in images.collect()}
    listed = {(r.page, r.layer): (r.objects, r.pixels) for r in review.manifest(images, {"boxes": boxes, "dots": points}).collect()}
    assert listed == {(1, "boxes"): (2, 12), (2, "boxes"): (1, 0), (1, "dots"): (1, 13), (3, "dots"): (1, 0)}


def test_review_is_written_and_read(spark, tmp_path):
    points = spark.createDataFrame([("s", 1, 5.0, 5.0)], "source_id string, page long, x double, y double")
    images = review.review_images({"dots": review.dot_runs(points, 1)}, 10, 8)
    review.write_review(images, review.manifest(images, {"dots": points}), str(tmp_path / "review"))
    assert review.read_back(spark.read.parquet(str(tmp_path / "review/images"))).first().pixels == 5
    assert spark.read.json(str(tmp_path / "review/manifest")).first().objects == 1
