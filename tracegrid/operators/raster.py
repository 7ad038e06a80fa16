"""Ink as runs: morphology, masks and symbol rules in plain relational form.

A run is (page, y, x0, x1). Opening by a line of k cells keeps exactly the runs of k or more; what touches in
neighbouring rows is one component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracegrid.functions.geometry import box_of
from tracegrid.operators.contours import linked_runs
from tracegrid.operators.objects import _named
from tracegrid.operators.spatial import grown_rows, range_join
from tracegrid.operators.topology import PAGE


def threshold(pixels: DataFrame, level: int = 180) -> DataFrame:
    """Pixels (page, y, x, value) that are ink."""
    return pixels.filter(F.col("value") <= level)


def runs(ink: DataFrame) -> DataFrame:
    """(page, y, x0, x1) of horizontal runs of ink cells (page, y, x)."""
    row = Window.partitionBy(*PAGE, "y").orderBy("x")
    return ink.withColumn("_g", F.col("x") - F.row_number().over(row)).groupBy(*PAGE, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def open_segments(ink: DataFrame, k: int) -> DataFrame:
    """(page, root, x0, y0, x1, y1, area): components of what an opening by k cells leaves, 8-connected."""
    met = linked_runs(runs(ink).filter(F.col("x1") - F.col("x0") + 1 >= k))
    return met.groupBy(*PAGE, "root").agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))


def directed_strokes(ink: DataFrame, k: int = 25, least_area: int = 8, least_length: int = 12) -> DataFrame:
    """(page, o, axis, lo, hi, thickness, area): level and upright strokes of ink, as the lines through their middles.

    A direction's strokes are the components of what an opening by ``k`` cells in that direction leaves, of so many cells
    and of so great a length at least.
    """
    turned = ink.select(*PAGE, F.col("x").alias("y"), F.col("y").alias("x"))
    found = open_segments(ink, k).withColumn("o", F.lit("H")).unionByName(open_segments(turned, k).withColumn("o", F.lit("V")))
    kept = found.filter((F.col("area") >= least_area) & (F.col("x1") - F.col("x0") + 1 >= least_length))
    return kept.select(*PAGE, "o", ((F.col("y0") + F.col("y1")) / 2).alias("axis"), F.col("x0").cast("double").alias("lo"), F.col("x1").cast("double").alias("hi"), (F.col("y1") - F.col("y0") + 1).cast("double").alias("thickness"), F.col("area").cast("long").alias("area"))


def cells_of(boxes: DataFrame, scale: int) -> DataFrame:
    """(page, y, x): lattice cells inside boxes, each once."""
    span = lambda lo, size: F.explode(F.expr(f"sequence(CAST(ceil({lo} / {scale}) AS BIGINT), CAST(floor(({lo} + {size}) / {scale}) AS BIGINT))"))
    fits = boxes.filter(F.expr(f"ceil(bx / {scale}) <= floor((bx + bw) / {scale}) AND ceil(by / {scale}) <= floor((by + bh) / {scale})"))
    return fits.withColumn("x", span("bx", "bw")).withColumn("y", span("by", "bh")).select(*PAGE, "y", "x").distinct()


def exclude(ink: DataFrame, boxes: DataFrame, scale: int = 10) -> DataFrame:
    """Ink outside all boxes."""
    return ink.join(cells_of(boxes, scale), [*PAGE, "y", "x"], "left_anti")


def scope_mask(ink: DataFrame, include: DataFrame, excluded: DataFrame, scale: int = 10) -> DataFrame:
    """Ink inside some include box (all of it on pages that have none) and in no excluded one."""
    scoped = include.select(*PAGE).distinct()
    free = ink.join(scoped, PAGE, "left_anti")
    held = ink.join(cells_of(include, scale), [*PAGE, "y", "x"], "left_semi")
    return exclude(free.unionByName(held), excluded, scale)


def ink_near(points: DataFrame, ink: DataFrame, reach: int, scale: int = 10) -> DataFrame:
    """``points`` (page, id, x, y) with ``dark``, the ink cells within ``reach`` cells both ways."""
    span = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    around = points.withColumn("dx", span).withColumn("dy", span).select(*PAGE, "id", F.expr(f"x div {scale} + dx").alias("x"), F.expr(f"y div {scale} + dy").alias("y"))
    dark = grown_rows(around).join(ink, [*PAGE, "y", "x"]).groupBy(*PAGE, "id").agg(F.count(F.lit(1)).alias("dark"))
    return points.select(*PAGE, "id").join(dark, [*PAGE, "id"], "left").withColumn("dark", F.coalesce("dark", F.lit(0)).cast("long"))


def ground_bar_sequences(bars: DataFrame, shrink: float = 0.85, gap: tuple[int, int] = (2, 14), ratio: float = 2.0) -> DataFrame:
    """(page, col, y): three bars under one another, each at least 15 % narrower than the last, gaps alike.

    ``bars`` is (page, col, y, width); ``col`` groups bars of one centre.
    """
    w = Window.partitionBy(*PAGE, "col").orderBy("y", "width")
    seq = bars.withColumns({"y2": F.lead("y", 1).over(w), "y3": F.lead("y", 2).over(w), "w2": F.lead("width", 1).over(w), "w3": F.lead("width", 2).over(w)}).filter("y3 IS NOT NULL")
    a, b = F.col("y2") - F.col("y"), F.col("y3") - F.col("y2")
    narrow = (F.col("w2") <= F.col("width") * shrink) & (F.col("w3") <= F.col("w2") * shrink)
    return seq.filter(narrow & a.between(*gap) & b.between(*gap) & (F.greatest(a, b) <= ratio * F.least(a, b))).select(*PAGE, "col", "y")


def text_region_confidence(width: Column, height: Column) -> Column:
    """Confidence of a text box by its proportions: labels are wide, but not as thin as a line."""
    aspect = width / F.greatest(height, F.lit(1))
    return F.when(aspect.between(2.0, 30.0), 0.85).when(aspect.between(1.25, 40.0), 0.70).otherwise(0.55)


def small_components(ink: DataFrame, area: tuple[int, int] = (2, 500), side: int = 40) -> DataFrame:
    """(page, id, bx, by, bw, bh): 8-connected components of ink as small as a letter."""
    found = open_segments(ink, 1).withColumns({"bw": F.col("x1") - F.col("x0") + 1, "bh": F.col("y1") - F.col("y0") + 1})
    return found.filter(F.col("area").between(*area) & (F.col("bw") <= side) & (F.col("bh") <= side)).select(*PAGE, F.col("root").alias("id"), F.col("x0").alias("bx"), F.col("y0").alias("by"), "bw", "bh")


def text_groups(boxes: DataFrame, gap: int = 12, level: int = 6, most_height: int = 40, least: tuple[int, int] = (8, 3)) -> DataFrame:
    """(page, n, bx, by, bw, bh, members, confidence, excluded): boxes (page, id, bx, by, bw, bh) joined up to lines of text.

    From top to bottom and left to right (then by size and id) a box joins the first group at its height and within
    ``gap``, if the two stay at most ``most_height`` high; else it opens a group. ``n`` numbers the groups of a page in the
    order in which they opened; groups below the ``least`` width and height go. Later boxes depend on what earlier ones
    did, so a page is one task; its work is the number of boxes times the number of groups, as vectors.
    """

    def join_up(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["by", "bx", "bw", "bh", "id"])
        held, n = np.zeros((6, len(pdf)), dtype=np.int64), 0  # left, top, right, bottom, middle, members
        for x, y, w, h in zip(*(pdf[c].tolist() for c in ("bx", "by", "bw", "bh"))):
            left, top, right, bottom, middle, _ = held[:, :n]
            apart = np.where(x >= right, x - right, left - (x + w))
            fits = (np.abs(middle - (y + h // 2)) <= level) & (apart <= gap) & (np.maximum(bottom, y + h) - np.minimum(top, y) <= most_height)
            at = int(fits.argmax()) if fits.any() else n
            box = held[:, at]
            box[:4] = (x, y, x + w, y + h) if at == n else (min(box[0], x), min(box[1], y), max(box[2], x + w), max(box[3], y + h))
            box[4] = box[1] + (box[3] - box[1]) // 2
            box[5] += 1
            n += at == n
        out = pd.DataFrame({"bx": held[0, :n], "by": held[1, :n], "bw": held[2, :n] - held[0, :n], "bh": held[3, :n] - held[1, :n], "members": held[5, :n]})
        out = out[(out["bw"] >= least[0]) & (out["bh"] >= least[1])].reset_index(drop=True)
        return out.assign(source_id=pdf["source_id"].iloc[0], page=pdf["page"].iloc[0], n=np.arange(len(out)))[["source_id", "page", "n", "bx", "by", "bw", "bh", "members"]]

    found = boxes.select(*PAGE, "id", *(F.col(c).cast("long") for c in ("bx", "by", "bw", "bh"))).groupBy(*PAGE).applyInPandas(join_up, "source_id string, page long, n long, bx long, by long, bw long, bh long, members long")
    scored = found.withColumn("confidence", text_region_confidence(F.col("bw"), F.col("bh")))
    return scored.withColumn("excluded", F.col("confidence") >= 0.70)


def text_regions(ink: DataFrame) -> DataFrame:
    """Text regions of a page's ink; the excluded ones are boxes for ``exclude`` before conductors are looked for."""
    return text_groups(small_components(ink))


def suppress_overlaps(regions: DataFrame, order: str = "id", share: float = 0.80) -> DataFrame:
    """Regions (page, id, bx, by, bw, bh) less those of which an earlier one that stays covers ``share`` of the smaller.

    Empty regions go. Whether a region stays depends on which earlier ones did, so only the pairs that overlap that much
    (found on the grid) go to a page's task, and regions without one never do.
    """
    import pandas as pd

    real = regions.filter("bw > 0 AND bh > 0")
    mine = real.select(*PAGE, F.col("id").alias("late"), F.col(order).alias("late_key"), *(F.col(c).cast("double").alias(c) for c in ("bx", "by", "bw", "bh")))
    met = range_join(mine, _named(real.withColumn("early_key", F.col(order)), "early_key"), (F.col("bx"), F.col("by"), F.col("bw"), F.col("bh")), box_of("o_"), 0.0, PAGE, "late", "obj", cell=160.0)
    cover = lambda lo, size: F.greatest(F.least(F.col(lo) + F.col(size), F.col(f"o_{lo}") + F.col(f"o_{size}")) - F.greatest(F.col(lo), F.col(f"o_{lo}")), F.lit(0))
    heavy = cover("bx", "bw") * cover("by", "bh") / F.least(F.col("bw") * F.col("bh"), F.col("o_bw") * F.col("o_bh")) > share
    pairs = met.filter(heavy & ((F.col("early_key") < F.col("late_key")) | ((F.col("early_key") == F.col("late_key")) & (F.col("obj") < F.col("late"))))).select(*PAGE, F.col("obj").alias("early"), "late", "late_key")

    def walk(pdf):
        gone: set = set()
        for late, earlier in pdf.sort_values(["late_key", "late"]).groupby("late", sort=False)["early"]:
            if any(e not in gone for e in earlier):
                gone.add(late)
        return pd.DataFrame({"source_id": pdf["source_id"].iloc[0], "page": pdf["page"].iloc[0], "id": sorted(gone)})

    gone = pairs.groupBy(*PAGE).applyInPandas(walk, "source_id string, page long, id string")
    return real.join(gone, [*PAGE, "id"], "left_anti")


def ink_in_boxes(boxes: DataFrame, ink: DataFrame, *ids: str) -> DataFrame:
    """(page, ``ids``, dark): ink cells in boxes (page, ``ids``, x0, y0, x1, y1; borders belong to them).

    A box goes to its rows and meets the runs there, so a wide box costs no more than a narrow one.
    """
    rows = boxes.filter("x0 <= x1 AND y0 <= y1").withColumn("y", F.explode(F.sequence("y0", "y1"))).select(*PAGE, *ids, "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    met = grown_rows(rows).join(runs(ink), [*PAGE, "y"]).filter("x0 <= b1 AND x1 >= b0")
    return met.groupBy(*PAGE, *ids).agg(F.sum(F.least("x1", "b1") - F.greatest("x0", "b0") + 1).alias("dark"))


def directed_ink(ends: DataFrame, ink: DataFrame, width: int, height: int) -> DataFrame:
    """(page, id, which, dark, cells): ink around ends (page, id, x, y, dx, dy) of lines on pages of ``width`` by ``height``.

    ``which`` is local (10 cells all round), forward (4 to 14 cells on in the direction dx, dy) and transverse (a strip
    across it). The direction is the axis of the larger move; an end that moved half a cell or less has no direction and
    only its local box. Boxes are cut at the page's borders and ``cells`` counts what is left.
    """
    flat = F.abs("dx") >= F.abs("dy")
    aimed = F.when(flat, F.abs("dx") > 0.5).otherwise(F.abs("dy") > 0.5)
    on = F.when(flat, F.signum("dx")).otherwise(F.signum("dy")).cast("long")
    near, far = F.least(on * 4, on * 14), F.greatest(on * 4, on * 14)
    lit = F.lit

    def box(which, x0, y0, x1, y1):
        return F.struct(lit(which).alias("which"), (F.col("x") + x0).alias("x0"), (F.col("y") + y0).alias("y0"), (F.col("x") + x1).alias("x1"), (F.col("y") + y1).alias("y1"))

    local = box("local", lit(-10), lit(-10), lit(10), lit(10))
    forward = F.when(flat, box("forward", near, lit(-4), far, lit(4))).otherwise(box("forward", lit(-4), near, lit(4), far))
    across = F.when(flat, box("transverse", lit(-7), lit(-3), lit(7), lit(3))).otherwise(box("transverse", lit(-3), lit(-7), lit(3), lit(7)))
    boxes = ends.withColumn("b", F.explode(F.when(aimed, F.array(local, forward, across)).otherwise(F.array(local)))).select(
        *PAGE, "id", "b.which", F.greatest("b.x0", lit(0)).cast("long").alias("x0"), F.greatest("b.y0", lit(0)).cast("long").alias("y0"), F.least("b.x1", lit(width - 1)).cast("long").alias("x1"), F.least("b.y1", lit(height - 1)).cast("long").alias("y1"),
    )
    cells = F.greatest(F.col("x1") - F.col("x0") + 1, lit(0)) * F.greatest(F.col("y1") - F.col("y0") + 1, lit(0))
    dark = ink_in_boxes(boxes, ink, "id", "which")
    return boxes.select(*PAGE, "id", "which", cells.alias("cells")).join(dark, [*PAGE, "id", "which"], "left").withColumn("dark", F.coalesce("dark", lit(0)).cast("long"))


def supported_lines(lines: DataFrame, ink: DataFrame, width: int, height: int, min_length: float = 12.0, half_width: int = 2, density: float = 0.08) -> DataFrame:
    """(page, seg, reason, measurement): whether the ink under level and upright lines (page, seg, x0, y0, x1, y1 in cells,
    whole numbers) carries them.

    A line below ``min_length`` is rejected with its length, one with too little ink in its corridor with that share; ones
    that stay have no reason and the share.
    """
    flat, length = F.col("y0") == F.col("y1"), ((F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0"))).cast("double")
    side = F.lit(half_width)
    wide, high = F.when(flat, F.lit(0)).otherwise(side), F.when(flat, side).otherwise(F.lit(0))
    boxes = lines.select(*PAGE, "seg", F.greatest(F.col("x0") - wide, F.lit(0)).alias("x0"), F.greatest(F.col("y0") - high, F.lit(0)).alias("y0"), F.least(F.col("x1") + wide, F.lit(width - 1)).alias("x1"), F.least(F.col("y1") + high, F.lit(height - 1)).alias("y1"), length.alias("length"))
    cells = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    long = boxes.filter(F.col("length") >= min_length)
    share = F.when((F.col("x0") > F.col("x1")) | (F.col("y0") > F.col("y1")), 0.0).otherwise(F.coalesce("dark", F.lit(0)) / cells)
    met = boxes.join(ink_in_boxes(long, ink, "seg"), [*PAGE, "seg"], "left").withColumn("share", share)
    short = F.col("length") < min_length
    reason = F.when(short, "below_minimum_continuous_length").when(F.col("share") < density, "insufficient_supporting_ink")
    return met.select(*PAGE, "seg", reason.alias("reason"), F.when(short, F.col("length")).otherwise(F.col("share")).alias("measurement"))


def adaptive_ink(images: DataFrame, block: int = 31, below: float = 7.0) -> DataFrame:
    """(page, y, x) of pixels darker by ``below`` than the Gaussian mean of the ``block`` around them.

    ``images`` is (page, width, height, gray), a byte a pixel. The mean is separable; beyond the border the last pixel
    repeats. An image is read by one task, which works through it in tiles of fixed height.
    """
    import numpy as np
    import pyarrow as pa

    half = block // 2
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    weights = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma * sigma))
    weights /= weights.sum()
    tile = 256

    def dark(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                source, page, width, height, gray = (batch.column(c)[row].as_py() for c in ("source_id", "page", "width", "height", "gray"))
                if not width or not height or gray is None:
                    continue
                image = np.frombuffer(gray, dtype=np.uint8).reshape(height, width)
                for top in range(0, height, tile):
                    rows = np.clip(np.arange(top - half, min(top + tile, height) + half), 0, height - 1)
                    wide = np.pad(image[rows].astype(float), ((0, 0), (half, half)), mode="edge")
                    flat = sum(w * wide[:, i : i + width] for i, w in enumerate(weights))
                    n = len(rows) - 2 * half
                    mean = sum(w * flat[i : i + n] for i, w in enumerate(weights))
                    y, x = np.nonzero(image[top : top + n] <= np.rint(mean) - below)
                    yield pa.RecordBatch.from_arrays([pa.array([source] * len(y), pa.string()), pa.array([page] * len(y), pa.int64()), pa.array(y + top, pa.int64()), pa.array(x, pa.int64())], names=["source_id", "page", "y", "x"])

    return images.select(*PAGE, "width", "height", "gray").mapInArrow(dark, "source_id string, page long, y long, x long")


def ground_approaches(grounds: DataFrame, ink: DataFrame, half: int = 12, height: int = 20, least: int = 4, most_runs: int = 6, widest: int = 30, jump: float = 24.0, keep: float = 1.5) -> DataFrame:
    """(page, id, n, x1, y1, x2, y2, thickness): the conductors that lead to ground symbols (page, id, bx, by, bw, bh) whose
    ends no segment reaches (``objects.unreached_grounds`` finds them), traced through the ink.

    In the corridor of ``height`` rows over a symbol the 8-connected ink that touches the lowest row nearest to the middle
    is followed upwards: of a row's runs the one nearest to the line so far. Too many runs, one too wide or a jump too
    long gives no conductor, and nor do fewer than ``least`` cells or two rows. The line starts at the far end and meets
    the symbol's upper middle; points within ``keep`` of the line through their neighbours go. Each symbol is a group of
    its own, bounded by the corridor.
    """

    def trace(pdf):
        import numpy as np
        import pandas as pd

        first = pdf.iloc[0]
        ax, ay = int(first["ax"]), int(first["ay"])
        cells = set(zip(pdf["y"].tolist(), pdf["x"].tolist()))
        x0, lowest = max(0, ax - half), ay - 1
        middle = (ax + half + 1 - x0) // 2

        def spans(row, among):
            xs = sorted(x for y, x in among if y == row)
            cuts = [i for i in range(1, len(xs)) if xs[i] != xs[i - 1] + 1]
            return [(xs[a], xs[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(xs)])] if xs else []

        none = pd.DataFrame(columns=["source_id", "page", "id", "n", "x1", "y1", "x2", "y2", "thickness"])
        touching = spans(lowest, cells)
        if not touching:
            return none
        start = min(touching, key=lambda s: abs((s[0] + s[1] - 2 * x0) // 2 - middle))
        part, edge = set(), [(lowest, start[0])]
        while edge:
            y, x = edge.pop()
            if (y, x) in cells and (y, x) not in part:
                part.add((y, x))
                edge += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        if len(part) < least:
            return none
        line, last = [], float(ax)
        for row in range(lowest, min(y for y, _ in part) - 1, -1):
            found = spans(row, part)
            if not found:
                continue
            a, b = min(found, key=lambda s: abs((s[0] + s[1]) / 2 - last))
            last, before = (a + b) / 2, last
            if len(found) > most_runs or b - a + 1 > widest or abs(last - before) > jump:
                return none
            line.append((last, float(row)))
        if len(line) < 2:
            return none
        line = [*line[:0:-1], (float(ax), float(ay))]
        if len(line) < 2:
            return none

        pts, stay, todo = np.array(line), {0, len(line) - 1}, [(0, len(line) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d, off = pts[b] - pts[a], pts[a + 1 : b] - pts[a]
            size = float(np.hypot(*d))
            far = np.abs(d[0] * off[:, 1] - d[1] * off[:, 0]) / size if size else np.hypot(off[:, 0], off[:, 1])
            if far.max() > keep:
                at = a + 1 + int(far.argmax())
                stay.add(at)
                todo += [(a, at), (at, b)]
        ends = pts[sorted(stay)]
        out = pd.DataFrame({"x1": ends[:-1, 0], "y1": ends[:-1, 1], "x2": ends[1:, 0], "y2": ends[1:, 1]})
        return out.assign(source_id=first["source_id"], page=first["page"], id=first["id"], n=np.arange(len(out)), thickness=len(part) / len(line))[list(none.columns)]

    at = grounds.select(*PAGE, "id", F.floor(F.col("bx") + F.floor(F.col("bw") / 2)).cast("long").alias("ax"), F.col("by").cast("long").alias("ay")).filter("ay > 0")
    rows = at.withColumn("y", F.explode(F.sequence(F.greatest(F.col("ay") - height, F.lit(0)), F.col("ay") - 1)))
    met = grown_rows(rows).join(ink, [*PAGE, "y"]).filter(F.col("x").between(F.greatest(F.col("ax") - half, F.lit(0)), F.col("ax") + half))
    return met.groupBy(*PAGE, "id").applyInPandas(trace, "source_id string, page long, id string, n long, x1 double, y1 double, x2 double, y2 double, thickness double")


def blob_kind(width: Column, height: Column, area: Column, circularity: Column) -> Column:
    """The primitive that a blob is: circle, line, rectangle, terminal lead, in this order of tests."""
    long, thin = F.greatest(width, height), F.least(width, height)
    fill, aspect = area / (width * height), long / thin
    return (
        F.when((fill >= 0.70) & (aspect <= 1.3) & (circularity >= 0.75), "circle").when((aspect >= 3) & (thin <= 3), "line")
        .when((fill >= 0.75) & (aspect <= 2.5), "rectangle").when(aspect >= 2, "terminal_lead").otherwise("unknown")
    )


def notch_gate(notches: DataFrame, depth: float = 2.0) -> DataFrame:
    """(region, notches): regions with two notches at least, on both the left and the right side.

    ``notches`` is (region, side, depth).
    """
    deep = notches.filter(F.col("depth") >= depth).groupBy("region").agg(F.count(F.lit(1)).alias("notches"), F.max(F.col("side") == "left").alias("l"), F.max(F.col("side") == "right").alias("r"))
    return deep.filter("notches >= 2 AND l AND r").select("region", "notches")


def circle_gate(circles: DataFrame) -> DataFrame:
    """Circles whose measures pass: circularity, aspect, radius, edge support, sides, inner density."""
    return circles.filter("circularity >= 0.65 AND aspect <= 1.35 AND radius BETWEEN 3 AND 60 AND support >= 0.65 AND weakest_side < 0.5 AND density <= 0.30")
