"""Boxes, quadrilaterals and points on pages beyond containment: nearest with a tolerance, unions of overlapping spans, projections, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least reach of a tap in pixels, and as a share of the page's shorter side; bytes and pixels of an image at most, and its long side.
TAP_PIXELS, TAP_SHARE = 12.0, 0.025
MEMORY_BYTES, IMAGE_PIXELS, LONG_SIDE = 384 * 1024 * 1024, 32_000_000, 8192
# Words that a span may touch.
SPAN_WORDS = 64
# End of the fixed values.


def reach(width: Column, height: Column) -> Column:
    """How far from a line a tap may be to mean it."""
    return F.greatest(F.lit(TAP_PIXELS), F.least(width, height) * TAP_SHARE)


def distance_to_box(x: Column, y: Column, box: Column) -> Column:
    dx = F.greatest(box["left"] - x, F.lit(0), x - box["right"])
    dy = F.greatest(box["top"] - y, F.lit(0), y - box["bottom"])
    return F.sqrt(dx * dx + dy * dy)


def nearest_within(points: DataFrame, boxes: DataFrame, by: list[str], point_id: str, box_id: str, limit: float) -> DataFrame:
    """For each point (x, y, reach) the nearest box of its group within its reach, then the least id; null where there is none.

    ``limit``: no reach is larger (a larger one raises). Boxes are dealt to the rows of a grid of that height, so a point meets the boxes of three rows of its group, not all.
    """
    cell = lambda v: F.floor(v / limit)
    far = F.when(F.col("reach") > limit, F.raise_error(F.lit("a reach is over the limit")).cast("double")).otherwise(F.col("reach"))
    # a box lies in all rows it touches; each point looks into its own and the two beside it, and may meet a box more than once
    dealt = boxes.select(*by, F.col(box_id).alias("_box_id"), F.col("box").alias("_box"), F.explode(F.sequence(cell(F.col("box.top")), cell(F.col("box.bottom")))).alias("_cell"))
    asked = points.select(*by, point_id, "x", "y", far.alias("reach"), F.explode(F.sequence(cell(F.col("y")) - 1, cell(F.col("y")) + 1)).alias("_cell"))
    away = distance_to_box(F.col("x"), F.col("y"), F.col("_box"))
    pairs = asked.join(dealt, [*by, "_cell"]).withColumn("_away", away).filter("_away <= reach")
    best = pairs.groupBy(*by, point_id).agg(F.min(F.struct("_away", "_box_id")).alias("_best"))
    return points.select(*by, point_id).join(best, [*by, point_id], "left").select(*by, point_id, F.col("_best._box_id").alias(box_id), F.col("_best._away").alias("distance"))


def span_boxes(spans: DataFrame, words: DataFrame, by: list[str], most: int = SPAN_WORDS, max_gap: float | None = None) -> DataFrame:
    """Each span's (span_id, span_start, span_end) enclosing box of the words (line, start, end, box) that it touches.

    reason: no_words, too_many_words, several_lines, or wide_gap where neighbouring words lie further apart than ``max_gap``; the box is null then.
    """
    touched = spans.join(words, by, "left").withColumn("_hit", F.coalesce((F.col("end") > F.col("span_start")) & (F.col("start") < F.col("span_end")), F.lit(False)))
    hit = lambda c: F.when(F.col("_hit"), c)
    box = F.col("box")
    sides = F.sort_array(F.collect_list(hit(F.struct(box["left"].alias("left"), box["right"].alias("right")))))
    found = touched.groupBy(*by, "span_id").agg(
        F.count_if("_hit").alias("words"), F.count_distinct(hit(F.col("line"))).alias("_lines"), F.min(hit(box["left"])).alias("left"), F.min(hit(box["top"])).alias("top"), F.max(hit(box["right"])).alias("right"), F.max(hit(box["bottom"])).alias("bottom"), sides.alias("_sides")
    )
    gaps = F.zip_with(F.slice("_sides", 2, F.greatest(F.size("_sides") - 1, F.lit(0))), F.slice("_sides", 1, F.greatest(F.size("_sides") - 1, F.lit(0))), lambda b, a: b["left"] - a["right"])
    wide = F.lit(False) if max_gap is None else F.exists(gaps, lambda g: g > max_gap)
    reason = F.when(F.col("words") == 0, "no_words").when(F.col("words") > most, "too_many_words").when(F.col("_lines") > 1, "several_lines").when(wide, "wide_gap")
    whole = F.when(reason.isNull(), F.struct("left", "top", "right", "bottom"))
    return found.select(*by, "span_id", "words", reason.alias("reason"), whole.alias("box"))


def overlap_unions(masks: DataFrame, regions: DataFrame, by: list[str], region_id: str) -> DataFrame:
    """Each region (top, bottom) with the union of itself and the masks of its group that it overlaps vertically, and their number."""
    m = masks.select(*by, F.col("top").alias("_top"), F.col("bottom").alias("_bottom"))
    joined = regions.join(m, by, "left").withColumn("_hit", F.coalesce((F.col("_bottom") > F.col("top")) & (F.col("_top") < F.col("bottom")), F.lit(False)))
    return joined.groupBy(*by, region_id).agg(
        F.least(F.min("top"), F.min(F.when(F.col("_hit"), F.col("_top")))).alias("top"), F.greatest(F.max("bottom"), F.max(F.when(F.col("_hit"), F.col("_bottom")))).alias("bottom"), F.count_if("_hit").alias("masks")
    )


def quad_problems(corners: Column, width: Column, height: Column, least_share: float, max_aspect: float) -> Column:
    """What is wrong with four corners (x, y), in order: outside, not_convex, small, aspect.

    Corners are convex where all turns go one way, which also excludes crossing sides. The aspect is that of the mean lengths of opposite sides.
    """
    at = lambda k: F.element_at(corners, k % 4 + 1)
    turn = [(at(k + 1)["x"] - at(k)["x"]) * (at(k + 2)["y"] - at(k + 1)["y"]) - (at(k + 1)["y"] - at(k)["y"]) * (at(k + 2)["x"] - at(k + 1)["x"]) for k in range(4)]
    side = [F.sqrt(F.pow(at(k + 1)["x"] - at(k)["x"], 2) + F.pow(at(k + 1)["y"] - at(k)["y"], 2)) for k in range(4)]
    doubled = sum((at(k)["x"] * at(k + 1)["y"] - at(k + 1)["x"] * at(k)["y"] for k in range(4)), F.lit(0.0))
    across, down = side[0] + side[2], side[1] + side[3]
    outside = F.exists(corners, lambda c: (c["x"] < 0) | (c["y"] < 0) | (c["x"] > width) | (c["y"] > height))
    convex = (F.greatest(*turn) < 0) | (F.least(*turn) > 0)
    return F.array_compact(
        F.array(
            F.when(outside, "outside"), F.when(~convex, "not_convex"), F.when(F.abs(doubled) / 2 < least_share * width * height, "small"),
            F.when(F.greatest(across, down) > max_aspect * F.least(across, down), "aspect"),
        )
    )


def fitted_point(x: Column, y: Column, view_width: Column, view_height: Column, width: Column, height: Column) -> Column:
    """A point of a view as a point of the image that fits into it whole and centred; null beside the image."""
    scale = F.least(view_width / width, view_height / height)
    px, py = (x - (view_width - width * scale) / 2) / scale, (y - (view_height - height * scale) / 2) / scale
    inside = (px >= 0) & (px < width) & (py >= 0) & (py < height)
    return F.when(inside, F.struct(px.alias("x"), py.alias("y")))


def admission(width: Column, height: Column, channels: Column, copies: Column, memory: int = MEMORY_BYTES) -> Column:
    """Why an image is not taken: dimensions, pixels, long_side or memory (its bytes times the copies that work needs); null if it is."""
    w, h = width.cast("long"), height.cast("long")
    bad = F.coalesce((w <= 0) | (h <= 0), F.lit(True))
    return F.when(bad, "dimensions").when(w * h > IMAGE_PIXELS, "pixels").when(F.greatest(w, h) > LONG_SIDE, "long_side").when(w * h * channels * copies > memory, "memory")


def column_points(points: DataFrame, by: list[str], x: str, score: str, width: int, k: int = 3) -> DataFrame:
    """The best ``k`` points of each column band of a page by score, then leftmost, then topmost."""
    from folioscope.operators.gates import top_k

    return top_k(points.withColumn("band", F.floor(F.col(x) / width)), [*by, "band"], score, [x, "y"], k)
