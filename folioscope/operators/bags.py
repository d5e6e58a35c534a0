"""Tiles and bags of paired pages (before and after masking), their scores, and figures of models that are held out by page.

Pixels need NumPy, one page at a time; all that follows is grouped by Catalyst, without collected lists.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.aggregates import rates, ratio
from folioscope.operators.pixels import components

# Labels of bags; weights and scales of clarity.
POSITIVE, NEGATIVE = "positive", "negative"
CONTRAST_WEIGHT, SHARPNESS_WEIGHT, HEIGHT_WEIGHT = 0.45, 0.4, 0.15
CONTRAST_SCALE, SHARPNESS_SCALE, HEIGHT_SCALE = 64.0, 8.0, 24.0
# End of the fixed values.


def changed(before: np.ndarray, after: np.ndarray, least: int = 30) -> np.ndarray:
    """Pixels that differ by ``least`` in any channel."""
    off = np.abs(before.astype(np.int64) - after.astype(np.int64)) >= least
    return off.any(axis=2) if off.ndim == 3 else off


def dilated(hit: np.ndarray, radius: int) -> np.ndarray:
    """True where a square of the radius around a pixel holds a true value; one pass for each axis."""
    out = hit.astype(bool)
    for axis in (0, 1):
        n = out.shape[axis]
        sums = np.concatenate([np.zeros_like(out.take([0], axis), dtype=np.int64), np.cumsum(out, axis=axis)], axis=axis)
        at = np.arange(n)
        out = sums.take(np.minimum(at + radius + 1, n), axis) > sums.take(np.maximum(at - radius, 0), axis)
    return out


def regions(hit: np.ndarray, least_area: int) -> np.ndarray:
    """Labels (0: none) of components of an area at least, numbered from 1 by their first pixel."""
    label = components(hit)
    area = np.bincount(label.ravel())
    stays = area >= least_area
    stays[0] = False
    return np.where(stays, np.cumsum(stays), 0)[label]


def tile_places(width: int, height: int, size: int, stride: int) -> list[tuple[int, int]]:
    """(x, y) of tiles by rows, up to both far edges; none where the page is smaller than a tile."""
    if width < size or height < size:
        return []
    starts = lambda length: sorted({*range(0, length - size + 1, stride), length - size})
    return [(x, y) for y in starts(height) for x in starts(width)]


def _pages(df: DataFrame, key: str, columns: list[str], schema: T.StructType, rows) -> DataFrame:
    """``rows(name, page, ...)`` for each page of (key, width, height, arrays of grey levels); a page without pixels gives none."""

    def run(batches):
        for batch in batches:
            out = []
            for name, width, height, *pixels in zip(batch[key], batch["width"], batch["height"], *(batch[c] for c in columns), strict=True):
                if all(p is not None and len(p) == width * height > 0 for p in pixels):
                    out += rows(name, *(np.asarray(p, dtype=np.int64).reshape(int(height), int(width)) for p in pixels))
            yield pd.DataFrame(out, columns=schema.names)

    return df.select(key, "width", "height", *columns).mapInPandas(run, schema)


def _schema(df: DataFrame, key: str, rest: str) -> T.StructType:
    return T.StructType([T.StructField(key, df.schema[key].dataType), *T.StructType.fromDDL(rest).fields])


def region_bags(
    df: DataFrame, key: str = "page_id", size: int = 64, stride: int = 32, least: int = 30, least_area: int = 16, least_fraction: float = 0.05, radius: int = 8
) -> DataFrame:
    """(key, bag_id, bag_label, x, y, region, fraction) of pages (key, width, height, before, after).

    A changed region is a bag of the tiles that it fills to a fraction; a tile without change within the radius is a negative
    bag of its own. All changes exclude negatives, those of small regions too. Pages whose arrays do not fit their size, and
    null arrays, give no rows.
    """
    if not 0 < least_fraction <= 1:
        raise ValueError("the fraction must be above 0 and at most 1")

    def rows(name, before, after):
        hit = changed(before, after, least)
        label, near = regions(hit, least_area), dilated(hit, radius)
        for k, (x, y) in enumerate(tile_places(hit.shape[1], hit.shape[0], size, stride)):
            inside = np.bincount(label[y : y + size, x : x + size].ravel()) / size**2
            for region in np.flatnonzero(inside[1:] >= least_fraction) + 1:
                yield name, f"{name}__region_{region:03d}", POSITIVE, x, y, region, inside[region]
            if not near[y : y + size, x : x + size].any():
                yield name, f"{name}__negative_{k:04d}", NEGATIVE, x, y, None, 0.0

    schema = _schema(df, key, "bag_id string, bag_label string, x int, y int, region int, fraction double")
    return _pages(df, key, ["before", "after"], schema, rows)


def paired_bags(df: DataFrame, key: str = "page_id", size: int = 64, stride: int = 32, least: int = 30, positive: float = 0.05, negative: float = 0.0) -> DataFrame:
    """(key, bag_id, bag_label, x, y, fraction): tiles by their share of changed pixels; those between the two bounds go."""
    if not 0 <= negative < positive <= 1:
        raise ValueError("the bounds must rise from 0 to 1")

    def rows(name, before, after):
        hit = changed(before, after, least)
        for x, y in tile_places(hit.shape[1], hit.shape[0], size, stride):
            fraction = float(hit[y : y + size, x : x + size].mean())
            if fraction >= positive or fraction <= negative:
                label = POSITIVE if fraction >= positive else NEGATIVE
                yield name, f"{name}__{label}", label, x, y, fraction

    return _pages(df, key, ["before", "after"], _schema(df, key, "bag_id string, bag_label string, x int, y int, fraction double"), rows)


def stretched(page: np.ndarray) -> np.ndarray:
    """Grey levels spread over 0 to 255; a page of one level stays."""
    low, high = int(page.min()), int(page.max())
    if high <= low:
        return page
    scale = 255.0 / (high - low)
    return np.clip((page * scale - low * scale).astype(np.int64), 0, 255)


def _triangles(length: int, size: int) -> np.ndarray:
    """Weights (size, length) of linear resampling; a shrinking filter widens with the scale."""
    scale = length / size
    support = max(scale, 1.0)
    centre = (np.arange(size) + 0.5) * scale
    first, last = np.maximum((centre - support + 0.5).astype(int), 0), np.minimum((centre + support + 0.5).astype(int), length)
    at = np.arange(length)
    weight = np.maximum(1 - np.abs(at + 0.5 - centre[:, None]) / support, 0) * ((at >= first[:, None]) & (at < last[:, None]))
    return weight / weight.sum(axis=1, keepdims=True)


def resized(page: np.ndarray, size: int) -> np.ndarray:
    """A square of grey levels, columns first, rounded after each axis."""
    wide = np.floor(page @ _triangles(page.shape[1], size).T + 0.5)
    return np.floor(_triangles(page.shape[0], size) @ wide + 0.5).clip(0, 255)


def features(page: np.ndarray, size: int = 32) -> np.ndarray:
    """Ink (0 to 1) and the magnitude of its edges, row by row."""
    if size < 8:
        raise ValueError("the size must be at least 8")
    grey = (resized(stretched(page), size) / 255).astype(np.float32)
    across, down = np.zeros_like(grey), np.zeros_like(grey)
    across[:, 1:-1] = grey[:, 2:] - grey[:, :-2]
    down[1:-1] = grey[2:] - grey[:-2]
    return np.concatenate([(1 - grey).ravel(), np.sqrt(across**2 + down**2).ravel()])


def tile_features(df: DataFrame, key: str = "page_id", size: int = 32) -> DataFrame:
    """(key, features) of tiles (key, width, height, pixels)."""
    schema = _schema(df, key, "features array<float>")
    return _pages(df, key, ["pixels"], schema, lambda name, page: [(name, features(page, size))])


def clarity(page: np.ndarray) -> float:
    """Contrast, sharpness and height of a line in one number from 0 to 1."""
    page = page.astype(np.int64)
    edges = page.copy()
    if min(page.shape) >= 3:
        around = sum(page[dy : dy + page.shape[0] - 2, dx : dx + page.shape[1] - 2] for dy in range(3) for dx in range(3))
        edges[1:-1, 1:-1] = np.clip(9 * page[1:-1, 1:-1] - around, 0, 255)
    contrast, sharpness = min(page.std() / CONTRAST_SCALE, 1.0), min(np.log1p(edges.var()) / SHARPNESS_SCALE, 1.0)
    return float(CONTRAST_WEIGHT * contrast + SHARPNESS_WEIGHT * sharpness + HEIGHT_WEIGHT * min(page.shape[0] / HEIGHT_SCALE, 1.0))


def clarity_scores(df: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, clarity) of lines (key, width, height, pixels)."""
    return _pages(df, key, ["pixels"], _schema(df, key, "clarity double"), lambda name, page: [(name, clarity(page))])


def bag_contracts(df: DataFrame, bag: str, label: str, page: str, positive: str = POSITIVE) -> DataFrame:
    """(bag, instances, target, page, problem): a bag has one label and one page; missing values differ from all others."""
    mixed = lambda c: (F.min(c) != F.max(c)) | (F.count(c) % F.count("*") != 0)
    found = df.groupBy(bag).agg(F.count("*").alias("instances"), F.min(label).alias("_label"), F.min(page).alias("page"), mixed(label).alias("_labels"), mixed(page).alias("_pages"))
    problem = F.when(F.col("_labels"), "mixed_labels").when(F.col("_pages"), "mixed_pages")
    return found.select(bag, "instances", (F.col("_label") == positive).cast("int").alias("target"), "page", problem.alias("problem"))


def bag_scores(df: DataFrame, bag: str, logit: str, temperature: float = 0.5) -> DataFrame:
    """(bag, logit, score): the log-mean-exp of the instances' logits at a temperature, and its logistic value.

    The greatest logit of a bag is subtracted first, so no exponential overflows; both steps add up before the exchange, so
    a large bag is no large task. Missing logits do not count; a bag of none has null.
    """
    top = df.groupBy(bag).agg((F.max(logit) / temperature).alias("_top"))
    each = df.select(bag, (F.col(logit) / temperature).alias("_z")).withColumnRenamed(bag, "_bag")
    mass = each.join(top, F.col("_bag").eqNullSafe(F.col(bag))).groupBy(bag, "_top").agg(F.avg(F.exp(F.col("_z") - F.col("_top"))).alias("_mean"))
    value = temperature * (F.col("_top") + F.ln("_mean"))
    logistic = 1 / (1 + F.exp(-F.least(F.lit(40.0), F.greatest(F.lit(-40.0), value))))
    return mass.select(bag, value.alias("logit"), F.when(value.isNotNull(), logistic).alias("score"))


def fold_thresholds(df: DataFrame, fold: str, target: str, score: str, min_recall: float) -> DataFrame:
    """(fold, threshold) for each fold's taught rows: with the recall (else all) the least false positive rate, then most recall, then the highest.

    Rows are counted by fold and score first; running sums go over distinct scores, in a hundred ranges of a fold.
    """
    hit = F.col(target).cast("long")
    counts = df.groupBy(fold, F.col(score).cast("double").alias("threshold")).agg(F.sum(hit).alias("_p"), F.sum(1 - hit).alias("_n"))
    ends = df.select(fold).distinct().select(fold, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("threshold"), F.lit(0).cast("long").alias("_p"), F.lit(0).cast("long").alias("_n"))
    counts = counts.unionByName(ends).groupBy(fold, "threshold").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    counts = counts.withColumn("_range", F.least(F.greatest(F.floor(F.col("threshold") * 100), F.lit(-1)), F.lit(101)))
    above = Window.partitionBy(fold).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy(fold, "_range").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    sums = [F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_above{c}") for c in ("_p", "_n")]
    whole = [F.sum(c).over(Window.partitionBy(fold)).alias(f"_all{c}") for c in ("_p", "_n")]
    ranges = ranges.select(F.col(fold).alias("_fold"), F.col("_range").alias("_r"), *sums, *whole)
    inner = Window.partitionBy(fold, "_range").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = counts.withColumns({f"_run{c}": F.sum(c).over(inner) for c in ("_p", "_n")})
    swept = swept.join(ranges, F.col(fold).eqNullSafe(F.col("_fold")) & (F.col("_range") == F.col("_r")))
    tp, fp = F.col("_run_p") + F.col("_above_p"), F.col("_run_n") + F.col("_above_n")
    rated = rates(swept.select(fold, "threshold", tp.alias("tp"), fp.alias("fp"), (F.col("_all_p") - tp).alias("fn"), (F.col("_all_n") - fp).alias("tn")))
    order = F.struct(~(F.col("recall") >= min_recall), F.col("false_positive_rate"), -F.col("recall"), -F.col("threshold"))
    return rated.groupBy(fold).agg(F.min_by("threshold", order).alias("threshold"))


def fold_reports(scores: DataFrame, thresholds: DataFrame, fold: str, target: str, score: str) -> DataFrame:
    """(fold, threshold, tp, fp, fn, tn, page_score, detected): each fold by its own threshold; its best positive decides detection."""
    known = thresholds.select(F.col(fold).alias("_fold"), "threshold")
    joined = scores.join(known, F.col(fold).eqNullSafe(F.col("_fold")))
    hit, found = F.col(target) == 1, F.col(score) >= F.col("threshold")
    counted = lambda c: F.count_if(c).alias
    best = F.coalesce(F.max(F.when(hit, F.col(score))), F.lit(0.0))
    out = joined.groupBy(fold, "threshold").agg(counted(hit & found)("tp"), counted(~hit & found)("fp"), counted(hit & ~found)("fn"), counted(~hit & ~found)("tn"), best.alias("page_score"))
    return out.withColumn("detected", F.col("page_score") >= F.col("threshold"))


def fold_totals(reports: DataFrame) -> DataFrame:
    """One row over all folds: counts, recall, missed and false positive rates, and detected pages."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    summed = reports.agg(*(total(c).alias(c) for c in ("tp", "fp", "fn", "tn")), F.count_if("detected").alias("pages_detected"), F.count("*").alias("pages"))
    tp, fp, fn, tn, hits, pages = (F.col(c) for c in ("tp", "fp", "fn", "tn", "pages_detected", "pages"))
    rate: dict[str, Column] = {"recall": ratio(tp, tp + fn), "missed_rate": ratio(fn, tp + fn), "false_positive_rate": ratio(fp, fp + tn), "page_recall": ratio(hits, pages)}
    return summed.withColumns(rate)
