"""Windows over ordered rows, selections and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, by: list[str], start: str, end: str, max_gap: int | float = 0) -> DataFrame:
    """Adds island: runs of intervals of which none begins more than ``max_gap`` behind all before it."""
    before = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(end).over(before)
    marked = df.withColumn("_new", (reach.isNull() | (F.col(start) - reach > max_gap)).cast("int"))
    return marked.withColumn("island", F.sum("_new").over(upto)).drop("_new")


def merged_intervals(df: DataFrame, by: list[str], start: str, end: str, max_gap: int | float = 0) -> DataFrame:
    """One row for each island: its start, end and members."""
    return islands(df, by, start, end, max_gap).groupBy(*by, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("members"))


def neighbour_flags(df: DataFrame, by: list[str], start: str, end: str, min_gap: int | float) -> DataFrame:
    """Adds close: whether a row lies nearer than ``min_gap`` to the one before or after it; both sides are flagged."""
    w = Window.partitionBy(*by).orderBy(start)
    near_before = F.col(start) - F.lag(end).over(w) < min_gap
    near_after = F.lead(start).over(w) - F.col(end) < min_gap
    return df.withColumn("close", F.coalesce(near_before, F.lit(False)) | F.coalesce(near_after, F.lit(False)))


def round_robin(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """n rows, one from each group in turn."""
    w = Window.partitionBy(group).orderBy(*order)
    # no group gives more than n rows, so each is cut before the common order
    turned = df.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n)
    return turned.orderBy("turn", group).limit(n)


def unified_splits(df: DataFrame, group: str, split: str, strong: str = "train") -> DataFrame:
    """Adds final_split: the strong split for every group that has it somewhere. Groups are aggregated, then joined."""
    has = df.groupBy(group).agg(F.bool_or(F.col(split) == strong).alias("_strong"))
    return df.join(has, group).withColumn("final_split", F.when(F.col("_strong"), F.lit(strong)).otherwise(F.col(split))).drop("_strong")


def split_leakage(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that occur in more than one split, with the splits in order."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits"), F.count("*").alias("n")).filter(F.size("splits") > 1)


def worst(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def both_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has."""
    only_left = left.select(key).distinct().join(right.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    only_right = right.select(key).distinct().join(left.select(key), key, "left_anti").withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)


def tiles(df: DataFrame, width: str, height: str, size: int, stride: int) -> DataFrame:
    """One row for each tile of a grid that reaches both far edges; nothing where an image is smaller than a tile."""
    def starts(length: str) -> Column:
        last = F.col(length) - size
        return F.array_sort(F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))

    fits = df.filter((F.col(width) >= size) & (F.col(height) >= size))
    return fits.withColumn("y", F.explode(starts(height))).withColumn("x", F.explode(starts(width)))


def shoelace(points: Column) -> Column:
    """Twice the area of a polygon given as an array of (x, y) arrays; positive for either direction."""
    n = F.size(points)
    def cross(p: Column, i: Column) -> Column:
        q = F.get(points, F.pmod(i + 1, n))
        return F.get(p, F.lit(0)) * F.get(q, F.lit(1)) - F.get(q, F.lit(0)) * F.get(p, F.lit(1))

    return F.abs(F.aggregate(F.transform(points, cross), F.lit(0).cast("long"), lambda a, x: a + x.cast("long")))


def priority_spans(spans: Column) -> Column:
    """Spans (priority, start, end, ...) that overlap none accepted before, by priority, start and length."""
    ordered = F.array_sort(spans)
    empty = F.slice(ordered, 1, 0)
    return F.aggregate(ordered, empty, lambda kept, s: F.when(F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept).otherwise(F.array_append(kept, s)))
