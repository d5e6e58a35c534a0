"""Metrics and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(above: Column, below: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(below == 0, F.lit(0.0)).otherwise(above / below)


def rates(df: DataFrame) -> DataFrame:
    """Adds precision, recall, false positive rate and accuracy to tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns(
        {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "false_positive_rate": ratio(fp, fp + tn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)}
    )


def confusion(df: DataFrame, target: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn and rates; target and predicted are booleans."""
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    found = df.groupBy(*(by or [])).agg(count(target & predicted).alias("tp"), count(~target & predicted).alias("fp"), count(target & ~predicted).alias("fn"), count(~target & ~predicted).alias("tn"))
    return rates(found)


def threshold_sweep(df: DataFrame, target: str, score: str) -> DataFrame:
    """tp, fp, fn, tn at each distinct score and at 0 and 1 (score >= threshold is positive).

    Counts for each score come first, so the running sums go over distinct scores, not over rows. Scores are bounded in
    number by their rounding; sums by score range are added where they are many.
    """
    counts = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(target).cast("long")).alias("_p"), F.sum(1 - F.col(target).cast("long")).alias("_n"))
    ends = df.sparkSession.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "threshold double, _p long, _n long")
    counts = counts.unionByName(ends).groupBy("threshold").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    # two levels: running sums in ranges of scores, and the ranges' own running sums (103 of them at most, whatever the scores)
    counts = counts.withColumn("_range", F.least(F.greatest(F.floor(F.col("threshold") * 100), F.lit(-1)), F.lit(101)))
    inner = Window.partitionBy("_range").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    outer = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.groupBy("_range").agg(F.sum("_p").alias("_rp"), F.sum("_n").alias("_rn"))
    before = ranges.select("_range", F.coalesce(F.sum("_rp").over(outer), F.lit(0)).alias("_bp"), F.coalesce(F.sum("_rn").over(outer), F.lit(0)).alias("_bn"))
    totals = ranges.agg(F.sum("_rp").alias("_tp"), F.sum("_rn").alias("_tn"))
    swept = counts.withColumns({"_cp": F.sum("_p").over(inner), "_cn": F.sum("_n").over(inner)}).join(F.broadcast(before), "_range").crossJoin(F.broadcast(totals))
    tp, fp = F.col("_cp") + F.col("_bp"), F.col("_cn") + F.col("_bn")
    return rates(swept.select("threshold", tp.alias("tp"), fp.alias("fp"), (F.col("_tp") - tp).alias("fn"), (F.col("_tn") - fp).alias("tn")))


def choose_threshold(sweep: DataFrame, min_recall: float) -> DataFrame:
    """Among thresholds with the recall (else all): least false positive rate, then most recall, then the highest."""
    order = F.struct(~(F.col("recall") >= min_recall), F.col("false_positive_rate"), -F.col("recall"), -F.col("threshold"))
    return sweep.agg(F.min_by(F.struct(*sweep.columns), order).alias("best")).select("best.*")


def page_rollup(df: DataFrame, by: list[str], target: str, score: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max(target).alias(target), F.max(score).alias(score))


def weighted_quality(df: DataFrame, by: list[str], score: str, weight: str, level: str, order: list[str]) -> DataFrame:
    """Mean score weighted by at least 1, and the worst level by the given order (worst first)."""
    w = F.greatest(F.lit(1), F.col(weight))
    place = F.array_position(F.array(*map(F.lit, order)), F.col(level))
    return df.groupBy(*by).agg((F.sum(F.col(score) * w) / F.sum(w)).alias("weighted_score"), F.min_by(level, place).alias("worst_level"))


def character_histogram(df: DataFrame, text: str = "text") -> DataFrame:
    """(character, n) over all texts."""
    return df.select(F.explode(F.split(text, "")).alias("character")).filter("character <> ''").groupBy("character").agg(F.count("*").alias("n"))


def element_counts(df: DataFrame, array: str, name: str = "reason") -> DataFrame:
    return df.select(F.explode(array).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def first_failure(df: DataFrame, rules: list[tuple[str, Column]], name: str = "reason") -> DataFrame:
    """How many rows fail each rule first; rows that fail none are not counted."""
    reason = F.coalesce(*(F.when(rule, F.lit(n)) for n, rule in rules))
    return df.withColumn(name, reason).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))


def character_error_rate(expected: Column, found: Column) -> Column:
    """Edits over expected characters; an empty expectation gives 0 for an empty text and 1 otherwise."""
    e, f = F.coalesce(expected, F.lit("")), F.coalesce(found, F.lit(""))
    return F.when(e == "", F.when(f == "", F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.levenshtein(e, f) / F.char_length(e))


def micro_error_rate(df: DataFrame, expected: str, found: str, by: list[str] | None = None) -> DataFrame:
    """errors, characters and their ratio (null without characters); a missing prediction deletes all characters."""
    e, f = F.coalesce(F.col(expected), F.lit("")), F.coalesce(F.col(found), F.lit(""))
    sums = df.groupBy(*(by or [])).agg(F.sum(F.levenshtein(e, f)).cast("long").alias("errors"), F.sum(F.char_length(e)).cast("long").alias("characters"))
    return sums.withColumn("cer", F.when(F.col("characters") == 0, None).otherwise(F.col("errors") / F.col("characters")))


def otsu_threshold(df: DataFrame, value: str, by: list[str], levels: int = 256) -> DataFrame:
    """For each group the level (0 to levels - 1) that best parts values up to it from those above; the first of equals."""
    bins = df.groupBy(*by, F.col(value).cast("int").alias("level")).agg(F.count("*").alias("n"))
    run = Window.partitionBy(*by).orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    w0, s0 = F.sum("n").over(run), F.sum(F.col("n") * F.col("level")).over(run)
    total, mass = F.sum("n").over(whole), F.sum(F.col("n") * F.col("level")).over(whole)
    parted = bins.select(*by, "level", w0.alias("w0"), s0.alias("s0"), total.alias("w"), mass.alias("s"))
    apart = F.when(F.col("w0") == F.col("w"), F.lit(0.0)).otherwise(F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0")), 2) * F.col("w0") * (F.col("w") - F.col("w0")))
    return parted.withColumn("v", F.round(apart, 6)).groupBy(*by).agg(F.max_by("level", F.struct("v", -F.col("level"))).alias("threshold"))


def status_rollup(df: DataFrame, by: list[str], status: str, priority: list[str]) -> DataFrame:
    """ok where all rows are ok, partial where some are, else the failure that comes first in the priority."""
    ok = F.col(status) == "ok"
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(status))
    found = df.groupBy(*by).agg(F.bool_and(ok).alias("_all"), F.bool_or(ok).alias("_some"), F.min_by(status, F.when(~ok, place)).alias("_worst"))
    return found.select(*by, F.when(F.col("_all"), "ok").when(F.col("_some"), "partial").otherwise(F.col("_worst")).alias("job_status"))
