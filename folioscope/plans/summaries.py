"""Queries of metrics and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.scalars import error_class
from folioscope.operators import aggregates as A
from folioscope.plans.registry import query
from folioscope.session import table

_RATE = "CASE WHEN {0} + {1} = 0 THEN 0.0 ELSE {2} / ({0} + {1}) END"
_RATES = f"round({_RATE.format('tp', 'fp', 'tp')}, 6) AS precision, round({_RATE.format('tp', 'fn', 'tp')}, 6) AS recall, round({_RATE.format('fp', 'tn', 'fp')}, 6) AS false_positive_rate"
_SCORED = "SELECT round(least(n_chars, 40000) / 40000, 6) AS score, quality FROM labels JOIN documents USING (doc_id)"
_SWEEP = f"""s AS ({_SCORED}), h AS (SELECT DISTINCT score AS threshold FROM s UNION SELECT 0.0 UNION SELECT 1.0),
    c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND quality = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND quality = 0) AS fp,
      count(*) FILTER (WHERE score < threshold AND quality = 1) AS fn, count(*) FILTER (WHERE score < threshold AND quality = 0) AS tn FROM h, s GROUP BY threshold)"""


def _scored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.round(F.least("n_chars", F.lit(40000)) / 40000, 6).alias("score"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "false_positive_rate")}).drop("accuracy")


@query("threshold_sweep", f"WITH {_SWEEP} SELECT threshold, tp, fp, fn, tn, {_RATES} FROM c")
def threshold_sweep(spark, sf_dir):
    return _rounded(A.threshold_sweep(_scored(spark, sf_dir), "quality", "score"))


@query(
    "threshold_choice",
    f"""WITH {_SWEEP}, r AS (SELECT *, {_RATE.format('tp', 'fn', 'tp')} AS rc, {_RATE.format('fp', 'tn', 'fp')} AS f FROM c)
    SELECT threshold, tp, fp, fn, tn, {_RATES} FROM r ORDER BY CASE WHEN rc >= 0.9 THEN 0 ELSE 1 END, f, rc DESC, threshold DESC LIMIT 1""",
)
def threshold_choice(spark, sf_dir):
    return _rounded(A.choose_threshold(A.threshold_sweep(_scored(spark, sf_dir), "quality", "score"), 0.9))


@query(
    "confusion_matrix",
    f"""WITH c AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND n_chars >= 2000) AS tp, count(*) FILTER (WHERE quality = 0 AND n_chars >= 2000) AS fp,
    count(*) FILTER (WHERE quality = 1 AND n_chars < 2000) AS fn, count(*) FILTER (WHERE quality = 0 AND n_chars < 2000) AS tn FROM labels JOIN documents USING (doc_id) GROUP BY lang) SELECT lang, tp, fp, fn, tn, {_RATES} FROM c""",
)
def confusion_matrix(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return _rounded(A.confusion(d, F.col("quality") == 1, F.col("n_chars") >= 2000, ["lang"]))


@query("page_rollup", "SELECT source, max(quality) AS quality, max(n_chars) AS n_chars FROM labels JOIN documents USING (doc_id) GROUP BY source")
def page_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return A.page_rollup(d, ["source"], "quality", "n_chars")


@query(
    "weighted_quality",
    """WITH d AS (SELECT lang, doc_id % 100 AS score, n_chars AS w, CASE WHEN n_chars < 500 THEN 'poor' WHEN n_chars < 2000 THEN 'warning' ELSE 'good' END AS level FROM documents)
    SELECT lang, round(sum(score * greatest(1, w)) / sum(greatest(1, w)), 6) AS weighted_score, arg_min(level, CASE level WHEN 'poor' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END) AS worst_level FROM d GROUP BY lang""",
)
def weighted_quality(spark, sf_dir):
    level = F.when(F.col("n_chars") < 500, "poor").when(F.col("n_chars") < 2000, "warning").otherwise("good")
    d = table(spark, sf_dir, "documents").select("lang", (F.col("doc_id") % 100).alias("score"), F.col("n_chars").alias("w"), level.alias("level"))
    found = A.weighted_quality(d, ["lang"], "score", "w", "level", ["poor", "warning", "good"])
    return found.withColumn("weighted_score", F.round("weighted_score", 6))


@query(
    "failure_classes",
    """WITH e AS (SELECT event_type, 400 + CAST(json_extract_string(props, '$.k') AS INT) AS code FROM events)
    SELECT event_type, CASE WHEN code IN (401, 403) THEN 'auth' WHEN code = 429 THEN 'rate_limit' WHEN code = 504 THEN 'timeout' WHEN code >= 500 THEN 'unavailable' ELSE 'other' END AS failure, count(*) AS n FROM e GROUP BY 1, 2""",
)
def failure_classes(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (400 + F.get_json_object("props", "$.k").cast("int")).alias("code"))
    return e.groupBy("event_type", error_class(F.col("code"), F.col("event_type")).alias("failure")).agg(F.count("*").alias("n"))


@query("json_properties", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY event_type")
def json_properties(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count("*").alias("n"))


@query(
    "otsu_thresholds",
    """WITH b AS (SELECT lang, CAST(n_chars % 256 AS INT) AS level, count(*) AS n FROM documents GROUP BY 1, 2),
    c AS (SELECT lang, level, sum(n) OVER r AS w0, sum(n * level) OVER r AS s0, sum(n) OVER g AS w, sum(n * level) OVER g AS s FROM b WINDOW r AS (PARTITION BY lang ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), g AS (PARTITION BY lang)),
    v AS (SELECT lang, level, CASE WHEN w0 = w THEN 0.0 ELSE round(pow(s0 / w0 - (s - s0) / (w - w0), 2) * w0 * (w - w0), 6) END AS v FROM c)
    SELECT lang, level AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY v DESC, level) AS rn FROM v) WHERE rn = 1""",
)
def otsu_thresholds(spark, sf_dir):
    return A.otsu_threshold(table(spark, sf_dir, "documents").select("lang", (F.col("n_chars") % 256).alias("v")), "v", ["lang"])


@query("medians", "SELECT lang, quantile_cont(n_chars, 0.5) AS median, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang")
def medians(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.median("n_chars").alias("median"), F.round(F.percentile("n_chars", F.lit(0.9)), 6).alias("p90"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query(
    "first_failures",
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 300 THEN 'short' WHEN text LIKE '%###%' THEN 'marks' WHEN lang <> 'en' THEN 'language' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY reason""",
)
def first_failures(spark, sf_dir):
    rules = [("short", F.col("n_chars") < 300), ("marks", F.contains(F.col("text"), F.lit("###"))), ("language", F.col("lang") != "en")]
    return A.first_failure(table(spark, sf_dir, "documents"), rules)


@query("reason_counts", "SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n_chars < 2000 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'language' END, CASE WHEN doc_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL)) AS reason FROM documents) GROUP BY reason")
def reason_counts(spark, sf_dir):
    reasons = F.array_compact(F.array(F.when(F.col("n_chars") < 2000, F.lit("short")), F.when(F.col("lang") != "en", F.lit("language")), F.when(F.col("doc_id") % 2 == 0, F.lit("even"))))
    return A.element_counts(table(spark, sf_dir, "documents").select(reasons.alias("reasons")), "reasons")


@query(
    "job_status",
    """WITH j AS (SELECT user_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'ok' WHEN event_type = 'signup' THEN 'timeout' ELSE 'failed' END AS s FROM events)
    SELECT user_id, CASE WHEN bool_and(s = 'ok') THEN 'ok' WHEN bool_or(s = 'ok') THEN 'partial' WHEN bool_or(s = 'failed') THEN 'failed' ELSE 'timeout' END AS job_status FROM j GROUP BY user_id""",
)
def job_status(spark, sf_dir):
    status = F.when(F.col("event_type").isin("click", "view", "purchase"), "ok").when(F.col("event_type") == "signup", "timeout").otherwise("failed")
    return A.status_rollup(table(spark, sf_dir, "events").select("user_id", status.alias("s")), ["user_id"], "s", ["failed", "timeout"])


@query("model_summary", "SELECT source, count(*) AS pages, count(*) FILTER (WHERE trim(text) <> '') AS non_empty, CAST(sum(n_chars) AS BIGINT) AS characters, round(count(*) FILTER (WHERE trim(text) <> '') / count(*), 6) AS rate FROM documents GROUP BY source")
def model_summary(spark, sf_dir):
    full = F.count_if(F.trim("text") != "")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("pages"), full.alias("non_empty"), F.sum("n_chars").alias("characters"), F.round(full / F.count("*"), 6).alias("rate"))
