"""Queries of tiles and bags, on drawn pages, and of figures by fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import bags as B
from folioscope.plans.registry import query
from folioscope.session import table

WIDTH, HEIGHT, SIZE, STRIDE = 48, 32, 16, 12
# two boxes on each page; the first is small on some
_BOXES = """b AS (SELECT doc_id AS i, doc_id % 9 AS l1, doc_id % 5 AS t1, doc_id % 9 + 6 + doc_id % 4 AS r1, doc_id % 5 + 5 AS b1,
    20 + doc_id % 13 AS l2, 14 + doc_id % 7 AS t2, 28 + doc_id % 13 AS r2, 20 + doc_id % 7 AS b2 FROM documents),
    g AS (SELECT CAST(y_nr * 4 + x_nr AS INT) AS k, x, y FROM (VALUES (0, 0), (1, 12), (2, 24), (3, 32)) a(x_nr, x), (VALUES (0, 0), (1, 12), (2, 16)) c(y_nr, y))"""


def _met(n, far=0):
    return f"greatest(0, least(x + 16, r{n} + {far}) - greatest(x, l{n} - {far})) * greatest(0, least(y + 16, b{n} + {far}) - greatest(y, t{n} - {far}))"


def _drawn(spark, sf_dir):
    """A page of stripes for each document, before and after its two boxes were masked."""
    i = F.col("doc_id")
    x, y = (lambda p: p % WIDTH), (lambda p: F.floor(p / WIDTH))
    box = lambda p, left, top, right, bottom: (x(p) >= left) & (x(p) < right) & (y(p) >= top) & (y(p) < bottom)
    places = F.sequence(F.lit(0), F.lit(WIDTH * HEIGHT - 1))
    grey = lambda p: (60 + (p + i) % 7 * 10).cast("int")
    first = lambda p: box(p, i % 9, i % 5, i % 9 + 6 + i % 4, i % 5 + 5)
    second = lambda p: box(p, 20 + i % 13, 14 + i % 7, 28 + i % 13, 20 + i % 7)
    after = F.transform(places, lambda p: F.when(first(p) | second(p), 255).otherwise(grey(p)).cast("int"))
    return table(spark, sf_dir, "documents").select(i.alias("page_id"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.transform(places, grey).alias("before"), after.alias("after"))


@query(
    "region_bags",
    f"""WITH {_BOXES}, m AS (SELECT i, k, x, y, {_met(1)} AS a1, {_met(2)} AS a2, {_met(1, 2)} + {_met(2, 2)} AS near, (r1 - l1) * 5 >= 40 AS large FROM b, g)
    SELECT i AS page_id, i || '__region_001' AS bag_id, 'positive' AS bag_label, x, y, 1 AS region, round(a1 / 256, 6) AS fraction FROM m WHERE large AND a1 >= 0.05 * 256
    UNION ALL SELECT i, i || CASE WHEN large THEN '__region_002' ELSE '__region_001' END, 'positive', x, y, CASE WHEN large THEN 2 ELSE 1 END, round(a2 / 256, 6) FROM m WHERE a2 >= 0.05 * 256
    UNION ALL SELECT i, i || '__negative_' || lpad(CAST(k AS VARCHAR), 4, '0'), 'negative', x, y, NULL, 0.0 FROM m WHERE near = 0""",
)
def region_bags(spark, sf_dir):
    """Bags of the tiles of each masked region, and of tiles away from all of them."""
    found = B.region_bags(_drawn(spark, sf_dir), size=SIZE, stride=STRIDE, least_area=40, radius=2)
    return found.withColumn("fraction", F.round("fraction", 6))


@query(
    "paired_bags",
    f"""WITH {_BOXES}, m AS (SELECT i, x, y, ({_met(1)} + {_met(2)}) / 256 AS share FROM b, g), n AS (SELECT *, CASE WHEN share >= 0.15 THEN 'positive' ELSE 'negative' END AS label FROM m WHERE share >= 0.15 OR share <= 0.02)
    SELECT i AS page_id, i || '__' || label AS bag_id, label AS bag_label, x, y, round(share, 6) AS fraction FROM n""",
)
def paired_bags(spark, sf_dir):
    """Tiles with much and with hardly any change; those between go."""
    found = B.paired_bags(_drawn(spark, sf_dir), size=SIZE, stride=STRIDE, positive=0.15, negative=0.02)
    return found.withColumn("fraction", F.round("fraction", 6))


@query("tile_features")
def tile_features(spark, sf_dir):
    """Ink and edges of each drawn page; tests hold them against plain loops."""
    found = B.tile_features(_drawn(spark, sf_dir).withColumnRenamed("after", "pixels"), size=8)
    return found.select("page_id", F.transform("features", lambda x: F.round(x.cast("double"), 5)).alias("features"))


@query("clarity_scores")
def clarity_scores(spark, sf_dir):
    """Clarity of each drawn page; tests hold it against plain loops."""
    return B.clarity_scores(_drawn(spark, sf_dir).withColumnRenamed("after", "pixels")).withColumn("clarity", F.round("clarity", 6))


@query(
    "bag_contracts",
    """SELECT o_custkey AS bag, count(*) AS instances, CAST(min(o_orderstatus) = 'F' AS INT) AS target, min(o_orderpriority) AS page,
    CASE WHEN min(o_orderstatus) <> max(o_orderstatus) THEN 'mixed_labels' WHEN min(o_orderpriority) <> max(o_orderpriority) THEN 'mixed_pages' END AS problem FROM orders GROUP BY o_custkey""",
)
def bag_contracts(spark, sf_dir):
    """Orders as the instances of a customer's bag."""
    return B.bag_contracts(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "bag"), "bag", "o_orderstatus", "o_orderpriority", "F")


@query(
    "bag_scores",
    """WITH z AS (SELECT l_orderkey AS bag, (CAST(l_quantity AS DOUBLE) - 25) / 5 AS z FROM lineitem), m AS (SELECT bag, max(z) AS top FROM z GROUP BY bag),
    v AS (SELECT bag, 0.5 * (top + ln(avg(exp(z - top)))) AS v FROM z JOIN m USING (bag) GROUP BY bag, top)
    SELECT bag, round(v, 6) AS logit, round(1 / (1 + exp(-v)), 6) AS score FROM v""",
)
def bag_scores(spark, sf_dir):
    """Smooth maximum of the order lines' logits in each order."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bag"), ((F.col("l_quantity").cast("double") - 25) / 10).alias("z"))
    return B.bag_scores(rows, "bag", "z").select("bag", F.round("logit", 6).alias("logit"), F.round("score", 6).alias("score"))


_FOLDS = """s AS (SELECT lang AS fold, quality AS target, CAST(n_chars % 500 AS DOUBLE) / 500 AS score FROM labels JOIN documents USING (doc_id)),
    f AS (SELECT DISTINCT fold FROM s), t AS (SELECT f.fold, target, score FROM f JOIN s ON s.fold <> f.fold),
    h AS (SELECT DISTINCT fold, score AS threshold FROM t UNION SELECT fold, 0 FROM f UNION SELECT fold, 1 FROM f),
    c AS (SELECT h.fold, threshold, count(*) FILTER (WHERE target = 1 AND score >= threshold) AS tp, count(*) FILTER (WHERE target = 0 AND score >= threshold) AS fp,
    count(*) FILTER (WHERE target = 1) AS p, count(*) FILTER (WHERE target = 0) AS n FROM h JOIN t ON t.fold = h.fold GROUP BY h.fold, threshold),
    r AS (SELECT fold, threshold, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS recall, CASE WHEN n = 0 THEN 0 ELSE fp / n END AS rate FROM c),
    b AS (SELECT fold, threshold FROM r QUALIFY row_number() OVER (PARTITION BY fold ORDER BY CASE WHEN recall >= 0.6 THEN 0 ELSE 1 END, rate, recall DESC, threshold DESC) = 1),
    e AS (SELECT fold, threshold, count(*) FILTER (WHERE target = 1 AND score >= threshold) AS tp, count(*) FILTER (WHERE target = 0 AND score >= threshold) AS fp,
    count(*) FILTER (WHERE target = 1 AND score < threshold) AS fn, count(*) FILTER (WHERE target = 0 AND score < threshold) AS tn,
    coalesce(max(score) FILTER (WHERE target = 1), 0) AS page_score FROM s JOIN b USING (fold) GROUP BY fold, threshold)"""


def _reports(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("fold"), ((F.col("n_chars") % 500).cast("double") / 500).alias("score"))
    rows = d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("target")), "doc_id").select("fold", "target", "score")
    folds = rows.select(F.col("fold").alias("_fold")).distinct()
    taught = rows.join(F.broadcast(folds), F.col("fold") != F.col("_fold")).select(F.col("_fold").alias("fold"), "target", "score")
    return B.fold_reports(rows, B.fold_thresholds(taught, "fold", "target", "score", 0.6), "fold", "target", "score")


@query("fold_reports", f"WITH {_FOLDS} SELECT *, page_score >= threshold AS detected FROM e")
def fold_reports(spark, sf_dir):
    """Labelled documents of each language by the threshold that suits the other languages."""
    return _reports(spark, sf_dir)


@query(
    "fold_totals",
    f"""WITH {_FOLDS}, a AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn, count(*) FILTER (WHERE page_score >= threshold) AS pages_detected, count(*) AS pages FROM e)
    SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, pages_detected, pages, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
    round(CASE WHEN tp + fn = 0 THEN 0 ELSE fn / (tp + fn) END, 6) AS missed_rate, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / (fp + tn) END, 6) AS false_positive_rate, round(pages_detected / pages, 6) AS page_recall FROM a""",
)
def fold_totals(spark, sf_dir):
    found = B.fold_totals(_reports(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("recall", "missed_rate", "false_positive_rate", "page_recall")})
