"""Queries of the geometry operators, on boxes made from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import geometry as G
from folioscope.plans.registry import query
from folioscope.session import table


@query(
    "nearest_within_reach",
    """WITH b AS (SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS id, l_partkey % 400 AS l, l_orderkey % 500 AS t, l_partkey % 400 + 60 AS r, l_orderkey % 500 + 8 AS b FROM lineitem),
    p AS (SELECT s_suppkey AS page, k, (s_suppkey * 37 + k * 101) % 460 AS x, (s_suppkey * 53 + k * 89) % 520 AS y FROM supplier, range(0, 20) a(k)),
    d AS (SELECT p.page, k, id, sqrt(power(greatest(l - x, 0, x - r), 2) + power(greatest(t - y, 0, y - b), 2)) AS away FROM p JOIN b ON b.page = p.page),
    m AS (SELECT page, k, id, away, row_number() OVER (PARTITION BY page, k ORDER BY away, id) AS n FROM d WHERE away <= greatest(12, 500 * 0.025))
    SELECT p.page, CAST(p.k AS INT) AS k, m.id, round(m.away, 6) AS distance FROM p LEFT JOIN m ON m.page = p.page AND m.k = p.k AND n = 1""",
)
def nearest_within_reach(spark, sf_dir):
    """Twenty taps on each page, each to the nearest line within reach."""
    x, y = F.col("l_partkey") % 400, F.col("l_orderkey") % 500
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.struct(x.alias("left"), y.alias("top"), (x + 60).alias("right"), (y + 8).alias("bottom")).alias("box"))
    s, k = F.col("s_suppkey"), F.col("k")
    taps = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    taps = taps.select(s.alias("page"), "k", ((s * 37 + k * 101) % 460).alias("x"), ((s * 53 + k * 89) % 520).alias("y"), G.reach(F.lit(500), F.lit(520)).alias("reach"))
    return G.nearest_within(taps, boxes, ["page"], "k", "id", 12.5).withColumn("distance", F.round("distance", 6))


_WORDS = "SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey % 2 AS line, l_linenumber * 10 AS s, l_linenumber * 10 + 8 AS e, l_partkey % 200 AS l, l_partkey % 200 + 40 AS r, l_suppkey % 2 * 20 AS t FROM lineitem"


@query(
    "span_boxes",
    f"""WITH w AS ({_WORDS}), p AS (SELECT o_orderkey AS o, o_custkey % 5 * 10 AS a, o_custkey % 5 * 10 + 25 AS z FROM orders),
    h AS (SELECT p.o, w.* EXCLUDE (o), max(r) OVER (PARTITION BY p.o ORDER BY l, r ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS before FROM p JOIN w ON w.o = p.o AND e > a AND s < z),
    g AS (SELECT o, count(*) AS words, count(DISTINCT line) AS lines, min(l) AS l, min(t) AS t, max(r) AS r, max(t) + 15 AS b, max(l - before) AS gap FROM h GROUP BY o),
    q AS (SELECT p.o, coalesce(words, 0) AS words, CASE WHEN words IS NULL THEN 'no_words' WHEN words > 2 THEN 'too_many_words' WHEN lines > 1 THEN 'several_lines' WHEN gap > 30 THEN 'wide_gap' END AS reason, l, t, r, b FROM p LEFT JOIN g ON g.o = p.o)
    SELECT o AS span_id, words, reason, CASE WHEN reason IS NULL THEN l || ',' || t || ',' || r || ',' || b END AS box FROM q""",
)
def span_boxes(spark, sf_dir):
    """Spans over the words of an order: at most two, on one line, no further apart than 30."""
    x, y, n = F.col("l_partkey") % 200, F.col("l_suppkey") % 2 * 20, F.col("l_linenumber")
    box = F.struct(x.alias("left"), y.alias("top"), (x + 40).alias("right"), (y + 15).alias("bottom"))
    words = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_suppkey") % 2).alias("line"), (n * 10).alias("start"), (n * 10 + 8).alias("end"), box.alias("box"))
    a = F.col("o_custkey") % 5 * 10
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), F.col("o_orderkey").alias("span_id"), a.alias("span_start"), (a + 25).alias("span_end"))
    found = G.span_boxes(spans, words, ["o"], most=2, max_gap=30)
    return found.select("span_id", "words", "reason", F.when(F.col("box").isNotNull(), F.concat_ws(",", *(F.col(f"box.{s}").cast("string") for s in ("left", "top", "right", "bottom")))).alias("box"))


@query(
    "overlap_unions",
    """WITH m AS (SELECT l_orderkey AS o, l_partkey % 300 AS t, l_partkey % 300 + 20 AS b FROM lineitem), r AS (SELECT o_orderkey AS o, o_custkey % 280 AS t, o_custkey % 280 + 30 AS b FROM orders)
    SELECT r.o, least(min(r.t), min(m.t)) AS top, greatest(max(r.b), max(m.b)) AS bottom, count(m.o) AS masks FROM r LEFT JOIN m ON m.o = r.o AND m.b > r.t AND m.t < r.b GROUP BY r.o""",
)
def overlap_unions(spark, sf_dir):
    t, c = F.col("l_partkey") % 300, F.col("o_custkey") % 280
    masks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), t.alias("top"), (t + 20).alias("bottom"))
    regions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), c.alias("top"), (c + 30).alias("bottom"))
    return G.overlap_unions(masks, regions.withColumn("region", F.col("o")), ["o"], "region").drop("region")


@query(
    "quad_problems",
    """WITH q AS (SELECT l_orderkey, l_linenumber, [l_partkey % 40, 100 + l_suppkey % 30, 90 + l_partkey % 60, l_suppkey % 50]::DOUBLE[] AS x, [l_suppkey % 30, l_partkey % 50, 40 + l_suppkey % 90, 30 + l_partkey % 110 - 25]::DOUBLE[] AS y FROM lineitem),
    t AS (SELECT *, list_transform(range(0, 4), lambda k: (x[(k + 1) % 4 + 1] - x[k + 1]) * (y[(k + 2) % 4 + 1] - y[(k + 1) % 4 + 1]) - (y[(k + 1) % 4 + 1] - y[k + 1]) * (x[(k + 2) % 4 + 1] - x[(k + 1) % 4 + 1])) AS t,
      list_transform(range(0, 4), lambda k: sqrt(power(x[(k + 1) % 4 + 1] - x[k + 1], 2) + power(y[(k + 1) % 4 + 1] - y[k + 1], 2))) AS s, list_sum(list_transform(range(0, 4), lambda k: x[k + 1] * y[(k + 1) % 4 + 1] - x[(k + 1) % 4 + 1] * y[k + 1])) AS a FROM q)
    SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN list_min(x) < 0 OR list_min(y) < 0 OR list_max(x) > 140 OR list_max(y) > 120 THEN 'outside' END, CASE WHEN NOT (list_max(t) < 0 OR list_min(t) > 0) THEN 'not_convex' END,
      CASE WHEN abs(a) / 2 < 0.2 * 140 * 120 THEN 'small' END, CASE WHEN greatest(s[1] + s[3], s[2] + s[4]) > 2.5 * least(s[1] + s[3], s[2] + s[4]) THEN 'aspect' END], lambda v: v IS NOT NULL), ',') AS problems FROM t""",
)
def quad_problems(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    points = [(p % 40, s % 30), (100 + s % 30, p % 50), (90 + p % 60, 40 + s % 90), (s % 50, 30 + p % 110 - 25)]
    corners = F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", corners.alias("corners"))
    return d.select("l_orderkey", "l_linenumber", F.array_join(G.quad_problems(F.col("corners"), F.lit(140), F.lit(120), 0.2, 2.5), ",").alias("problems"))


@query(
    "fitted_points",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey % 320 + 0.37::DOUBLE AS x, l_suppkey % 200 + 0.41::DOUBLE AS y, least(320.0 / (l_partkey % 90 + 50), 200.0 / (l_suppkey % 70 + 40))::DOUBLE AS s, l_partkey % 90 + 50 AS w, l_suppkey % 70 + 40 AS h FROM lineitem),
    f AS (SELECT *, (x - (320 - w * s) / 2) / s AS px, (y - (200 - h * s) / 2) / s AS py FROM p)
    SELECT l_orderkey, l_linenumber, CASE WHEN px >= 0 AND px < w AND py >= 0 AND py < h THEN round(px, 9) END AS x FROM f""",
)
def fitted_points(spark, sf_dir):
    w, h = F.col("l_partkey") % 90 + 50, F.col("l_suppkey") % 70 + 40
    x, y = F.col("l_partkey") % 320 + F.lit(0.37), F.col("l_suppkey") % 200 + F.lit(0.41)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(G.fitted_point(x, y, F.lit(320.0), F.lit(200.0), w, h)["x"], 9).alias("x"))


@query(
    "image_admissions",
    """SELECT p_partkey, CASE WHEN w <= 0 THEN 'dimensions' WHEN w * h > 32000000 THEN 'pixels' WHEN greatest(w, h) > 8192 THEN 'long_side' WHEN w * h * c * 4 > 402653184 THEN 'memory' END AS reason
    FROM (SELECT p_partkey, p_partkey * 37 % 9000 AS w, p_partkey * 53 % 7000 + 1 AS h, p_size % 4 + 1 AS c FROM part)""",
)
def image_admissions(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", G.admission(k * 37 % 9000, k * 53 % 7000 + 1, F.col("p_size") % 4 + 1, F.lit(4)).alias("reason"))


@query("column_points", "SELECT l_suppkey, CAST(band AS BIGINT) AS band, id, CAST(rank AS INT) AS rank FROM (SELECT l_suppkey, x // 50 AS band, id, row_number() OVER (PARTITION BY l_suppkey, x // 50 ORDER BY q DESC, x, id) AS rank FROM (SELECT l_suppkey, l_partkey % 400 AS x, l_orderkey * 10 + l_linenumber AS id, l_quantity AS q FROM lineitem)) WHERE rank <= 3")
def column_points(spark, sf_dir):
    """The three largest lines of each band of 50 of a page; the id is the height."""
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 400).alias("x"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("y"), "l_quantity")
    return G.column_points(d, ["l_suppkey"], "x", "l_quantity", 50).select("l_suppkey", "band", F.col("y").alias("id"), "rank")
