"""Queries of ordered operators: windows, islands, selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.scalars import bucket_split, micros, sha256
from folioscope.operators import ordered as W
from folioscope.plans.registry import query
from folioscope.plans.texts import _SPLIT
from folioscope.session import table


@query(
    "gaps_and_islands",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS s FROM events), m AS (SELECT *, CASE WHEN s - max(s) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 21600000000 THEN 0 ELSE 1 END AS new FROM e),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
    SELECT user_id, CAST(island AS BIGINT) AS island, min(s) AS s, max(s) AS t, count(*) AS members FROM i GROUP BY user_id, island""",
)
def gaps_and_islands(spark, sf_dir):
    """Runs of a user's events that are at most six hours apart."""
    e = table(spark, sf_dir, "events").select("user_id", micros("ts").alias("s"), micros("ts").alias("t"))
    return W.merged_intervals(e, ["user_id"], "s", "t", 21_600_000_000)


@query(
    "interval_merge",
    """WITH e AS (SELECT o_custkey, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS s, CAST(epoch(o_orderdate) // 86400 + 20 + o_orderkey % 40 AS BIGINT) AS t FROM orders),
    m AS (SELECT *, CASE WHEN s <= max(t) OVER (PARTITION BY o_custkey ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM e),
    i AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
    SELECT o_custkey, CAST(island AS BIGINT) AS island, min(s) AS s, max(t) AS t, count(*) AS members FROM i GROUP BY o_custkey, island""",
)
def interval_merge(spark, sf_dir):
    """A customer's orders as intervals, those that overlap merged."""
    day = F.floor(micros("o_orderdate") / 86_400_000_000)
    e = table(spark, sf_dir, "orders").select("o_custkey", day.alias("s"), (day + 20 + F.col("o_orderkey") % 40).alias("t"))
    return W.merged_intervals(e, ["o_custkey"], "s", "t")


@query(
    "close_neighbours",
    """SELECT event_id, coalesce(s - lag(s) OVER w < 3600000000, FALSE) OR coalesce(lead(s) OVER w - s < 3600000000, FALSE) AS close
    FROM (SELECT event_id, user_id, epoch_us(ts) AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s)""",
)
def close_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", micros("ts").alias("s"), micros("ts").alias("t"))
    return W.neighbour_flags(e, ["user_id"], "s", "t", 3_600_000_000).select("event_id", "close")


@query("round_robin_pick", "WITH t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) SELECT source, doc_id, CAST(turn AS INT) AS turn FROM t ORDER BY turn, source LIMIT 50")
def round_robin_pick(spark, sf_dir):
    return W.round_robin(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"], 50)


@query(
    "split_unification",
    f"""WITH s AS (SELECT doc_id, sha256(text) AS h, {_SPLIT.format('source')} AS split FROM documents), g AS (SELECT h, bool_or(split = 'train') AS strong FROM s GROUP BY h)
    SELECT doc_id, split, CASE WHEN strong THEN 'train' ELSE split END AS final_split FROM s JOIN g USING (h)""",
)
def split_unification(spark, sf_dir):
    """Equal texts share a split: train wherever one of them is in train."""
    d = table(spark, sf_dir, "documents").select("doc_id", sha256(F.col("text")).alias("h"), bucket_split(F.col("source")).alias("split"))
    return W.unified_splits(d, "h", "split").select("doc_id", "split", "final_split")


@query("cross_source_leakage", "SELECT sha256(text) AS h, array_to_string(list_sort(list_distinct(list(source))), ',') AS splits, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_source_leakage(spark, sf_dir):
    """Texts that occur in more than one source."""
    found = W.split_leakage(table(spark, sf_dir, "documents").select(sha256(F.col("text")).alias("h"), "source"), "h", "source")
    return found.select("h", F.array_join("splits", ",").alias("splits"), "n")


@query("worst_k", "SELECT d.doc_id, d.n_chars, l.quality FROM labels l JOIN documents d USING (doc_id) ORDER BY l.quality, d.n_chars DESC, d.doc_id DESC LIMIT 20")
def worst_k(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return W.worst(d, [F.col("quality").asc(), F.desc("n_chars"), F.desc("doc_id")], 20)


@query(
    "tile_grid",
    """WITH d AS (SELECT doc_id, 100 + n_chars % 500 AS w, 100 + doc_id % 300 AS h FROM documents), k AS (SELECT * FROM d WHERE w >= 128 AND h >= 128)
    SELECT doc_id, count(*) AS tiles, CAST(sum(x) AS BIGINT) AS xs, CAST(sum(y) AS BIGINT) AS ys FROM (SELECT doc_id, unnest(list_distinct(list_append(range(0, w - 127, 96), w - 128))) AS x, ys FROM (SELECT doc_id, w, list_distinct(list_append(range(0, h - 127, 96), h - 128)) AS ys FROM k)), LATERAL (SELECT unnest(ys) AS y) GROUP BY doc_id""",
)
def tile_grid(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (100 + F.col("n_chars") % 500).cast("int").alias("w"), (100 + F.col("doc_id") % 300).cast("int").alias("h"))
    return W.tiles(d, "w", "h", 128, 96).groupBy("doc_id").agg(F.count("*").alias("tiles"), F.sum("x").alias("xs"), F.sum("y").alias("ys"))


@query("polygon_areas", "SELECT l_orderkey, l_linenumber, abs((l_partkey % 50) * (l_suppkey % 50 + 1) - (l_suppkey % 7) * (l_linenumber * 3)) AS twice_area FROM lineitem")
def polygon_areas(spark, sf_dir):
    """Triangles from the origin."""
    point = lambda x, y: F.array(x.cast("long"), y.cast("long"))
    triangle = F.array(point(F.lit(0), F.lit(0)), point(F.col("l_partkey") % 50, F.col("l_suppkey") % 7), point(F.col("l_linenumber") * 3, F.col("l_suppkey") % 50 + 1))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", W.shoelace(triangle).alias("twice_area"))


@query("priority_spans")
def priority_spans(spark, sf_dir):
    """Spans of three classes in each order; a class of higher priority wins an overlap."""
    e = table(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") % 40).cast("int")
    span = F.struct((F.col("l_suppkey") % 3).cast("int").alias("priority"), start.alias("start"), (start + 3 + F.col("l_linenumber")).alias("end"))
    grouped = e.groupBy("l_orderkey").agg(F.collect_list(span).alias("spans"))
    kept = W.priority_spans(F.col("spans"))
    return grouped.select("l_orderkey", F.size("spans").alias("n"), F.size(kept).alias("kept"), F.array_join(F.transform(kept, lambda s: s["start"].cast("string")), ",").alias("starts"))
