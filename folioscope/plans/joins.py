"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions.scalars import micros, sha256
from folioscope.operators import joins as J
from folioscope.operators import ordered
from folioscope.plans.registry import query
from folioscope.session import table


@query("benchmark_containment", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_containment(spark, sf_dir):
    """Documents that hold a whole benchmark text."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("pattern"))
    return J.rule_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), items, literal=True).select("doc_id", "item_id")


@query(
    "train_gold_exclusions",
    """SELECT d.doc_id, array_to_string(list_filter([CASE WHEN sha256(d.text) IN (SELECT sha256(text) FROM benchmark) OR d.doc_id % 50 = 0 THEN 'text_sha256' END,
    CASE WHEN d.lang = 'de' AND d.doc_id IN (SELECT item_id FROM benchmark) THEN 'source_id' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents d""",
)
def train_gold_exclusions(spark, sf_dir):
    """Training rows with the reasons that keep them out: equal text, or (for one tier) equal source id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", sha256(F.col("text")).alias("text_sha256"))
    docs = docs.withColumn("source_id", F.when(F.col("lang") == "de", F.col("doc_id"))).withColumn("text_sha256", F.when(F.col("doc_id") % 50 == 0, F.lit("gold")).otherwise(F.col("text_sha256")))
    gold = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("source_id"), sha256(F.col("text")).alias("text_sha256"))
    hashes = gold.select("text_sha256").unionByName(spark.range(1).select(F.lit("gold").alias("text_sha256")))
    found = J.without_known(docs, {"text_sha256": ("text_sha256", hashes), "source_id": ("source_id", gold)})
    return found.select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "nearest_preceding_marker",
    """WITH m AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'),
    u AS (SELECT user_id, ts, 0 AS k, event_id, epoch_us(ts) AS us FROM m UNION ALL SELECT user_id, ts, 1, event_id, epoch_us(ts) FROM v),
    w AS (SELECT *, last_value(CASE WHEN k = 0 THEN event_id END IGNORE NULLS) OVER o AS click, last_value(CASE WHEN k = 0 THEN us END IGNORE NULLS) OVER o AS mark_us FROM u
      WINDOW o AS (PARTITION BY user_id ORDER BY us, k, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT event_id, CASE WHEN us - mark_us <= 86400000000 THEN click END AS click_id FROM w WHERE k = 1""",
)
def nearest_preceding_marker(spark, sf_dir):
    """Each purchase with the same user's last click, up to a day before."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", micros("ts").alias("us"), "event_type")
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("us").alias("click_us"), F.col("event_id").alias("click_id"))
    found = J.nearest_preceding(e.filter("event_type = 'purchase'").drop("event_type"), clicks, ["user_id"], "us", "click_us", ["click_id"], 86_400_000_000)
    return found.select("event_id", F.col("preceding_click_id").alias("click_id"))


_BOX = "l_orderkey, l_linenumber AS n, min(l_partkey) % 60 AS x, min(l_suppkey) % 60 AS y"


@query(
    "containment_nearest",
    f"""WITH b AS (SELECT {_BOX} FROM lineitem GROUP BY ALL), i AS (SELECT l_orderkey AS k, n, x AS l, y AS t, x + 5 + n AS r, y + 5 AS b FROM b),
    o AS (SELECT l_orderkey AS k, n, x - 30 AS l, y - 30 AS t, x + 60 AS r, y + 60 AS b FROM b)
    SELECT i.k AS l_orderkey, i.n AS inner_id, (SELECT arg_min(o.n, ((o.l + o.r - i.l - i.r) * (o.l + o.r - i.l - i.r) + (o.t + o.b - i.t - i.b) * (o.t + o.b - i.t - i.b)) * 100 + o.n)
      FROM o WHERE o.k = i.k AND o.l <= i.l AND o.t <= i.t AND o.r >= i.r AND o.b >= i.b) AS outer_id FROM i""",
)
def containment_nearest(spark, sf_dir):
    """Small boxes with the nearest large box of their order that holds them."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("n"))
    base = lines.agg((F.min("l_partkey") % 60).alias("x"), (F.min("l_suppkey") % 60).alias("y"))
    def box(left, top, right, bottom):
        return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))

    x, y, n = F.col("x"), F.col("y"), F.col("n")
    inner = base.select("l_orderkey", n.alias("inner_id"), box(x, y, x + 5 + n, y + 5).alias("inner_box"))
    outer = base.select("l_orderkey", n.alias("outer_id"), box(x - 30, y - 30, x + 60, y + 60).alias("outer_box"))
    return J.containment_nearest(inner, outer, ["l_orderkey"], "inner_id", "outer_id", "inner_box", "outer_box")


@query("union_boxes", "SELECT l_orderkey, min(l_partkey % 60) AS left, min(l_suppkey % 60) AS top, max(l_partkey % 60 + 5) AS right, max(l_suppkey % 60 + 5) AS bottom, count(*) AS boxes FROM lineitem GROUP BY l_orderkey")
def union_boxes(spark, sf_dir):
    x, y = F.col("l_partkey") % 60, F.col("l_suppkey") % 60
    box = F.struct(x.alias("left"), y.alias("top"), (x + 5).alias("right"), (y + 5).alias("bottom"))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", box.alias("box"))
    return d.groupBy("l_orderkey").agg(*J.union_box(F.col("box")), F.count("*").alias("boxes"))


@query("points_in_boxes", "SELECT l_orderkey, count(*) AS hits FROM lineitem WHERE l_partkey % 100 >= l_suppkey % 40 AND l_partkey % 100 < l_suppkey % 40 + 30 AND l_suppkey % 100 >= 10 AND l_suppkey % 100 < 60 GROUP BY l_orderkey")
def points_in_boxes(spark, sf_dir):
    left = F.col("l_suppkey") % 40
    box = F.struct(left.alias("left"), F.lit(10).alias("top"), (left + 30).alias("right"), F.lit(60).alias("bottom"))
    hit = J.in_box(F.col("l_partkey") % 100, F.col("l_suppkey") % 100, F.col("box"))
    return table(spark, sf_dir, "lineitem").withColumn("box", box).filter(hit).groupBy("l_orderkey").agg(F.count("*").alias("hits"))


@query("interval_overlap", "SELECT o_orderkey, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE epoch(l_shipdate) + 864000 > epoch(o_orderdate) AND epoch(l_shipdate) < epoch(o_orderdate) + 5184000 GROUP BY o_orderkey")
def interval_overlap(spark, sf_dir):
    """Lines whose ten days touch the sixty days after their order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.floor(micros("o_orderdate") / 1_000_000).alias("span_start"), (F.floor(micros("o_orderdate") / 1_000_000) + 5_184_000).alias("span_end"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.floor(micros("l_shipdate") / 1_000_000).alias("start"), (F.floor(micros("l_shipdate") / 1_000_000) + 864_000).alias("end"))
    return J.span_words(orders, lines, ["k"]).groupBy(F.col("k").alias("o_orderkey")).agg(F.count("*").alias("lines"))


@query(
    "rule_theta_join",
    r"""WITH r(rule, pattern) AS (VALUES ('mail', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+'), ('digits', '[0-9]{4,}'), ('shout', '[A-Z]{6,}!'), ('table', ' \| ')),
    l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    k AS (SELECT doc_id, line, printf('P1-B%02d', row_number() OVER (PARTITION BY doc_id ORDER BY pos)) AS block_id FROM l WHERE trim(line) <> '')
    SELECT doc_id, rule, CAST(count(*) AS INT) AS blocks, min(block_id) AS first_block FROM k JOIN r ON regexp_matches(line, pattern) GROUP BY doc_id, rule""",
)
def rule_theta_join(spark, sf_dir):
    """Lines by the rules that they match."""
    rules = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(p).alias("pattern")) for n, p in (("mail", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), ("digits", "[0-9]{4,}"), ("shout", "[A-Z]{6,}!"), ("table", r" \| "))))))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).filter(F.trim("text") != "")
    lines = lines.withColumn("block_id", F.format_string("P1-B%02d", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))))
    found = J.rule_coverage(lines, rules, "doc_id")
    return found.select("doc_id", "rule", F.size("block_ids").alias("blocks"), F.array_min("block_ids").alias("first_block"))


@query(
    "reference_resolution",
    """WITH i AS (SELECT doc_id, [doc_id + 1, doc_id, -1, doc_id * 2] AS ids FROM documents),
    u AS (SELECT doc_id, list_distinct(ids) AS d, ids FROM i), e AS (SELECT doc_id, unnest(d) AS id, ids FROM u),
    p AS (SELECT e.doc_id, e.id, list_position(e.ids, e.id) AS pos, x.lang FROM e LEFT JOIN documents x ON x.doc_id = e.id)
    SELECT doc_id, coalesce(string_agg(lang, ',' ORDER BY pos) FILTER (WHERE lang IS NOT NULL), '') AS resolved, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE lang IS NULL), '') AS invalid FROM p GROUP BY doc_id""",
)
def reference_resolution(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    i = F.col("doc_id")
    rows = d.select("doc_id", F.array(i + 1, i, F.lit(-1).cast("long"), i * 2).alias("ids"))
    found = J.resolve_references(rows, d.select(F.col("doc_id").alias("target"), "lang"), "doc_id", "ids", "target", "lang")
    return found.select("doc_id", F.array_join("resolved", ",").alias("resolved"), F.array_join(F.transform("invalid", lambda x: x.cast("string")), ",").alias("invalid"))


@query(
    "null_safe_comparison",
    """WITH e AS (SELECT doc_id, nullif(lang, 'en') AS lang, n_chars AS v FROM documents WHERE doc_id % 11 <> 0), a AS (SELECT doc_id, nullif(lang, 'en') AS lang, n_chars + CAST(doc_id % 5 = 0 AS INT) AS v FROM documents WHERE doc_id % 7 <> 0)
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN e.doc_id IS NULL THEN 'unexpected' WHEN e.v IS NOT DISTINCT FROM a.v THEN 'match' ELSE 'differs' END AS status
    FROM e FULL JOIN a ON e.doc_id = a.doc_id AND e.lang IS NOT DISTINCT FROM a.lang) GROUP BY status""",
)
def null_safe_comparison(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("nullif(lang, 'en')").alias("lang"), F.col("n_chars").alias("v"))
    actual = d.filter("doc_id % 7 <> 0").withColumn("v", F.col("v") + (F.col("doc_id") % 5 == 0).cast("int"))
    return J.compare_null_safe(d.filter("doc_id % 11 <> 0"), actual, ["doc_id", "lang"], "v").groupBy("status").agg(F.count("*").alias("n"))


@query(
    "table_differences",
    """WITH b AS (SELECT * FROM labels WHERE doc_id % 9 <> 0), h AS (SELECT doc_id, quality, CASE WHEN doc_id % 4 = 0 THEN 1 - toxic ELSE toxic END AS toxic FROM labels WHERE doc_id % 10 <> 0)
    SELECT doc_id, change FROM (SELECT coalesce(b.doc_id, h.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN h.doc_id IS NULL THEN 'removed' WHEN (b.quality, b.toxic) IS DISTINCT FROM (h.quality, h.toxic) THEN 'changed' END AS change
    FROM b FULL JOIN h ON b.doc_id = h.doc_id) WHERE change IS NOT NULL""",
)
def table_differences(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    head = labels.filter("doc_id % 10 <> 0").withColumn("toxic", F.when(F.col("doc_id") % 4 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    return J.table_diff(labels.filter("doc_id % 9 <> 0"), head, "doc_id", ["quality", "toxic"])


@query("set_differences", "SELECT page_id AS id, 'left' AS side FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages)")
def set_differences(spark, sf_dir):
    pages, labels = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return ordered.both_differences(pages, labels, "id")


@query("missing_predictions", "SELECT d.lang, count(*) AS docs, CAST(sum(coalesce(l.quality, 0)) AS BIGINT) AS quality, count(*) - count(l.doc_id) AS without_label FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.lang")
def missing_predictions(spark, sf_dir):
    """Left join with a default for what is missing."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(1).alias("hit")), "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.coalesce("quality", F.lit(0))).alias("quality"), (F.count("*") - F.count("hit")).alias("without_label"))
