"""Queries of the decision cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import decisions as D
from folioscope.operators.quality import characters_in
from folioscope.plans.registry import query
from folioscope.session import table


@query(
    "privacy_statuses",
    """SELECT doc_id, status, status IN ('redacted', 'template_safe') AS allowed FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN 'redacted' WHEN doc_id % 5 = 0 THEN 'needs_redaction' WHEN doc_id % 7 = 0 THEN 'template_safe' ELSE 'uncertain' END AS status FROM documents)""",
)
def privacy_statuses(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", D.privacy_status(i % 2 == 0, i % 3 == 0, i % 5 == 0, i % 7 == 0).alias("status"))
    return d.withColumn("allowed", D.ocr_allowed(F.col("status")))


@query(
    "handwriting_statuses",
    """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'uncertain' WHEN r < 0.0004 THEN 'no_handwriting_detected' WHEN doc_id % 3 > 0 THEN 'handwriting_detected' WHEN r < 0.002 THEN 'uncertain' ELSE 'no_handwriting_detected' END AS status FROM (SELECT doc_id, (n_chars % 50) / 10000 AS r FROM documents)""",
)
def handwriting_statuses(spark, sf_dir):
    i = F.col("doc_id")
    ratio = F.when(i % 10 != 0, (F.col("n_chars") % 50) / 10000)
    return table(spark, sf_dir, "documents").select("doc_id", D.handwriting_status(ratio, i % 3).alias("status"))


@query(
    "composed_statuses",
    """WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'review' ELSE 'reject' END AS own,
      CASE WHEN n_chars % 100 < 10 THEN 'fail_page_too_small' WHEN doc_id % 4 = 0 THEN 'review_no_text_measurement' WHEN n_chars % 20 < 6 THEN 'fail_text_too_small' ELSE 'pass' END AS up FROM documents)
    SELECT doc_id, up AS upstream, CASE WHEN up LIKE 'fail%' THEN 'reject' WHEN up LIKE 'review%' THEN CASE WHEN own = 'reject' THEN 'reject' ELSE 'review' END ELSE own END AS status,
    CASE WHEN up LIKE 'fail%' THEN 'a,upstream_resolution_failure' WHEN up LIKE 'review%' THEN 'a,upstream_resolution_review' ELSE 'a' END AS reasons FROM d""",
)
def composed_statuses(spark, sf_dir):
    i, n = F.col("doc_id"), F.col("n_chars")
    own = F.when(i % 3 == 0, "accepted").when(i % 3 == 1, "review").otherwise("reject")
    upstream = D.resolution_status(n % 100, n % 10, F.when(i % 4 != 0, n % 20), 10, 6)
    d = table(spark, sf_dir, "documents").select("doc_id", own.alias("own"), upstream.alias("upstream"))
    status, reasons = D.composed_status(F.col("own"), F.array(F.lit("a")), F.col("upstream"))
    return d.select("doc_id", "upstream", status.alias("status"), F.array_join(reasons, ",").alias("reasons"))


@query(
    "layout_classes",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 60 AS l, l_suppkey % 90 AS t, l_partkey % 60 + 10 + l_linenumber * 4 AS r, l_suppkey % 90 + 10 AS b FROM lineitem),
    c AS (SELECT *, (t + b) / 2.0 / 100 AS m FROM b)
    SELECT l_orderkey, l_linenumber, l, t, CASE WHEN m < 0.18 THEN 'party_header_zone' WHEN m < 0.42 THEN 'property_address_zone' WHEN m >= 0.72 THEN 'signature_zone' WHEN r >= 72 AND r - l <= 38 THEN 'right_label_shape' WHEN r - l <= 60 AND l_linenumber % 2 = 0 THEN 'digit_pattern' END AS reason,
    greatest(0, l - 12) AS padded_left, least(100, b + 3) AS padded_bottom FROM c""",
)
def layout_classes(spark, sf_dir):
    x, y, n = F.col("l_partkey") % 60, F.col("l_suppkey") % 90, F.col("l_linenumber")
    box = F.struct(x.alias("left"), y.alias("top"), (x + 10 + n * 4).alias("right"), (y + 10).alias("bottom"))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"))
    _, reason = D.layout_class(F.col("box"), F.lit(100), F.lit(100), F.col("l_linenumber") % 2 == 0)
    padded = D.padded_box(F.col("box"), F.lit(100), F.lit(100))
    return d.select("l_orderkey", "l_linenumber", F.col("box.left").alias("l"), F.col("box.top").alias("t"), reason.alias("reason"), padded["left"].alias("padded_left"), padded["bottom"].alias("padded_bottom"))


@query(
    "usefulness_scores",
    """WITH d AS (SELECT doc_id, doc_id % 7 AS a, doc_id % 5 AS m, len(regexp_extract_all(text, '[à-ÿ]')) AS n, len(regexp_extract_all(text, '[A-Za-z]')) AS l, (doc_id % 11) / 10 AS c, doc_id % 13 AS s, doc_id % 20 AS t FROM documents),
    e AS (SELECT *, l / greatest(1, n + l) AS sh, n / greatest(1, n + l) AS oth FROM d)
    SELECT doc_id, round(greatest(0.0, a * 3 + m * 2 + oth * 10 + c * 5 - sh * 8 - (CASE WHEN sh > 0.25 THEN (sh - 0.25) * 10 ELSE 0 END + CASE WHEN s >= 5 THEN least(s / 3, 8) ELSE 0 END + CASE WHEN t > 0 AND s / greatest(1, t) > 0.6 THEN 2 ELSE 0 END)), 3) AS score FROM e""",
)
def usefulness_scores(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    score = D.usefulness_score(i % 7, i % 5, characters_in(F.col("text"), "à-ÿ"), characters_in(F.col("text"), "A-Za-z"), (i % 11) / 10, i % 13, i % 20)
    return d.select("doc_id", score.alias("score"))


@query("best_attempts", "SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents GROUP BY source")
def best_attempts(spark, sf_dir):
    return D.best_attempt(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], "n_chars", "doc_id", ["doc_id", "n_chars"])


@query(
    "assertion_scores",
    """WITH b AS (SELECT doc_id, CAST(doc_id % 40 AS VARCHAR) AS case_id, lang, n_chars FROM documents), e AS (SELECT * FROM b WHERE doc_id % 11 <> 0), a AS (SELECT doc_id, case_id, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE lang END AS lang, n_chars + CAST(doc_id % 4 = 0 AS INT) AS n_chars FROM b WHERE doc_id % 7 <> 0)
    SELECT coalesce(e.case_id, a.case_id) AS case_id, count(e.doc_id) AS assertions_total, count(*) FILTER (WHERE e.lang = a.lang AND e.n_chars = a.n_chars) AS assertions_exact, count(*) FILTER (WHERE e.n_chars = a.n_chars) AS value_matches,
    count(*) FILTER (WHERE e.lang = a.lang) AS state_matches, count(*) FILTER (WHERE e.doc_id IS NOT NULL AND a.doc_id IS NOT NULL) AS refs_matches, count(*) FILTER (WHERE e.doc_id IS NULL) AS unexpected FROM e FULL JOIN a ON e.doc_id = a.doc_id GROUP BY 1""",
)
def assertion_scores(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", (i % 40).cast("string").alias("case_id"), i.alias("question_id"), F.when(i % 2 == 0, "m").alias("mechanism_id"), F.lit("f").alias("field"), F.col("n_chars").alias("value"), F.col("lang").alias("state"))
    expected = d.filter("doc_id % 11 <> 0").withColumn("refs", F.array(F.lit("a"), F.lit("b")))
    actual = d.filter("doc_id % 7 <> 0").withColumn("state", F.when(i % 3 == 0, "x").otherwise(F.col("state"))).withColumn("value", F.col("value") + (i % 4 == 0).cast("int")).withColumn("refs", F.array(F.lit("b"), F.lit("a")))
    return D.assertion_scores(expected, actual)


@query("cache_ledger", "SELECT sha256(text) AS text_sha256, CASE WHEN min(doc_id) % 2 = 0 THEN 'hit' ELSE 'miss' END AS cache, count(*) AS pages FROM documents GROUP BY 1")
def cache_ledger(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    cache = d.groupBy("text_sha256").agg(F.min("doc_id").alias("answer")).filter("answer % 2 = 0")
    return D.cache_ledger(d, cache, "text_sha256", "answer").groupBy("text_sha256", "cache").agg(F.count("*").alias("pages"))


@query(
    "routed_blocks",
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'X1' ELSE printf('B%02d', doc_id % 90 + 1) END AS block_id, CAST(doc_id // 80 AS VARCHAR) AS c FROM documents)
    SELECT rule, count(*) AS n FROM (SELECT 'block_id' AS rule FROM d WHERE block_id = 'X1' UNION ALL SELECT 'unknown_family' FROM d WHERE doc_id % 5 = 1 UNION ALL SELECT 'mixed_exclusion' FROM d WHERE doc_id % 5 = 2
    UNION ALL SELECT 'repeated_family' FROM d WHERE doc_id % 5 = 3 UNION ALL SELECT 'no_family' FROM d WHERE doc_id % 5 = 4 UNION ALL SELECT 'repeated_block' FROM d GROUP BY c, block_id HAVING count(*) > 1) GROUP BY rule""",
)
def routed_blocks(spark, sf_dir):
    i = F.col("doc_id").cast("int")
    text = lambda *x: F.array(*map(F.lit, x))
    families = F.when(i % 5 == 0, text("PAYMENT")).when(i % 5 == 1, text("WHAT")).when(i % 5 == 2, text("PAYMENT", "EXCLUDED")).when(i % 5 == 3, text("TERM", "TERM")).otherwise(F.array().cast("array<string>"))
    block = F.when(i % 19 == 0, "X1").otherwise(F.format_string("B%02d", i % 90 + 1))
    items = table(spark, sf_dir, "documents").select(F.floor(i / 80).cast("string").alias("case_id"), block.alias("block_id"), families.alias("families"))
    return D.routed_blocks(items, ["PAYMENT", "TERM"]).groupBy("rule").agg(F.count("*").alias("n"))


@query("request_guards", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'request_id' WHEN octet_length(encode(text)) + 8 > 5000 THEN 'too_large' WHEN doc_id % 3 = 1 THEN 'not_png' END AS refused FROM documents")
def request_guards(spark, sf_dir):
    i = F.col("doc_id")
    content = F.concat(F.unhex(F.when(i % 3 == 1, "0000000000000000").otherwise("89504E470D0A1A0A")), F.col("text").cast("binary"))
    name = F.when(i % 3 == 0, F.lit("a b")).otherwise(F.concat(F.lit("req-"), i.cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", D.guarded_request(name, content, 5000).alias("refused"))
