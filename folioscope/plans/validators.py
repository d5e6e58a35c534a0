"""Queries of the validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.scalars import sha256
from folioscope.operators import evidence as E
from folioscope.operators import rules as R
from folioscope.plans.registry import query
from folioscope.session import table


@query(
    "role_sequences",
    """SELECT 'turns' AS rule, CAST(conv_id AS VARCHAR) AS key, printf('%d rows, %d positions, %d to %d', n, d, a, b) AS message FROM (SELECT conv_id, min(t) AS a, max(t) AS b, count(*) AS n, count(DISTINCT t) AS d
    FROM (SELECT conv_id, CASE WHEN conv_id % 10 = 0 THEN turn * 2 ELSE turn END AS t FROM conversations) GROUP BY conv_id) WHERE a <> 0 OR b <> n - 1 OR d <> n""",
)
def role_sequences(spark, sf_dir):
    """Conversations whose turns are not 0, 1, ...; every tenth is made to skip."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("conv_id") % 10 == 0, F.col("turn") * 2).otherwise(F.col("turn")).alias("t"))
    return R.not_contiguous(c, "conv_id", "t", "turns", first=0)


_MANIFEST = """m AS (SELECT CAST(CASE WHEN doc_id % 97 = 0 THEN doc_id + 1 ELSE doc_id END AS VARCHAR) AS sample_id, CASE WHEN lang = 'en' THEN 'synthetic' WHEN lang = 'de' THEN 'silver' WHEN lang = 'fr' THEN 'gold' ELSE 'other' END AS tier,
    CASE WHEN doc_id % 3 = 0 THEN 'train' WHEN doc_id % 3 = 1 THEN 'validation' ELSE 'test' END AS split, text, sha256(text) AS h, CASE WHEN doc_id % 50 = 0 THEN '' ELSE source END AS source FROM documents)"""


@query(
    "manifest_violations",
    f"""WITH {_MANIFEST} SELECT rule, count(*) AS n FROM (
    SELECT 'data_tier' AS rule FROM m WHERE tier = 'other' UNION ALL SELECT 'training_tier_in_test' FROM m WHERE tier IN ('synthetic', 'silver') AND split = 'test'
    UNION ALL SELECT 'gold_outside_test' FROM m WHERE tier = 'gold' AND split <> 'test' UNION ALL SELECT 'source_dataset_blank' FROM m WHERE source = ''
    UNION ALL SELECT 'text_not_canonical' FROM m WHERE text <> trim(regexp_replace(text, '\\s+', ' ', 'g')) UNION ALL SELECT 'duplicate_sample_id' FROM m GROUP BY sample_id HAVING count(*) > 1
    UNION ALL SELECT 'duplicate_image' FROM m GROUP BY h HAVING count(*) > 1 UNION ALL SELECT 'text_leakage' FROM m GROUP BY h HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'image_leakage' FROM m GROUP BY h HAVING count(DISTINCT split) > 1) GROUP BY rule""",
)
def manifest_violations(spark, sf_dir):
    """Documents read as a training manifest."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        F.when(i % 97 == 0, i + 1).otherwise(i).cast("string").alias("sample_id"), F.lit(1).alias("schema_version"), F.lit("d").alias("dataset_id"), F.lit("approved").alias("label_status"),
        F.when(i % 50 == 0, "").otherwise(F.col("source")).alias("source_dataset"), F.lit("s").alias("source_id"), "text", sha256(F.col("text")).alias("text_sha256"), sha256(F.col("text")).alias("image_sha256"),
        F.when(F.col("lang") == "en", "synthetic").when(F.col("lang") == "de", "silver").when(F.col("lang") == "fr", "gold").otherwise("other").alias("data_tier"),
        F.when(i % 3 == 0, "train").when(i % 3 == 1, "validation").otherwise("test").alias("split"),
    )
    return R.manifest_violations(rows).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "dangling_references",
    "SELECT 'label_without_document' AS rule, CAST(doc_id AS VARCHAR) AS key, CAST(doc_id * 2 AS VARCHAR) AS message FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)",
)
def dangling_references(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") * 2).alias("ref"))
    return R.dangling(labels, "doc_id", "ref", table(spark, sf_dir, "documents"), "doc_id", "label_without_document")


@query(
    "annotation_violations",
    """WITH b AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS region_id, l_returnflag AS cls, l_partkey % 60 AS l, l_suppkey % 60 AS t, l_partkey % 60 + l_linenumber AS r, l_suppkey % 60 + 5 AS b FROM lineitem)
    SELECT rule, count(*) AS n FROM (SELECT 'class' AS rule FROM b WHERE cls = 'R' UNION ALL SELECT 'geometry' FROM b WHERE NOT (l >= 0 AND t >= 0 AND r <= 60 AND b <= 62 AND l < r AND t < b)
    UNION ALL SELECT 'duplicate_region' FROM b GROUP BY region_id HAVING count(*) > 1) GROUP BY rule""",
)
def annotation_violations(spark, sf_dir):
    x, y = F.col("l_partkey") % 60, F.col("l_suppkey") % 60
    regions = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("region_id"), F.col("l_returnflag").alias("pii_class"), F.lit("bbox").alias("kind"), F.array(x, y, x + F.col("l_linenumber"), y + 5).alias("box"),
        F.lit(60).alias("width"), F.lit(62).alias("height"), F.lit("open").alias("review_status"), F.array(F.lit("a")).alias("reason_codes"),
    )
    return R.annotation_violations(regions, ["A", "N"], ["open"]).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "answer_violations",
    """WITH a AS (SELECT doc_id AS i FROM documents WHERE doc_id % 17 <> 0) SELECT rule, count(*) AS n FROM (SELECT 'arity' AS rule FROM a WHERE i % 7 <> 0 AND i % 11 = 0
    UNION ALL SELECT 'found_nothing_but_values' FROM a WHERE i % 3 = 0 AND i % 7 <> 0 UNION ALL SELECT 'no_evidence' FROM a WHERE i % 3 <> 0 AND i % 5 = 0 UNION ALL SELECT 'found_without_value' FROM a WHERE i % 3 <> 0 AND i % 7 = 0
    UNION ALL SELECT 'unknown_block' FROM a WHERE i % 5 <> 0 AND i % 13 = 0 UNION ALL SELECT 'coverage' FROM documents WHERE doc_id % 17 = 0) GROUP BY rule""",
)
def answer_violations(spark, sf_dir):
    """Answers made from documents against as many questions, some broken in each way."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id")
    name = F.concat(F.lit("Q"), i.cast("string"))
    questions = d.select(name.alias("question_id"), F.array(F.lit("a"), F.lit("b")).alias("answer_fields"))
    blocks = d.select(F.concat(F.lit("B"), i.cast("string")).alias("block_id"))
    none = F.lit(None).cast("string")
    values = F.when(i % 7 == 0, F.array(none, none)).when(i % 11 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), none))
    cited = F.when(i % 5 == 0, F.array().cast("array<string>")).when(i % 13 == 0, F.array(F.lit("B-1"))).otherwise(F.array(F.concat(F.lit("B"), i.cast("string"))))
    answers = d.filter("doc_id % 17 <> 0").select(name.alias("question_id"), F.when(i % 3 == 0, "NOT_FOUND").otherwise("FOUND").alias("status"), values.alias("values"), cited.alias("evidence_block_ids"))
    return R.answer_violations(answers, questions, blocks).groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "evidence_claims",
    """WITH d AS (SELECT doc_id, doc_id % 4 AS m, doc_id % 8 AS e, string_split(text, chr(10))[1] AS line, substr(text, 1, 40) AS head FROM documents)
    SELECT doc_id, CASE WHEN m = 1 OR m = 3 OR (e = 0 AND NOT contains(line, '31337')) OR (m = 2 AND trim(regexp_replace(head, '\\s+', ' ', 'g')) = '') THEN 'drop' ELSE 'keep' END AS action,
    CASE WHEN m = 1 THEN 'invalid_block' WHEN m = 3 OR (m = 2 AND trim(regexp_replace(head, '\\s+', ' ', 'g')) = '') THEN 'missing_evidence' WHEN e = 0 AND NOT contains(line, '31337') THEN 'numbers_not_supported' WHEN m = 2 THEN 'quote_fallback' END AS reason,
    1 AS page, CAST(CASE WHEN m = 0 AND NOT (e = 0 AND NOT contains(line, '31337')) THEN length(line) WHEN m = 2 THEN length(head) ELSE 19 END AS INT) AS quote_length FROM d""",
)
def evidence_claims(spark, sf_dir):
    """Claims about documents' lines, by what becomes of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array(F.lit(1)).alias("pages"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    blocks = lines.select("doc_id", F.concat(F.lit("P1-B"), (F.col("pos") + 1).cast("string")).alias("block_id"), "text", F.lit(1).alias("page"))
    i = F.col("doc_id")
    cited = F.when(i % 4 == 0, F.array(F.lit("P1-B1"))).when(i % 4 == 1, F.array(F.lit("P1-B999999"))).otherwise(F.array().cast("array<string>"))
    claims = docs.select(
        "doc_id", i.cast("string").alias("claim_id"), F.when(i % 8 == 0, F.lit("it says 31337")).otherwise(F.lit("it says so")).alias("claim"), F.when(i % 4 == 2, F.substring("text", 1, 40)).otherwise(F.lit("not there at all 77")).alias("quote"),
        F.lit(1).alias("page"), F.lit(0.9).alias("confidence"), cited.alias("evidence_block_ids"),
    )
    return E.judged_claims(claims, blocks, docs, strict=True).select("doc_id", "action", "reason", "page", F.char_length("quote").alias("quote_length"))
