"""Queries of the dataset operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.scalars import sha256
from folioscope.operators import datasets as D
from folioscope.plans.registry import query
from folioscope.session import table

_BASE = """d AS (SELECT doc_id, lang, source, text, sha256(text) AS h FROM documents), gold AS (SELECT h FROM d WHERE doc_id % 20 = 0),
    r AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'synthetic' ELSE 'silver' END AS tier, source, text, h, CASE WHEN lang = 'en' AND doc_id % 10 < 9 THEN 'train' WHEN lang = 'en' THEN 'validation'
      WHEN ('0x' || substr(h, 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.1 THEN 'validation' ELSE 'train' END AS proposed FROM d WHERE doc_id % 20 <> 0),
    k AS (SELECT * FROM r WHERE h NOT IN (SELECT h FROM gold)), s AS (SELECT h, bool_or(proposed = 'train') AS strong FROM k GROUP BY h)"""


def _parts(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", i.alias("source_id"), F.concat(F.lit("img"), i.cast("string")).alias("image_sha256"), F.when(i % 10 < 9, "train").otherwise("validation").alias("split"))
    rest = d.filter("doc_id % 20 <> 0")
    records = D.source_records(rest.filter("lang = 'en'"), "synthetic", "made").unionByName(D.source_records(rest.filter("lang <> 'en'"), "silver", "read"))
    gold = d.filter("doc_id % 20 = 0").select(F.col("doc_id").cast("string").alias("gold_id"), "image_sha256", sha256(F.col("text")).alias("text_sha256"), F.lit(None).cast("string").alias("source_crop"))
    return records, gold


@query(
    "training_manifest",
    f"""WITH {_BASE} SELECT CAST(doc_id AS VARCHAR) AS source_id, CASE WHEN tier = 'synthetic' THEN 'syn_' ELSE 'sil_' END || left(sha256(tier || chr(0) || CASE WHEN tier = 'synthetic' THEN 'made' ELSE 'read' END || chr(0) || doc_id || chr(0) || text), 20) AS sample_id,
    CASE WHEN strong THEN 'train' ELSE 'validation' END AS split, proposed <> CASE WHEN strong THEN 'train' ELSE 'validation' END AS reassigned FROM k JOIN s USING (h)""",
)
def training_manifest(spark, sf_dir):
    rows, _ = D.training_dataset(*_parts(spark, sf_dir), "d")
    return rows.select("source_id", "sample_id", "split", "reassigned")


@query("gold_exclusions", f"WITH {_BASE} SELECT CAST(doc_id AS VARCHAR) AS source_id, 'text_sha256' AS reasons FROM r WHERE h IN (SELECT h FROM gold)")
def gold_exclusions(spark, sf_dir):
    _, out = D.training_dataset(*_parts(spark, sf_dir), "d")
    return out.select("source_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "training_summary",
    f"""WITH {_BASE}, m AS (SELECT tier, text, CASE WHEN strong THEN 'train' ELSE 'validation' END AS split, proposed FROM k JOIN s USING (h))
    SELECT 'data_tier' AS kind, tier AS name, count(*) AS n FROM m GROUP BY tier UNION ALL SELECT 'split', split, count(*) FROM m GROUP BY split UNION ALL SELECT 'source_dataset', CASE WHEN tier = 'synthetic' THEN 'made' ELSE 'read' END, count(*) FROM m GROUP BY tier
    UNION ALL SELECT 'reassigned', 'rows', count(*) FILTER (WHERE split <> proposed) FROM m UNION ALL SELECT 'characters', 'distinct', count(DISTINCT c) FROM (SELECT unnest(string_split(text, '')) AS c FROM m) WHERE c <> ''""",
)
def training_summary(spark, sf_dir):
    rows, _ = D.training_dataset(*_parts(spark, sf_dir), "d")
    return D.summary(rows)


@query(
    "mask_diagnostics",
    """WITH m AS (SELECT l_orderkey AS page_id, count(*) AS masks, count(*) FILTER (WHERE l_returnflag IN ('A', 'R')) AS z FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
    SELECT o_orderkey AS page_id, coalesce(masks, 0) AS masks, CASE WHEN coalesce(masks, 0) = 0 THEN 0.0 ELSE round(z / masks, 6) END AS zone_share, round((o_custkey % 1000) / 2000, 6) AS masked_share FROM orders LEFT JOIN m ON page_id = o_orderkey""",
)
def mask_diagnostics(spark, sf_dir):
    masks = table(spark, sf_dir, "lineitem").filter("l_linenumber > 1").select(F.col("l_orderkey").alias("page_id"), F.array("l_returnflag").alias("reason_codes"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit(40).alias("width"), F.lit(50).alias("height"), (F.col("o_custkey") % 1000).alias("masked_pixels"))
    return D.mask_diagnostics(masks, pages, ["A", "R"])


@query(
    "analysis_readiness",
    r"""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), r(dep, pattern) AS (VALUES ('mail', '@'), ('table', ' \| '), ('shout', '!!')),
    n AS (SELECT DISTINCT doc_id, dep FROM b JOIN r ON regexp_matches(line, pattern)), m AS (SELECT doc_id, string_agg(dep, ',' ORDER BY dep) AS missing FROM n WHERE NOT (doc_id % 2 = 0 AND dep = 'table') GROUP BY doc_id)
    SELECT doc_id, CASE WHEN n_chars < 300 OR doc_id % 9 = 0 THEN 'BLOCKED' WHEN missing IS NOT NULL THEN 'PARTIAL' ELSE 'READY' END AS readiness, CASE WHEN n_chars < 300 OR doc_id % 9 = 0 OR missing IS NULL THEN '' ELSE missing END AS missing FROM documents LEFT JOIN m USING (doc_id)""",
)
def analysis_readiness(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rules = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(n).alias("dependency_id"), F.lit(p).alias("pattern")) for n, p in (("mail", "@"), ("table", r" \| "), ("shout", "!!"))))))
    blocks = d.select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    state = d.select("doc_id", (F.col("n_chars") >= 300).alias("usable"), (F.col("doc_id") % 9 != 0).alias("confirmed"))
    provided = d.filter("doc_id % 2 = 0").select("doc_id", F.lit("table").alias("dependency_id"))
    return D.readiness(state, blocks, rules, provided).withColumn("missing", F.array_join("missing", ","))


@query("class_id_texts", r"SELECT doc_id, CASE WHEN regexp_matches(text, '^[ -~\n]*$') THEN coalesce(list_sum(list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: CASE WHEN c = chr(10) THEN 96 ELSE ascii(c) - 31 END)), 0) END::BIGINT AS ids FROM documents")
def class_id_texts(spark, sf_dir):
    """Sums of the class ids of each text's characters; null where one is not in the set."""
    ids = D.class_ids(F.col("text"), [*map(chr, range(32, 127)), "\n"])
    return table(spark, sf_dir, "documents").select("doc_id", F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))
