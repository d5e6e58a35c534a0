"""Queries of the gates over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import gates as G
from folioscope.operators.aggregates import character_error_rate
from folioscope.plans.registry import query
from folioscope.session import table

LETTERS, OTHER = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[0-9]"
WORDS = ("the", "der", "que", "les")
_HITS = " + ".join(f"CAST(contains(text, '{w}') AS INT)" for w in WORDS)


def _documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    hits = sum((F.contains("text", F.lit(w)).cast("int") for w in WORDS), F.lit(0))
    return d.withColumns({"letters": F.regexp_count("text", F.lit(LETTERS)), "others": F.regexp_count("text", F.lit(OTHER)), "hits": hits})


@query(
    "usable_texts",
    f"""WITH m AS (SELECT doc_id, len(regexp_extract_all(text, '{LETTERS}')) AS a, len(regexp_extract_all(text, '{OTHER}')) AS b, {_HITS} AS hits, length(trim(text)) AS n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
    u AS (SELECT *, a >= 80 AND b <= a AND hits >= 1 AS usable FROM m)
    SELECT doc_id, usable, CASE WHEN doc_id % 5 = 0 THEN false WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 ELSE usable END AS sufficient,
    array_to_string(list_filter([CASE WHEN doc_id % 13 = 0 THEN 'no_pages' END, CASE WHEN n < 200 THEN 'too_short' END, CASE WHEN a < 50 THEN 'too_few_letters' END], lambda x: x IS NOT NULL), ',') AS problems FROM u""",
)
def usable_texts(spark, sf_dir):
    """Usability, sufficiency and the text layer's problems of each document."""
    d = _documents(spark, sf_dir).withColumn("usable", G.text_usable(F.col("letters"), F.col("others"), F.col("hits")))
    i = F.col("doc_id")
    sufficient = G.quality_sufficient(F.when(i % 3 != 0, F.col("usable")), F.when(i % 2 == 0, "medium").otherwise("low"), i % 5 != 0)
    problems = G.text_layer_problems(F.col("text"), F.col("letters"), F.when(i % 13 != 0, F.lit(2)))
    return d.select("doc_id", "usable", sufficient.alias("sufficient"), F.array_join(problems, ",").alias("problems"))


@query(
    "mean_confidences",
    """SELECT l_orderkey, CASE WHEN count(c) = 0 THEN 0.0 ELSE round(greatest(0.0, least(avg(c) / 100, 1.0)), 4) END AS confidence
    FROM (SELECT l_orderkey, CASE WHEN l_partkey % 4 <> 0 THEN l_suppkey % 130 + 0.0123::DOUBLE END AS c FROM lineitem) GROUP BY l_orderkey""",
)
def mean_confidences(spark, sf_dir):
    c = F.when(F.col("l_partkey") % 4 != 0, F.col("l_suppkey") % 130 + F.lit(0.0123))
    # nulls stay in the list
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.collect_list(F.struct(c.alias("c"))), lambda x: x["c"]).alias("c"))
    return listed.select("l_orderkey", G.mean_confidence(F.col("c")).alias("confidence"))


@query(
    "attempt_grids",
    """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY v, g, c) AS INT) AS attempt, ['plain', 'sharp'][v] || '/' || ['heb', 'heb+eng'][g] || '/' || ['block', 'sparse', 'column'][c] AS name
    FROM pages, range(1, 3) a(v), range(1, 3) b(g), range(1, 4) d(c)""",
)
def attempt_grids(spark, sf_dir):
    found = G.attempt_grid(table(spark, sf_dir, "pages").select("page_id"), ["plain", "sharp"], ["heb", "heb+eng"], ["block", "sparse", "column"])
    return found.select("page_id", "attempt", F.concat_ws("/", "variant", "language", "config").alias("name"))


@query(
    "content_lines",
    r"""WITH t AS (SELECT doc_id, '--- PAGE 1: scan.png ---' || chr(10) || 'scan 01.png' || chr(10) || ' [MASKED] ' || coalesce(replace(text, '.', '[redacted]'), '') AS t FROM documents),
    l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\r\n|\r|\n'), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^\s*---\s*(?:PAGE\s+\d+|OCR SOURCE|OCR MODE|IMAGE PAGES PREPARED)\b.*---\s*$') AND NOT regexp_matches(x, '(?i)^\s*[\w .\-()]+\.(?:png|jpe?g|webp|heic|pdf)\s*$')) AS l FROM t)
    SELECT doc_id, sha256(trim(array_to_string(list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '(?i)\[(?:MASKED|REDACTED)\]', ' ', 'g'))), lambda x: x <> ''), chr(10)))) AS content FROM l""",
)
def content_lines(spark, sf_dir):
    """Each text behind a page header and a file name, with masks for its full stops."""
    text = F.concat(F.lit("--- PAGE 1: scan.png ---\nscan 01.png\n [MASKED] "), F.coalesce(F.replace("text", F.lit("."), F.lit("[redacted]")), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(G.content_lines(text), 256).alias("content"))


@query(
    "document_statuses",
    """WITH p AS (SELECT l_orderkey, min(l_suppkey % 100) AS s, max(CASE WHEN l_partkey % 19 = 0 THEN 3 WHEN l_partkey % 5 = 0 THEN 2 ELSE 1 END) AS w FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY l_orderkey)
    SELECT o_orderkey, CASE WHEN w = 3 THEN 'poor' WHEN w = 2 AND flat = 'good' THEN 'warning' ELSE flat END AS status, least(score, coalesce(s, score)) AS score
    FROM (SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'poor' WHEN o_custkey % 4 = 1 THEN 'warning' ELSE 'good' END AS flat, o_custkey % 100 AS score FROM orders) LEFT JOIN p ON l_orderkey = o_orderkey""",
)
def document_statuses(spark, sf_dir):
    c, p = F.col("o_custkey") % 4, F.col("l_partkey")
    flat = table(spark, sf_dir, "orders").select("o_orderkey", F.when(c == 0, "poor").when(c == 1, "warning").otherwise("good").alias("status"), (F.col("o_custkey") % 100).alias("score"))
    pages = table(spark, sf_dir, "lineitem").filter("l_orderkey % 3 > 0").select(F.col("l_orderkey").alias("o_orderkey"), F.when(p % 19 == 0, "poor").when(p % 5 == 0, "warning").otherwise("good").alias("status"), (F.col("l_suppkey") % 100).alias("score"))
    return G.document_quality(flat, pages, "o_orderkey")


_BOXES = """SELECT l_orderkey, l_linenumber % 3 AS page, CASE WHEN l_suppkey % 11 = 0 THEN ' ' ELSE 'x' END AS text, l_partkey % 60 AS l, l_suppkey % 50 AS t, l_partkey % 60 + 30 - l_suppkey % 7 * 5 AS r, l_suppkey % 50 + 20 AS b, CASE WHEN l_partkey % 23 > 0 THEN 95 END AS w FROM lineitem"""


def _boxes(spark, sf_dir):
    x, y = F.col("l_partkey") % 60, F.col("l_suppkey") % 50
    box = F.struct(x.alias("left"), y.alias("top"), (x + 30 - F.col("l_suppkey") % 7 * 5).alias("right"), (y + 20).alias("bottom"))
    frame = F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), F.when(F.col("l_partkey") % 23 > 0, 95).alias("right"), F.lit(90).alias("bottom"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("page"), F.when(F.col("l_suppkey") % 11 == 0, " ").otherwise("x").alias("text"), box.alias("box"), frame.alias("frame"))


@query(
    "geometry_gates",
    f"""WITH b AS ({_BOXES}), v AS (SELECT *, coalesce(w > 0, false) AS f, trim(text) <> '' AND coalesce(w > 0 AND l >= 0 AND l < r AND r <= w AND b <= 90, false) AS g FROM b),
    p AS (SELECT l_orderkey, page, max(f) AS f, max(g) AS g, sum(CAST(trim(text) <> '' AS INT)) AS t, sum(CAST(trim(text) <> '' AND NOT g AS INT)) AS x FROM v GROUP BY ALL)
    SELECT l_orderkey, count(*) AS pages, CAST(sum(f::INT) AS BIGINT) AS pages_with_frame, CAST(sum(g::INT) AS BIGINT) AS pages_with_usable_text, CAST(sum(t) AS BIGINT) AS text_blocks, CAST(sum(x) AS BIGINT) AS invalid_text_blocks,
    sum(f::INT) = count(*) AND sum(g::INT) = count(*) AND sum(t) > 0 AND sum(x) = 0 AS passed FROM p GROUP BY l_orderkey""",
)
def geometry_gates(spark, sf_dir):
    return G.geometry_usability(_boxes(spark, sf_dir), ["l_orderkey"], "page")


_PARTS = "SELECT p_partkey // 12 AS doc, p_partkey % 12 AS page, p_name AS e, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN replace(p_name, 'a', 'o') ELSE p_name END AS o FROM part"


def _part_pages(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.floor(k / 12).alias("doc"), (k % 12).alias("page"), F.col("p_name").alias("e"), F.when(k % 7 == 0, None).when(k % 3 == 0, F.replace("p_name", F.lit("a"), F.lit("o"))).otherwise(F.col("p_name")).alias("o"))


@query(
    "document_cer",
    f"""WITH p AS ({_PARTS}), d AS (SELECT doc, string_agg(e, chr(10) ORDER BY page) AS e, string_agg(coalesce(o, ''), chr(10) ORDER BY page) AS o FROM p GROUP BY doc)
    SELECT doc, round(levenshtein(e, o) / length(e), 6) AS cer FROM d""",
)
def document_cer(spark, sf_dir):
    """Error rate of whole documents, whose pages are joined in order."""
    whole = G.document_text(_part_pages(spark, sf_dir), ["doc"], "page", ["e", "o"])
    return whole.select("doc", F.round(character_error_rate(F.col("e"), F.col("o")), 6).alias("cer"))


@query(
    "viability_verdicts",
    f"""WITH p AS ({_PARTS}), d AS (SELECT doc, count(o) = count(*) AS pages, bool_and(coalesce(contains(o, e[1:4]), false)) AS kept, levenshtein(string_agg(e, chr(10) ORDER BY page), string_agg(coalesce(o, ''), chr(10) ORDER BY page)) / length(string_agg(e, chr(10) ORDER BY page)) AS cer FROM p GROUP BY doc),
    g AS (SELECT doc, list_filter([CASE WHEN NOT pages THEN 'page_set' END, CASE WHEN cer > 0.05 THEN 'quality' END, CASE WHEN NOT kept THEN 'sentinels' END], lambda x: x IS NOT NULL) AS b FROM d)
    SELECT doc, CASE WHEN len(b) = 0 THEN 'PASS' ELSE 'BLOCK' END AS verdict, array_to_string(b, ',') AS blocking FROM g""",
)
def viability_verdicts(spark, sf_dir):
    pages = _part_pages(spark, sf_dir)
    whole = G.document_text(pages, ["doc"], "page", ["e", "o"]).select("doc", character_error_rate(F.col("e"), F.col("o")).alias("cer"))
    sets = pages.groupBy("doc").agg((F.count("o") == F.count("*")).alias("pages"), F.bool_and(G.preserved(F.substring("e", 1, 4), F.col("o"))).alias("kept"))
    said, blocking = G.verdict({"page_set": F.col("pages"), "quality": F.col("cer") <= 0.05, "sentinels": F.col("kept")})
    return whole.join(sets, "doc").select("doc", said.alias("verdict"), F.array_join(blocking, ",").alias("blocking"))


CLAUSE, MIXED, PUNCTUATION, CURRENCY = r"^\s*\d+[.)]\s*", "[A-Z]{2}", r"[.,;:!?()\[\]/-]", r"[%$]|\d\d/\d\d"


@query(
    "review_scores",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    n AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN i || '. ' || x ELSE x END AS x FROM l),
    m AS (SELECT *, regexp_matches(x, '{CLAUSE}') AS c, regexp_replace(x, '{CLAUSE}', '', 'g') AS r FROM n),
    s AS (SELECT *, len(regexp_extract_all(r, '[0-9]')) AS d, len(regexp_extract_all(x, '{PUNCTUATION}')) AS p FROM m)
    SELECT doc_id, i AS line, CASE WHEN c THEN -1.0 ELSE least(length(x), 120) / 120 END::DOUBLE AS body, round(CASE WHEN c THEN 2.0 ELSE -1.0 END::DOUBLE + least(len(regexp_extract_all(x, '\.')), 3) * 0.1::DOUBLE, 6) AS clause,
    round(CASE WHEN d > 0 OR regexp_matches(r, '{CURRENCY}') THEN 2.0 ELSE -1.0 END::DOUBLE + least(d, 8) * 0.08::DOUBLE, 6) AS numeric, round(CASE WHEN regexp_matches(x, '{MIXED}') THEN 3.0 ELSE 0.0 END::DOUBLE + CASE WHEN p >= 3 THEN 1.0 ELSE -1.0 END::DOUBLE + least(p, 10) * 0.08::DOUBLE, 6) AS mixed_punctuation FROM s""",
)
def review_scores(spark, sf_dir):
    """Category scores of each line of each text; every third line is numbered."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    numbered = lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line"), F.when((F.col("i") + 1) % 3 == 0, F.concat((F.col("i") + 1).cast("string"), F.lit(". "), "x")).otherwise(F.col("x")).alias("x"))
    return numbered.select("doc_id", "line", *(F.round(v, 6).alias(c) if c != "body" else v.alias(c) for c, v in G.category_scores(F.col("x"), CLAUSE, MIXED, PUNCTUATION, CURRENCY).items()))


@query(
    "selection_scores",
    """SELECT l_orderkey, l_linenumber, round((CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.7 END + 1.2 * coalesce(CASE WHEN l_partkey % 6 > 0 THEN l_discount::DOUBLE END, 0) + 0.8 * l_tax::DOUBLE + 0.5 * l_tax::DOUBLE) + 1.2 * (l_suppkey % 64 / 64.0) + 0.35 * least(l_partkey % 150 / 90.0, 1.0), 6)::DOUBLE AS score FROM lineitem""",
)
def selection_scores(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    tax = F.col("l_tax").cast("double")
    evidence = {"line": (1.2, F.when(F.col("l_partkey") % 6 > 0, F.col("l_discount").cast("double"))), "similar": (0.8, tax), "overlap": (0.5, tax)}
    status = F.when(F.col("l_returnflag") == "N", "consensus_verified").otherwise("unversioned")
    return d.select("l_orderkey", "l_linenumber", G.selection_score(status, evidence, F.col("l_suppkey") % 64 / 64.0, F.col("l_partkey") % 150).alias("score"))


@query("top_candidates", "SELECT o_custkey, o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_candidates(spark, sf_dir):
    return G.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", ["o_orderkey"]).select("o_custkey", "o_orderkey", "rank")


@query("zipped_rows", "SELECT o_orderkey, o_custkey IS DISTINCT FROM CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END AS differs FROM orders")
def zipped_rows(spark, sf_dir):
    """Two manifests paired by position; some customers differ."""
    left = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    right = left.withColumn("o_custkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return G.zipped(left, right, "o_orderkey", ["o_custkey"]).select("o_orderkey", F.col("o_custkey_differs").alias("differs"))


@query(
    "looked_up_names",
    """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, nullif(regexp_extract(unnest(string_split(text, chr(10))), '[A-ZÀ-Þ][a-zß-ÿ]{7,}'), '') AS name FROM documents)
    SELECT doc_id, CAST(i - 1 AS INT) AS i, coalesce(name, last_value(name IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) AS looked_up FROM l""",
)
def looked_up_names(spark, sf_dir):
    """A long capitalised word of each line, or of the three lines before it."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    named = lines.withColumn("name", F.nullif(F.regexp_extract("x", "[A-ZÀ-Þ][a-zß-ÿ]{7,}", 0), F.lit("")))
    return G.look_back(named, ["doc_id"], "i", "name").select("doc_id", "i", "looked_up")


@query(
    "identity_zones",
    """WITH b AS (SELECT doc_id, strpos(text, 'the') AS place, substr(text, strpos(text, 'the') + 3) AS b FROM documents),
    e AS (SELECT *, list_min(list_filter([strpos(b, '. The'), strpos(b, '!')], lambda x: x > 0)) AS e FROM b)
    SELECT doc_id, CASE WHEN place > 0 THEN sha256(trim(CASE WHEN e IS NULL THEN b ELSE substr(b, 1, e - 1) END)) END AS body FROM e""",
)
def identity_zones(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(G.between_markers(F.col("text"), "the", [". The", "!"]), 256).alias("body"))


@query(
    "page_hints",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Take it again.' || CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN ' Go nearer.' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ' Hold it level.' ELSE '' END || ' Use light from the side.' END AS hint FROM documents""",
)
def page_hints(spark, sf_dir):
    i = F.col("doc_id")
    signals = F.array_compact(F.array(*(F.when(i % k == 0, F.lit(n)) for k, n in ((3, "short"), (5, "few_letters"), (7, "low_ratio")))))
    advice = [(["short", "few_letters"], "Go nearer."), (["low_ratio", "isolated"], "Hold it level.")]
    return table(spark, sf_dir, "documents").select("doc_id", G.hints(signals, F.when(i % 4 == 0, "good").otherwise("poor"), advice, ("Take it again.", "Use light from the side.")).alias("hint"))


@query("guarded_report", "SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS o_orderpriority, 0 AS lists FROM orders")
def guarded_report(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.array("o_orderstatus").alias("lists"))
    return G.without_columns(d, ["o_orderpriority"], ["lists"]).withColumn("lists", F.size("lists"))


@query(
    "report_summaries",
    """SELECT l_orderkey, count(*) AS items, count(*) FILTER (WHERE l_returnflag = 'A') AS "A", count(*) FILTER (WHERE l_returnflag = 'N') AS "N", count(*) FILTER (WHERE l_returnflag = 'R') AS "R", min(l_tax) AS least_confidence, max(l_returnflag) AS highest FROM lineitem GROUP BY l_orderkey""",
)
def report_summaries(spark, sf_dir):
    return G.report_summary(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag", ["A", "N", "R"], "l_tax")
