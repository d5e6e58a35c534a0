"""Queries over texts: redaction, gates, blocks, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import scalars as S
from folioscope.functions.profiles import CAUTIONS, NEUTRAL, TOPICS
from folioscope.operators import aggregates, blocks, quality
from folioscope.operators.redaction import redact
from folioscope.plans.registry import query
from folioscope.session import table

EMAIL, PHONE, DIGITS = (rule.pattern for rule in NEUTRAL.redaction)


@query(
    "redact_email_report",
    f"""SELECT source, count(*) AS docs, CAST(sum(len(regexp_extract_all(text, '{EMAIL}'))) AS BIGINT) AS emails,
    CAST(sum(CAST(regexp_matches(text, '[0-9]{{8,}}') AS INT)) AS BIGINT) AS with_digit_run,
    CAST(sum(CAST(length(text) >= 250 AS INT)) AS BIGINT) AS usable
    FROM documents GROUP BY source""",
)
def redact_email_report(spark, sf_dir):
    """Per source: documents, emails, digit-run hits, documents of usable length."""
    d = table(spark, sf_dir, "documents").select("source", "text")
    return d.groupBy("source").agg(
        F.count("*").alias("docs"),
        F.sum(F.regexp_count("text", F.lit(EMAIL))).cast("long").alias("emails"),
        F.sum(F.col("text").rlike("[0-9]{8,}").cast("int")).alias("with_digit_run"),
        F.sum((F.length("text") >= 250).cast("int")).alias("usable"),
    )


@query(
    "redact_text",
    f"""WITH a AS (SELECT doc_id, text AS t0, regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g') AS t1 FROM documents),
    b AS (SELECT *, regexp_replace(t1, '{PHONE}', '[PHONE]', 'g') AS t2 FROM a)
    SELECT doc_id, len(regexp_extract_all(t0, '{EMAIL}')) AS emails, len(regexp_extract_all(t1, '{PHONE}')) AS phones,
    len(regexp_extract_all(t2, '{DIGITS}')) AS ids, sha256(regexp_replace(t2, '{DIGITS}', '[ID]', 'g')) AS redacted_sha256 FROM b""",
)
def redact_text(spark, sf_dir):
    d = redact(table(spark, sf_dir, "documents").select("doc_id", "text"), NEUTRAL)
    return d.select("doc_id", *(F.col(f"report.{c}").cast("long").alias(c) for c in ("emails", "phones", "ids")), S.sha256(F.col("redacted")).alias("redacted_sha256"))


@query("character_histogram", "SELECT c AS character, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c")
def character_histogram(spark, sf_dir):
    return aggregates.character_histogram(table(spark, sf_dir, "documents"))


_SPLIT = "CASE WHEN (('0x' || left(sha256({0}), 8))::BIGINT % 100) < 70 THEN 'train' WHEN (('0x' || left(sha256({0}), 8))::BIGINT % 100) < 85 THEN 'val' ELSE 'test' END"


@query("hash_split_buckets", f"SELECT doc_id, {_SPLIT.format('source')} AS split FROM documents")
def hash_split_buckets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.bucket_split(F.col("source")).alias("split"))


@query("hash_fraction_split", "SELECT doc_id, round(('0x' || substr(sha256(text), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0, 12) AS fraction, (('0x' || substr(sha256(text), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0) < 0.1 AS validation FROM documents")
def hash_fraction_split(spark, sf_dir):
    x = S.hash_fraction(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(x, 12).alias("fraction"), (x < 0.1).alias("validation"))


@query("stable_sample_id", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'syn_' WHEN lang = 'de' THEN 'sil_' ELSE 'gld_' END || substr(sha256(source || '|' || text), 1, 20) AS sample_id FROM documents")
def stable_sample_id(spark, sf_dir):
    tier = F.when(F.col("lang") == "en", "synthetic").when(F.col("lang") == "de", "silver").otherwise("gold")
    return table(spark, sf_dir, "documents").select("doc_id", S.sample_id(tier, F.concat_ws("|", "source", "text")).alias("sample_id"))


@query(
    "length_prefixed_hash",
    """SELECT doc_id, sha256(from_hex(printf('%016x', octet_length(encode(source)))) || from_hex('00') || encode(source) || from_hex(printf('%016x', octet_length(encode(text)))) || from_hex('00') || encode(text)) AS cache_key
    FROM documents""",
)
def length_prefixed_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.parts_hash(F.col("source"), F.col("text")).alias("cache_key"))


@query("git_blob_sha1", "SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text))) || from_hex('00') || encode(text)) AS blob_id FROM documents")
def git_blob_sha1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.git_blob_sha1(F.col("text")).alias("blob_id"))


@query(
    "iban_mod97",
    """WITH i AS (SELECT doc_id, lpad(CAST(doc_id % 97 AS VARCHAR), 2, '0') AS c, lpad(CAST(doc_id * 7919 AS VARCHAR), 19, '0') AS b FROM documents)
    SELECT doc_id, (b || '1821' || c)::HUGEINT % 97 = 1 AS valid FROM i""",
)
def iban_mod97(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    iban = F.concat(F.lit("IL"), F.lpad((F.col("doc_id") % 97).cast("string"), 2, "0"), F.lpad((F.col("doc_id") * 7919).cast("string"), 19, "0"))
    return d.select("doc_id", S.iban_valid(iban).alias("valid"))


def _shifted(spark, sf_dir):
    """Each run of 60 characters of each text, and the 60 that begin 3 later."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("text"), F.lit(1)), F.lit(60))
    each = d.select("doc_id", "source", "text", F.explode(starts).alias("at"))
    return each.select("doc_id", "source", F.expr("substring(text, at, 60)").alias("e"), F.expr("substring(text, at + 3, 60)").alias("f"))


@query("cer_slices")
def cer_slices(spark, sf_dir):
    """Error rate of each whole text, run by run; DuckDB counts bytes where a character is not ASCII, so there is no twin."""
    return aggregates.micro_error_rate(_shifted(spark, sf_dir), "e", "f", ["doc_id"]).withColumn("cer", F.round("cer", 6))


@query("micro_cer_by_source")
def micro_cer_by_source(spark, sf_dir):
    return aggregates.micro_error_rate(_shifted(spark, sf_dir), "e", "f", ["source"]).withColumn("cer", F.round("cer", 6))


@query(
    "line_blocks",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    k AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM l WHERE trim(line) <> '')
    SELECT doc_id, printf('P1-B%02d', i) AS block_id, CAST(i AS INT) AS index, CAST(length(trim(line)) AS INT) AS length FROM k""",
)
def line_blocks(spark, sf_dir):
    return blocks.line_blocks(table(spark, sf_dir, "documents"))


@query(
    "usability_gate",
    rf"""WITH s AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
    m AS (SELECT doc_id, len(regexp_extract_all(t, '[{NEUTRAL.letters}]')) AS letters, length(t) AS n,
      len(list_filter(string_split_regex(t, '\n\s*\n|\n\s*(?:\d+|[א-ת])?[.)-]?\s+|[.;]\s+'), lambda p: len(regexp_extract_all(p, '[{NEUTRAL.letters}]')) >= 15)) AS clauses,
      CASE WHEN len(regexp_extract_all(t, '\S')) = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - len(regexp_extract_all(t, '[A-Za-zÀ-ÖØ-öø-ÿ0-9\s.,;:!?/"''()\[\]\-]')) / len(regexp_extract_all(t, '\S'))) END AS garbage FROM s),
    u AS (SELECT *, letters >= 120 AND clauses >= 4 AND garbage <= 0.35 AND n >= 250 AS usable FROM m)
    SELECT doc_id, CAST(letters AS INT) AS letters, CAST(clauses AS INT) AS clauses, round(garbage, 6) AS garbage, usable,
    CASE WHEN usable AND letters >= 900 AND clauses >= 10 THEN 'high' WHEN usable AND letters >= 350 AND clauses >= 6 THEN 'medium' ELSE 'low' END AS completeness FROM u""",
)
def usability_gate(spark, sf_dir):
    found = quality.usability(table(spark, sf_dir, "documents").select("doc_id", "text"), NEUTRAL)
    return found.select("doc_id", "letters", "clauses", F.round("garbage", 6).alias("garbage"), "usable", "completeness")


@query(
    "clause_jumps",
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents),
    n AS (SELECT doc_id, list_transform(range(1, len(t) + 1), lambda i: CASE WHEN (i * 7) % 11 = 0 THEN i + 5 ELSE i END) AS v FROM l)
    SELECT doc_id, len(v) >= 4 AND len(list_filter(range(1, len(v)), lambda i: v[i + 1] > v[i] + 3)) > 0 AS jumps FROM (SELECT doc_id, list_filter(v, lambda x: x < 100) AS v FROM n)""",
)
def clause_jumps(spark, sf_dir):
    """Lines are numbered, some with a jump; the operator reads the numbers of one or two digits back from the text."""
    lines = F.split("text", "\n")
    numbered = F.array_join(F.transform(lines, lambda x, i: F.concat(F.when(((i + 1) * 7) % 11 == 0, i + 6).otherwise(i + 1).cast("string"), F.lit(". "), F.regexp_replace(x, "^\\s+", ""))), "\n")
    d = table(spark, sf_dir, "documents").select("doc_id", numbered.alias("text"))
    return d.select("doc_id", quality.suspicious_jumps(F.col("text")).alias("jumps"))


def _any(terms) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{t}')" for t in terms) + ")"


@query(
    "topic_presence",
    "SELECT doc_id, missing, cautions, CASE WHEN cautions >= 2 OR missing >= 3 THEN 'High' WHEN cautions >= 1 OR missing >= 1 THEN 'Medium' ELSE 'Low' END AS risk_level FROM (SELECT doc_id, "
    + " + ".join(f"CAST(NOT {_any(t)} AS INT)" for t in TOPICS.values())
    + " AS missing, "
    + " + ".join(f"CAST({_any(t)} AS INT)" for t in CAUTIONS.values())
    + " AS cautions FROM documents)",
)
def topic_presence(spark, sf_dir):
    found = quality.topics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("missing").alias("missing"), F.size("cautions").alias("cautions"), "risk_level")


@query("quality_signals")
def quality_signals(spark, sf_dir):
    """Signals, score and status of each text; markers are frequent English words here."""
    words = ("the", "and", "of", "to", "in", "for", "that")
    hits = F.lit(0)
    for w in words:
        hits = hits + F.contains(F.col("text"), F.lit(f" {w} ")).cast("int")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", hits.alias("hits"))
    d = d.withColumn("signals", quality.garbage_signals(F.col("text"), NEUTRAL, F.col("hits")))
    d = d.withColumn("score", quality.quality_score(F.col("text"), NEUTRAL, F.col("hits"), F.col("signals")))
    return d.select("doc_id", F.array_join("signals", ",").alias("signals"), "score", quality.quality_status(F.col("text"), NEUTRAL, F.col("hits"), F.col("signals"), F.col("score")).alias("status"))


@query(
    "token_windows",
    """WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]'), lambda x: x <> '') AS t FROM documents),
    w AS (SELECT doc_id, flatten([list_transform(range(1, len(t) - k + 2), lambda i: array_to_string(t[i:i + k - 1], ' ')) FOR k IN [1, 2, 3]]) AS w FROM t)
    SELECT doc_id, CAST(len(w) AS INT) AS windows, sha256(array_to_string(w, '|')) AS windows_sha256 FROM w""",
)
def token_windows(spark, sf_dir):
    tokens = F.filter(F.split("text", "[ \n]"), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select("doc_id", blocks.token_windows(tokens, 2).alias("w"))
    return d.select("doc_id", F.size("w").alias("windows"), F.sha2(F.array_join("w", "|"), 256).alias("windows_sha256"))


_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query("quote_containment", rf"SELECT doc_id, contains(trim(regexp_replace(text, '{_WHITE}', ' ', 'g')), trim(regexp_replace(substr(text, 11, 50), '{_WHITE}', ' ', 'g'))) AND trim(regexp_replace(substr(text, 11, 50), '{_WHITE}', ' ', 'g')) <> '' AS found FROM documents")
def quote_containment(spark, sf_dir):
    spaced = F.regexp_replace(F.substring("text", 11, 50), " ", "  ")
    return table(spark, sf_dir, "documents").select("doc_id", S.quote_exists(spaced, F.col("text")).alias("found"))


@query(
    "date_checks",
    """WITH d AS (SELECT doc_id, printf('%04d-%02d-%02d', 2000 + doc_id % 30, 1 + doc_id % 13, 1 + doc_id % 31) AS s FROM documents)
    SELECT doc_id, try_cast(s AS DATE) IS NOT NULL AS valid, CASE WHEN try_cast(s AS DATE) <= DATE '2015-06-30' THEN 'before' WHEN try_cast(s AS DATE) IS NOT NULL THEN 'after' END AS era FROM d""",
)
def date_checks(spark, sf_dir):
    i = F.col("doc_id").cast("int")
    text = F.format_string("%04d-%02d-%02d", 2000 + i % 30, 1 + i % 13, 1 + i % 31)
    d = table(spark, sf_dir, "documents").select("doc_id", S.iso_date(text).alias("d"))
    return d.select("doc_id", F.col("d").isNotNull().alias("valid"), F.when(F.col("d") <= F.lit("2015-06-30").cast("date"), "before").when(F.col("d").isNotNull(), "after").alias("era"))


@query(
    "retry_delays",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 60 AS DOUBLE) WHEN doc_id % 3 = 1 THEN CAST(doc_id % 60 AS DOUBLE) + 0.5 ELSE NULL END AS seconds FROM documents""",
)
def retry_delays(spark, sf_dir):
    i = F.col("doc_id")
    said = F.when(i % 3 == 0, F.concat((i % 60).cast("string"), F.lit("s"))).when(i % 3 == 1, F.concat(F.lit('{"retryDelay": "'), (i % 60).cast("string"), F.lit('.5s"}'))).otherwise(F.lit("soon"))
    return table(spark, sf_dir, "documents").select("doc_id", S.retry_seconds(said).alias("seconds"))


@query("url_hosts", "SELECT page_id, regexp_matches(url, '^https://([^/:?#]*\\.)?example\\.com([/:?#]|$)') AS allowed FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, 'http://', 'https://') ELSE url END AS url FROM pages)")
def url_hosts(spark, sf_dir):
    url = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "http://", "https://")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", S.host_allowed(url, ["example.com"]).alias("allowed"))


@query("natural_order_keys", "SELECT doc_id, 'page' || lpad(CAST(doc_id AS VARCHAR), 20, '0') || '.png' AS key FROM documents")
def natural_order_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.natural_key(F.concat(F.lit("Page"), F.col("doc_id").cast("string"), F.lit(".png"))).alias("key"))


@query("ordered_concat_fingerprint", "SELECT source, doc_id // 1000 AS part, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || sha256(text), ',' ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY ALL")
def ordered_concat_fingerprint(spark, sf_dir):
    """A selection's fingerprint for each source and run of 1,000 ids, so no group is larger."""
    d = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 1000).alias("part"), "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), S.sha256(F.col("text"))).alias("x"))
    return d.groupBy("source", "part").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "x"))), lambda r: r["x"]), ","), 256).alias("fingerprint"))


@query("evidence_blocks")
def evidence_blocks(spark, sf_dir):
    """Blocks of every text, with its lines as paragraphs of two pages."""
    half = F.concat(F.regexp_replace("text", "\n", "\n\n"), F.lit("\n--- PAGE 2: x ---\n"), F.substring("text", 1, 200))
    found = blocks.evidence_blocks(table(spark, sf_dir, "documents").select("doc_id", half.alias("text")), profile=NEUTRAL)
    return found.select("doc_id", "block_id", "page", "index", F.char_length("text").alias("length"))
