"""Queries of the contracts, markers and evidence; most break each rule for some rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.markers import marker_relations as relations
from folioscope.operators import contracts as C
from folioscope.operators import evidence as E
from folioscope.plans.registry import query
from folioscope.session import table

_COUNTED = "SELECT rule, count(*) AS n FROM v GROUP BY rule"


def _counted(found):
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "marker_relations",
    """SELECT doc_id, 'email' AS kind, CAST(length(doc_id::VARCHAR) + 19 AS INT) AS marker_start, CAST(length(doc_id::VARCHAR) + 24 AS INT) AS marker_end, CAST(length(doc_id::VARCHAR) + 28 AS INT) AS value_start, CAST(2 * length(doc_id::VARCHAR) + 41 AS INT) AS value_end FROM documents""",
)
def marker_relations(spark, sf_dir):
    """Each text behind an address whose marker is part of a word, and one with a marker of its own; the first relation."""
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("xemail a"), i, F.lit("@one.org; "), F.lit("(eMail [: u"), i, F.lit("@example.com "), F.coalesce("text", F.lit("")))
    found = table(spark, sf_dir, "documents").select("doc_id", F.get(relations(text), F.lit(0)).alias("r"))
    return found.select("doc_id", "r.*")


_KINDS = ["email", "phone", "israeli_id", "bank_identifier"]
_CANDIDATES = """SELECT l_orderkey, l_linenumber, ['email', 'phone', 'israeli_id', 'bank_identifier'][l_partkey % 4 + 1] AS kind, l_suppkey % 3 > 0 AS marked, l_partkey % 5 = 0 AS moved, l_suppkey % 7 = 0 AS wrong, l_suppkey % 11 = 0 AS none FROM lineitem"""


def _candidates(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (p % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", kind.alias("kind"), F.lit("1,2,3,4").alias("geometry"), F.when(s % 3 > 0, "0,2,1,4").alias("marker_geometry"), (p % 5 == 0).alias("moved"), (s % 7 == 0).alias("wrong"), (s % 11 == 0).alias("none"), F.lit(True).alias("geometry_ok")
    )
    made = C.value_candidates(rows, F.concat_ws("-", F.lit("c"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    # some candidates lie elsewhere than their value, have another class, or no evidence at all
    made = made.withColumns({"geometry": F.when(F.col("moved"), "9,9,9,9").otherwise(F.col("geometry")), "proposed_class": F.when(F.col("wrong"), "stamp").otherwise(F.col("proposed_class"))})
    return made.withColumn("evidence", F.when(F.col("none"), F.slice("evidence", 1, 0)).otherwise(F.col("evidence")))


CLASSES = [*_KINDS, "signature", "initials", "stamp"]


@query(
    "candidate_decisions",
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN none THEN 'preserve' WHEN wrong OR moved THEN 'local_review' ELSE 'auto_mask' END AS disposition, CASE WHEN NOT none AND (wrong OR moved) THEN 'insufficient_evidence' END AS ambiguity_reason FROM ({_CANDIDATES})""",
)
def candidate_decisions(spark, sf_dir):
    return C.decided_candidates(_candidates(spark, sf_dir), CLASSES).select("l_orderkey", "l_linenumber", "disposition", "ambiguity_reason")


@query(
    "candidate_problems",
    f"""SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_linenumber = 2 THEN 'reason_not_allowed' END, CASE WHEN l_linenumber = 1 AND none THEN 'review_without_evidence' END, CASE WHEN l_linenumber > 1 AND l_linenumber <> 4 AND (none OR wrong) THEN 'mask:no_strong_evidence' END,
    CASE WHEN l_linenumber > 1 AND l_linenumber <> 4 AND wrong AND NOT none THEN 'mask:class' END, CASE WHEN l_linenumber = 1 AND false THEN '' END], lambda x: x IS NOT NULL), ',') AS problems FROM ({_CANDIDATES})""",
)
def candidate_problems(spark, sf_dir):
    """First lines are reviewed, second ones masked with a reason, fourth ones preserved, and others masked."""
    n = F.col("l_linenumber")
    d = _candidates(spark, sf_dir).withColumns({"disposition": F.when(n == 1, "local_review").when(n == 4, "preserve").otherwise("auto_mask"), "ambiguity_reason": F.when(n <= 2, "why")})
    return d.select("l_orderkey", "l_linenumber", F.array_join(C.candidate_problems(CLASSES), ",").alias("problems"))


_DISPOSED = """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'preserve' WHEN doc_id % 3 = 0 OR doc_id % 7 = 0 OR doc_id % 4 = 0 THEN 'local_review' ELSE 'auto_mask' END AS disposition FROM documents"""


@query("dispositions", _DISPOSED)
def dispositions(spark, sf_dir):
    """Two strong records and a weak one: some of another geometry, invalid, or all weak."""
    i = F.col("doc_id")
    record = lambda s, v, g: F.struct(s.alias("strength"), v.alias("valid"), g.alias("geometry"))
    strong = F.when(i % 4 == 0, "weak").otherwise("strong")
    records = F.array(record(strong, F.lit(True), F.lit("a")), record(strong, i % 7 != 0, F.when(i % 3 == 0, "b").otherwise("a")), record(F.lit("weak"), F.lit(True), F.lit("c")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("a").alias("geometry"), F.when(i % 10 == 0, F.slice(records, 1, 0)).otherwise(records).alias("evidence"))
    return E.dispositions(d).select("doc_id", "disposition")


@query(
    "claims_by_section",
    """WITH c AS (SELECT doc_id, unnest(['risks', 'clauses', 'financial_hints', 'unclear_fragments']) AS section, unnest(range(0, 4)) AS k FROM documents),
    j AS (SELECT doc_id, section, k, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN (doc_id + k) % 5 = 0 THEN 'invalid_block' WHEN k = 2 AND doc_id % 3 = 0 THEN 'numbers_not_supported' WHEN k = 0 AND doc_id % 3 = 0 THEN 'numbers_not_supported' END
      WHEN doc_id % 7 = 0 THEN 'missing_evidence' WHEN k = 2 AND doc_id % 3 = 0 THEN 'numbers_not_supported' ELSE 'quote_fallback' END AS reason FROM c)
    SELECT doc_id, section, reason, CASE WHEN reason IS NULL OR reason = 'quote_fallback' THEN 'keep' WHEN section = 'clauses' THEN 'downgrade' ELSE 'drop' END AS action,
    CASE WHEN section = 'clauses' AND reason IN ('invalid_block', 'missing_evidence') THEN 'unclear' ELSE 'high' END AS level, CAST(CASE WHEN reason IS NOT NULL THEN count(reason) OVER (PARTITION BY doc_id ORDER BY k) END AS INT) AS warning FROM j""",
)
def claims_by_section(spark, sf_dir):
    """One claim of each section of each document. Ids of claims and blocks are those of their document only; some documents list no pages; quotes hold other white space than texts.

    Documents of even number cite blocks: some that are not there, and some claims have a number that their block lacks. The others quote.
    """
    i, k = F.col("doc_id"), F.col("position")
    d = table(spark, sf_dir, "documents").select("doc_id")
    text = F.concat(F.lit("block 12 of "), F.when(i % 2 == 0, F.lit("word 34")).otherwise(F.lit("word")))
    blocks = d.select("doc_id", F.lit("b1").alias("block_id"), text.alias("text"), F.lit(1).alias("page"))
    documents = d.select("doc_id", text.alias("text"), F.when(i % 4 == 1, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("pages"))
    each = d.select("doc_id", F.posexplode(F.array(*map(F.lit, E.SECTIONS))).alias("position", "section"))
    quote = F.when(i % 7 == 0, F.lit("not there")).otherwise(F.lit(" block 12 of  word"))
    wrong = (i % 3 == 0) & ((k == 2) | ((k == 0) & (i % 2 == 0)))
    claims = each.select(
        "doc_id", F.concat(F.lit("c"), k.cast("string")).alias("claim_id"), "section", "position", F.when(wrong, "costs 99").otherwise("costs 12").alias("claim"), quote.alias("quote"), F.when(i % 4 == 1, 5).otherwise(1).alias("page"), F.lit(0.9).alias("confidence"), F.lit("high").alias("level"),
        F.when(i % 2 == 1, F.array().cast("array<string>")).when((i + k) % 5 == 0, F.array(F.lit("b1"), F.lit("b9"))).otherwise(F.array(F.lit("b1"), F.lit("b1"))).alias("evidence_block_ids"),
    )
    return E.judged_answer(claims, blocks, documents).select("doc_id", "section", "reason", "action", "level", "warning")


@query(
    "line_row_problems",
    rf"""WITH r AS (SELECT CASE WHEN l_suppkey % 13 = 0 THEN 'p ' ELSE 'p' END || l_orderkey AS page_id, l_linenumber AS o, l_partkey % 17 = 0 AS badid, CASE l_suppkey % 5 WHEN 0 THEN 'review' WHEN 1 THEN 'bad' ELSE 'accepted' END AS status, CASE WHEN l_partkey % 9 = 0 THEN 'reject' ELSE 'accepted' END AS seg, l_partkey % 8 > 0 AS up, l_partkey % 6 = 0 AS hash, l_partkey % 10 AS w FROM lineitem),
    v AS (SELECT 'page_id' AS rule FROM r WHERE page_id LIKE 'p %' UNION ALL SELECT 'line_id' FROM r WHERE badid UNION ALL SELECT 'status' FROM r WHERE status = 'bad' UNION ALL SELECT 'accepted_geometry' FROM r WHERE status = 'accepted' AND seg <> 'accepted' UNION ALL SELECT 'accepted_upstream' FROM r WHERE status = 'accepted' AND NOT up
      UNION ALL SELECT 'accepted_hash' FROM r WHERE status = 'accepted' AND hash UNION ALL SELECT 'accepted_box' FROM r WHERE status = 'accepted' AND w = 0 UNION ALL SELECT 'repeated_line' FROM r GROUP BY CASE WHEN badid THEN page_id || '-L0' ELSE page_id || printf('-L%04d', o) END HAVING count(*) > 1) {_COUNTED}""",
)
def line_row_problems(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    page = F.concat(F.when(s % 13 == 0, "p ").otherwise("p"), F.col("l_orderkey").cast("string"))
    box = F.struct(F.lit(5).alias("left"), F.lit(5).alias("top"), (5 + p % 10).alias("right"), F.lit(9).alias("bottom"))
    rows = table(spark, sf_dir, "lineitem").select(
        page.alias("page_id"), F.col("l_linenumber").alias("order"), F.when(p % 17 == 0, F.concat(page, F.lit("-L0"))).otherwise(F.format_string("%s-L%04d", page, "l_linenumber")).alias("line_id"),
        F.when(s % 5 == 0, "review").when(s % 5 == 1, "bad").otherwise("accepted").alias("status"), F.when(p % 9 == 0, "reject").otherwise("accepted").alias("segmentation_status"), F.when(p % 8 > 0, "pass").alias("upstream"),
        F.array().cast("array<string>").alias("reasons"), F.when(p % 6 == 0, "short").otherwise(F.sha2(F.lit("x"), 256)).alias("line_sha256"), box.alias("box"),
    )
    return _counted(C.line_row_problems(rows))


@query(
    "review_problems",
    f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'fail' WHEN doc_id % 25 = 1 THEN 'skip' ELSE 'pass' END AS outcome, CASE WHEN doc_id % 12 = 0 THEN [] WHEN doc_id % 18 = 6 THEN ['a', 'a'] WHEN doc_id % 6 = 0 OR doc_id % 10 = 3 THEN ['a'] ELSE [] END AS f FROM documents WHERE doc_id % 9 <> 4),
    v AS (SELECT 'outcome' AS rule FROM r WHERE outcome = 'skip' UNION ALL SELECT 'pass_with_findings' FROM r WHERE outcome = 'pass' AND len(f) > 0 UNION ALL SELECT 'fail_without_findings' FROM r WHERE outcome = 'fail' AND len(f) = 0 UNION ALL SELECT 'repeated_finding' FROM r WHERE len(f) > 1
      UNION ALL SELECT 'reviewed_images' FROM documents WHERE doc_id % 9 = 4) {_COUNTED}""",
)
def review_problems(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(i.alias("image_id"), i)
    findings = F.when(i % 12 == 0, F.array().cast("array<string>")).when(i % 18 == 6, F.array(F.lit("a"), F.lit("a"))).when((i % 6 == 0) | (i % 10 == 3), F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    reviews = d.filter(i % 9 != 4).select("image_id", F.when(i % 6 == 0, "fail").when(i % 25 == 1, "skip").otherwise("pass").alias("outcome"), findings.alias("findings"))
    return _counted(C.review_problems(reviews, d.select("image_id")))


@query(
    "block_packets",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS n FROM lineitem)
    SELECT l_orderkey, CASE WHEN count(*) <= 5 THEN string_agg(printf('B%02d: ', n) || l_returnflag, chr(10) ORDER BY n) END AS packet, CASE WHEN count(*) <= 5 THEN count(*) END AS blocks FROM l GROUP BY l_orderkey""",
)
def block_packets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("place", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    return C.packet(lines, ["l_orderkey"], "place", "l_returnflag", 5)


@query(
    "label_coverage",
    f"""WITH n AS (SELECT l_orderkey AS o, count(*) AS n FROM lineitem GROUP BY l_orderkey), w AS (SELECT o, unnest(range(1, n + 1)) AS k FROM n),
    r AS (SELECT *, CASE WHEN (o + k) % 10 = 0 THEN [] WHEN (o + k) % 10 = 1 THEN ['EXCLUDED', 'rent'] WHEN (o + k) % 10 = 2 THEN ['other'] ELSE ['rent'] END AS l FROM w WHERE (o + k) % 13 > 0),
    v AS (SELECT 'no_label' AS rule FROM r WHERE len(l) = 0 UNION ALL SELECT 'unknown_label' FROM r WHERE l = ['other'] UNION ALL SELECT 'excluded_not_alone' FROM r WHERE len(l) = 2 UNION ALL SELECT 'covered_blocks' FROM w WHERE (o + k) % 13 = 0) {_COUNTED}""",
)
def label_coverage(spark, sf_dir):
    packets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.count("*").alias("blocks"))
    each = packets.select("o", F.explode(F.sequence(F.lit(1), F.col("blocks").cast("int"))).alias("k"))
    m = F.pmod(F.col("o") + F.col("k"), F.lit(10))
    labels = F.when(m == 0, F.array().cast("array<string>")).when(m == 1, F.array(F.lit("EXCLUDED"), F.lit("rent"))).when(m == 2, F.array(F.lit("other"))).otherwise(F.array(F.lit("rent")))
    responses = each.filter((F.col("o") + F.col("k")) % 13 > 0).select("o", F.format_string("B%02d", "k").alias("block"), labels.alias("labels"))
    return _counted(C.labels_cover(responses, packets, ["o"], ["rent", "term"], "EXCLUDED"))


@query(
    "risky_lines",
    """WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r\\n|\\r|\\n'), 1) AS n FROM documents)
    SELECT doc_id AS path, CAST(n AS INT) AS line_number, pattern, trim(line) AS line FROM l, (VALUES ('password'), ('Licen'), ('???'), ('der die')) p(pattern) WHERE contains(lower(line), lower(pattern))""",
)
def risky_lines(spark, sf_dir):
    return C.risky_lines(table(spark, sf_dir, "documents"), ["password", "Licen", "???", "der die"], path="doc_id")


@query(
    "sensitive_paths",
    """SELECT page_id, list_has_any(string_split(lower(url), '/'), ['private', 'a']) OR contains(lower(url), 'secret') OR contains(lower(url), '7') AS sensitive FROM pages""",
)
def sensitive_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.sensitive_path(F.col("url"), ["private", "a"], ["secret", "7"]).alias("sensitive"))


@query(
    "change_problems",
    f"""WITH b AS (SELECT 'f' || page_id AS path, html AS c FROM pages WHERE page_id % 10 > 0), h AS (SELECT 'f' || page_id AS path, CASE WHEN page_id % 4 = 0 THEN html || 'x' ELSE html END AS c FROM pages WHERE page_id % 11 > 0),
    x AS (SELECT coalesce(b.path, h.path) AS path FROM b FULL JOIN h ON b.path = h.path WHERE b.path IS NULL OR h.path IS NULL OR b.c IS DISTINCT FROM h.c), d AS (SELECT 'f' || page_id AS path FROM pages WHERE page_id % 3 = 0),
    v AS (SELECT 'undeclared' AS rule FROM x WHERE path NOT IN (SELECT path FROM d) UNION ALL SELECT 'not_changed' FROM d WHERE path NOT IN (SELECT path FROM x) UNION ALL SELECT 'state_not_declared' FROM (VALUES ('f3'), ('state.md')) s(path) WHERE path NOT IN (SELECT path FROM d)) {_COUNTED}""",
)
def change_problems(spark, sf_dir):
    i = F.col("page_id")
    d = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("f"), i.cast("string")).alias("path"), F.col("html").alias("content"))
    head = d.filter(i % 11 > 0).withColumn("content", F.when(i % 4 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    return _counted(C.change_problems(d.filter(i % 3 == 0), d.filter(i % 10 > 0), head, ["f3", "state.md"]))


@query(
    "audit_problems",
    f"""WITH s AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'law/public' WHEN 1 THEN 'law/paid' WHEN 2 THEN 'blog/public' ELSE 'case/paid' END AS ka, DATE '2024-01-01' + CAST(s_suppkey * 7 AS INT) AS got FROM supplier WHERE s_suppkey % 12 <> 5),
    c AS (SELECT l_orderkey * 10 + l_linenumber AS cid, l_suppkey AS id, CASE WHEN l_partkey % 3 = 0 THEN 'direct' ELSE 'context' END AS support, DATE '2024-01-01' + CAST(l_partkey % 400 AS INT) AS eff FROM lineitem WHERE l_suppkey % 15 <> 6),
    v AS (SELECT 'kind_access' AS rule FROM s WHERE ka = 'case/paid' UNION ALL SELECT 'retrieved_later' FROM s WHERE got > DATE '2025-06-01' UNION ALL SELECT 'support' FROM c JOIN s USING (id) WHERE (ka IN ('law/paid', 'blog/public') AND support = 'direct') UNION ALL SELECT 'effective_later' FROM c JOIN s USING (id) WHERE eff > got
      UNION ALL SELECT 'repeated_claim' FROM c GROUP BY cid HAVING count(*) > 1 UNION ALL SELECT 'unknown_source' FROM c WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT 'source_without_claim' FROM s WHERE id NOT IN (SELECT id FROM c)) {_COUNTED}""",
)
def audit_problems(spark, sf_dir):
    k = F.col("s_suppkey")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    sources = table(spark, sf_dir, "supplier").filter(k % 12 != 5).select(k.alias("source_id"), F.when(k % 4 < 2, "law").when(k % 4 == 2, "blog").otherwise("case").alias("kind"), F.when(k % 2 == 0, "public").otherwise("paid").alias("access"), day(k * 7).alias("retrieved"))
    claims = table(spark, sf_dir, "lineitem").filter("l_suppkey % 15 <> 6").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), F.col("l_suppkey").alias("source_id"), F.when(F.col("l_partkey") % 3 == 0, "direct").otherwise("context").alias("support"), day(F.col("l_partkey") % 400).alias("effective"))
    allowed = {"law": {"public": ["direct", "context"], "paid": ["context"]}, "blog": {"public": ["context"]}}
    return _counted(C.audit_problems(sources, claims, allowed, "2025-06-01"))


@query(
    "family_split_problems",
    f"""WITH f AS (SELECT o_custkey AS fam, CASE WHEN o_orderkey % 50 = 0 THEN 'other' WHEN o_custkey % 3 = 0 OR o_orderkey % 97 = 0 THEN 'train' ELSE 'test' END AS split, o_orderkey % 3000 AS t FROM orders),
    v AS (SELECT 'split' AS rule FROM f WHERE split = 'other' UNION ALL SELECT 'family_in_two_splits' FROM f GROUP BY fam HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'text_in_two_splits' FROM f GROUP BY t HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'empty_split') {_COUNTED}""",
)
def family_split_problems(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(c.cast("string").alias("family_id"), F.when(o % 50 == 0, "other").when((c % 3 == 0) | (o % 97 == 0), "train").otherwise("test").alias("split"), (o % 3000).alias("text_sha256"))
    return _counted(C.family_split_problems(rows, ["train", "test", "validation"]))


@query(
    "covered_sets",
    """WITH t AS (SELECT c_custkey AS k, 'customer' AS t FROM customer UNION ALL SELECT o_custkey, 'orders' FROM orders UNION ALL SELECT s_suppkey, 'supplier' FROM supplier),
    g AS (SELECT k, list_distinct(list(t)) AS have FROM t GROUP BY k) SELECT CAST(k AS VARCHAR) AS key, array_to_string(list_filter(['customer', 'orders', 'supplier'], lambda x: NOT list_contains(have, x)), ',') AS message FROM g WHERE len(have) < 3""",
)
def covered_sets(spark, sf_dir):
    names = {"customer": "c_custkey", "orders": "o_custkey", "supplier": "s_suppkey"}
    found = C.same_sets({t: table(spark, sf_dir, t).select(F.col(c).alias("k")) for t, c in names.items()}, "k")
    return found.select("key", "message")


@query("common_keys", "SELECT DISTINCT page_id AS id FROM pages WHERE page_id IN (SELECT doc_id FROM labels)")
def common_keys(spark, sf_dir):
    return C.common_keys(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id")


@query("rows_of_split", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def rows_of_split(spark, sf_dir):
    """Documents of a set that another table names: a semi join."""
    chosen = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(chosen, "doc_id", "left_semi")


@query(
    "assembled_prompts",
    """SELECT doc_id, sha256(array_to_string(list_filter(['## Task' || chr(10) || 'Read it.', CASE WHEN doc_id % 3 > 0 THEN '## Language' || chr(10) || lang END, CASE WHEN trim(text) <> '' THEN '## Text' || chr(10) || trim(text) END], lambda x: x IS NOT NULL), chr(10) || chr(10))) AS prompt,
    CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS language FROM documents""",
)
def assembled_prompts(spark, sf_dir):
    prompt = C.assembled_prompt([("Task", F.lit("Read it.")), ("Language", F.when(F.col("doc_id") % 3 > 0, F.col("lang"))), ("Text", F.col("text"))])
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(prompt, 256).alias("prompt"), C.labelled(F.col("lang"), {"en": "English", "de": "German"}).alias("language"))


_MOVES = {("open", "a"): "review", ("review", "b"): "closed", ("review", "c"): "open", ("closed", "d"): "open"}


@query(
    "replayed_sessions",
    """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, chr(CAST(97 + event_id % 5 AS INT)) AS e FROM events),
    s(user_id, n, state, refused) AS (SELECT DISTINCT user_id, 0::BIGINT, 'open', 0 FROM e UNION ALL
      SELECT s.user_id, e.n, CASE s.state || e.e WHEN 'opena' THEN 'review' WHEN 'reviewb' THEN 'closed' WHEN 'reviewc' THEN 'open' WHEN 'closedd' THEN 'open' ELSE s.state END, s.refused + CAST(s.state || e.e NOT IN ('opena', 'reviewb', 'reviewc', 'closedd') AS INT) FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT user_id, arg_max(state, n) AS state, max(refused) AS refused FROM s GROUP BY user_id""",
)
def replayed_sessions(spark, sf_dir):
    """Events of each user as a session of reviews."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.expr("chr(97 + event_id % 5)").alias("e"))
    return C.replayed(events, ["user_id"], ["ts", "event_id"], "e", "open", _MOVES)


@query(
    "review_pack_problems",
    """WITH p AS (SELECT o_orderkey AS i, o_custkey AS sha, o_custkey % 40 + 10 AS w, o_custkey % 30 + 10 AS h, CAST(o_orderkey % 4 AS INT) AS masks FROM orders WHERE o_orderkey % 23 <> 0),
    d AS (SELECT o_orderkey AS i, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_custkey END AS sha, o_custkey % 40 + CASE WHEN o_orderkey % 13 = 0 THEN 11 ELSE 10 END AS w, o_custkey % 30 + 10 AS h,
    CASE WHEN o_orderkey % 29 = 0 THEN 9 ELSE o_orderkey % 4 END AS masks, o_custkey % 1000 AS pixels FROM orders WHERE o_orderkey % 17 <> 0),
    l AS (SELECT l_orderkey AS i, l_linenumber + CASE WHEN l_orderkey % 19 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN l_orderkey % 31 = 0 AND l_linenumber = 2 THEN 0 ELSE o_custkey END AS sha, l_orderkey * 8 + CASE WHEN l_orderkey % 37 = 0 THEN 0 ELSE l_linenumber END AS id
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    g AS (SELECT i, count(*) AS c, count(DISTINCT n) AS orders, min(n) AS first, max(n) AS last, min(sha) AS least, max(sha) AS most FROM l GROUP BY i)
    SELECT CAST(i AS VARCHAR) AS subject, 'no_prediction' AS problem FROM d WHERE i NOT IN (SELECT i FROM p) UNION ALL SELECT CAST(i AS VARCHAR), 'unknown_page' FROM g WHERE i NOT IN (SELECT i FROM p)
    UNION ALL SELECT CAST(i AS VARCHAR), 'no_renderer' FROM p WHERE i NOT IN (SELECT i FROM d) UNION ALL SELECT CAST(p.i AS VARCHAR), 'source_hash' FROM p JOIN d USING (i) WHERE p.sha <> d.sha
    UNION ALL SELECT CAST(p.i AS VARCHAR), 'size' FROM p JOIN d USING (i) WHERE p.w <> d.w OR p.h <> d.h UNION ALL SELECT CAST(p.i AS VARCHAR), 'mask_count' FROM p JOIN d USING (i) WHERE p.masks <> d.masks
    UNION ALL SELECT CAST(p.i AS VARCHAR), 'masked_pixels' FROM p JOIN d USING (i) WHERE pixels > p.w * p.h UNION ALL SELECT CAST(i AS VARCHAR), 'line_order' FROM g WHERE first <> 1 OR last <> c OR orders <> c
    UNION ALL SELECT CAST(p.i AS VARCHAR), 'line_hash' FROM p JOIN g USING (i) WHERE least <> CAST(sha AS BIGINT) OR most <> CAST(sha AS BIGINT) UNION ALL SELECT CAST(id AS VARCHAR), 'repeated_line' FROM l GROUP BY id HAVING count(*) > 1""",
)
def review_pack_problems(spark, sf_dir):
    """Orders as predicted pages and their masked images, order lines as their lines, with each binding broken somewhere."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    size = [(c % 40 + 10).alias("width"), (c % 30 + 10).alias("height")]
    ids = F.transform(F.slice(F.array(*map(F.lit, range(4))), F.lit(1), (o % 4).cast("int")), lambda k: F.concat_ws("-", o.cast("string"), k.cast("string")))
    predictions = orders.filter(o % 23 != 0).select(o.alias("image_id"), c.alias("image_sha256"), *size, ids.alias("candidates"))
    renderers = orders.filter(o % 17 != 0).select(
        o.alias("image_id"), F.when(o % 11 == 0, 0).otherwise(c).alias("source_image_sha256"), (c % 40 + F.when(o % 13 == 0, 11).otherwise(10)).alias("width"), size[1],
        F.when(o % 29 == 0, 9).otherwise(o % 4).cast("int").alias("mask_count"), (c % 1000).alias("masked_pixel_count"),
    )
    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").join(orders, "o_orderkey").select(
        o.alias("page_id"), (o * 8 + F.when(o % 37 == 0, 0).otherwise(n)).alias("line_id"), (n + F.when(o % 19 == 0, 1).otherwise(0)).alias("order"), F.when((o % 31 == 0) & (n == 2), 0).otherwise(c).alias("source_master_sha256"),
    )
    return C.review_pack_problems(predictions, renderers, lines)
