"""Gates, geometry, contracts, markers and evidence in the cases that their queries do not hold."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import markers
from folioscope.functions import python_functions as P
from folioscope.operators import aggregates, contracts, datasets, evidence, gates, geometry, joins, redaction, selection


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_claims_belong_to_their_documents(spark):
    """The same ids of claims and blocks in two documents, a document without pages, and a quote with another white space."""
    docs = spark.createDataFrame([(1, "rent is 10", [1]), (2, "rent is 20", []), (3, "a\u00a0b c", None)], "doc_id int, text string, pages array<int>")
    blocks = spark.createDataFrame([(1, "b", "rent is 10", 1), (2, "b", "rent is 20", 1)], "doc_id int, block_id string, text string, page int")
    kind = "doc_id int, claim_id string, claim string, quote string, page int, confidence double, evidence_block_ids array<string>, level string"
    claims = spark.createDataFrame([(1, "c", "pay 10", None, None, 0.9, ["b"], "low"), (2, "c", "pay 10", None, None, 0.9, ["b"], "low"), (2, "q", "so", "rent", 9, 0.9, [], "low"), (3, "q", "so", "a b", 4, 0.9, [], "low")], kind)
    got = {(r["doc_id"], r["claim_id"]): r for r in evidence.judged_claims(claims, blocks, docs).collect()}
    assert [got[k]["action"] for k in ((1, "c"), (2, "c"), (2, "q"), (3, "q"))] == ["keep", "drop", "keep", "keep"] and got[1, "c"]["quote"] == "rent is 10"
    low = {(r["doc_id"], r["claim_id"]): (r["action"], r["level"], r["confidence"]) for r in evidence.judged_claims(claims.withColumn("evidence_block_ids", F.array(F.lit("z"))), blocks, docs, on_failure="downgrade").collect()}
    assert set(low.values()) == {("downgrade", "unclear", 0.3)}


def test_repeated_keys_resolve_each(spark):
    rows = spark.createDataFrame([(1, ["a"]), (1, ["b", "x"]), (1, ["a"])], "k int, ids array<string>")
    targets = spark.createDataFrame([("a", "A"), ("b", "B")], "t string, p string")
    found = joins.resolve_references(rows, targets, "k", "ids", "t", "p").collect()
    assert sorted((r["ids"], r["resolved"], r["invalid"]) for r in found) == [(["a"], ["A"], []), (["a"], ["A"], []), (["b", "x"], ["B"], ["x"])]


def test_strong_evidence_must_all_agree(spark):
    kind = "geometry string, evidence array<struct<strength:string,valid:boolean,geometry:string>>"
    rows = [("a", []), ("a", None), ("a", [("strong", True, "a")]), ("a", [("strong", True, "a"), ("strong", True, "b")]), ("a", [("strong", True, None)]), (None, [("strong", True, None)]), ("a", [("strong", True, "a"), ("weak", None, "a")]), ("a", [("weak", True, "a")])]
    found = [r["disposition"] for r in evidence.dispositions(spark.createDataFrame(rows, kind)).collect()]
    assert found == ["preserve", "preserve", "auto_mask", *["local_review"] * 5]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("email: a@b.org", [("email", 0, 5, 7, 14)]),
        ("my-email a@b.org", [("email", 3, 8, 9, 16)]),
        ("xemail a@b.org", []),
        ("email\na@b.org", []),
        ("email is a@b.org", []),
        ("email" + " " * 17 + "a@b.org", []),
        ("email" + " " * 16 + "a@b.org", [("email", 0, 5, 21, 28)]),
        ("מספר IBAN: IL620108000000099999999", [("bank_identifier", 0, 9, 11, 34)]),
        ("טלפון 050-123-4567 email 052-765-4321", [("phone", 0, 5, 6, 18)]),
        ("", []),
        (None, []),
    ],
)
def test_markers(text, wanted):
    assert [(r["kind"], r["marker_start"], r["marker_end"], r["value_start"], r["value_end"]) for r in markers.related_values(text)] == wanted


def test_markers_inside_others_of_their_class():
    assert markers.marked_places("ת.ז. IBAN מספר IBAN") == [("israeli_id", 0, 4), ("bank_identifier", 5, 9), ("bank_identifier", 10, 19)]


def problems(spark, **changes):
    base = {"candidate_id": "'c1'", "proposed_class": "'email'", "geometry_ok": "true", "disposition": "'auto_mask'", "detector_version": "'v0'", "ambiguity_reason": "cast(null as string)"} | changes
    records = base.pop("evidence", [("v", "direct_value", "direct-email-v0", None)])
    df = spark.createDataFrame([([(i, f, d, None, r) for i, f, d, r in records],)], f"evidence {contracts.EVIDENCE}")
    return df.select("*", *(F.expr(v).alias(k) for k, v in base.items())).select(contracts.candidate_problems(["email", "signature"]).alias("p")).first()["p"]


def test_candidates(spark):
    value, mark, seen = ("v", "direct_value", "direct-email-v0", None), ("m", "marker", "marker-email-v0", None), ("s", "visual_sensitive_region", "visual-evidence-signature-v0", None)
    link = lambda t="marker_to_value", a="m", b="v", d="marker-to-direct-value-v0": ("r", "relation", d, (t, a, b))
    assert problems(spark) == [] and problems(spark, evidence=[mark, value, link()]) == []
    assert problems(spark, candidate_id="'-x'", detector_version="null", geometry_ok="null") == ["candidate_id", "detector_version", "geometry"]
    assert problems(spark, disposition="'local_review'") == ["review_without_reason"] and problems(spark, disposition="'preserve'", ambiguity_reason="'why'") == ["reason_not_allowed"]
    assert problems(spark, evidence=[value, value]) == ["repeated_evidence_id"] and problems(spark, evidence=[("v", "guess", "d", None)]) == ["family", "mask:no_strong_evidence"]
    assert problems(spark, evidence=[value, link(a="gone")]) == ["missing_evidence"] and problems(spark, evidence=[value, link(a="v", b="v")]) == ["self_reference"]
    assert problems(spark, evidence=[mark, value, link("nearby")]) == ["relation_type"] and problems(spark, evidence=[mark, value, link(a="v", b="m")]) == ["relation_ends"]
    assert problems(spark, evidence=[mark, value, link(d="other")]) == ["mask:relation_detector"] and problems(spark, evidence=[("r", "relation", "d", None)]) == ["relation_missing", "mask:no_strong_evidence"]
    assert problems(spark, evidence=[mark, seen, link("marker_to_visual", b="s", d="marker-to-visual-v0")]) == ["mask:no_strong_evidence", "mask:classes_differ"]
    assert problems(spark, evidence=[mark, ("s", "visual_sensitive_region", "visual-evidence-handwriting-v0", None), link("marker_to_visual", b="s", d="marker-to-visual-v0")]) == []


def test_gates_of_missing_values(spark):
    null = F.lit(None).cast("int")
    assert one(spark, gates.text_usable(null, F.lit(1), F.lit(1))) is False and one(spark, gates.quality_sufficient(F.lit(None).cast("boolean"), F.lit(None).cast("string"), F.lit(True))) is False
    assert one(spark, gates.text_layer_problems(F.lit(None).cast("string"), F.lit(0), null)) == ["no_pages", "too_short", "too_few_letters"]
    assert [one(spark, gates.mean_confidence(F.array(*(F.lit(v).cast("double") for v in x)).cast("array<double>"))) for x in ([], [None], [50.0, None, 300.0], [-5.0])] == [0.0, 0.0, 1.0, 0.0]
    said, blocking = gates.verdict({"a": F.lit(True), "b": F.lit(None).cast("boolean"), "c": F.lit(False)})
    assert (one(spark, said), one(spark, blocking)) == ("BLOCK", ["b", "c"])
    assert one(spark, gates.content_lines(F.lit("--- OCR MODE fast ---\r\n a b.PNG \n\n[masked]\nx [REDACTED] y"))) == "x   y"
    assert one(spark, gates.between_markers(F.lit("a START b END c STOP"), "START", ["STOP", "END"])) == "b" and one(spark, gates.between_markers(F.lit("a"), "START", ["END"])) is None


def test_unpaired_rows_are_errors(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "n int, v string"), spark.createDataFrame([(1, "x")], "n int, v string")
    assert gates.zipped(a, a, "n", ["v"]).filter("v_differs").count() == 0
    with pytest.raises(Exception, match="unpaired position 2"):
        gates.zipped(a, b, "n", ["v"]).collect()


def test_nearest_within_like_all_pairs(spark):
    draw = random.Random(4)
    boxes = [(p, f"b{p}-{k}", (x := draw.randint(0, 300), y := draw.randint(0, 300), x + draw.randint(0, 80), y + draw.randint(0, 120))) for p in range(3) for k in range(25)]
    points = [(p, k, float(draw.randint(-20, 380)), float(draw.randint(-20, 420)), float(draw.choice([0, 5, 12]))) for p in range(3) for k in range(40)]
    away = lambda x, y, b: (max(b[0] - x, 0, x - b[2]) ** 2 + max(b[1] - y, 0, y - b[3]) ** 2) ** 0.5
    wanted = {}
    for p, k, x, y, r in points:
        near = sorted((away(x, y, b), i) for q, i, b in boxes if q == p and away(x, y, b) <= r)
        wanted[p, k] = near[0][1] if near else None
    df = spark.createDataFrame(boxes, "p int, i string, box struct<left:int,top:int,right:int,bottom:int>")
    asked = spark.createDataFrame(points, "p int, k int, x double, y double, reach double")
    assert {(r["p"], r["k"]): r["i"] for r in geometry.nearest_within(asked, df, ["p"], "k", "i", 12.0).collect()} == wanted
    with pytest.raises(Exception, match="over the limit"):
        geometry.nearest_within(asked, df, ["p"], "k", "i", 4.0).collect()


def test_quads(spark):
    def of(points):
        corners = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points))
        return one(spark, geometry.quad_problems(corners, F.lit(100), F.lit(100), 0.2, 2.5))

    assert of([(0, 0), (90, 5), (95, 95), (5, 90)]) == [] and of([(0, 0), (90, 90), (90, 0), (0, 90)])[0] == "not_convex"
    assert of([(0, 0), (101, 0), (100, 30), (0, 30)]) == ["outside", "aspect"] and of([(0, 0), (10, 0), (10, 10), (0, 10)]) == ["small"]


def test_error_rates_of_runs_by_hand(spark):
    """What the queries without a twin compute, against a plain distance."""
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    pairs = [("née", "nee"), ("", "ab"), ("漢字", "漢"), ("abc", ""), (None, "x")]
    df = spark.createDataFrame([(str(k % 2), a, b) for k, (a, b) in enumerate(pairs)], "s string, e string, f string")
    found = {r["s"]: r["errors"] for r in aggregates.micro_error_rate(df, "e", "f", ["s"]).collect()}
    for s in ("0", "1"):
        assert found[s] == sum(distance(a or "", b) for k, (a, b) in enumerate(pairs) if k % 2 == int(s))


def test_page_text():
    assert P.html_text("<p>a<!-- <p>no</p> -->b<br/>c &amp; d</p><script>if (a < b) x()</script>") == "ab\nc & d\nif (a < b) x()"
    assert P.nfc_text("a\u061cb") == "a\u061cb" and P.nfc_text("a\u200eb") is None and P.folded_text("a\u061cb") == "ab"


def test_quotas_may_be_required(spark):
    rows = spark.createDataFrame([("g", "i", 1, 1, 1.0, 0.5)], "group_id string, item_id string, page long, line long, score double, odd double")
    assert selection.greedy_quota(rows, {"odd": 2}).count() == 1
    with pytest.raises(Exception, match="cannot be filled"):
        selection.greedy_quota(rows, {"odd": 2}, whole=True).collect()


def test_last_row_of_a_hash_leaks(spark):
    training = spark.createDataFrame([("z", "h", None, 1), ("a", "h", None, 2), (None, None, "t", 3)], "sample_id string, image_sha256 string, text_sha256 string, n int")
    gold = spark.createDataFrame([("g", "h", "u"), ("k", None, None)], "gold_id string, image_sha256 string, text_sha256 string")
    assert [r["sample_id"] for r in datasets.leakage(training, gold, "n").collect()] == ["a"] and [r["sample_id"] for r in datasets.leakage(training, gold).collect()] == ["z"]


def test_tokens_are_literal(spark):
    df = spark.createDataFrame([("x a\\Eb.c y", ["a\\Eb.c", ""])], "t string, k array<string>")
    assert df.select(redaction.remove_tokens(F.col("t"), F.col("k"), "[N]").alias("x")).first()["x"] == "x [N] y"


def test_sessions_and_sets(spark):
    events = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "z"), (2, 1, "b")], "s int, n int, e string")
    found = {r["s"]: (r["state"], r["refused"]) for r in contracts.replayed(events, ["s"], ["n"], "e", "open", {("open", "a"): "review", ("review", "b"): "closed"}).collect()}
    assert found == {1: ("closed", 1), 2: ("open", 1)}
    a, b = (spark.createDataFrame([(x,) for x in v], "k int") for v in ([1, 2, 2], [2, 3]))
    assert [r["k"] for r in contracts.common_keys(a, b, "k").collect()] == [2]
    with pytest.raises(ValueError, match="both sides have 2"):
        contracts.require_disjoint(a, b, "k")
    contracts.require_disjoint(a, b.filter("k > 2"), "k")


def test_spans_without_words(spark):
    words = spark.createDataFrame([(1, 0, 0, 5, (0, 0, 10, 5)), (1, 0, 6, 9, (14, 0, 20, 5)), (1, 1, 10, 15, (0, 9, 9, 15))], "g int, line int, start int, end int, box struct<left:int,top:int,right:int,bottom:int>")
    spans = spark.createDataFrame([(1, "a", 0, 9), (1, "b", 0, 12), (1, "c", 30, 40), (2, "d", 0, 1)], "g int, span_id string, span_start int, span_end int")
    found = {r["span_id"]: (r["words"], r["reason"], r["box"] and tuple(r["box"])) for r in geometry.span_boxes(spans, words, ["g"], max_gap=4).collect()}
    assert found == {"a": (2, None, (0, 0, 20, 5)), "b": (3, "several_lines", None), "c": (0, "no_words", None), "d": (0, "no_words", None)}
    wide = {r["span_id"]: r["reason"] for r in geometry.span_boxes(spans, words, ["g"], max_gap=3).collect()}
    assert wide["a"] == "wide_gap" and len(list(itertools.islice(wide, 9))) == 4
