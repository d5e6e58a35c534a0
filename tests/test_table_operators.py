"""Joins, metrics, ordered operators, validators, evidence, selection, learning, pixels on small rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import aggregates as A
from folioscope.operators import evidence, joins, learning, ordered, pixels, rules, selection


def test_nearest_preceding(spark):
    values = spark.createDataFrame([("a", 5), ("a", 30), ("a", 1), ("b", 9)], "g string, at int")
    marks = spark.createDataFrame([("a", 5, "x"), ("a", 4, "y"), ("a", 12, "z")], "g string, m int, p string")
    found = joins.nearest_preceding(values, marks, ["g"], "at", "m", ["p"], 10)
    assert {(r["g"], r["at"]): r["preceding_p"] for r in found.collect()} == {("a", 5): "x", ("a", 30): None, ("a", 1): None, ("b", 9): None}


def test_references(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b", "x"]), (2, []), (3, None)], "k int, ids array<string>")
    targets = spark.createDataFrame([("a", "A"), ("b", "B")], "t string, p string")
    found = {r["k"]: (r["resolved"], r["invalid"]) for r in joins.resolve_references(rows, targets, "k", "ids", "t", "p").collect()}
    assert found[1] == (["B", "A"], ["x"]) and found[2] == (None, None) == found[3]


def test_null_safe_comparison(spark):
    e = spark.createDataFrame([(1, None, "a"), (2, "m", None), (3, "m", "c")], "q int, m string, v string")
    a = spark.createDataFrame([(1, None, "a"), (2, "m", "b"), (4, None, "d")], "q int, m string, v string")
    assert {r["q"]: r["status"] for r in joins.compare_null_safe(e, a, ["q", "m"], "v").collect()} == {1: "match", 2: "differs", 3: "missing", 4: "unexpected"}


def test_edges(spark):
    df = spark.sql("""SELECT 'c' AS candidate_id, array(named_struct('evidence_id', 'e1', 'family', 'marker', 'relation', CAST(NULL AS STRUCT<relation_type: STRING, source_evidence_id: STRING, target_evidence_id: STRING>)),
        named_struct('evidence_id', 'e2', 'family', 'value', 'relation', named_struct('relation_type', 'precedes', 'source_evidence_id', 'e1', 'target_evidence_id', 'e9'))) AS evidence""")
    row = joins.edges_with_ends(df).first()
    assert (row["relation_type"], row["source_family"], row["target_family"]) == ("precedes", "marker", None)


def test_unbounded_tables_are_not_broadcast(spark):
    small, large = spark.range(5), spark.range(50)
    assert "broadcast" in joins.bounded(small, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in joins.bounded(large, 10)._jdf.queryExecution().logical().toString().lower()


def test_sweep_and_choice(spark):
    draw = random.Random(4)
    rows = [(draw.randint(0, 1), round(draw.random(), 2)) for _ in range(300)] + [(1, 0.0), (0, 1.0)]
    swept = A.threshold_sweep(spark.createDataFrame(rows, "y int, s double"), "y", "s")
    found = {r["threshold"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in swept.collect()}
    assert set(found) == {0.0, 1.0, *(s for _, s in rows)}
    for t, counts in found.items():
        assert counts == (sum(y and s >= t for y, s in rows), sum(not y and s >= t for y, s in rows), sum(y and s < t for y, s in rows), sum(not y and s < t for y, s in rows))
    best = A.choose_threshold(swept, 0.9).first()
    fit = [(c[1] / (c[1] + c[3]), -c[0] / (c[0] + c[2]), -t) for t, c in found.items() if c[0] / (c[0] + c[2]) >= 0.9]
    assert best["threshold"] == -min(fit)[2]


def test_zero_denominators(spark):
    row = A.confusion(spark.createDataFrame([], "t boolean, p boolean"), F.col("t"), F.col("p")).first()
    assert (row["tp"], row["precision"], row["recall"], row["false_positive_rate"]) == (0, 0.0, 0.0, 0.0)
    df = spark.createDataFrame([("", ""), ("", "a"), ("ab", None)], "e string, f string")
    assert [r[0] for r in df.select(A.character_error_rate(F.col("e"), F.col("f"))).collect()] == [0.0, 1.0, 1.0]
    assert A.micro_error_rate(df.limit(2), "e", "f").first()["cer"] is None


def test_otsu(spark):
    draw = np.random.default_rng(1)
    values = [int(v) for v in np.clip(np.concatenate([draw.normal(60, 9, 300), draw.normal(180, 9, 200)]), 0, 255)]
    found = A.otsu_threshold(spark.createDataFrame([("g", v) for v in values], "g string, v int"), "v", ["g"]).first()["threshold"]
    assert found == pixels.otsu(np.array(values)) and 80 < found < 160


def test_islands(spark):
    rows = [("a", 1, 3), ("a", 2, 9), ("a", 4, 5), ("a", 12, 13), ("a", 16, 17), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "g string, s int, e int")
    assert sorted((r["g"], r["s"], r["e"], r["members"]) for r in ordered.merged_intervals(df, ["g"], "s", "e", 3).collect()) == [("a", 1, 17, 5), ("b", 1, 1, 1)]
    assert sorted((r["g"], r["s"], r["e"], r["members"]) for r in ordered.merged_intervals(df, ["g"], "s", "e", 2).collect()) == [("a", 1, 9, 3), ("a", 12, 13, 1), ("a", 16, 17, 1), ("b", 1, 1, 1)]


def test_priority_spans(spark):
    df = spark.createDataFrame([([(2, 0, 5), (1, 4, 8), (3, 8, 9), (2, 7, 9)],), ([],)], "s array<struct<priority:int,start:int,end:int>>")
    assert [[tuple(x) for x in r[0]] for r in df.select(ordered.priority_spans(F.col("s"))).collect()] == [[(1, 4, 8), (3, 8, 9)], []]


def test_tiles_and_shoelace(spark):
    found = ordered.tiles(spark.createDataFrame([(10, 7), (3, 9)], "w int, h int"), "w", "h", 4, 3)
    assert sorted((r["x"], r["y"]) for r in found.collect()) == [(x, y) for x in (0, 3, 6) for y in (0, 3)]
    df = spark.createDataFrame([([[0, 0], [4, 0], [4, 3], [0, 3]],), ([[0, 0], [0, 3], [4, 0]],)], "p array<array<int>>")
    assert [r[0] for r in df.select(ordered.shoelace(F.col("p"))).collect()] == [24, 12]


def test_manifest_rules(spark):
    sha = lambda t: F.sha2(F.lit(t).cast("binary"), 256)
    names = "schema_version dataset_id sample_id label_status source_dataset source_id data_tier split text".split()
    rows = [(1, "d", "a", "x", "s", "1", "silver", "train", "ab"), (1, "d", "b", "x", "s", "2", "silver", "test", "a  b"), (2, "e", "b", "", "s", "3", "gold", "train", "ab"), (1, "d", "c", "approved", "s", "4", "bad", "none", "")]
    df = spark.createDataFrame(rows, "schema_version int, " + ", ".join(f"{n} string" for n in names[1:])).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).withColumn("image_sha256", F.col("sample_id"))
    found = {(r["rule"], r["key"]) for r in rules.manifest_violations(df, charset=["a", "b"]).collect()}
    for wanted in [("schema_version", "b"), ("label_status_blank", "b"), ("data_tier", "c"), ("split", "c"), ("training_tier_in_test", "b"), ("gold_outside_test", "b"), ("gold_label_status", "b"), ("text_empty", "c"), ("text_not_canonical", "b"), ("unknown_characters", "b"), ("duplicate_sample_id", "b"), ("several_datasets", "*")]:
        assert wanted in found
    assert not any(key == "a" for _, key in found)
    with pytest.raises(rules.Violations, match="data_tier: c"):
        rules.require(rules.manifest_violations(df).filter("rule = 'data_tier'"))
    rules.require(rules.violations(df.filter("sample_id = 'a'"), "sample_id", [rules.Rule("never", F.lit(False))]))
    assert sha("x") is not None


def test_answers(spark):
    q = spark.createDataFrame([("Q1", ["a"]), ("Q2", ["a", "b"]), ("Q3", ["a"])], "question_id string, answer_fields array<string>")
    b = spark.createDataFrame([("B1",)], "block_id string")
    a = spark.createDataFrame([("Q1", "FOUND", [" "], ["B1"]), ("Q2", "NOT_FOUND", ["x"], []), ("Q9", "FOUND", ["x"], ["B2", "B2"]), ("Q1", "FOUND", ["x"], [])], "question_id string, status string, values array<string>, evidence_block_ids array<string>")
    found = sorted({(r["rule"], r["key"]) for r in rules.answer_violations(a, q, b).collect()})
    assert found == [("arity", "Q2"), ("coverage", "Q3"), ("duplicate_answer", "Q1"), ("found_nothing_but_values", "Q2"), ("found_without_value", "Q1"), ("no_evidence", "Q1"), ("repeated_evidence", "Q9"), ("unknown_block", "Q9"), ("unknown_question", "Q9")]


def test_claims(spark):
    docs = spark.createDataFrame([(1, "rent is 3500 a month. more text", [1])], "doc_id int, text string, pages array<int>")
    blocks = spark.createDataFrame([(1, "P1-B01", "rent is 3500 a month.", 1), (1, "P2-B01", "more text", 2)], "doc_id int, block_id string, text string, page int")
    claims = spark.createDataFrame(
        [(1, "ok", "pay 3500", None, None, 0.9, ["P1-B01"]), (1, "num", "pay 4000", None, None, 0.9, ["P1-B01"]), (1, "bad", "pay", None, None, 0.9, ["P9-B01"]), (1, "quote", "so", "more  text", 1, 0.9, []), (1, "page", "so", "more text", 7, 0.9, []), (1, "none", "so", None, None, 0.9, []), (1, "two", "so", None, None, 0.9, ["P1-B01", "P2-B01"])],
        "doc_id int, claim_id string, claim string, quote string, page int, confidence double, evidence_block_ids array<string>",
    )
    got = {r["claim_id"]: r for r in evidence.judged_claims(claims, blocks, docs).collect()}
    assert {k: r["action"] for k, r in got.items()} == {"ok": "keep", "num": "drop", "bad": "drop", "quote": "keep", "page": "drop", "none": "drop", "two": "keep"}
    assert got["ok"]["quote"] == "rent is 3500 a month." and got["ok"]["page"] == 1 and got["two"]["page"] is None and got["quote"]["reason"] == "quote_fallback"
    low = {r["claim_id"]: (r["action"], r["confidence"]) for r in evidence.judged_claims(claims, blocks, docs, on_failure="downgrade").collect()}
    assert low["bad"] == ("downgrade", 0.3) and low["num"] == ("keep", 0.9)


def test_greedy_quota(spark):
    rows = [("g", f"i{k}", k % 3, k, 1.0, 0.5 if k % 2 else None) for k in range(12)]
    found = selection.greedy_quota(spark.createDataFrame(rows, "group_id string, item_id string, page long, line long, score double, odd double"), {"odd": 4}).orderBy("rank").collect()
    assert [r["item_id"] for r in found] == ["i3", "i1", "i5", "i9"]


def test_learning(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(120, 2))
    rows = [(int(k), f"f{k % 4}", float(a), float(b), int(a + b > 0)) for k, (a, b) in enumerate(x)]
    found = learning.leave_one_out(spark.createDataFrame(rows, "k long, fold string, a double, b double, y int"), "fold", ["a", "b"], "y", "k").collect()
    assert len(found) == 120 and np.mean([(r["score"] > 0.5) == r["target"] for r in found]) > 0.95
    bags = np.concatenate([draw.normal(loc=3 * (k % 2) * (j == 0), size=(1, 2)) for k in range(40) for j in range(4)])
    begin, y = np.arange(0, 160, 4), np.arange(40) % 2
    beta, bias = learning.mil_fit(bags, begin, y)
    logit, share = learning.bag_logits(bags, begin, beta, bias, learning.TEMPERATURE)
    assert np.mean((logit > 0) == y) > 0.85 and np.allclose(np.add.reduceat(share, begin), 1)


def test_pixels():
    page = np.full((20, 30), 255)
    page[3:6, 2:20] = 0
    page[10:14, 5:25] = 10
    assert pixels.text_lines(page) == [(2, 3, 20, 6), (5, 10, 25, 14)]
    assert pixels.components(pixels.ink(page)).max() == 2
    wide = np.full((60, 200), 255)
    wide[10:12, 20:180] = wide[30:32, 20:180] = 0
    assert pixels.skew_angle(wide) == 0 and pixels.skew_angle(np.full((5, 5), 255)) == 0
    assert (pixels.masked(page, [(0, 0, 5, 5)])[:5, :5] == 0).all() and page[0, 0] == 255
    assert pixels.runs(np.array([1, 1, 0, 1, 0, 0, 1], dtype=bool), 1) == [(0, 4), (6, 7)]


def test_training_dataset(spark):
    from folioscope.operators import datasets as D

    schema = "source_id string, text string, image_sha256 string, split string"
    made = D.source_records(spark.createDataFrame([("1", "a", "i1", "train"), ("2", "b", "i2", "validation"), ("3", "c", "i3", "validation"), ("4", "gold", "i4", "train")], schema), "synthetic", "m")
    read = D.source_records(spark.createDataFrame([("5", "b", "i5", None), ("6", "d", "g1", None), ("7", "e", "i7", None)], schema), "silver", "r", validation_fraction=1.0)
    gold = D.gold_dataset(spark.createDataFrame([("g", "gold", "g1", "approved", "7"), ("h", "zzz", "g2", "pending", "1")], "gold_id string, text string, image_sha256 string, review_status string, source_crop string"), "gd")
    rows, out = D.training_dataset(made.unionByName(read), gold, "d")
    assert {r["source_id"]: (r["split"], r["reassigned"]) for r in rows.collect()} == {"1": ("train", False), "2": ("validation", False), "3": ("validation", False), "5": ("validation", False)}
    assert {r["source_id"]: r["reasons"] for r in out.collect()} == {"4": ["text_sha256"], "6": ["image_sha256"], "7": ["source_id"]}
    assert D.leakage(rows, gold).count() == 0 and gold.count() == 1
    assert D.charset_problems([" ", "a", "b"]) == [] and len(D.charset_problems(["a", "a", "ab", "é", "‏"])) == 5


def test_merged_row_boxes(spark):
    from folioscope.operators.datasets import merged_row_boxes

    df = spark.createDataFrame([([(0, 0, 5, 9), (4, 3, 8, 5), (20, 0, 22, 1), (7, 0, 9, 1)],), ([],)], "b array<struct<top:int,left:int,bottom:int,right:int>>")
    assert [[tuple(x) for x in r[0]] for r in df.select(merged_row_boxes(F.col("b"))).collect()] == [[(0, 0, 9, 9), (20, 0, 22, 1)], []]
