"""Redaction, gates, blocks and Python-backed functions on small rows of our own."""

from pyspark.sql import functions as F

from folioscope.functions import profiles as P
from folioscope.functions import python_functions as Y
from folioscope.functions import scalars as S
from folioscope.operators import blocks, quality
from folioscope.operators.redaction import redact, remove_tokens, residual_findings

LEASE = """חוזה שכירות
שם המשכיר: ישראל ישראלי
ת.ז. 123456782
כתובת: רחוב הרצל 5
טלפון: 050-1234567
מייל: ab@example.com
דמי שכירות: 3,500 ₪ פיקדון 123456789
חתימה: ________
מספר 987654321 בלבד
חשבון בנק: 12-345
שם הערב: פלוני"""


def one(spark, column, *values, names=("x",)):
    return [r[0] for r in spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in values], ", ".join(f"{n} string" for n in names)).select(column).collect()]


def test_redaction(spark):
    row = redact(spark.createDataFrame([(1, LEASE), (2, None), (3, "")], "doc_id int, text string"), P.LEASE_HE).orderBy("doc_id").collect()
    text, report = row[0]["redacted"], row[0]["report"]
    for secret in ("ישראלי", "123456782", "הרצל", "050-1234567", "ab@example", "987654321", "12-345", "פלוני"):
        assert secret not in text
    assert "3,500 ₪" in text and "123456789" in text  # a money line keeps its number
    for mark in (P.NAME, P.ID, P.ADDRESS, P.PHONE, P.EMAIL, P.SIGNATURE, P.BANK, P.GUARANTOR):
        assert mark in text
    assert report["total"] == sum(report[c] for c in P.COUNTERS) == 9 and report["ids"] == 2
    assert row[1]["redacted"] is None and row[1]["report"]["total"] == 0 and row[2]["redacted"] == ""
    again = redact(spark.createDataFrame([(text,)], "text string"), P.LEASE_HE).first()
    assert again["redacted"] == text and again["report"]["total"] == 0


def test_residual_findings_and_tokens(spark):
    assert one(spark, residual_findings(F.col("x"), {"mail": "@", "digits": r"\d{4}"}), "a@b 1234", "none") == [["digits", "mail"], []]
    df = spark.createDataFrame([("Dan Daniel (Dan) Danny", ["Dan", "Daniel"])], "t string, n array<string>")
    assert df.select(remove_tokens(F.col("t"), F.col("n"), "[X]")).first()[0] == "[X] [X] ([X]) Danny"


def test_usability(spark):
    long = ("המשכיר משכיר לשוכר את הדירה לתקופה של שנה אחת. " * 30) + "חוזה שכירות. השוכר. תקופת השכירות. דמי שכירות."
    rows = quality.usability(spark.createDataFrame([(1, long), (2, ""), (3, "abc " * 100), (4, None)], "i int, text string"), P.LEASE_HE).orderBy("i").collect()
    assert rows[0]["usable"] and rows[0]["completeness"] == "high" and rows[0]["problems"] == []
    assert rows[1]["garbage"] == 1.0 and not rows[1]["usable"] and rows[1]["completeness"] == "low"
    assert set(rows[2]["problems"]) == {"few_letters", "few_indicators", "few_clauses", "garbage"}
    assert rows[3]["problems"] == rows[1]["problems"]


def test_jumps(spark):
    texts = ["1. a\n2. b\n3. c\n9. d", "1. a\n2. b\n3. c\n6. d", "1. a\n9. b\n10. c", ""]
    assert one(spark, quality.suspicious_jumps(F.col("x")), *texts) == [True, False, False, False]


def test_evidence_blocks(spark):
    text = "one\n\ntwo\n\nthree\n--- СТРАНИЦА 2 ---\nfour\n\n1. a\n2. b\n--- СТРАНИЦА 2 ---\nfive\n \n"
    rows = blocks.evidence_blocks(spark.createDataFrame([(1, text), (2, None), (3, "only")], "doc_id int, text string")).orderBy("doc_id", "page", "index").collect()
    assert [(r["doc_id"], r["block_id"], r["text"]) for r in rows] == [
        (1, "P1-B01", "one"), (1, "P1-B02", "two"), (1, "P1-B03", "three"), (1, "P2-B01", "four"), (1, "P2-B02", "1. a"), (1, "P2-B03", "2. b"), (1, "P2-B04", "five"), (3, "P1-B01", "only"),
    ]


def test_scalars(spark):
    assert one(spark, S.iban_valid(F.col("x")), "IL620108000000099999999", "IL62 0108 0000 0009 9999 999", "IL630108000000099999999", "GB62", None) == [True, True, False, False, False]
    assert one(spark, S.numbers(F.col("x")), "pay 3,500 or 12345 by 1/2/2024", None) == [["3,500", "123", "45", "1/2/2024"], []]
    assert one(spark, S.retry_seconds(F.col("x")), "12s", ' 7 ', '{"retryDelay":"1.5s"}', "soon", None) == [12.0, 7.0, 1.5, None, None]
    assert one(spark, S.safe_relative_path(F.col("x")), "a/b.png", "../a", "/a", "a//b", "a/./b", "a\\b", "", "C:/a", None) == [True] + [False] * 8
    assert one(spark, S.natural_key(F.col("x")) < S.natural_key(F.lit("page10")), "Page2", "page11") == [True, False]
    assert one(spark, S.host_allowed(F.col("x"), ["a.org"]), "https://a.org/x", "https://b.a.org", "http://a.org", "https://xa.org", None) == [True, True, False, False, False]
    assert one(spark, S.iso_date(F.col("x")).cast("string"), "2024-02-29", "2023-02-29", "2024-2-9", None) == ["2024-02-29", None, None, None]
    assert one(spark, S.version_key(F.col("x")) < S.version_key(F.lit("1.10.0")), "v1.9.9", "2.0.0", "x") == [True, False, None]
    assert one(spark, S.duplicate_json_keys(F.col("x")), '{"a":1,"a":2}', '{"a":1}', None) == [True, False, False]
    assert one(spark, S.bucket_split(F.col("x")), "g1") == ["train"]


def test_alignment():
    assert [op for op, _, _ in Y.aligned("אבג 12", "אב 13")] == ["match", "match", "deletion", "match", "match", "substitution"]
    assert Y.aligned("", "ab") == [("insertion", None, "a"), ("insertion", None, "b")] and Y.aligned("", "") == []
    assert [Y.character_class(c) for c in "א1a .\u0301"] == ["hebrew", "digits", "latin", "space", "punctuation_symbols", "other"]


def test_word_similarity():
    assert Y.word_similarity("", None) == 1.0 and Y.word_similarity("a b", "") == 0.0
    assert Y.word_similarity("a b c d", "a x c d e") == 1 - 2 / 5


def test_text_forms():
    assert Y.nfc_text("\ufeffe\u0301  x") == "é x" and Y.nfc_text("a\u200fb") is None and Y.nfc_text(None) is None
    assert Y.folded_text("Ａ·b\u0301\u200f!c") == "A b c"
    assert Y.html_text("<p>a &amp; b</p><!-- x --><div>c<br/>d <b>e</b></div>") == "a & b\nc\nd e"
    assert Y.ctc_text([0, 1, 1, 0, 1, 2, 2], ["a", "b"]) == "aab" and Y.ctc_text([], ["a"]) == ""


def test_order():
    line = "דירה (12) abc"
    assert Y.reordered(Y.reordered(line)) == line and Y.reordered("abc 1") == "abc 1" and Y.reordered("אa") is None and Y.reordered(None) is None


def test_markers():
    found = Y.fuzzy_markers("הסכם שכירות בין חשוכר לבין המשכיר ארנונא")
    assert found["הסכם שכירות"] == "הסכם שכירות" and found["שוכר"] == "חשוכר" and found["ארנונה"] == "ארנונא" and "פינוי" not in found
    assert Y.fuzzy_markers(None) == {}


def test_direct_values():
    text = "a.b@example.com 050-1234567 x IL62 0108 0000 0009 9999 999 id 123456782 and 123456789"
    assert [(k, text[a:b]) for k, a, b in Y.direct_values(text)] == [("email", "a.b@example.com"), ("phone", "050-1234567"), ("bank_identifier", "IL62 0108 0000 0009 9999 999"), ("israeli_id", "123456782")]


def test_registered(spark):
    Y.register(spark)
    assert spark.sql("SELECT nfc('e\u0301'), size(pii_spans('a@b.co'))").first()[:] == ("é", 1)
