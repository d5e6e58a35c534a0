"""Review packs, charset contracts and results as text with metadata."""

import json

from folioscope.operators import contracts
from folioscope.operators.datasets import charset_contract_problems
from folioscope.sources.readers import markdown_results

PREDICTIONS = "image_id string, image_sha256 string, width int, height int, candidates array<string>"
RENDERERS = "image_id string, source_image_sha256 string, width int, height int, mask_count int, masked_pixel_count long"
LINES = "page_id string, line_id string, `order` int, source_master_sha256 string"


def problems(spark, predictions, renderers, lines):
    tables = (spark.createDataFrame(rows, shape) for rows, shape in ((predictions, PREDICTIONS), (renderers, RENDERERS), (lines, LINES)))
    return sorted((r.subject, r.problem) for r in contracts.review_pack_problems(*tables).collect())


def test_sound_pack(spark):
    assert problems(spark, [("a", "h", 4, 5, ["c1", "c2"]), ("b", "k", 1, 1, [])], [("a", "h", 4, 5, 2, 20), ("b", "k", 1, 1, 0, 0)], [("a", "l2", 2, "h"), ("a", "l1", 1, "h")]) == []
    assert problems(spark, [], [], []) == []


def test_each_binding(spark):
    base, image = ("a", "h", 4, 5, ["c1"]), ("a", "h", 4, 5, 1, 3)
    assert problems(spark, [base], [], []) == [("a", "no_renderer")]
    assert problems(spark, [], [image], [("a", "l", 1, "h")]) == [("a", "no_prediction"), ("a", "unknown_page")]
    assert problems(spark, [base], [("a", None, 4, 5, 1, 3)], []) == [("a", "source_hash")]
    assert problems(spark, [base], [("a", "h", 5, 5, 1, 3)], []) == [("a", "size")]
    assert problems(spark, [base], [("a", "h", 4, 5, 2, 21)], []) == [("a", "mask_count"), ("a", "masked_pixels")]
    assert problems(spark, [base], [("a", "h", 4, 5, 1, None)], []) == [("a", "masked_pixels")]
    for orders in ([2], [1, 3], [1, 1], [0, 1], [1, None]):
        assert problems(spark, [base], [image], [("a", f"l{k}", n, "h") for k, n in enumerate(orders)]) == [("a", "line_order")]
    assert problems(spark, [base], [image], [("a", "l1", 1, "h"), ("a", "l2", 2, "x")]) == [("a", "line_hash")]
    assert problems(spark, [base], [image], [("a", "l1", 1, "h"), ("a", "l2", 2, None)]) == [("a", "line_hash")]
    assert problems(spark, [base, base], [image], []) == [("a", "repeated_image"), ("c1", "repeated_candidate")]
    assert problems(spark, [base], [image], [("a", "l", 1, "h"), ("a", "l", 2, "h")]) == [("l", "repeated_line")]


def test_charset_contract():
    good = {"schema_version": 1, "ctc_blank_id": 0, "characters": [" ", "a"]}
    assert charset_contract_problems(good) == []
    assert charset_contract_problems([]) == ["not an object"]
    assert charset_contract_problems(good | {"schema_version": 2, "ctc_blank_id": 1}) == ["another schema version", "the blank is not 0"]
    assert charset_contract_problems(good | {"characters": [1]}) == ["the characters are no list of texts"]
    assert charset_contract_problems(good | {"characters": ["a", " "]}) == ["the first character is not a space"]


def test_markdown_results(spark, tmp_path):
    def put(stem, text=None, meta=None):
        (tmp_path / stem).mkdir()
        if text is not None:
            (tmp_path / stem / f"{stem}.md").write_text(text, encoding="utf-8")
        if meta is not None:
            (tmp_path / stem / f"{stem}_metadata.json").write_text(json.dumps(meta), encoding="utf-8")

    put("one", "\n # Title\nline \n", {"num_pages": 1, "pages": [{"n": 7}], "total_token_count": 12, "total_chunks": 3})
    put("two", "x", {"num_pages": 2})
    put("text", "x")
    put("meta", None, {"num_pages": 1})
    put("blank", "", {"num_pages": 1, "pages": []})
    put("bytes", "", {"num_pages": 1})
    (tmp_path / "bytes" / "bytes.md").write_bytes(b"a\xff")
    found = {r.document_id: r for r in markdown_results(spark, str(tmp_path)).collect()}
    one = found["one"]
    assert (one.page_number, one.text, json.loads(one.page), one.token_count, one.chunk_count, one["_bad"]) == (1, "# Title\nline", {"n": 7}, 12, 3, None)
    assert {k: r["_bad"] for k, r in found.items()} == {"one": None, "two": "not one page", "text": "no metadata", "meta": "no text", "blank": "no text", "bytes": "not UTF-8"}
    assert found["blank"].text is None and found["blank"].page is None
