"""Decision cascades and scores as native expressions: statuses from flags, measures and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The statuses, cut-offs and zones that results are compared by.
OCR_ALLOWED = ("redacted", "template_safe")
DARK_NONE, DARK_LITTLE = 0.0004, 0.002
UPSTREAM_REVIEW = "review_no_text_measurement"
UPSTREAM_FAILURES = ("fail_page_too_small", "fail_text_too_small")
ZONES = (("other_likely_pii", "party_header_zone", 0.0, 0.18), ("property_address", "property_address_zone", 0.18, 0.42), ("signature", "signature_zone", 0.72, 2.0))
RIGHT_EDGE, LABEL_WIDTH, DIGITS_WIDTH = 0.72, 0.38, 0.60
PAD_X, PAD_Y, LEAST_PAD_X, LEAST_PAD_Y = 1.25, 0.30, 4, 2
LEAST_CONFIDENCE = 60
# End of the fixed values.


def privacy_status(manual_masks: Column, auto_masks: Column, handwriting: Column, template_safe: Column) -> Column:
    """A page's status from its flags: a mask outranks handwriting, which outranks a safe template."""
    return F.when(manual_masks | auto_masks, "redacted").when(handwriting, "needs_redaction").when(template_safe, "template_safe").otherwise("uncertain")


def ocr_allowed(status: Column) -> Column:
    return status.isin(*OCR_ALLOWED)


def handwriting_status(dark_ratio: Column, suspicious_regions: Column) -> Column:
    """From the share of dark pixels and the number of suspicious regions; an unread page (null) is uncertain."""
    return (
        F.when(dark_ratio.isNull(), "uncertain")
        .when(dark_ratio < DARK_NONE, "no_handwriting_detected")
        .when(suspicious_regions > 0, "handwriting_detected")
        .when(dark_ratio < DARK_LITTLE, "uncertain")
        .otherwise("no_handwriting_detected")
    )


def composed_status(own: Column, reasons: Column, upstream: Column) -> tuple[Column, Column]:
    """(status, sorted reasons) of a line or page under the state of the page it was cut from."""
    review, failed = upstream == UPSTREAM_REVIEW, upstream.isin(*UPSTREAM_FAILURES)
    status = F.when(failed | (own == "reject"), "reject").when(review, "review").otherwise(own)
    status = F.when(failed | review, status).otherwise(own)
    added = F.array_compact(F.array(F.when(review, F.lit("upstream_resolution_review")), F.when(failed, F.lit("upstream_resolution_failure"))))
    return status, F.array_sort(F.array_union(reasons, added))


def resolution_status(width: Column, height: Column, band: Column, least_side: int, least_band: float) -> Column:
    return F.when(F.greatest(width, height) < least_side, "fail_page_too_small").when(band.isNull(), UPSTREAM_REVIEW).when(band < least_band, "fail_text_too_small").otherwise("pass")


def fraction_class(fraction: Column, positive_from: float, negative_to: float) -> Column:
    """positive, negative, or null in the band between."""
    return F.when(fraction >= positive_from, "positive").when(fraction <= negative_to, "negative")


def layout_class(box: Column, width: Column, height: Column, digits: Column) -> tuple[Column, Column]:
    """(class, reason) that a line's place and shape suggest; nulls for none. box: left, top, right, bottom."""
    middle = (box["top"] + box["bottom"]) / 2.0 / height
    wide = box["right"] - box["left"]
    rules = [((middle >= a) & (middle < b), name, reason) for name, reason, a, b in ZONES]
    rules += [
        ((box["right"] >= F.floor(width * RIGHT_EDGE)) & (wide <= F.floor(width * LABEL_WIDTH)), "other_likely_pii", "right_label_shape"),
        ((wide <= F.floor(width * DIGITS_WIDTH)) & digits, "other_likely_pii", "digit_pattern"),
    ]
    return F.coalesce(*(F.when(c, F.lit(n)) for c, n, _ in rules)), F.coalesce(*(F.when(c, F.lit(r)) for c, _, r in rules))


def padded_box(box: Column, width: Column, height: Column) -> Column:
    """A line's box grown by shares of its height, within the page."""
    tall = box["bottom"] - box["top"]
    x = F.greatest(F.lit(LEAST_PAD_X), F.bround(tall * PAD_X).cast("int"))
    y = F.greatest(F.lit(LEAST_PAD_Y), F.bround(tall * PAD_Y).cast("int"))
    return F.struct(
        F.greatest(F.lit(0), box["left"] - x).alias("left"), F.greatest(F.lit(0), box["top"] - y).alias("top"), F.least(width, box["right"] + x).alias("right"), F.least(height, box["bottom"] + y).alias("bottom")
    )


def word_box_reasons(words: Column, mean_confidence: Column) -> Column:
    """Why a page's word boxes (arrays of structs with text) cannot be masked by: an empty array means that they can."""
    mixed = F.exists(words, lambda w: w["text"].rlike(r"(?U)\s"))
    return F.array_compact(
        F.array(F.when(F.size(words) == 0, F.lit("no_word_boxes")), F.when(mean_confidence < LEAST_CONFIDENCE, F.lit("mean_confidence_below_threshold")), F.when(mixed, F.lit("ambiguous_word_boxes")))
    )


def usefulness_score(anchors: Column, money: Column, native: Column, latin: Column, confidence: Column, short_latin: Column, latin_tokens: Column) -> Column:
    """A recognition's worth, 0 at least, rounded to 3 places; native and latin are letter counts."""
    letters = F.greatest(F.lit(1), native + latin)
    share, other = latin / letters, native / letters
    noise = (
        F.when(share > 0.25, (share - 0.25) * 10).otherwise(F.lit(0.0))
        + F.when(short_latin >= 5, F.least(short_latin / 3, F.lit(8.0))).otherwise(F.lit(0.0))
        + F.when((latin_tokens > 0) & (short_latin / F.greatest(F.lit(1), latin_tokens) > 0.6), F.lit(2.0)).otherwise(F.lit(0.0))
    )
    return F.round(F.greatest(F.lit(0.0), anchors * 3 + money * 2 + other * 10 + confidence * 5 - share * 8 - noise), 3)


def best_attempt(df: DataFrame, by: list[str], score: str, position: str, payload: list[str]) -> DataFrame:
    """Each group's attempt of the highest score, the first of equals."""
    return df.groupBy(*by).agg(F.max_by(F.struct(*payload), F.struct(F.col(score), -F.col(position))).alias("_best")).select(*by, "_best.*")


def assertion_scores(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Matches of assertions (case_id, question_id, mechanism_id or null, field, value, state, refs) for each case.

    Values, states and sets of references are compared by themselves; exact needs all three.
    """
    keys = ["case_id", "question_id", "mechanism_id", "field"]
    e = expected.select(*(F.col(k).alias(f"e_{k}") for k in keys), F.struct("value", "state", F.array_sort("refs").alias("refs")).alias("e"))
    a = actual.select(*(F.col(k).alias(f"a_{k}") for k in keys), F.struct("value", "state", F.array_sort("refs").alias("refs")).alias("a"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"e_{k}").eqNullSafe(F.col(f"a_{k}"))
    both = F.col("e").isNotNull() & F.col("a").isNotNull()
    same = {n: both & F.col(f"e.{n}").eqNullSafe(F.col(f"a.{n}")) for n in ("value", "state", "refs")}
    joined = e.join(a, on, "full_outer").withColumn("case_id", F.coalesce("e_case_id", "a_case_id"))
    return joined.groupBy("case_id").agg(
        F.count("e").alias("assertions_total"), F.count_if(same["value"] & same["state"] & same["refs"]).alias("assertions_exact"), F.count_if(same["value"]).alias("value_matches"),
        F.count_if(same["state"]).alias("state_matches"), F.count_if(same["refs"]).alias("refs_matches"), F.count_if(F.col("e").isNull()).alias("unexpected"),
    )


def cache_ledger(pages: DataFrame, cache: DataFrame, key: str, payload: str) -> DataFrame:
    """Pages with what a cache holds for their key, and hit or miss."""
    held = cache.select(key, payload, F.lit(True).alias("_hit"))
    return pages.join(held, key, "left").withColumn("cache", F.when(F.col("_hit"), "hit").otherwise("miss")).drop("_hit")


def routed_blocks(items: DataFrame, labels: list[str]) -> DataFrame:
    """Violations of routed blocks (case_id, block_id, families): form, closed labels, an exclusion that stands alone, repeated blocks."""
    from folioscope.operators.rules import Rule, all_of, violations

    keyed = items.withColumn("key", F.concat_ws("/", "case_id", "block_id"))
    rules = [
        Rule("block_id", ~F.coalesce(F.col("block_id").rlike(r"^B\d{2}$"), F.lit(False))),
        Rule("no_family", F.coalesce(F.size("families") == 0, F.lit(True))),
        Rule("repeated_family", F.size(F.array_distinct("families")) != F.size("families")),
        Rule("unknown_family", F.size(F.array_except("families", F.array(*map(F.lit, [*labels, "EXCLUDED"])))) > 0),
        Rule("mixed_exclusion", F.array_contains("families", "EXCLUDED") & (F.size("families") > 1)),
    ]
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("repeated_block").alias("rule"), "key", F.col("n").cast("string").alias("message"))
    return all_of(violations(keyed, "key", rules), many)


def guarded_request(request_id: Column, content: Column, most_bytes: int) -> Column:
    """Why a posted page is refused (null: it is not): its id, its size, or bytes that are no PNG."""
    return (
        F.when(~F.coalesce(request_id.rlike(r"^[A-Za-z0-9_-]{1,64}$"), F.lit(False)), "request_id")
        .when(F.octet_length(content) > most_bytes, "too_large")
        .when(F.coalesce(F.hex(F.substring(content, 1, 8)) != "89504E470D0A1A0A", F.lit(True)), "not_png")
    )


def hidden_expectations(cases: Column) -> Column:
    """Assertions without what is expected of them."""
    return F.transform(cases, lambda a: a.dropFields("expected", "state", "refs"))
