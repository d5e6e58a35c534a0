"""Gates over recognised pages and documents: usable text, confidence, geometry, benchmark verdicts, and what reports say of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters that recognised text and a page's text layer must have, and levels that suffice.
USABLE_LETTERS = 80
TEXT_LAYER_CHARACTERS, TEXT_LAYER_LETTERS = 200, 50
SUFFICIENT = ("good", "medium")
STATUS_ORDER = ("good", "warning", "poor")
# Lines of recognised text that are not its content, and what stands for masked parts.
SCAFFOLD = (
    r"(?i)^\s*---\s*(?:PAGE\s+\d+|OCR SOURCE|OCR MODE|IMAGE PAGES PREPARED)\b.*---\s*$",
    r"(?i)^\s*[\w .\-()]+\.(?:png|jpe?g|webp|heic|pdf)\s*$",
)
MASK = r"(?i)\[(?:MASKED|REDACTED)\]"
# Points of a category score.
BODY_LENGTH, NUMERIC_POINTS, DIGIT_POINTS, DOT_POINTS = 120, 2.0, 0.08, 0.1
# End of the fixed values.


def text_usable(letters: Column, other_letters: Column, anchors: Column, least: int = USABLE_LETTERS) -> Column:
    """Whether recognised text will do: enough letters of its script, no more of another, and a known term."""
    return F.coalesce((letters >= least) & (other_letters <= letters) & (anchors >= 1), F.lit(False))


def quality_sufficient(usable: Column, level: Column, measured: Column) -> Column:
    """A measured usability decides; without one the level does; without quality at all nothing suffices."""
    return F.coalesce(measured, F.lit(False)) & F.coalesce(usable, F.coalesce(level, F.lit("failed")).isin(*SUFFICIENT))


def text_layer_problems(text: Column, letters: Column, pages: Column, characters: int = TEXT_LAYER_CHARACTERS, least: int = TEXT_LAYER_LETTERS) -> Column:
    """Why a page layer's text is none; empty for a text document."""
    size = F.char_length(F.trim(F.coalesce(text, F.lit(""))))
    return F.array_compact(F.array(F.when(F.coalesce(pages, F.lit(0)) <= 0, "no_pages"), F.when(size < characters, "too_short"), F.when(letters < least, "too_few_letters")))


def mean_confidence(confidences: Column) -> Column:
    """Mean of percentages as 0 to 1, to four places; missing ones do not count, and none at all give 0."""
    known = F.filter(confidences, lambda c: c.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda s, c: s + c) / F.size(known) / 100
    return F.when(F.size(known) > 0, F.round(F.greatest(F.lit(0.0), F.least(mean, F.lit(1.0))), 4)).otherwise(F.lit(0.0))


def attempt_grid(pages: DataFrame, variants: list[str], languages: list[str], configs: list[str]) -> DataFrame:
    """Each page with each attempt to read it, numbered in order; the grid is a constant of few rows."""
    grid = F.array(*(F.struct(F.lit(k).alias("attempt"), F.lit(v).alias("variant"), F.lit(g).alias("language"), F.lit(c).alias("config")) for k, (v, g, c) in enumerate(((v, g, c) for v in variants for g in languages for c in configs), 1)))
    return pages.select("*", F.inline(grid))


def content_lines(text: Column) -> Column:
    """The text that quality is measured on: without scaffold and blank lines, masks as spaces."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~reduce(lambda a, b: a | b, (x.rlike(p) for p in SCAFFOLD)))
    cleaned = F.transform(kept, lambda x: F.trim(F.regexp_replace(x, MASK, " ")))
    return F.trim(F.array_join(F.filter(cleaned, lambda x: x != ""), "\n"))


def document_quality(flat: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """A document's status and score with its pages': the least score; poor if a page is; a good document with a middling page is a warning.

    flat: (key, status, score); pages: the same for each page. A document without pages stays as it is.
    """
    worst = pages.groupBy(key).agg(F.min("score").alias("_score"), F.max(F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status"))).alias("_worst"))
    joined = flat.join(worst, key, "left")
    status = F.when(F.col("_worst") == 3, "poor").when((F.col("_worst") == 2) & (F.col("status") == "good"), "warning").otherwise(F.col("status"))
    return joined.select(key, status.alias("status"), F.least("score", F.coalesce("_score", "score")).alias("score"))


def valid_box(box: Column, frame: Column) -> Column:
    """Whether a box has an area and lies in a frame that has one; a missing side is invalid."""
    inside = (frame["left"] <= box["left"]) & (box["left"] < box["right"]) & (box["right"] <= frame["right"]) & (frame["top"] <= box["top"]) & (box["top"] < box["bottom"]) & (box["bottom"] <= frame["bottom"])
    return F.coalesce(inside & (frame["left"] < frame["right"]) & (frame["top"] < frame["bottom"]), F.lit(False))


def geometry_usability(blocks: DataFrame, by: list[str], page: str, pages: int | None = None) -> DataFrame:
    """Counts of pages and text blocks (text, box, frame) with usable boxes, and whether all are.

    A page has a frame if one of its rows has a valid one; blank text is no block. ``pages``: how many there must be.
    """
    text = F.coalesce(F.trim("text") != "", F.lit(False))
    framed = valid_box(F.col("frame"), F.col("frame"))
    good = text & framed & valid_box(F.col("box"), F.col("frame"))
    count = lambda c: F.sum(c.cast("long"))
    each = blocks.groupBy(*by, page).agg(F.max(framed).alias("f"), F.max(good).alias("g"), count(text).alias("t"), count(text & ~good).alias("b"))
    found = each.groupBy(*by).agg(F.count("*").alias("pages"), count(F.col("f")).alias("pages_with_frame"), count(F.col("g")).alias("pages_with_usable_text"), F.sum("t").alias("text_blocks"), F.sum("b").alias("invalid_text_blocks"))
    enough = F.col("pages") == pages if pages is not None else F.lit(True)
    all_good = enough & (F.col("pages_with_frame") == F.col("pages")) & (F.col("pages_with_usable_text") == F.col("pages")) & (F.col("text_blocks") > 0) & (F.col("invalid_text_blocks") == 0)
    return found.withColumn("passed", all_good)


def verdict(gates: dict[str, Column]) -> tuple[Column, Column]:
    """(PASS or BLOCK, the names of the gates that block, in order); an unknown gate blocks."""
    blocking = F.array_compact(F.array(*(F.when(~F.coalesce(g, F.lit(False)), n) for n, g in gates.items())))
    return F.when(F.size(blocking) == 0, "PASS").otherwise("BLOCK"), blocking


def document_text(pages: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each document's pages as one text for each column, in order, a missing page as an empty one; a document has as many pages as a reader can turn."""
    listed = pages.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *(F.coalesce(c, F.lit("")).alias(c) for c in columns)))).alias("_pages"))
    return listed.select(*by, *(F.array_join(F.col(f"_pages.{c}"), "\n").alias(c) for c in columns))


def preserved(expected: Column, observed: Column) -> Column:
    """Whether a value that must stay is in the page's text; both are normalised by the caller."""
    return F.coalesce(F.contains(observed, expected), F.lit(False))


def category_scores(text: Column, clause: str, mixed: str, punctuation: str, currency: str) -> dict[str, Column]:
    """Scores by which lines are picked for review: body, clause, numeric and mixed punctuation."""
    has_clause = text.rlike(clause)
    rest = F.regexp_replace(text, clause, "")
    digits = F.regexp_count(rest, F.lit("[0-9]"))
    numeric = (digits > 0) | rest.rlike(currency)
    marks = F.regexp_count(text, F.lit(punctuation))
    dots = F.regexp_count(text, F.lit(r"\."))
    return {
        "body": F.when(has_clause, F.lit(-1.0)).otherwise(F.least(F.char_length(text), F.lit(BODY_LENGTH)) / BODY_LENGTH),
        "clause": F.when(has_clause, F.lit(2.0)).otherwise(F.lit(-1.0)) + F.least(dots, F.lit(3)) * DOT_POINTS,
        "numeric": F.when(numeric, F.lit(NUMERIC_POINTS)).otherwise(F.lit(-1.0)) + F.least(digits, F.lit(8)) * DIGIT_POINTS,
        "mixed_punctuation": F.when(text.rlike(mixed), F.lit(3.0)).otherwise(F.lit(0.0)) + F.when(marks >= 3, F.lit(1.0)).otherwise(F.lit(-1.0)) + F.least(marks, F.lit(10)) * DIGIT_POINTS,
    }


def selection_score(status: Column, evidence: dict[str, tuple[float, Column]], clarity: Column, length: Column) -> Column:
    """How much a line is worth reviewing: its label's status, weighted evidence (missing is 0), clarity and length."""
    sums = reduce(lambda a, b: a + b, (F.lit(w) * F.coalesce(c, F.lit(0.0)) for w, c in evidence.values()))
    return F.round(F.when(status == "consensus_verified", 1.0).otherwise(0.7) + sums + 1.2 * clarity + 0.35 * F.least(length / 90.0, F.lit(1.0)), 6)


def top_k(df: DataFrame, by: list[str], score: str, ties: list[str], k: int = 3) -> DataFrame:
    """The best ``k`` rows of each group by descending score, then by ``ties``, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), *ties)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def zipped(left: DataFrame, right: DataFrame, position: str, ids: list[str]) -> DataFrame:
    """Rows of two tables paired by position; raises where their positions differ. ids: columns that must agree, as ``<id>_differs``."""
    first = left.select(*(F.col(c).alias(c if c == position else f"left_{c}") for c in left.columns), F.lit(True).alias("_l"))
    second = right.select(*(F.col(c).alias(c if c == position else f"right_{c}") for c in right.columns), F.lit(True).alias("_r"))
    both = first.join(second, position, "full_outer")
    lone = F.col("_l").isNull() | F.col("_r").isNull()
    checked = both.withColumn(position, F.when(lone, F.raise_error(F.concat(F.lit("unpaired position "), F.col(position).cast("string"))).cast(left.schema[position].dataType)).otherwise(F.col(position)))
    return checked.withColumns({f"{c}_differs": ~F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")) for c in ids}).drop("_l", "_r")


def look_back(lines: DataFrame, by: list[str], order: str, found: str, rows: int = 3) -> DataFrame:
    """Fills a line's missing ``found`` from the nearest of the ``rows`` lines before it that has one."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(-rows, -1)
    return lines.withColumn("looked_up", F.coalesce(found, F.last(found, ignorenulls=True).over(before)))


def between_markers(text: Column, start: str, ends: list[str]) -> Column:
    """The text behind the first ``start``, up to the first of the ends; null where the start is missing."""
    at = F.instr(text, start)
    body = F.substring(text, at + len(start), F.char_length(text))
    places = F.array_compact(F.array(*(F.nullif(F.instr(body, e), F.lit(0)) for e in ends)))
    cut = F.when(F.size(places) > 0, F.substring(body, F.lit(1), F.array_min(places) - 1)).otherwise(body)
    return F.when(at > 0, F.trim(cut))


def hints(signals: Column, status: Column, advice: list[tuple[list[str], str]], always: tuple[str, str]) -> Column:
    """What to do about a page: nothing if it is good; else the first line, one for each group of signals that it has, and the last."""
    lines = [F.lit(always[0]), *(F.when(F.arrays_overlap(signals, F.array(*map(F.lit, names))), F.lit(line)) for names, line in advice), F.lit(always[1])]
    return F.when(status == "good", "").otherwise(F.concat_ws(" ", *lines))


def without_columns(df: DataFrame, nulls: list[str], empty: list[str]) -> DataFrame:
    """Parts of a report that no gate backs yet: fields to null, lists to empty ones."""
    kind = {c: df.schema[c].dataType for c in (*nulls, *empty)}
    return df.withColumns({c: F.lit(None).cast(kind[c]) for c in nulls} | {c: F.array().cast(kind[c]) for c in empty})


def report_summary(items: DataFrame, by: list[str], level: str, levels: list[str], confidence: str) -> DataFrame:
    """Counts of a report's items by level, their least confidence, and the highest level that occurs (levels go up)."""
    place = F.array_position(F.array(*map(F.lit, levels)), F.col(level))
    counts = [F.count_if(F.col(level) == n).alias(n) for n in levels]
    found = items.groupBy(*by).agg(F.count("*").alias("items"), *counts, F.min(confidence).alias("least_confidence"), F.max(place).alias("_top"))
    return found.withColumn("highest", F.get(F.array(*map(F.lit, levels)), (F.col("_top") - 1).cast("int"))).drop("_top")
