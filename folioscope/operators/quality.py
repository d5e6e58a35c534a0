"""Usability and quality gates over texts; all native but the fuzzy markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.profiles import CAUTIONS, LEASE_HE, TOPICS, Profile


def characters_in(text: Column, members: str) -> Column:
    """How many characters are in a class: what is left without runs of others, which is cheaper than an array of matches."""
    return F.char_length(F.regexp_replace(text, f"[^{members}]+", ""))


def solid(text: Column) -> Column:
    """A text without white space; byte-wise replacements are cheaper than a pattern with a match for each word."""
    for white in " \t\n\x0b\f\r":
        text = F.replace(text, F.lit(white), F.lit(""))
    return text


def letters(text: Column, profile: Profile) -> Column:
    return characters_in(solid(text), profile.letters)


def clause_count(text: Column, profile: Profile) -> Column:
    """Parts between blank lines, numbered lines and sentence ends that have enough letters."""
    parts = F.split(text, r"\n\s*\n|\n\s*(?:\d+|[א-ת])?[.)-]?\s+|[.;]\s+")
    return F.size(F.filter(parts, lambda p: p.rlike(f"(?:[{profile.letters}][^{profile.letters}]*+){{{profile.clause_letters}}}")))


def garbage_ratio(text: Column, profile: Profile) -> Column:
    """1 less the useful characters over those that are no white space, 0 at least; 1 for a blank text.

    White space counts as useful, so the ratio is biased low; this is kept, since results are compared by it.
    """
    whole = F.char_length(solid(text))
    useful = characters_in(text, profile.useful)
    return F.when(whole == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - useful / whole))


def usability(df: DataFrame, profile: Profile = LEASE_HE, text: str = "text") -> DataFrame:
    """Adds letters, indicators, clauses, garbage, pages, problems, usable and completeness."""
    df = df.withColumn("_stripped", F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r")))
    stripped = F.col("_stripped")
    indicators = F.lit(0)
    for word in profile.indicators:
        indicators = indicators + F.contains(stripped, F.lit(word)).cast("int")
    measured = df.withColumns(
        {
            "letters": letters(stripped, profile), "indicators": indicators, "clauses": clause_count(stripped, profile), "garbage": garbage_ratio(stripped, profile),
            "pages": F.regexp_count(stripped, F.lit(profile.page_header)), "_length": F.char_length(stripped),
        }
    )
    rules = [
        ("few_letters", F.col("letters") < profile.min_letters),
        ("few_indicators", F.col("indicators") < profile.min_indicators),
        ("few_clauses", F.col("clauses") < profile.min_clauses),
        ("garbage", F.col("garbage") > profile.max_garbage),
        ("many_pages", F.col("pages") > profile.max_pages),
        ("short", F.col("_length") < profile.min_length),
    ]
    problems = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))
    judged = measured.withColumn("problems", problems).withColumn("usable", F.size("problems") == 0)
    high, medium = profile.high, profile.medium
    level = (
        F.when(F.col("usable") & (F.col("letters") >= high[0]) & (F.col("clauses") >= high[1]) & (F.col("indicators") >= high[2]), "high")
        .when(F.col("usable") & (F.col("letters") >= medium[0]) & (F.col("clauses") >= medium[1]), "medium")
        .otherwise("low")
    )
    return judged.withColumn("completeness", level).drop("_length", "_stripped")


def single_character_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.char_length(F.trim(x)) == 1))


def suspicious_jumps(text: Column) -> Column:
    """Whether clause numbers at line starts (four at least) go up by more than 3 somewhere."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(\d{1,2})[.)]"), F.lit(1)), lambda n: n.cast("int"))
    jumps = F.exists(F.zip_with(F.slice(numbers, 1, F.greatest(F.size(numbers) - 1, F.lit(0))), F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0))), lambda a, b: b > a + 3), lambda x: x)
    return (F.size(numbers) >= 4) & jumps


def garbage_signals(text: Column, profile: Profile, marker_hits: Column, expected_pages: Column | None = None) -> Column:
    """Names of the signs of a bad recognition that a text shows."""
    n, total = letters(text, profile), F.char_length(text)
    ratio = F.round(n / F.greatest(total, F.lit(1)), 4)
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    single = single_character_lines(text)
    rules = [
        ("very_low_hebrew_char_count", n < 80),
        ("low_hebrew_ratio", (total >= 120) & (ratio < 0.45)),
        ("many_isolated_latin_tokens", F.regexp_count(text, F.lit(r"(?U)\b[A-Za-z]\b")) >= 6),
        ("many_single_character_lines", (single >= 5) | ((lines > 0) & (single / F.greatest(lines, F.lit(1)) >= 0.35))),
        ("replacement_or_unknown_characters", F.regexp_count(text, F.lit("[�□]")) >= 2),
        ("too_few_lease_markers", marker_hits < 2),
    ]
    if expected_pages is not None:
        rules.append(("too_short_for_expected_pages", (expected_pages > 0) & (n < F.greatest(F.lit(80), expected_pages * 70))))
    rules.append(("suspicious_clause_number_jumps", suspicious_jumps(text)))
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))


def quality_score(text: Column, profile: Profile, marker_hits: Column, signals: Column) -> Column:
    """0 to 100: letters and markers help, signals hurt."""
    n = letters(text, profile)
    ratio = F.round(n / F.greatest(F.char_length(text), F.lit(1)), 4)
    dense = F.when(ratio >= 0.70, 20).when(ratio >= 0.50, 10).when(ratio < 0.30, -15).otherwise(0)
    score = F.least(F.lit(35), F.floor(n / 15)) + F.least(F.lit(40), marker_hits * 6) + dense - F.least(F.lit(35), F.size(signals) * 7)
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def quality_status(text: Column, profile: Profile, marker_hits: Column, signals: Column, score: Column) -> Column:
    n, total = letters(text, profile), F.char_length(text)
    ratio = F.round(n / F.greatest(total, F.lit(1)), 4)
    severe = F.arrays_overlap(signals, F.array(*map(F.lit, ("very_low_hebrew_char_count", "low_hebrew_ratio", "too_short_for_expected_pages"))))
    return (
        F.when((total == 0) | (n < 40) | ((ratio < 0.25) & (total >= 120)) | (marker_hits == 0) | (severe & (score < 55)), "poor")
        .when((score >= 70) & (marker_hits >= 4) & (F.size(signals) == 0), "good")
        .otherwise("warning")
    )


def topics(df: DataFrame, text: str = "text", required: dict[str, tuple[str, ...]] = TOPICS, cautions: dict[str, tuple[str, ...]] = CAUTIONS) -> DataFrame:
    """Adds missing topics, cautions and a risk level: High from two cautions or three missing topics on."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))

    def any_of(terms: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for term in terms:
            found = found | F.contains(low, F.lit(term))
        return found

    missing = F.array_compact(F.array(*(F.when(~any_of(t), F.lit(n)) for n, t in required.items())))
    caution = F.array_compact(F.array(*(F.when(any_of(t), F.lit(n)) for n, t in cautions.items())))
    level = F.when((F.size("cautions") >= 2) | (F.size("missing") >= 3), "High").when((F.size("cautions") >= 1) | (F.size("missing") >= 1), "Medium").otherwise("Low")
    return df.withColumns({"missing": missing, "cautions": caution}).withColumn("risk_level", level)


def document_class(text: Column, anchors: tuple[str, ...], least_signals: int = 2) -> Column:
    """Whether a text has enough of the signals that make it a document of a class."""
    hits = F.lit(0)
    for pattern in anchors:
        hits = hits + text.rlike(pattern).cast("int")
    return hits >= least_signals
