"""Pages, paragraphs, lines and their stable numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.profiles import LEASE_HE, Profile

#: Fixed value: what a numbered line starts with.
NUMBERED = r"^\s*(?:\d+|[\u0590-\u05FF])[.)-]\s+"


def page_sections(text: Column, profile: Profile = LEASE_HE) -> Column:
    """Sections between page headers as (page, text), in order; without a header one section of page 1; blank ones go."""
    pattern = profile.page_header
    numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    bodies = F.split(text, pattern)
    pages = F.transform(bodies, lambda b, i: F.struct(F.when(i == 0, F.lit(1)).otherwise(F.get(numbers, i - 1).cast("int")).alias("page"), b.alias("text")))
    return F.filter(pages, lambda s: s["text"].rlike(r"\S"))


def paragraphs(text: Column) -> Column:
    """Blank-line paragraphs; one with two or more numbered lines falls into its lines. Trimmed, blank ones go."""
    plain = F.regexp_replace(text, "\r\n?", "\n")
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    def lines(p: Column) -> Column:
        return F.filter(F.transform(F.split(p, "\n"), trimmed), lambda x: x != "")

    def parts(p: Column) -> Column:
        return F.when(F.size(F.filter(lines(p), lambda x: x.rlike(NUMBERED))) >= 2, lines(p)).otherwise(F.array(trimmed(p)))

    kept = F.filter(F.split(plain, r"\n\s*\n+"), lambda p: p.rlike(r"\S"))
    return F.flatten(F.transform(kept, parts))


def evidence_blocks(df: DataFrame, key: str = "doc_id", text: str = "text", profile: Profile = LEASE_HE) -> DataFrame:
    """(key, block_id, page, index, text): blocks numbered within their page, on where a page's header comes again."""
    found = df.select(key, F.posexplode(page_sections(F.coalesce(F.col(text), F.lit("")), profile)).alias("_section", "_s"))
    each = found.select(key, F.col("_s.page").alias("page"), "_section", F.posexplode(paragraphs(F.col("_s.text"))).alias("_pos", "text"))
    w = Window.partitionBy(key, "page").orderBy("_section", "_pos")
    numbered = each.withColumn("index", F.row_number().over(w))
    return numbered.select(key, F.format_string("P%d-B%02d", "page", "index").alias("block_id"), "page", "index", "text")


def line_blocks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block_id, index, length): lines that are not blank, numbered within their document."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).filter(F.trim("line") != "")
    w = Window.partitionBy(key).orderBy("pos")
    return lines.withColumn("index", F.row_number().over(w)).select(key, F.format_string("P1-B%02d", "index").alias("block_id"), "index", F.char_length(F.trim("line")).alias("length"))


def sections_by_header(df: DataFrame, key: str, position: str, line: str, header: str) -> DataFrame:
    """Lines with the header above them; lines before the first header go."""
    w = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = df.withColumn("header", F.last(F.when(F.col(line).rlike(header), F.col(line)), ignorenulls=True).over(w))
    return marked.filter(F.col("header").isNotNull() & ~F.col(line).rlike(header))


def token_windows(tokens: Column, n: int) -> Column:
    """Runs of n - 1, n and n + 1 tokens, joined by a space."""
    def of(tokens: Column, k: int) -> Column:
        starts = F.when(F.size(tokens) >= k, F.sequence(F.lit(1), F.size(tokens) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, k), " "))

    # the tokens are made once for each row, not once for each window
    return F.element_at(F.transform(F.array(tokens), lambda t: F.flatten(F.array(*(of(t, k) for k in (n - 1, n, n + 1) if k > 0)))), 1)
