"""Evidence: claims that cite blocks are kept, rewritten, downgraded or dropped by what the blocks say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.scalars import numbers_supported, quote_exists
from folioscope.operators.joins import resolve_references


#: Sections of an answer in the order in which their warnings are told: (failure, whether numbers must be strictly supported or not at all).
SECTIONS = {"risks": ("drop", False), "clauses": ("downgrade", None), "financial_hints": ("drop", True), "unclear_fragments": ("drop", None)}


def judged_claims(claims: DataFrame, blocks: DataFrame, documents: DataFrame, on_failure: str = "drop", strict: bool | None = False) -> DataFrame:
    """Claims (doc_id, claim_id, claim, quote, page, confidence, evidence_block_ids) with action, reason, quote and page.

    documents: (doc_id, text, pages). Cited blocks must exist and hold the claim's numbers; a claim without blocks stands by a quote
    that the document has, on a page that it has (any page where it has none). ``on_failure``: drop, or downgrade to level unclear and confidence 0.3 at
    most. ``strict``: whether a source without numbers supports none; None, and a downgrade, leave numbers alone. A claim's ``level``, if it has one, is kept.
    """
    placed = blocks.select("doc_id", "block_id", F.struct("text", "page").alias("_block"))
    cited = resolve_references(claims, placed, "claim_id", "evidence_block_ids", "block_id", "_block", ["doc_id"])
    joined = cited.join(documents.select("doc_id", F.col("text").alias("_text"), F.col("pages").alias("_pages")), "doc_id", "left")
    none = F.coalesce(F.size("evidence_block_ids") == 0, F.lit(True))
    source = F.array_join(F.transform("resolved", lambda b: b["text"]), "\n\n")
    pages = F.array_distinct(F.array_compact(F.transform("resolved", lambda b: b["page"])))
    on_page = F.col("page").isNull() | F.coalesce(F.size("_pages") < 1, F.lit(True)) | F.array_contains("_pages", F.col("page"))
    quoted = F.coalesce(quote_exists(F.col("quote"), F.col("_text")) & on_page, F.lit(False))
    downgrade = on_failure == "downgrade"
    backed = F.lit(True) if downgrade or strict is None else numbers_supported(F.when(none, F.col("quote")).otherwise(source), F.col("claim"), strict)
    reason = (
        F.when(~none & (F.size("invalid") > 0), "invalid_block")
        .when(none & ~quoted, "missing_evidence")
        .when(~backed, "numbers_not_supported")
        .when(none, "quote_fallback")
    )
    bad = F.coalesce(reason.isin("invalid_block", "missing_evidence", "numbers_not_supported"), F.lit(False))
    out = joined.withColumns({"reason": reason, "_bad": bad, "_source": source, "_one": pages})
    return out.select(
        "doc_id",
        "claim_id",
        "claim",
        F.when(F.col("_bad"), "downgrade" if downgrade else "drop").otherwise("keep").alias("action"),
        "reason",
        F.when(~F.col("_bad") & ~none, F.col("_source")).otherwise(F.col("quote")).alias("quote"),
        F.when(~F.col("_bad") & ~none, F.when(F.size("_one") == 1, F.get("_one", F.lit(0)))).otherwise(F.col("page")).alias("page"),
        F.when(F.col("_bad") & F.lit(downgrade), F.least(F.col("confidence"), F.lit(0.3))).otherwise(F.col("confidence")).alias("confidence"),
        *([F.when(F.col("_bad") & F.lit(downgrade), "unclear").otherwise(F.col("level")).alias("level")] if "level" in claims.columns else []),
    )


def judged_answer(claims: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims of all sections (section, position, level beside the columns of :func:`judged_claims`), each by its section's rules.

    warning: the place of the claim's reason among its document's, section by section in their order; null for a claim without one.
    """
    order = F.create_map(*(x for k, s in enumerate(SECTIONS) for x in (F.lit(s), F.lit(k))))
    parts = []
    for section, (on_failure, strict) in SECTIONS.items():
        own = claims.filter(F.col("section") == section)
        judged = judged_claims(own, blocks, documents, on_failure, strict)
        parts.append(judged.join(own.select("doc_id", "claim_id", "section", "position"), ["doc_id", "claim_id"]))
    told = reduce(DataFrame.unionByName, parts)
    place = F.row_number().over(Window.partitionBy("doc_id", F.col("reason").isNull()).orderBy(order[F.col("section")], "position", "claim_id"))
    return told.withColumn("warning", F.when(F.col("reason").isNotNull(), place))


def dispositions(candidates: DataFrame) -> DataFrame:
    """Adds disposition: no evidence preserves; valid evidence of which some is strong, and all of that has the candidate's geometry, masks; all else is reviewed.

    Strong evidence without a geometry has another one; so has any where the candidate has none.
    """
    strong = F.filter("evidence", lambda e: e["strength"] == "strong")
    alike = F.forall(strong, lambda e: F.coalesce(e["geometry"] == F.col("geometry"), F.lit(False)))
    valid = F.forall("evidence", lambda e: F.coalesce(e["valid"], F.lit(False)))
    none = F.coalesce(F.size("evidence") < 1, F.lit(True))
    return candidates.withColumn("disposition", F.when(none, "preserve").when((F.size(strong) > 0) & alike & valid, "auto_mask").otherwise("local_review"))
