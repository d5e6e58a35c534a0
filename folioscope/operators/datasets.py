"""Training and test sets: exclusions against gold, unified splits, ids, summaries, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.scalars import hash_fraction, sample_id, sha256
from folioscope.operators.joins import without_known
from folioscope.operators.ordered import unified_splits

KEYS = ["data_tier", "source_dataset", "source_id"]


def source_records(rows: DataFrame, tier: str, dataset: str, validation_fraction: float = 0.1) -> DataFrame:
    """Rows (source_id, text, image_sha256, and perhaps split) as records of a tier with hashes and a proposed split.

    A split of a synthetic row stands if it is train or validation; else the text's hash decides.
    """
    drawn = F.when(hash_fraction(F.col("text")) < validation_fraction, "validation").otherwise("train")
    asked = F.when(F.col("split").isin("train", "validation"), F.col("split")) if tier == "synthetic" and "split" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        F.lit(tier).alias("data_tier"), F.lit(dataset).alias("source_dataset"), F.col("source_id").cast("string").alias("source_id"), "text", "image_sha256", sha256(F.col("text")).alias("text_sha256"), F.coalesce(asked, drawn).alias("proposed_split")
    )


def without_gold(records: DataFrame, gold: DataFrame) -> DataFrame:
    """Records with the reasons that keep them out: an image or text of gold, or (silver only) the source of a gold row."""
    silver = records.withColumn("_silver_id", F.when(F.col("data_tier") == "silver", F.col("source_id")))
    sources = gold.select(F.col("source_crop").cast("string").alias("_silver_id"))
    found = without_known(silver, {"image_sha256": ("image_sha256", gold), "text_sha256": ("text_sha256", gold), "source_id": ("_silver_id", sources)})
    return found.drop("_silver_id")


def training_dataset(records: DataFrame, gold: DataFrame, dataset_id: str) -> tuple[DataFrame, DataFrame]:
    """(manifest rows, exclusions). Equal texts share a split; ids follow from tier, source and text."""
    judged = without_gold(records, gold)
    exclusions = judged.filter(F.size("reasons") > 0).select(*KEYS, "image_sha256", "text_sha256", "reasons")
    unified = unified_splits(judged.filter(F.size("reasons") == 0), "text_sha256", "proposed_split")
    key = F.concat_ws("\0", *KEYS, "text")
    rows = unified.select(
        F.lit(1).alias("schema_version"), F.lit(dataset_id).alias("dataset_id"), sample_id(F.col("data_tier"), key).alias("sample_id"), "text", *KEYS, F.col("final_split").alias("split"),
        (F.col("proposed_split") != F.col("final_split")).alias("reassigned"), "image_sha256", "text_sha256",
    )
    return rows, exclusions


def gold_dataset(reviews: DataFrame, dataset_id: str) -> DataFrame:
    """Approved and corrected review rows as test rows."""
    kept = reviews.filter(F.col("review_status").isin("approved", "corrected"))
    return kept.select(F.lit(dataset_id).alias("dataset_id"), "gold_id", "text", F.lit("gold").alias("data_tier"), F.lit("test").alias("split"), F.col("review_status").alias("label_status"), sha256(F.col("text")).alias("text_sha256"), "image_sha256", "source_crop")


def summary(rows: DataFrame) -> DataFrame:
    """(kind, name, n): rows by tier, split and source, reassignments, and distinct characters."""
    counted = [rows.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(c).alias("kind"), "name", "n") for c in ("data_tier", "split", "source_dataset")]
    moved = rows.agg(F.count_if("reassigned").alias("n")).select(F.lit("reassigned").alias("kind"), F.lit("rows").alias("name"), "n")
    letters = rows.select(F.explode(F.split("text", "")).alias("c")).filter("c <> ''").distinct().agg(F.count("*").alias("n")).select(F.lit("characters").alias("kind"), F.lit("distinct").alias("name"), "n")
    out = moved.unionByName(letters)
    for c in counted:
        out = out.unionByName(c)
    return out


def leakage(training: DataFrame, gold: DataFrame, position: str | None = None) -> DataFrame:
    """(gold_id, kind, sample_id): training rows of the same image or text; of several the last by ``position`` (without one: the greatest sample id)."""
    found = []
    for c in ("image_sha256", "text_sha256"):
        held = training.filter(F.col(c).isNotNull()).groupBy(c).agg(F.max_by("sample_id", F.struct(position, "sample_id") if position else F.col("sample_id")).alias("sample_id"))
        found.append(gold.join(held, c).select("gold_id", F.lit(c).alias("kind"), "sample_id"))
    return found[0].unionByName(found[1])


def class_ids(text: Column, charset: list[str]) -> Column:
    """A text as ids of its characters (the first has id 1; 0 is the blank); null for a character that the set lacks."""
    if any(len(c) != 1 for c in charset) or len(set(charset)) < len(charset):
        raise ValueError("a character set has single characters, each once")
    known = F.lit("".join(charset))
    each = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.nullif(F.position(c, known), F.lit(0)))
    return F.when(F.exists(each, lambda x: x.isNull()), None).otherwise(each)


def charset_problems(characters: list[str]) -> list[str]:
    """Why a list of characters is no charset: empty, repeated, longer than a character, not composed, a direction mark, or no leading space."""
    import unicodedata

    found = []
    if not characters or characters[0] != " ":
        found.append("the first character is not a space")
    if len(set(characters)) != len(characters):
        found.append("a character is repeated")
    if any(len(c) != 1 for c in characters):
        found.append("an entry is not one character")
    if any(unicodedata.normalize("NFC", c) != c for c in characters):
        found.append("a character is not composed")
    if any(unicodedata.bidirectional(c[:1] or " ") in {"LRE", "RLE", "LRO", "RLO", "PDF", "LRI", "RLI", "FSI", "PDI"} or c in ("‎", "‏", "؜") for c in characters):
        found.append("a direction mark")
    return found


def charset_contract_problems(payload, version: int = 1) -> list[str]:
    """Why a charset's JSON value breaks its contract: the list's own problems, the schema version and the places of blank and space."""
    if not isinstance(payload, dict):
        return ["not an object"]
    characters = payload.get("characters")
    if not isinstance(characters, list) or any(not isinstance(c, str) for c in characters):
        found = ["the characters are no list of texts"]
    else:
        found = charset_problems(characters)
    if payload.get("schema_version") != version:
        found.append("another schema version")
    if payload.get("ctc_blank_id") != 0:
        found.append("the blank is not 0")
    return found


def merged_row_boxes(boxes: Column) -> Column:
    """Boxes by top and left, each merged into the last one kept where the two touch; a fold, not islands."""
    kind = "array<struct<top:int,left:int,bottom:int,right:int>>"
    ordered = F.array_sort(boxes.cast(kind))

    def step(kept: Column, box: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        touch = (F.size(kept) > 0) & (box["top"] <= last["bottom"]) & (box["left"] <= last["right"]) & (box["right"] >= last["left"])
        grown = F.struct(
            F.least(last["top"], box["top"]).alias("top"), F.least(last["left"], box["left"]).alias("left"), F.greatest(last["bottom"], box["bottom"]).alias("bottom"), F.greatest(last["right"], box["right"]).alias("right")
        )
        return F.when(touch, F.array_append(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), grown)).otherwise(F.array_append(kept, box))

    return F.aggregate(ordered, F.slice(ordered, 1, 0), step)


def mask_diagnostics(masks: DataFrame, pages: DataFrame, zones: list[str]) -> DataFrame:
    """For each page: masks, share of those with a zone reason, masked share of the page. masks: (page_id, box, reason_codes); pages: (page_id, width, height, masked_pixels)."""
    zone = F.arrays_overlap("reason_codes", F.array(*map(F.lit, zones)))
    by_page = masks.groupBy("page_id").agg(F.count("*").alias("masks"), F.count_if(zone).alias("_zone"))
    joined = pages.join(by_page, "page_id", "left").fillna(0, ["masks", "_zone"])
    share = F.when(F.col("masks") == 0, F.lit(0.0)).otherwise(F.round(F.col("_zone") / F.col("masks"), 6))
    return joined.select("page_id", "masks", share.alias("zone_share"), F.round(F.col("masked_pixels") / (F.col("width") * F.col("height")), 6).alias("masked_share"))


def readiness(documents: DataFrame, blocks: DataFrame, rules: DataFrame, provided: DataFrame) -> DataFrame:
    """(doc_id, readiness, missing): READY where all documents that blocks refer to are provided, PARTIAL where one is missing, BLOCKED for unusable or unconfirmed texts.

    documents: (doc_id, usable, confirmed); rules: (dependency_id, pattern); provided: (doc_id, dependency_id).
    """
    from folioscope.operators.joins import rule_matches

    needed = rule_matches(blocks, rules).select("doc_id", "dependency_id").distinct()
    missing = needed.join(provided, ["doc_id", "dependency_id"], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_list("dependency_id")).alias("missing"))
    joined = documents.join(missing, "doc_id", "left")
    state = F.when(~(F.col("usable") & F.col("confirmed")), "BLOCKED").when(F.col("missing").isNotNull(), "PARTIAL").otherwise("READY")
    return joined.select("doc_id", state.alias("readiness"), F.when(state == "PARTIAL", F.col("missing")).otherwise(F.array().cast("array<string>")).alias("missing"))
