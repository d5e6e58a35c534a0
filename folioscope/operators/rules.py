"""Validators: rules give violation rows (rule, key, message); fail-fast and accumulating forms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.scalars import squeezed


@dataclass(frozen=True)
class Rule:
    """``broken`` holds for rows that break the rule; null counts as not broken."""

    name: str
    broken: Column
    message: Column | str = ""


class Violations(ValueError):
    """The first violation of a failed check."""


def _message(rule: Rule) -> Column:
    return rule.message if isinstance(rule.message, Column) else F.lit(rule.message)


def violations(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """One row for each broken rule of each row; all rules are judged in one pass."""
    found = F.array_compact(F.array(*(F.when(r.broken, F.struct(F.lit(r.name).alias("rule"), F.col(key).cast("string").alias("key"), _message(r).alias("message"))) for r in rules)))
    return df.select(F.inline(found))


def duplicates(df: DataFrame, key: str, rule: str) -> DataFrame:
    many = df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
    return many.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("message"))


def dangling(df: DataFrame, key: str, reference: str, targets: DataFrame, target: str, rule: str) -> DataFrame:
    """References (not null) that no target has."""
    t = targets.select(F.col(target).alias(reference)).distinct()
    lost = df.filter(F.col(reference).isNotNull()).join(t, reference, "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.col(reference).cast("string").alias("message"))


def across_splits(df: DataFrame, hash_column: str, split: str, rule: str) -> DataFrame:
    """Hashes that occur in more than one split."""
    found = df.filter(F.col(hash_column).isNotNull()).groupBy(hash_column).agg(F.array_sort(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    return found.select(F.lit(rule).alias("rule"), F.col(hash_column).cast("string").alias("key"), F.array_join("s", ",").alias("message"))


def not_contiguous(df: DataFrame, group: str, position: str, rule: str, first: int = 1) -> DataFrame:
    """Groups whose positions are not first, first + 1, ... without gaps or repetitions."""
    found = df.groupBy(group).agg(F.min(position).alias("a"), F.max(position).alias("b"), F.count("*").alias("n"), F.count_distinct(position).alias("d"))
    bad = found.filter((F.col("a") != first) | (F.col("b") != first + F.col("n") - 1) | (F.col("d") != F.col("n")))
    return bad.select(F.lit(rule).alias("rule"), F.col(group).cast("string").alias("key"), F.format_string("%d rows, %d positions, %d to %d", "n", "d", "a", "b").alias("message"))


def set_equality(left: DataFrame, right: DataFrame, key: str, rule: str) -> DataFrame:
    """Keys that only one of two tables has."""
    a = left.select(key).distinct().withColumn("_a", F.lit(True))
    b = right.select(key).distinct().withColumn("_b", F.lit(True))
    odd = a.join(b, key, "full_outer").filter("_a is null or _b is null")
    return odd.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.when(F.col("_a").isNull(), "only right").otherwise("only left").alias("message"))


def all_of(*found: DataFrame) -> DataFrame:
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def require(found: DataFrame) -> None:
    """Fail-fast: raises with the least violation, if there is one."""
    first = found.orderBy("rule", "key").first()
    if first:
        raise Violations(f"{first['rule']}: {first['key']}: {first['message']}")


def is_blank(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(F.col(column)) == "")


def outside(column: str, allowed: list) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(*allowed)


# Tiers, splits and label states of a training manifest.
TIERS = ["synthetic", "silver", "gold"]
SPLITS = ["train", "validation", "test"]
GOLD_STATES = ["approved", "corrected"]
# End of the fixed values.


def manifest_violations(rows: DataFrame, schema_version: int = 1, charset: list[str] | None = None) -> DataFrame:
    """A training manifest's violations; hashes of images are checked where the table has image_bytes."""
    tier, split = F.col("data_tier"), F.col("split")
    rules = [
        Rule("schema_version", outside("schema_version", [schema_version])),
        *(Rule(f"{c}_blank", is_blank(c)) for c in ("dataset_id", "sample_id", "label_status", "source_dataset", "source_id")),
        Rule("data_tier", outside("data_tier", TIERS)),
        Rule("split", outside("split", SPLITS)),
        Rule("training_tier_in_test", tier.isin("synthetic", "silver") & (split == "test")),
        Rule("gold_outside_test", (tier == "gold") & (split != "test")),
        Rule("gold_label_status", (tier == "gold") & outside("label_status", GOLD_STATES)),
        Rule("text_empty", is_blank("text")),
        Rule("text_not_canonical", F.col("text") != squeezed(F.col("text"))),
        Rule("text_sha256", F.col("text_sha256") != F.sha2(F.col("text").cast("binary"), 256)),
    ]
    if charset is not None:
        unknown = F.array_sort(F.array_except(F.array_distinct(F.filter(F.split("text", ""), lambda c: c != "")), F.array(*map(F.lit, charset))))
        rules.append(Rule("unknown_characters", F.size(unknown) > 0, F.array_join(unknown, " ")))
    if "image_bytes" in rows.columns:
        rules.append(Rule("image_sha256", F.col("image_sha256") != F.sha2("image_bytes", 256)))
    return all_of(
        violations(rows, "sample_id", rules), duplicates(rows, "sample_id", "duplicate_sample_id"), duplicates(rows, "image_sha256", "duplicate_image"),
        across_splits(rows, "text_sha256", "split", "text_leakage"), across_splits(rows, "image_sha256", "split", "image_leakage"),
        rows.agg(F.min("dataset_id").alias("a"), F.max("dataset_id").alias("b")).filter("a <> b").select(F.lit("several_datasets").alias("rule"), F.lit("*").alias("key"), F.concat_ws(",", "a", "b").alias("message")),
    )


def answer_violations(answers: DataFrame, questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Model answers (question_id, status, values, evidence_block_ids) against questions (question_id, answer_fields) and blocks."""
    q = questions.select("question_id", F.size("answer_fields").alias("_arity"))
    known = answers.join(q, "question_id", "left")
    said = F.exists("values", lambda v: v.isNotNull())
    rules = [
        Rule("unknown_question", F.col("_arity").isNull()),
        Rule("arity", F.size("values") != F.col("_arity")),
        Rule("repeated_evidence", F.size(F.array_distinct("evidence_block_ids")) != F.size("evidence_block_ids")),
        Rule("found_nothing_but_values", (F.col("status") == "NOT_FOUND") & said),
        Rule("no_evidence", (F.col("status") != "NOT_FOUND") & (F.size("evidence_block_ids") == 0)),
        Rule("found_without_value", (F.col("status") == "FOUND") & ~F.exists("values", lambda v: F.coalesce(F.trim(v) != "", F.lit(False)))),
    ]
    cited = answers.select("question_id", F.explode("evidence_block_ids").alias("block_id"))
    return all_of(
        violations(known, "question_id", rules), duplicates(answers, "question_id", "duplicate_answer"),
        dangling(cited, "question_id", "block_id", blocks, "block_id", "unknown_block"), set_equality(answers, questions, "question_id", "coverage").filter("message = 'only right'"),
    )


def geometry_broken(kind: Column, box: Column, width: Column, height: Column) -> Column:
    """Whether a half-open box of four whole numbers lies outside its page or is empty."""
    x = [F.get(box, F.lit(k)) for k in range(4)]
    inside = (x[0] >= 0) & (x[1] >= 0) & (x[2] <= width) & (x[3] <= height) & (x[0] < x[2]) & (x[1] < x[3])
    return (kind == "bbox") & F.coalesce((F.size(box) != 4) | ~inside, F.lit(True))


def annotation_violations(regions: DataFrame, classes: list[str], states: list[str]) -> DataFrame:
    """Regions (region_id, pii_class, kind, box, width, height, review_status, reason_codes) of annotated pages."""
    rules = [
        Rule("class", outside("pii_class", classes)),
        Rule("review_status", outside("review_status", states)),
        Rule("geometry", geometry_broken(F.col("kind"), F.col("box"), F.col("width"), F.col("height"))),
        Rule("repeated_reason", F.size(F.array_distinct("reason_codes")) != F.size("reason_codes")),
    ]
    return all_of(violations(regions, "region_id", rules), duplicates(regions, "region_id", "duplicate_region"))
