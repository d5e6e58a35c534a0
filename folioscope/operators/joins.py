"""Joins beyond equality: rules over texts, nearest preceding, boxes, arrays of references, differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a rule or dimension table that may go to every task.
RULE_ROWS = 10_000


def bounded(df: DataFrame, rows: int = RULE_ROWS) -> DataFrame:
    """A table that may be broadcast: its rows are counted first. A larger one is joined without the hint."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def rule_matches(blocks: DataFrame, rules: DataFrame, text: str = "text", pattern: str = "pattern", literal: bool = False) -> DataFrame:
    """Blocks by the rules whose pattern they match (or whose literal text they contain)."""
    on = F.contains(F.col(text), F.col(pattern)) if literal else F.rlike(F.col(text), F.col(pattern))
    return blocks.join(bounded(rules), on)


def rule_coverage(blocks: DataFrame, rules: DataFrame, key: str, block_id: str = "block_id", rule: str = "rule") -> DataFrame:
    """For each key and rule the blocks that match, in order."""
    found = rule_matches(blocks, rules)
    return found.groupBy(key, rule).agg(F.array_sort(F.collect_set(block_id)).alias("block_ids"))


def nearest_preceding(values: DataFrame, marks: DataFrame, by: list[str], at: str, mark_at: str, payload: list[str], max_gap: int | float | None = None) -> DataFrame:
    """Each value with the payload of the last mark at or before it in its group: one sort of both, no range join."""
    v = values.withColumns({"_at": F.col(at), "_is": F.lit(1), "_m": F.lit(None).cast(marks.select(F.struct(mark_at, *payload)).schema[0].dataType)})
    m = marks.select(*by, F.col(mark_at).alias("_at"), F.lit(0).alias("_is"), F.struct(mark_at, *payload).alias("_m"))
    w = Window.partitionBy(*by).orderBy("_at", "_is", "_m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = v.unionByName(m, allowMissingColumns=True).withColumn("_last", F.last("_m", ignorenulls=True).over(w)).filter("_is = 1")
    near = F.lit(True) if max_gap is None else F.col("_at") - F.col(f"_last.{mark_at}") <= max_gap
    return both.select(*values.columns, *(F.when(near, F.col(f"_last.{c}")).alias(f"preceding_{c}") for c in (mark_at, *payload)))


def contains_box(outer: Column, inner: Column) -> Column:
    """Boxes are structs of left, top, right, bottom, half open."""
    return (outer["left"] <= inner["left"]) & (outer["top"] <= inner["top"]) & (outer["right"] >= inner["right"]) & (outer["bottom"] >= inner["bottom"])


def overlaps_box(a: Column, b: Column) -> Column:
    return (a["left"] < b["right"]) & (b["left"] < a["right"]) & (a["top"] < b["bottom"]) & (b["top"] < a["bottom"])


def area(box: Column) -> Column:
    return (box["right"] - box["left"]) * (box["bottom"] - box["top"])


def centre_distance(a: Column, b: Column) -> Column:
    """Twice the distance of the centres, squared: exact for whole numbers."""
    dx = (a["left"] + a["right"]) - (b["left"] + b["right"])
    dy = (a["top"] + a["bottom"]) - (b["top"] + b["bottom"])
    return dx * dx + dy * dy


def union_box(box: Column) -> list[Column]:
    """Aggregates that enclose all boxes of a group."""
    return [F.min(box["left"]).alias("left"), F.min(box["top"]).alias("top"), F.max(box["right"]).alias("right"), F.max(box["bottom"]).alias("bottom")]


def clamp_box(box: Column, width: Column, height: Column) -> Column:
    return F.struct(
        F.greatest(F.lit(0), F.least(box["left"], width)).alias("left"), F.greatest(F.lit(0), F.least(box["top"], height)).alias("top"),
        F.greatest(F.lit(0), F.least(box["right"], width)).alias("right"), F.greatest(F.lit(0), F.least(box["bottom"], height)).alias("bottom"),
    )


def containment_nearest(inner: DataFrame, outer: DataFrame, by: list[str], inner_id: str, outer_id: str, inner_box: str, outer_box: str) -> DataFrame:
    """For each inner box the outer box of its group that holds it: nearest centre, then least spare area, then least id."""
    o = outer.select(*by, F.col(outer_id).alias("_oid"), F.col(outer_box).alias("_obox"))
    pairs = inner.join(o, by).filter(contains_box(F.col("_obox"), F.col(inner_box)))
    rank = F.struct(centre_distance(F.col("_obox"), F.col(inner_box)), area(F.col("_obox")) - area(F.col(inner_box)), F.col("_oid"))
    best = pairs.groupBy(*by, inner_id).agg(F.min_by("_oid", rank).alias(outer_id))
    return inner.select(*by, inner_id).join(best, [*by, inner_id], "left")


def in_box(x: Column, y: Column, box: Column) -> Column:
    return (x >= box["left"]) & (x < box["right"]) & (y >= box["top"]) & (y < box["bottom"])


def span_words(spans: DataFrame, words: DataFrame, by: list[str]) -> DataFrame:
    """Words (start, end, and more) that each span (span_id, span_start, span_end) touches."""
    return spans.join(words, by).filter((F.col("end") > F.col("span_start")) & (F.col("start") < F.col("span_end")))


def resolve_references(rows: DataFrame, targets: DataFrame, key: str, ids: str, target_id: str, payload: str, by: list[str] | None = None) -> DataFrame:
    """Adds resolved (payloads in the ids' first-seen order) and invalid (ids without a target); null for a row without ids.

    ``by`` narrows rows and targets to those of one group; rows that share a key in it, with other ids or the same, are resolved each.
    """
    own = [*(by or []), key, ids]
    by = by or []
    each = rows.select(*own).distinct().select(*own, F.posexplode(F.array_distinct(ids)).alias("_pos", "_id"))
    t = targets.select(*by, F.col(target_id).alias("_id"), F.col(payload).alias("_payload"), F.lit(True).alias("_hit"))
    joined = each.join(t, [*by, "_id"], "left")
    found = joined.groupBy(*own).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_hit"), F.struct("_pos", "_payload")))), lambda x: x["_payload"]).alias("resolved"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_hit").isNull(), F.struct("_pos", "_id")))), lambda x: x["_id"]).alias("invalid"),
    )
    found = found.select(*(F.col(c).alias(f"_own{k}") for k, c in enumerate(own)), "resolved", "invalid")
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_own{k}")) for k, c in enumerate(own)))
    return rows.join(found, same, "left").drop(*(f"_own{k}" for k in range(len(own))))


def compare_null_safe(expected: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison on keys that may be null: status match, differs, missing or unexpected."""
    e = expected.select(*(F.col(k).alias(f"e_{k}") for k in keys), F.col(value).alias("expected"), F.lit(True).alias("_e"))
    a = actual.select(*(F.col(k).alias(f"a_{k}") for k in keys), F.col(value).alias("actual"), F.lit(True).alias("_a"))
    on = reduce(lambda x, y: x & y, (F.col(f"e_{k}").eqNullSafe(F.col(f"a_{k}")) for k in keys))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("expected").eqNullSafe(F.col("actual")), "match").otherwise("differs")
    joined = e.join(a, on, "full_outer")
    return joined.select(*(F.coalesce(f"e_{k}", f"a_{k}").alias(k) for k in keys), "expected", "actual", status.alias("status"))


def table_diff(base: DataFrame, head: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys that were added, removed or changed."""
    b = base.select(F.col(key), F.struct(*columns).alias("_b"), F.lit(True).alias("_in_b"))
    h = head.select(F.col(key), F.struct(*columns).alias("_h"), F.lit(True).alias("_in_h"))
    change = F.when(F.col("_in_b").isNull(), "added").when(F.col("_in_h").isNull(), "removed").when(~F.col("_b").eqNullSafe(F.col("_h")), "changed")
    return b.join(h, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def edges_with_ends(candidates: DataFrame, key: str = "candidate_id", evidence: str = "evidence") -> DataFrame:
    """Typed relations of an evidence array with the families of both ends; an end that is not there is null."""
    each = candidates.select(key, F.explode(evidence).alias("e"))
    nodes = each.select(key, F.col("e.evidence_id").alias("_id"), F.col("e.family").alias("_family"))
    edges = each.filter("e.relation is not null").select(key, F.col("e.relation.relation_type").alias("relation_type"), F.col("e.relation.source_evidence_id").alias("source"), F.col("e.relation.target_evidence_id").alias("target"))
    for end in ("source", "target"):
        side = nodes.select(key, F.col("_id").alias(end), F.col("_family").alias(f"{end}_family"))
        edges = edges.join(side, [key, end], "left")
    return edges


def without_known(rows: DataFrame, known: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Adds the reasons for which a row is known already. known: reason -> (column, table with that column)."""
    out = rows
    for reason, (column, table) in known.items():
        keys = table.select(F.col(column)).filter(F.col(column).isNotNull()).distinct().withColumn(f"_{reason}", F.lit(reason))
        out = out.join(keys, column, "left")
    return out.withColumn("reasons", F.array_compact(F.array(*(F.col(f"_{r}") for r in known)))).drop(*(f"_{r}" for r in known))
