"""Contracts of rows that pass between stages: candidates of personal data, frozen lines, reviews, packets, declared changes, source audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.markers import DIRECT_DETECTORS, MARKERS, RELATION_DETECTORS, VISUAL_CLASSES
from folioscope.operators.evidence import dispositions
from folioscope.operators.rules import Rule, across_splits, all_of, dangling, duplicates, is_blank, outside, set_equality, violations

# Classes, families, dispositions and identifiers of candidates; ends of relations; states of lines.
FAMILIES = ["direct_value", "marker", "relation", "visual_sensitive_region", "weak_layout_context"]
DISPOSITIONS = ["auto_mask", "local_review", "preserve"]
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
RELATION_ENDS = {"marker_to_value": ("marker", "direct_value"), "marker_to_visual": ("marker", "visual_sensitive_region")}
LINE_STATES = ["accepted", "review", "reject"]
REVIEW_REASON = "insufficient_evidence"
# End of the fixed values.

EVIDENCE = "array<struct<evidence_id:string,family:string,detector_id:string,geometry:string,relation:struct<relation_type:string,source:string,target:string>>>"


def _lookup(values: dict[str, str | None], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in values.items() if v is not None for x in (k, v))), key)


def _of(evidence: Column, name: Column) -> Column:
    """The evidence record of an id; null where there is none."""
    return F.get(F.filter(evidence, lambda e: e["evidence_id"] == name), F.lit(0))


def _relation_problem(evidence: Column, e: Column, proposed: Column) -> Column:
    """What is wrong with a relation, and with its classes for automatic masking; null if nothing is."""
    r = e["relation"]
    source, target = _of(evidence, r["source"]), _of(evidence, r["target"])
    ends = reduce(lambda a, b: a | b, ((r["relation_type"] == k) & (source["family"] == s) & (target["family"] == t) for k, (s, t) in RELATION_ENDS.items()))
    structure = (
        F.when(~r["relation_type"].isin(*RELATION_ENDS), "relation_type")
        .when(~r["source"].rlike(IDENTIFIER) | ~r["target"].rlike(IDENTIFIER), "relation_end")
        .when(r["source"] == r["target"], "self_reference")
        .when(source.isNull() | target.isNull(), "missing_evidence")
        .when(~ends, "relation_ends")
    )
    marker = _lookup({d: k for k, (d, _) in MARKERS.items()}, source["detector_id"])
    direct = _lookup({d: k for k, d in DIRECT_DETECTORS.items()}, target["detector_id"])
    seen = F.coalesce(_lookup(VISUAL_CLASSES, target["detector_id"]), marker)
    visual = F.when(target["detector_id"].isin(*VISUAL_CLASSES), seen)
    kind = F.when(r["relation_type"] == "marker_to_value", direct).otherwise(visual)
    policy = (
        F.when(~F.coalesce(e["detector_id"] == _lookup(RELATION_DETECTORS, r["relation_type"]), F.lit(False)), "mask:relation_detector")
        .when(marker.isNull(), "mask:marker_detector")
        .when(kind.isNull(), "mask:target_detector")
        .when(marker != kind, "mask:classes_differ")
        .when(kind != proposed, "mask:class")
    )
    return F.coalesce(structure, policy)


def candidate_problems(classes: list[str]) -> Column:
    """All that is wrong with a candidate (candidate_id, proposed_class, geometry_ok, disposition, detector_version, evidence, ambiguity_reason), in order.

    evidence is of type ``EVIDENCE``. Problems that begin with ``mask:`` count for automatic masking only.
    """
    e, d, why = F.col("evidence"), F.col("disposition"), F.col("ambiguity_reason")
    ids = F.transform(e, lambda x: x["evidence_id"])
    said = F.coalesce(F.trim(why) != "", F.lit(False))
    relations = F.filter(e, lambda x: (x["family"] == "relation") & x["relation"].isNotNull())
    judged = F.transform(relations, lambda x: _relation_problem(e, x, F.col("proposed_class")))
    direct = F.filter(e, lambda x: x["family"] == "direct_value")
    direct_class = lambda x: _lookup({v: k for k, v in DIRECT_DETECTORS.items()}, x["detector_id"])
    direct_problem = F.transform(direct, lambda x: F.when(direct_class(x).isNull(), "mask:direct_detector").when(direct_class(x) != F.col("proposed_class"), "mask:class"))
    strong = F.size(F.filter(direct_problem, lambda p: p.isNull())) + F.size(F.filter(judged, lambda p: p.isNull()))
    masks = d == "auto_mask"
    single = [
        (~F.coalesce(F.col("candidate_id").rlike(IDENTIFIER), F.lit(False)), "candidate_id"),
        (outside("proposed_class", classes), "proposed_class"),
        (outside("disposition", DISPOSITIONS), "disposition"),
        (~F.coalesce(F.col("detector_version").rlike(IDENTIFIER), F.lit(False)), "detector_version"),
        (~F.coalesce(F.col("geometry_ok"), F.lit(False)), "geometry"),
        (why.isNotNull() & (F.trim(why) == ""), "blank_reason"),
        ((d == "local_review") & ~said, "review_without_reason"),
        (d.isin("auto_mask", "preserve") & why.isNotNull(), "reason_not_allowed"),
        ((d == "local_review") & (F.size(e) == 0), "review_without_evidence"),
        (F.exists(ids, lambda x: ~F.coalesce(x.rlike(IDENTIFIER), F.lit(False))), "evidence_id"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "repeated_evidence_id"),
        (F.exists(e, lambda x: ~F.coalesce(x["family"].isin(*FAMILIES), F.lit(False))), "family"),
        (F.exists(e, lambda x: ~F.coalesce(x["detector_id"].rlike(IDENTIFIER), F.lit(False))), "detector_id"),
        (F.exists(e, lambda x: (x["family"] == "relation") & x["relation"].isNull()), "relation_missing"),
        (F.exists(e, lambda x: F.coalesce(x["family"] != "relation", F.lit(True)) & x["relation"].isNotNull()), "relation_not_allowed"),
        (masks & (strong == 0), "mask:no_strong_evidence"),
    ]
    plain = F.array(*(F.when(broken, F.lit(name)) for broken, name in single))
    listed = F.array_compact(F.concat(plain, judged, direct_problem))
    return F.array_distinct(F.filter(listed, lambda p: masks | ~p.startswith("mask:")))


def decided_candidates(candidates: DataFrame, classes: list[str]) -> DataFrame:
    """Candidates (candidate_id, proposed_class, geometry, geometry_ok, detector_version, evidence) with disposition and ambiguity_reason.

    Masked are those that would be valid as masked and whose strong evidence (direct values, and the targets of relations to what is seen) all has the
    candidate's geometry; those without evidence are preserved; the rest is reviewed.
    """
    tried = candidates.withColumns({"disposition": F.lit("auto_mask"), "ambiguity_reason": F.lit(None).cast("string")}).withColumn("_problems", candidate_problems(classes))
    targets = F.transform(F.filter("evidence", lambda e: e["relation"]["relation_type"] == "marker_to_visual"), lambda e: e["relation"]["target"])
    rated = F.transform(
        "evidence",
        lambda e: F.struct(F.when((e["family"] == "direct_value") | F.array_contains(targets, e["evidence_id"]), "strong").otherwise("weak").alias("strength"), (F.size("_problems") == 0).alias("valid"), e["geometry"].alias("geometry")),
    )
    own = [c for c in candidates.columns if c != "evidence"]
    judged = dispositions(tried.select(*own, F.col("evidence").alias("_records"), rated.alias("evidence")))
    return judged.select(*own, F.col("_records").alias("evidence"), "disposition", F.when(F.col("disposition") == "local_review", REVIEW_REASON).alias("ambiguity_reason"))


def _record(name: Column, family: str, detector: Column, geometry: Column, relation: Column | None = None) -> Column:
    none = F.lit(None).cast("struct<relation_type:string,source:string,target:string>")
    return F.struct(name.alias("evidence_id"), F.lit(family).alias("family"), detector.alias("detector_id"), geometry.cast("string").alias("geometry"), (none if relation is None else relation).alias("relation"))


def value_candidates(found: DataFrame, key: Column) -> DataFrame:
    """Candidates from values (kind, geometry) and, where marker_geometry is not null, their markers: one for each row."""
    kind = F.col("kind")
    value = _record(F.concat(key, F.lit("-value")), "direct_value", _lookup(DIRECT_DETECTORS, kind), F.col("geometry"))
    marker = _record(F.concat(key, F.lit("-marker")), "marker", _lookup({k: d for k, (d, _) in MARKERS.items()}, kind), F.col("marker_geometry"))
    link = F.struct(F.lit("marker_to_value").alias("relation_type"), F.concat(key, F.lit("-marker")).alias("source"), F.concat(key, F.lit("-value")).alias("target"))
    relation = _record(F.concat(key, F.lit("-relation")), "relation", F.lit(RELATION_DETECTORS["marker_to_value"]), F.lit(None), link)
    evidence = F.when(F.col("marker_geometry").isNull(), F.array(value)).otherwise(F.array(marker, value, relation))
    return found.select("*", key.alias("candidate_id"), kind.alias("proposed_class"), F.lit("evidence-v0").alias("detector_version"), evidence.alias("evidence"))


def line_row_problems(rows: DataFrame) -> DataFrame:
    """Frozen lines (page_id, order, line_id, status, segmentation_status, upstream, reasons, line_sha256, box): broken contracts.

    The id is the page's and the order of four digits; an accepted line has accepted geometry without reasons, passed upstream, and a box with an area.
    """
    accepted, box = F.col("status") == "accepted", F.col("box")
    rules = [
        Rule("page_id", ~F.coalesce(F.col("page_id").rlike(IDENTIFIER), F.lit(False))),
        Rule("order", F.coalesce(F.col("order") < 1, F.lit(True))),
        Rule("line_id", ~F.col("line_id").eqNullSafe(F.format_string("%s-L%04d", "page_id", "order"))),
        Rule("status", outside("status", LINE_STATES)),
        Rule("segmentation_status", outside("segmentation_status", LINE_STATES)),
        Rule("accepted_geometry", accepted & ((F.col("segmentation_status") != "accepted") | (F.size("reasons") > 0))),
        Rule("accepted_upstream", accepted & ~F.col("upstream").eqNullSafe(F.lit("pass"))),
        Rule("accepted_hash", accepted & ~F.coalesce(F.col("line_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))),
        Rule("accepted_box", accepted & ~F.coalesce((box["right"] > box["left"]) & (box["bottom"] > box["top"]), F.lit(False))),
    ]
    return all_of(violations(rows, "line_id", rules), duplicates(rows, "line_id", "repeated_line"))


def review_problems(reviews: DataFrame, expected: DataFrame) -> DataFrame:
    """Reviews (image_id, outcome, findings) of all expected images: a pass has no findings, a fail has some."""
    rules = [
        Rule("outcome", outside("outcome", ["pass", "fail"])),
        Rule("pass_with_findings", (F.col("outcome") == "pass") & (F.size("findings") > 0)),
        Rule("fail_without_findings", (F.col("outcome") == "fail") & (F.size("findings") == 0)),
        Rule("repeated_finding", F.size(F.array_distinct("findings")) < F.size("findings")),
    ]
    return all_of(violations(reviews, "image_id", rules), duplicates(reviews, "image_id", "repeated_review"), set_equality(reviews, expected, "image_id", "reviewed_images"))


def packet(blocks: DataFrame, by: list[str], order: str, text: str, most: int) -> DataFrame:
    """Blocks numbered B01, B02, ... in order, as one text for each group; a group of more than ``most`` blocks has none."""
    w = Window.partitionBy(*by).orderBy(order)
    each = blocks.withColumn("_n", F.row_number().over(w)).withColumn("_line", F.concat(F.format_string("B%02d: ", "_n"), text))
    listed = each.filter(F.col("_n") <= most + 1).groupBy(*by).agg(F.count("*").alias("_kept"), F.array_sort(F.collect_list(F.struct("_n", "_line"))).alias("_lines"))
    joined = F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n")
    return listed.select(*by, F.when(F.col("_kept") <= most, joined).alias("packet"), F.when(F.col("_kept") <= most, F.col("_kept")).alias("blocks"))


def labels_cover(responses: DataFrame, packets: DataFrame, by: list[str], labels: list[str], excluded: str) -> DataFrame:
    """Responses (``by``, block, labels) against packets (``by``, blocks): every block once, labels of a closed list, the excluding label alone."""
    key = F.concat_ws("/", *(F.col(c).cast("string") for c in by), F.col("block"))
    rows = responses.withColumn("_key", key)
    wanted = packets.withColumn("block", F.explode(F.transform(F.sequence(F.lit(1), F.col("blocks").cast("int")), lambda k: F.format_string("B%02d", k)))).withColumn("_key", key)
    rules = [
        Rule("no_label", F.size("labels") < 1),
        Rule("unknown_label", F.size(F.array_except("labels", F.array(*map(F.lit, [*labels, excluded])))) > 0),
        Rule("excluded_not_alone", F.array_contains("labels", excluded) & (F.size("labels") > 1)),
    ]
    return all_of(violations(rows, "_key", rules), duplicates(rows, "_key", "repeated_block"), set_equality(rows, wanted, "_key", "covered_blocks"))


def risky_lines(files: DataFrame, patterns: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """(path, line_number, pattern, line) wherever a line holds a pattern, in any case; patterns are plain text."""
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(text), "\r\n|\r|\n")).alias("_k", "_line"))
    hits = F.filter(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.lower("_line"), F.lower(p)))
    return lines.select("path", (F.col("_k") + 1).alias("line_number"), F.explode(hits).alias("pattern"), F.trim("_line").alias("line"))


def sensitive_path(path: Column, folders: list[str], tokens: list[str]) -> Column:
    """Whether a path lies in one of the folders or holds one of the tokens, in any case."""
    low = F.lower(path)
    return F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, folders))) | F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(low, t))


def change_problems(declared: DataFrame, base: DataFrame, head: DataFrame, state_files: list[str], versions: tuple[Column, Column] | None = None) -> DataFrame:
    """(rule, key, message): changes between trees (path, content) that were not declared (path), declared ones that are none, state files that were not declared."""
    changed = base.select("path", F.col("content").alias("_a")).join(head.select("path", F.col("content").alias("_b")), "path", "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select("path")
    said = declared.select("path")
    none = lambda rule, df: df.select(F.lit(rule).alias("rule"), F.col("path").alias("key"), F.lit("").alias("message"))
    state = declared.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, state_files))).alias("path"))
    return all_of(
        none("undeclared", changed.join(said.distinct(), "path", "left_anti")), none("not_changed", said.distinct().join(changed, "path", "left_anti")),
        none("state_not_declared", state.join(said.distinct(), "path", "left_anti")), duplicates(said, "path", "declared_twice"),
    )


def audit_problems(sources: DataFrame, claims: DataFrame, allowed: dict[str, dict[str, list[str]]], today: str) -> DataFrame:
    """Sources (source_id, kind, access, retrieved) and claims (claim_id, source_id, support, effective) against a matrix kind -> access -> support.

    Every claim has a source and every source a claim; retrieval is no later than today and no claim takes effect later than its source was retrieved.
    """
    pairs = F.create_map(*(F.lit(x) for k, per in allowed.items() for a, s in per.items() for x in (f"{k}/{a}", "|".join(s))))
    own = sources.withColumn("_support", F.element_at(pairs, F.concat_ws("/", "kind", "access")))
    first = [Rule("kind_access", F.col("_support").isNull()), Rule("retrieved_later", F.coalesce(F.col("retrieved") > F.lit(today), F.lit(True))), Rule("source_id", is_blank("source_id"))]
    joined = claims.join(own.select("source_id", "_support", "retrieved"), "source_id")
    second = [Rule("support", F.col("_support").isNotNull() & ~F.array_contains(F.split("_support", r"\|"), F.col("support"))), Rule("effective_later", F.col("effective") > F.col("retrieved"))]
    return all_of(
        violations(own, "source_id", first), duplicates(sources, "source_id", "repeated_source"), duplicates(claims, "claim_id", "repeated_claim"),
        violations(joined, "claim_id", second), dangling(claims, "claim_id", "source_id", sources, "source_id", "unknown_source"), dangling(sources, "source_id", "source_id", claims, "source_id", "source_without_claim"),
    )


def family_split_problems(families: DataFrame, splits: list[str]) -> DataFrame:
    """Families (family_id, split, text_sha256): known splits, one for each family, and no text in two of them; every split has a family."""
    empty = families.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, splits))).alias("split")).join(families.select("split").distinct(), "split", "left_anti")
    return all_of(
        violations(families, "family_id", [Rule("split", outside("split", splits)), Rule("family_id", is_blank("family_id"))]), across_splits(families, "family_id", "split", "family_in_two_splits"),
        across_splits(families, "text_sha256", "split", "text_in_two_splits"), empty.select(F.lit("empty_split").alias("rule"), F.col("split").alias("key"), F.lit("").alias("message")),
    )


def same_sets(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(rule, key, message): keys that some of the named tables lack, in one pass over all; the message names those that do."""
    each = reduce(DataFrame.unionByName, (df.select(F.col(key).cast("string").alias("key"), F.lit(n).alias("t")) for n, df in tables.items()))
    found = each.groupBy("key").agg(F.collect_set("t").alias("_have"))
    lacking = F.array_except(F.array(*map(F.lit, tables)), F.col("_have"))
    return found.filter(F.size("_have") < len(tables)).select(F.lit("not_in_all").alias("rule"), "key", F.array_join(lacking, ",").alias("message"))


def common_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of both tables, each once."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")


def require_disjoint(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raises with the least key that both tables have, if there is one."""
    least = common_keys(left, right, key).agg(F.min(key)).first()[0]
    if least is not None:
        raise ValueError(f"both sides have {least}")


def assembled_prompt(parts: list[tuple[str, Column]]) -> Column:
    """Titled sections in order, an empty line between them; sections without text are left out."""
    return F.concat_ws("\n\n", *(F.when(F.coalesce(F.trim(c) != "", F.lit(False)), F.concat(F.lit(f"## {title}\n"), F.trim(c))) for title, c in parts))


def labelled(code: Column, names: dict[str, str], default: str | None = None) -> Column:
    """A code's name; without one the default, or the code itself."""
    return F.coalesce(_lookup(names, code), F.lit(default) if default is not None else code)


def replayed(events: DataFrame, by: list[str], order: list[str], event: str, start: str, moves: dict[tuple[str, str], str]) -> DataFrame:
    """The state of each session after its events in order, and how many of them its states did not allow (they change nothing).

    A session is one row's work; its events are those of one person at one screen.
    """
    table = F.create_map(*(F.lit(x) for (s, e), t in moves.items() for x in (f"{s}/{e}", t)))
    listed = events.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(event).alias("_event")))).alias("_events"))
    begin = F.struct(F.lit(start).alias("state"), F.lit(0).alias("refused"))

    def step(s: Column, e: Column) -> Column:
        to = F.element_at(table, F.concat_ws("/", s["state"], e["_event"]))
        return F.struct(F.coalesce(to, s["state"]).alias("state"), (s["refused"] + to.isNull().cast("int")).alias("refused"))

    return listed.withColumn("_end", F.aggregate("_events", begin, step)).select(*by, "_end.state", "_end.refused")


def review_pack_problems(predictions: DataFrame, renderers: DataFrame, lines: DataFrame) -> DataFrame:
    """(subject, problem) of a pack: predicted pages, their masked images and their lines, bound by image id, hash and size.

    Subjects are image ids, for repeated ids of candidates and lines those ids. Each table comes down to one row for an id
    before the join, so repeated ids multiply nothing; of repeated pages the least row is compared. A missing id matches none.
    Columns: predictions (image_id, image_sha256, width, height, candidates: ids), renderers (image_id, source_image_sha256,
    width, height, mask_count, masked_pixel_count), lines (page_id, line_id, order, source_master_sha256).
    """

    def one(df: DataFrame, name: str, *columns) -> DataFrame:
        return df.groupBy(F.col("image_id").cast("string").alias("subject")).agg(F.count("*").alias(f"{name}_rows"), F.min(F.struct(*columns)).alias(name))

    p = one(predictions, "p", F.col("image_sha256").alias("sha256"), "width", "height", F.size("candidates").alias("masks"))
    d = one(renderers, "d", F.col("source_image_sha256").alias("sha256"), "width", "height", "mask_count", "masked_pixel_count")
    sha = "source_master_sha256"
    places = lines.groupBy(F.col("page_id").cast("string").alias("subject"), "order").agg(F.count("*").alias("n"), F.count(sha).alias("known"), F.min(sha).alias("least"), F.max(sha).alias("most"))
    l = places.groupBy("subject").agg(  # noqa: E741
        F.struct(F.sum("n").alias("n"), F.count("order").alias("orders"), F.min("order").alias("first"), F.max("order").alias("last"), F.sum("known").alias("known"), F.min("least").alias("least"), F.max("most").alias("most")).alias("l")
    )
    has = {c: F.col(c).isNotNull() for c in "pdl"}
    differ = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    in_order = (F.col("l.first") == 1) & (F.col("l.last") == F.col("l.n")) & (F.col("l.orders") == F.col("l.n"))
    fits = F.col("d.masked_pixel_count").between(0, F.col("p.width").cast("long") * F.col("p.height"))
    checks = {
        "no_prediction": ~has["p"] & has["d"],
        "unknown_page": ~has["p"] & has["l"],
        "no_renderer": has["p"] & ~has["d"],
        "repeated_image": (F.coalesce("p_rows", F.lit(0)) > 1) | (F.coalesce("d_rows", F.lit(0)) > 1),
        "source_hash": has["p"] & has["d"] & differ("p.sha256", "d.sha256"),
        "size": has["p"] & has["d"] & (differ("p.width", "d.width") | differ("p.height", "d.height")),
        "mask_count": has["p"] & has["d"] & differ("p.masks", "d.mask_count"),
        "masked_pixels": has["p"] & has["d"] & ~F.coalesce(fits, F.lit(False)),
        "line_order": has["l"] & ~F.coalesce(in_order, F.lit(False)),
        "line_hash": has["p"] & has["l"] & (differ("l.least", "p.sha256") | differ("l.most", "p.sha256") | (F.col("l.known") < F.col("l.n"))),
    }
    joined = p.join(d, "subject", "full_outer").join(l, "subject", "full_outer")
    found = joined.select("subject", F.explode(F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in checks.items())))).alias("problem"))
    ids = [("repeated_candidate", predictions.select(F.explode("candidates").alias("subject"))), ("repeated_line", lines.select(F.col("line_id").alias("subject")))]
    for name, each in ids:
        many = each.groupBy(F.col("subject").cast("string").alias("subject")).agg(F.count("*").alias("n")).filter("n > 1")
        found = found.unionByName(many.select("subject", F.lit(name).alias("problem")))
    return found
