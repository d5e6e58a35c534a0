"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections, by DataFrame functions alone.

A paragraph is a line with its line ends (eight at most; more are paragraphs of their own). A section ends with each paragraph whose
digest starts with one of four of the sixteen digits, so an edit moves no other section's ends. Digests are SHA-256: a paragraph's
of its text, a section's of its paragraphs' digests, the root's of the sections'. Below a paragraph are its leaves, sentences or
runs of ``LEAF`` characters of them, one rule for texts of all lengths. A leaf counts with the leaf before it, by a 58-bit hash of both
and its length. The fingerprint is ``root:sections``, 16 digits for each section.

Two trees are compared from the root down. Equal roots are equal texts. Otherwise equal sections at the two ends are
left out, then equal paragraphs at the ends of the rest; only the leaves of the paragraphs between are compared, as often as they occur. Likeness is twice the
characters in equal branches and equal leaves over the characters of both texts; the order of leaves counts, since each goes with its predecessor.

Defined results: equal texts have equal roots, different texts different ones (but for collisions of SHA-256);
a null text is an empty one, with no paragraph; an empty text and one that is not have likeness 0. Texts of different roots may have
likeness 1 only where they hold the same pairs of leaves as often, in another order.
Rows are ordered by id, null ids first; rows of one id (or of none) by the hash of their text; a repeated id is a document of its own; a table of one row is
its own successor. Extra columns stay; one named like a computed column is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a leaf that no sentence end cuts short.
LEAF = 16
#: Documents that a range of ids should have at most, and the fewest and most ranges.
RANGE_ROWS, FEWEST, MOST = 1000, 64, 16_384
#: Range cuts that are looked through at once.
GROUP = 128
PARAGRAPHS = r"[^\n]*\n{1,8}|[^\n]+"
#: At most 31 characters.
LEAVES = rf"[^.!?\n]{{0,{LEAF - 1}}}(?:[.!?]{{1,8}} {{0,8}}|\n{{1,8}})|[^.!?\n]{{1,{LEAF}}}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(ends: Column, items: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of each run of items, given the runs' last places."""
    def one(end: Column, k: Column) -> Column:
        before = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))
        return make(F.slice(items, before + 1, end - before))

    return F.transform(ends, one)


def _places(items: Column, is_end: Callable[[Column], Column]) -> Column:
    """Places (from 1) of the items that end a run; the last always does."""
    n = F.size(items)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | is_end(F.get(items, i - 1))))


def _leaf_key(leaf: Column, before: Column) -> Column:
    """58 bits of the hash of a leaf and the one before it, five of its length, and one that is 0."""
    return F.xxhash64(leaf, before).bitwiseAND(F.lit(-64)).bitwiseOR(F.shiftleft(F.char_length(leaf).cast("long"), 1))


def _leaf_keys(paragraphs: Column) -> Column:
    """The keys of each paragraph's leaves."""
    def chained(leaves: Column) -> Column:
        def of(own: Column, j: Column) -> Column:
            last = F.element_at(F.get(leaves, j - 1), -1)
            return F.transform(own, lambda x, i: _leaf_key(x, F.when(i == 0, last).otherwise(F.get(own, i - 1))))

        return F.transform(leaves, of)

    return let(F.transform(paragraphs, lambda p: F.regexp_extract_all(p, F.lit(LEAVES), F.lit(0))), chained)


def tree(text: Column) -> Column:
    """The tree: root, n (characters), sections and paragraphs (digests), ends (each section's last paragraph, from 1), keys (leaves of each paragraph)."""
    def whole(paragraphs: Column) -> Column:
        def above(digests: Column) -> Column:
            def sections(ends: Column) -> Column:
                return let(
                    _runs(ends, digests, lambda run: F.sha2(F.array_join(run, ""), 256)),
                    lambda s: F.struct(F.sha2(F.array_join(s, ""), 256).alias("root"), F.char_length(text).cast("long").alias("n"), s.alias("sections"), ends.alias("ends"), digests.alias("paragraphs"), _leaf_keys(paragraphs).alias("keys")),
                )

            return let(_places(digests, lambda d: F.substring(d, 1, 1).isin("0", "1", "2", "3")), sections)

        return let(F.transform(paragraphs, lambda p: F.sha2(p, 256)), above)

    return let(F.regexp_extract_all(text, F.lit(PARAGRAPHS), F.lit(0)), whole)


def fingerprint(whole: Column) -> Column:
    """A tree's root and sections as text."""
    return F.concat(whole["root"], F.lit(":"), F.array_join(F.transform(whole["sections"], lambda s: F.substring(s, 1, 16)), ","))


def text_fingerprint(text: Column) -> Column:
    return let(tree(text), fingerprint)


def _common(a: Column, b: Column) -> Column:
    """Items in which two arrays begin alike."""
    return let(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False), lambda p: F.when(p == 0, F.size(a)).otherwise((p - 1).cast("int")))


def _slice(items: Column, start: Column, end: Column) -> Column:
    return F.slice(items, start + 1, end - start)


def _between(a: Column, b: Column, start: Column, a_end: Column, b_end: Column) -> Column:
    """(start, a_end, b_end) without equal items at both ends of these parts of two arrays."""
    def cut(x: Column, y: Column) -> Column:
        def front(p: Column) -> Column:
            back = _common(F.reverse(_slice(x, p, F.size(x))), F.reverse(_slice(y, p, F.size(y))))
            return let(back, lambda q: F.struct((start + p).alias("start"), (a_end - q).alias("a_end"), (b_end - q).alias("b_end")))

        return let(_common(x, y), front)

    return let(_slice(a, start, a_end), lambda x: let(_slice(b, start, b_end), lambda y: cut(x, y)))


def unlike(a: Column, b: Column) -> Column:
    """Where two trees differ: start (equal paragraphs in front), a_end and b_end (paragraphs before the equal ones at the end)."""
    def last(t: Column, sections: Column) -> Column:
        return F.when(sections == 0, F.lit(0)).otherwise(F.get(t["ends"], sections - 1))

    def entered(s: Column) -> Column:
        return _between(a["paragraphs"], b["paragraphs"], last(a, s["start"]), last(a, s["a_end"]), last(b, s["b_end"]))

    return let(_between(a["sections"], b["sections"], F.lit(0), F.size(a["sections"]), F.size(b["sections"])), entered)


def _shared(x: Column, y: Column) -> Column:
    """Characters of the leaves that two lists of keys share, each as often as in both."""
    def step(s: Column, z: Column) -> Column:
        key, other = F.shiftright(z, 1), z.bitwiseAND(1) == 1
        same = s["key"] == key
        held = F.when(same, s["held"]).otherwise(F.lit(0).cast("long"))
        hit = other & (held > 0)
        return F.struct(
            key.alias("key"),
            F.when(~other, held + 1).when(hit, held - 1).otherwise(F.lit(0).cast("long")).alias("held"),
            (s["sum"] + F.when(hit, key.bitwiseAND(31)).otherwise(F.lit(0).cast("long"))).alias("sum"),
        )

    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(-1).cast("long").alias("key"), zero.alias("held"), zero.alias("sum"))
    return F.aggregate(F.sort_array(F.concat(x, F.transform(y, lambda k: k.bitwiseOR(F.lit(1).cast("long"))))), start, step, lambda s: s["sum"])


def likeness(a: Column, b: Column) -> Column:
    """Twice the characters in equal branches and leaves of two trees over the characters of both; 1 for equal roots."""
    def of(u: Column) -> Column:
        def ratio(x: Column, y: Column) -> Column:
            entered = F.aggregate(x, F.lit(0).cast("long"), lambda n, k: n + F.shiftright(k, 1).bitwiseAND(31))
            return F.lit(2.0) * (a["n"] - entered + _shared(x, y)) / (a["n"] + b["n"])

        return let(F.flatten(_slice(a["keys"], u["start"], u["a_end"])), lambda x: let(F.flatten(_slice(b["keys"], u["start"], u["b_end"])), lambda y: ratio(x, y)))

    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(let(unlike(a, b), of))


def differing(a: Column, b: Column) -> Column:
    """What an edit made of ``a`` changed: section and paragraph (from 1) where the first differs, and how many paragraphs of ``a`` do; zeros for equal texts."""
    def place(section: Column, paragraph: Column, paragraphs: Column) -> Column:
        return F.struct(section.cast("int").alias("section"), paragraph.cast("int").alias("paragraph"), paragraphs.cast("int").alias("paragraphs"))

    return F.when(a["root"] == b["root"], place(F.lit(0), F.lit(0), F.lit(0))).otherwise(
        let(unlike(a, b), lambda u: place(F.size(F.filter(a["ends"], lambda e: e <= u["start"])) + 1, u["start"] + 1, u["a_end"] - u["start"]))
    )


def _rank(groups: Column, heads: Column, key: Column, with_equal: bool) -> Column:
    """How many cuts, in groups of ``GROUP``, are below ``key`` (or not above it)."""
    below = (lambda c: c <= key) if with_equal else (lambda c: c < key)
    return let(F.size(F.filter(heads, below)), lambda g: F.when(g == 0, F.lit(0)).otherwise((g - 1) * GROUP + F.size(F.filter(F.get(groups, g - 1), below))))


def with_next(df: DataFrame, key: str, text: str, derived: dict[str, Column], carried: dict[str, str]) -> DataFrame:
    """Adds columns of the row after each row by ascending numeric ``key`` (after the last: the first).

    Ids are cut into ranges of about equal counts; an id that fills several (or having none) is cut by the hash of its text, so that only rows alike in both
    stay together. The first row of each range also stands behind the last of the range before. ``MOST`` ranges of 1 GB of texts
    each are 16 TB; larger tables have larger ranges, which spill. derived: columns to add before, computed once for each row, behind the
    shuffle; carried: column -> name of its successor's value.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    number = F.col(key).cast("double")
    total, nulls = df.agg(F.count("*"), F.count_if(F.col(key).isNull())).first()
    ranges = max(FEWEST, min(MOST, total // RANGE_ROWS))
    cuts = df.agg(F.percentile_approx(number, [i / ranges for i in range(1, ranges)], F.lit(10 * ranges)).alias("q")).first()["q"] or []
    cuts = sorted(cuts)
    listed = [cuts[i : i + GROUP] for i in range(0, len(cuts), GROUP)]
    groups = F.from_json(F.lit(json.dumps(listed)), "array<array<double>>")
    heads = F.from_json(F.lit(json.dumps([g[0] for g in listed])), "array<double>")
    nameless = -(-ranges * nulls // total) if total else 0
    place = (F.col("_hash").cast("double") / 2.0**64 + 0.5).alias("place")
    share = lambda n: F.least(F.floor(place * n), n - 1)
    low, high = _rank(groups, heads, number, False), _rank(groups, heads, number, True)
    named = let(low, lambda a: let(high, lambda b: a + share(b - a + 1))) + nameless
    dealt = df.withColumn("_hash", F.xxhash64(text)).withColumn("_range", F.when(F.col(key).isNull(), share(F.lit(nameless))).otherwise(named).cast("int"))
    # one id and hash for each range, 16,384 at most
    found = dealt.groupBy("_range").agg(F.min(F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("head"), F.col("_hash").alias("hash"))).alias("least")).collect()
    firsts = sorted(((r["_range"], r["least"]["head"], r["least"]["hash"]) for r in found), key=lambda x: x[0])
    before = [{"_to": firsts[i - 1][0], "_head": firsts[i][1], "_at": firsts[i][2]} for i in range(len(firsts))]
    first = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(before)), f"array<struct<_to:int,_head:{kind},_at:bigint>>")))
    same = F.col(key).eqNullSafe(F.col("_head")) & (F.col("_hash") == F.col("_at"))
    # rows alike in id and text are alike: one of them will do
    behind = dealt.join(F.broadcast(first), same).drop("_range").withColumnRenamed("_to", "_range").dropDuplicates(["_range"])
    rows = dealt.withColumn("_behind", F.lit(False)).unionByName(behind.select(*dealt.columns, F.lit(True).alias("_behind")))
    w = Window.partitionBy("_range").orderBy("_behind", F.col(key).asc_nulls_first(), "_hash", text)
    rows = rows.repartition("_range").withColumns(derived)
    return rows.select("*", *(F.lead(c).over(w).alias(n) for c, n in carried.items())).filter(~F.col("_behind")).drop("_range", "_behind", "_hash")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text, whose last quarter is the next document's beginning.

    near_edited and near_next are the likeness of its tree to the edited text's and the next document's; edit_section, edit_paragraph and
    edit_paragraphs tell where the edited text's tree differs from its own (:func:`differing`).
    """
    made = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edit_section", "edit_paragraph", "edit_paragraphs"]
    keep = [c for c in docs.columns if c.lower() not in made and c != text]
    marked = docs.select(*keep, F.coalesce(text, F.lit("")).alias("_text"))
    follows = with_next(marked, doc_id, "_text", {"_tree": tree(F.col("_text"))}, {"_text": "_next_text", "_tree": "_next"})
    n = F.char_length("_text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - quarter), F.substring(F.col("_next_text"), F.lit(1), quarter))
    own = F.col("_tree")

    def seen(e: Column) -> Column:
        return let(tree(e), lambda t: F.struct(F.sha2(e, 256).alias("sha256"), fingerprint(t).alias("fingerprint"), likeness(own, t).alias("near"), differing(own, t).alias("at")))

    return follows.withColumn("n_chars", n.cast("long")).withColumn("_edited", let(edited, seen)).select(
        *keep,
        "n_chars",
        F.col("_edited.sha256").alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"),
        F.col("_edited.fingerprint").alias("edited_fingerprint"),
        F.col("_edited.near").alias("near_edited"),
        likeness(own, F.col("_next")).alias("near_next"),
        F.col("_edited.at.section").alias("edit_section"),
        F.col("_edited.at.paragraph").alias("edit_paragraph"),
        F.col("_edited.at.paragraphs").alias("edit_paragraphs"),
    )
