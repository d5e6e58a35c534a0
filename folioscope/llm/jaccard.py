"""N-gram Jaccard join: MinHash banding, a shuffle on band hashes, and pairs verified on full n-gram sets.

Documents are compared by the sets of their 5-word shingles (:mod:`arrow_text`); a link joins two documents of
similarity 0.8 or more. Documents of equal words are one node; links between nodes count as often as their copies.
Bands come from the target recall. A bucket of equal band hashes gives one edge from each member to its least member, not
its pairs; the components of these edges hold every pair that shares a bucket. Members meet in square blocks of nodes, bounded in rows
and bytes: those of their component, or, where a component is so large that its blocks would outnumber the bands, those of each of
their buckets. In a block the pairs that share a band (in a bucket's block: that band and none before) are verified on their full shingle sets,
each pair once, and give counts and a spanning edge for each node, never rows for pairs.

Defined results: one row per document: class_id (the least doc_id of the documents it is linked to by a chain of links, its own
without links) and n_links. Texts without a word link to nothing, not to each other either; texts of fewer than five
words have one shingle of all their words. Repeated rows are copies of each other; a null doc_id is a document
whose class has the least id that is not null, or null. An empty table gives no rows. Only the id column stays. Components that do not
settle in 60 rounds (a chain of some 2**30 links) raise ``RuntimeError``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.arrow_text import mix, ngram_hashes, span_hashes, text_slices, word_bounds
from folioscope.llm.components import connected_components
from folioscope.llm.workspace import bounded_batches, discard, map_arrow, written

SHINGLE, THRESHOLD = 5, 0.8
#: Minima in a band, and the share of pairs at the threshold that must meet in a bucket.
ROWS, RECALL = 8, 0.9999
#: Nodes on a side of a block of pairs: a sixteenth of the group between these, and as many as hold so many bytes of text; and cells of its matrix
#: that are held at once.
LEAST_SIDE, MOST_SIDE, SIDE_BYTES, CELLS = 128, 1024, 1 << 23, 1 << 22


def bands_for(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> int:
    """The fewest bands with which a pair at the threshold shares a bucket at that rate."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _draws(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20_24)).integers(1 << 62, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


def word_keys(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's sequence of words."""
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        each = mix(words * np.uint64(salt) + mix(place + np.uint64(salt)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        out.append(mix(sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """doc_id, the two hashes of its words (null without a word), the bytes of its text, and a hash for each band."""
    bands = bands_for(threshold, rows, recall)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = [f"b{k}" for k in range(bands)]
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches):
        draws = _draws(bands * rows)
        for batch in batches:
            for part, raw, offs in text_slices(batch, "text"):
                starts, ends, first = word_bounds(raw, offs)
                words = span_hashes(raw, starts, ends)
                grams, begin = ngram_hashes(words, first, shingle)
                k1, k2 = word_keys(words, first)
                some = np.flatnonzero(np.diff(begin) > 0)
                none = np.diff(begin) == 0
                made = []
                at = begin[some]
                for band in range(bands):
                    joined = np.full(len(some), band + 1, dtype=np.uint64)
                    for row in range(rows):
                        if len(some):
                            joined = mix(joined * np.uint64(0x100000001B3) + np.minimum.reduceat(grams * draws[band * rows + row], at))
                    whole = np.zeros(len(none), dtype=np.int64)
                    whole[some] = joined.view(np.int64)
                    made.append(pa.array(whole, mask=none))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(k1, mask=none), pa.array(k2, mask=none), pa.array(np.diff(offs)), *made], names=["doc_id", "k1", "k2", "size", *names])

    return map_arrow(source, run, f"doc_id {kind}, k1 long, k2 long, size long, " + ", ".join(f"{n} long" for n in names))


def with_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds k1 and k2, the two hashes of a text's words (null without a word)."""
    keep = [c for c in docs.columns if c not in ("k1", "k2")]
    source = docs.select(*keep)
    schema = T.StructType([*source.schema.fields]).add("k1", "long").add("k2", "long")

    def run(batches):
        for batch in batches:
            for rows, raw, offs in text_slices(batch, text):
                starts, ends, first = word_bounds(raw, offs)
                none = np.diff(first) == 0
                k1, k2 = word_keys(span_hashes(raw, starts, ends), first)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(k1, mask=none), pa.array(k2, mask=none)], names=schema.names)

    return map_arrow(source, run, schema)


def verify(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of ``left`` by ``right`` rows have Jaccard similarity of the threshold or more."""
    rows = np.concatenate([left, right])
    sizes = np.array([len(sets[r]) for r in rows])
    values, column, count = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), sizes)
    shared = count > 1  # no other column adds to an intersection of two rows
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = int(shared.sum())
    common = np.zeros((len(left), len(right)))
    wide = max(256, CELLS // len(rows))
    for a in range(0, total, wide):
        lo, hi = np.searchsorted(column, [a, a + wide])
        dense = np.zeros((len(rows), min(wide, total - a)), dtype=np.float32)
        dense[row[lo:hi], column[lo:hi] - a] = 1
        common += dense[: len(left)] @ dense[len(left) :].T
    union = sizes[: len(left), None] + sizes[None, len(left) :] - common
    return common >= threshold * union - 1e-9


def _roots(near: np.ndarray) -> np.ndarray:
    """The least row that each row of a symmetric relation reaches."""
    label = np.arange(len(near))
    while True:
        least = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near)))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def candidates(left: np.ndarray, right: np.ndarray, band: int = -1) -> np.ndarray:
    """Which pairs of rows of band hashes share a band; or share ``band`` and none before it."""
    def some(upto: int) -> np.ndarray:
        out = np.zeros((len(left), len(right)), dtype=bool)
        step = max(1, CELLS // max(out.size, 1))
        for k in range(0, upto, step):
            out |= (left[:, None, k : min(k + step, upto)] == right[None, :, k : min(k + step, upto)]).any(axis=2)
        return out

    if band < 0:
        return some(left.shape[1])
    return (left[:, None, band] == right[None, :, band]) & ~some(band)


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, asked: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the asked pairs of ``left`` by ``right`` rows have Jaccard similarity of the threshold or more."""
    out = np.zeros(asked.shape, dtype=bool)
    rows, columns = np.flatnonzero(asked.any(axis=1)), np.flatnonzero(asked.any(axis=0))
    if asked.sum() > 4 * (len(rows) + len(columns)):
        out[np.ix_(rows, columns)] = verify(sets, left[rows], right[columns], threshold)
        return out & asked
    for i, j in zip(*np.nonzero(asked), strict=True):
        x, y = sets[left[i]], sets[right[j]]
        if min(len(x), len(y)) >= threshold * max(len(x), len(y)) - 1e-9:
            common = len(np.intersect1d(x, y, assume_unique=True))
            out[i, j] = common >= threshold * (len(x) + len(y) - common) - 1e-9
    return out


_BLOCK = ["root", "band", "a", "b"]


def _blocks_links(rows: pa.Table, shingle: int, threshold: float):
    """(node, links, a node that it is linked with by a chain) for the nodes of whole blocks, in the order of ``_BLOCK``."""
    column = {n: rows.column(n).combine_chunks() for n in (*_BLOCK, "c", "node", "n")}
    key = np.stack([np.asarray(column[n]).astype(np.int64) for n in _BLOCK])
    own, node, weight = (np.asarray(column[n]).astype(np.int64) for n in ("c", "node", "n"))
    listed = rows.column("bands").combine_chunks()
    bands = np.asarray(listed.flatten()).reshape(rows.num_rows, -1)
    sets: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    for batch in rows.select(["text"]).combine_chunks().to_batches():
        for _, raw, offs in text_slices(batch, "text"):
            starts, ends, first = word_bounds(raw, offs)
            words = span_hashes(raw, starts, ends)
            keys.append(word_keys(words, first)[0])
            grams, begin = ngram_hashes(words, first, shingle)
            sets += [np.unique(grams[s:e]) for s, e in zip(begin[:-1], begin[1:], strict=True)]
    own_words = np.concatenate(keys) == node
    cuts = np.concatenate([[0], np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1, [rows.num_rows]])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        # one row for each node, with its own words (ids may repeat); the least node comes first, so that the least row is the least node
        at = np.arange(s, e)[own_words[s:e]]
        at = at[np.unique(node[at], return_index=True)[1]]
        near = np.zeros((len(at), len(at)), dtype=bool)
        if key[2, s] == key[3, s]:
            left = right = np.arange(len(at))
        else:
            left, right = np.flatnonzero(own[at] == key[2, s]), np.flatnonzero(own[at] == key[3, s])
        if len(left) and len(right):
            asked = candidates(bands[at[left]], bands[at[right]], int(key[1, s]))
            if left is right:
                asked = np.triu(asked, 1)
            found = linked(sets, at[left], at[right], asked, threshold)
            near[np.ix_(left, right)] = found
            near |= near.T
        links = near @ weight[at]
        root = node[at][_roots(near)]
        some = links > 0
        out.append((node[at][some], links[some], root[some]))
    return [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]


def _links(members: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links and spanning edges of members (root and band: the group, g: parts of it, node, n, text, bands)."""
    dealt = members.withColumn("c", F.pmod(F.xxhash64("node"), F.col("g")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    names = [*_BLOCK, "c", "node", "n", "text", "bands"]
    blocks = dealt.select("root", "band", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "c", "node", "n", "text", "bands")

    def run(batches):
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            last = [rest.column(n)[rest.num_rows - 1].as_py() for n in _BLOCK] if rest.num_rows else None
            if last is None:
                continue
            same = np.ones(rest.num_rows, dtype=bool)
            for n, v in zip(_BLOCK, last, strict=True):
                same &= np.asarray(rest.column(n).combine_chunks()) == v
            whole = int((~same).sum())
            if whole:
                yield from made(rest.slice(0, whole))
                rest = rest.slice(whole)
        if rest is not None and rest.num_rows:
            yield from made(rest)

    def made(rows: pa.Table):
        node, links, root = _blocks_links(rows, shingle, threshold)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(root)], names=["node", "links", "root"])

    return map_arrow(blocks.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).select(*names), run, "node long, links long, root long")


def _groups(found: DataFrame, nodes: DataFrame, dealt: DataFrame, buckets: DataFrame, bands: int) -> tuple[DataFrame, list[DataFrame]]:
    """(node, root, band, g): the groups in which nodes meet, and in how many parts each is; and the tables this reads."""
    def parts(m, mean):
        side = F.least(F.greatest(F.ceil(m / 16), F.lit(LEAST_SIDE)), F.lit(MOST_SIDE), F.greatest(F.lit(16), F.floor(SIDE_BYTES / F.greatest(mean, F.lit(1)))))
        return F.ceil(m / side).cast("int")

    known = found.join(nodes.select(F.col("k1").alias("node"), "size"), "node")
    sizes = written(known.groupBy("root").agg(F.count("*").alias("m"), F.avg("size").alias("mean")).withColumn("g", parts(F.col("m"), F.col("mean"))), "sizes")
    within = found.join(sizes, "root")
    whole = within.filter(F.col("g") <= bands).select("node", "root", F.lit(-1).alias("band"), "g")
    if sizes.filter(F.col("g") > bands).isEmpty():
        return whole, [sizes]
    met = within.filter(F.col("g") > bands).select("node", "mean").join(dealt, "node").join(buckets, "hash")
    own = met.select("node", F.col("hash").alias("root"), "band", parts(F.col("c"), F.col("mean")).alias("g"))
    return whole.unionByName(own), [sizes]


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL, with_key: bool = False) -> DataFrame:
    """doc_id, class_id and n_links of every document; ``with_key`` adds k1, k2 (its words) and class_key."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marks = written(signatures(source, "doc_id", "text", shingle, threshold, rows, recall), "signatures")
    names = [c for c in marks.columns if c.startswith("b")]
    copies = marks.filter("k1 is not null").groupBy("k1", "k2")
    nodes = written(copies.agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.min("size").alias("size"), F.array(*(F.min(b) for b in names)).alias("bands")), "nodes")
    # sides of joins that come from an aggregate are written, so that joins are of plain shuffles and hot keys can be split
    dealt = nodes.select(F.col("k1").alias("node"), F.posexplode("bands").alias("band", "hash"))
    buckets = written(dealt.groupBy("hash").agg(F.min("node").alias("least"), F.count("*").alias("c")).filter("c > 1"), "buckets")
    edges = dealt.join(buckets, "hash").filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    stars = connected_components(edges)
    found = written(stars, "candidates")
    groups, read = _groups(found, nodes, dealt, buckets, len(names))
    ids = groups.join(nodes.select(F.col("k1").alias("node"), "k2", "n", "rep", "bands"), "node")
    texts = source.filter("doc_id is not null").withColumnRenamed("doc_id", "rep")
    nameless = with_keys(source.filter("doc_id is null")).select(F.col("k1").alias("node"), "k2", "text")
    columns = ["root", "band", "g", "node", "n", "text", "bands"]
    members = ids.filter("rep is not null").join(texts, "rep").select(*columns).unionByName(ids.filter("rep is null").join(nameless, ["node", "k2"]).select(*columns))
    links = written(_links(members, shingle, threshold), "links")
    classes = connected_components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = written(
        nodes.select(F.col("k1").alias("node"), "k2", "rep", "n").join(classes, "node", "left").join(counted, "node", "left").withColumn("class_key", F.coalesce("root", "node")), "named"
    )
    discard(nodes, buckets, stars, found, links, classes, *read)
    least = written(named.filter("root is not null").groupBy("class_key").agg(F.min("rep").alias("least")), "least-ids")
    each = named.join(least, "class_key", "left").select(F.col("node").alias("k1"), "k2", "class_key", F.coalesce("least", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = marks.select("doc_id", "k1", "k2").join(each, ["k1", "k2"], "left")
    extra = ["k1", "k2", "class_key"] if with_key else []
    return out.select(F.col("doc_id"), F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *extra)
