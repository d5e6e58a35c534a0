"""Packing: token sequences of a fixed size from documents, shortest pack first over the length histogram.

Each document's ids and one end id are cut at multiples of the sequence size. Only the histogram of piece
lengths (as many counts as the sequence size) reaches the driver; it is packed there, longest length first, each
time into the shortest pack that has room, with one count for all packs of a pattern. Pieces find their pack by
their rank among the pieces of their length, counted in hash buckets so that no length is one task's work.

Where a length opens new packs, each takes as many pieces of it as fit, so a corpus of short documents fills up too.

Defined results: a null or empty text is its end id alone; an empty table gives no rows; repeated rows are
documents of their own; the table of pieces is written once, so a piece's rank is the same however often a
task runs. Of other input columns only the id column is kept.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.arrow_text import text_slices
from folioscope.llm.bpe import SLICE_BYTES, encoder
from folioscope.llm.workspace import bounded_batches, map_arrow, written

SIZE = 2048
END_ID = 1
#: Pieces that one hash bucket of a length's ranks should have at most, and the fewest and most buckets. With all pieces of one
#: length, 65,536 buckets of 100,000 hold 6.5 * 10**9 pieces, some 50 TB of text; beyond that buckets grow and their sorts spill.
BUCKET_PIECES, FEWEST, MOST = 100_000, 64, 65_536


@dataclass(frozen=True)
class Pattern:
    """``packs`` packs that each hold ``parts``: (length, how many), longest first."""

    packs: int
    parts: tuple[tuple[int, int], ...]


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """Patterns that hold every piece of the histogram once.

    There are at most two patterns for each length and each pattern that it meets; their number depends on
    ``size`` and not on the number of pieces.
    """
    open_by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []  # a heap of the negative rooms that have open patterns

    def keep(pattern: Pattern, room: int) -> None:
        if room not in open_by_room:
            open_by_room[room] = []
            heapq.heappush(rooms, -room)
        open_by_room[room].append(pattern)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or -rooms[0] < length:
                each = size // length
                if whole := left // each:
                    keep(Pattern(whole, ((length, each),)), size - each * length)
                if rest := left % each:
                    keep(Pattern(1, ((length, rest),)), size - rest * length)
                break
            room = -rooms[0]
            found = open_by_room[room].pop()
            if not open_by_room[room]:
                del open_by_room[room]
                heapq.heappop(rooms)
            each = room // length
            packs = min(found.packs, left // each)
            if not packs:
                each, packs = left, 1
            keep(Pattern(packs, (*found.parts, (length, each))), room - each * length)
            left -= packs * each
            if found.packs > packs:
                keep(Pattern(found.packs - packs, found.parts), room)
    merged: Counter[tuple] = Counter()
    for patterns in open_by_room.values():
        for p in patterns:
            merged[p.parts] += p.packs
    return [Pattern(n, parts) for parts, n in sorted(merged.items(), reverse=True)]


def slots(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each pattern and length: its first rank, first sequence, pieces in a pack, and place in the pack."""
    rows, used, sequence = [], Counter(), 0
    for p in patterns:
        place = 0
        for length, each in p.parts:
            rows.append((length, used[length], sequence, each, place))
            used[length] += p.packs * each
            place += each * length
        sequence += p.packs
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "place"), table.T, strict=True))


def pieces(docs: DataFrame, definition: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``size`` ids: doc_id, start, length, ids_crc32, doc_tokens, and the ids if asked for."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([source.schema["doc_id"]])
    made = ["start", "length", "ids_crc32", "doc_tokens"]
    for n in made:
        schema.add(n, "long")
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        own = encoder(definition)
        for batch in batches:
            for rows, raw, offs in text_slices(batch, "text", SLICE_BYTES):
                ids, first = own.encode(raw, offs)
                n = len(first) - 1
                ends = first[1:] + np.arange(1, n + 1)
                whole = np.empty(len(ids) + n, dtype="<u4")
                stop = np.zeros(len(whole), dtype=bool)
                stop[ends - 1] = True
                whole[stop], whole[~stop] = end_id, ids
                tokens = np.diff(first) + 1
                cuts = -(-tokens // size)
                row = np.repeat(np.arange(n), cuts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * size
                length = np.minimum(tokens[row] - start, size)
                begin = (ends - tokens)[row] + start
                view = memoryview(whole).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                columns = [rows.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[row])]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(whole)), pa.int32()), pa.array(whole.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_arrow(source, run, schema)


def pack(cut: DataFrame, size: int = SIZE, keys: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length``; ``keys`` order pieces of the same length."""
    spark = cut.sparkSession
    kept = written(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(x is None or not 0 < x <= size for x in histogram):
        raise ValueError(f"lengths from 1 to {size} are expected")
    table = slots(shortest_pack_first(histogram, size))
    total = sum(histogram.values())
    buckets = min(MOST, max(FEWEST, total // BUCKET_PIECES))
    dealt = kept.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("length", "_bucket").orderBy(*keys)
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(bases, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    out = ranked.select(*kept.columns, "_rank")
    schema = T.StructType([*kept.schema.fields]).add("sequence_id", "long").add("offset", "long")
    spread = int(max(histogram.values(), default=0)) + 1

    def run(batches):
        at_key = table["length"] * spread + table["rank"]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))).astype(np.int64) for c in ("length", "_rank"))
            slot = np.searchsorted(at_key, length * spread + rank, side="right") - 1
            pack_no, place = np.divmod(rank - table["rank"][slot], table["each"][slot])
            made = [pa.array(table["sequence"][slot] + pack_no), pa.array(table["place"][slot] + place * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema.names)

    if not total:
        return spark.createDataFrame([], schema)
    return map_arrow(out, run, schema)


def packed_documents(docs: DataFrame, definition: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their sequences."""
    return pack(pieces(docs, definition, doc_id, text, size, with_ids=with_ids), size)
