"""Suffix-array dedup over sparse suffixes: passages of at least 50 words that occur more than once.

Of all suffixes only those at minimiser positions are kept: of every 40 consecutive words the one whose next three
words hash lowest. Each window of 50 words has its minimiser among its first 40 words, chosen by its own words, so equal windows
keep equal suffixes with at least 11 equal words ahead. A suffix whose first 11 words no other suffix has (by a 64-bit hash, which
may keep too many but never too few) is in no repeat and leaves. Suffixes whose whole surroundings (the words of all windows that chose them) are
alike by 128 bits of hash are judged by one of them. The rest is the sparse suffix array: the words ahead and, reversed, the words behind are
range-sorted as texts. Neighbours are compared word by word; a suffix is extended to the right as far as neighbours agree, and to the left by the
same comparison of the reversed words in their own order, so a window is repeated where a run of suffixes agrees in its words ahead and in its words
behind. Runs that reach the border of a task's part may go on behind it; their windows are brought together by 128 bits of hash. The result
is exact: a word is in a repeat if and only if a window of 50 words around it occurs elsewhere.

Defined results: windows may overlap in one text, so a text that repeats itself has repeats. The occurrence with the least
(doc_id, hash of the words, position) is the first one; ``removed`` has the words of later occurrences that are in no first
occurrence, so one copy of every passage stays. Rows alike in id and words are one document. Texts of fewer than 50
words, null and empty texts have no repeats. An empty table gives no rows. Null ids sort first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.arrow_text import mix, row_of, span_hashes, text_buffers, text_slices, word_bounds
from folioscope.llm.arrow_text import _power as power
from folioscope.llm.jaccard import with_keys, word_keys
from folioscope.llm.workspace import bounded_batches, discard, map_arrow, written

#: Words of a passage at least, words among which a minimiser is chosen, and words that decide it.
LENGTH, WINDOW, GRAM = 50, 40, 3
#: Bytes of the sorted suffixes of a task, and rows of them that are compared at once.
PART_BYTES, SEGMENT_ROWS = 1 << 23, 1 << 13
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_SECOND = 0xE7037ED1A0B428DB
_SECOND_INVERSE = pow(_SECOND, -1, 1 << 64)


class Words:
    """Words of a slice of rows, with hashes of any run of them."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        self.starts, self.ends, self.first = word_bounds(raw, offs)
        self.hashes = span_hashes(raw, self.starts, self.ends)
        self.sums = np.zeros(len(self.hashes) + 1, dtype=np.uint64)
        np.cumsum(self.hashes * power(_BASE, len(self.hashes)), out=self.sums[1:])
        character = np.cumsum((raw & 0xC0) != 0x80) - 1 if len(raw) else np.zeros(0, np.int64)
        base = np.zeros(len(offs) - 1, dtype=np.int64)
        inside = offs[:-1] < len(raw)
        base[inside] = character[offs[:-1][inside]]
        self.row = row_of(self.first)
        self.begin = character[self.starts] - base[self.row]
        self.stop = character[self.ends - 1] + 1 - base[self.row]

    def runs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words from a to before b."""
        return mix((self.sums[b] - self.sums[a]) * power(_INVERSE, len(self.sums))[a] + (b - a).astype(np.uint64))


def minimisers(words: Words, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of each kept suffix, as word numbers of the slice."""
    n = len(words.hashes)
    counts = np.diff(words.first)
    if not n or counts.max() < length:
        none = np.zeros(0, np.int64)
        return none, none, none
    bits = np.uint64(max(n.bit_length(), 1))
    # the place is in the low bits, so ties go to the leftmost
    least = mix(words.runs(np.arange(n), np.minimum(np.arange(n) + gram, n))) >> bits << bits | np.arange(n, dtype=np.uint64)
    wide = 1
    while wide * 2 <= window:
        least[: n - wide] = np.minimum(least[: n - wide], least[wide:])
        wide *= 2
    if rest := window - wide:
        least[: n - rest] = np.minimum(least[: n - rest], least[rest:])
    chosen = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    valid = np.arange(n) + length <= words.first[1:][words.row]
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (chosen[at[1:]] != chosen[at[:-1]])
    lead = np.flatnonzero(new)
    return chosen[at[lead]], at[lead], at[np.append(lead[1:] - 1, len(at) - 1)]


def suffixes(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The kept suffixes of (doc_id, text) rows: doc_id, k1 (hash of the words), prefix, around and around2, pos, chars and times.

    pos packs the first window's word number, how far the suffix lies behind it, and how many windows follow (16 bits each for these two); chars the first
    and last code point of all these windows. A text that repeats itself may have a suffix with the same surroundings many times:
    the first has their number as times; the windows of the others are later occurrences, and stand as spans without a prefix.
    """
    if not 0 < window <= min(length, 1 << 15):
        raise ValueError("a window has one word at least and no more than a passage or 32,768")
    kind = docs.schema["doc_id"].dataType.simpleString()
    ahead = length - window + 1

    def run(batches):
        for batch in batches:
            for rows, raw, offs in text_slices(batch, "text"):
                words = Words(raw, offs)
                place, low, high = minimisers(words, length, window, gram)
                if not len(low):
                    continue
                row = words.row[low]
                k1 = word_keys(words.hashes, words.first)[0]
                around = mix(words.runs(low, high + length) * np.uint64(3) + (place - low).astype(np.uint64)).view(np.int64)
                around2 = mix(_second(words, low, high + length) + (place - low).astype(np.uint64)).view(np.int64)
                prefix = words.runs(place, place + ahead).view(np.int64)
                first, times, again = _first_of_each(row, prefix, around)
                pos = (low - words.first[:-1][row]) << 32 | (place - low) << 16 | (high - low)
                begin, stop = words.begin[low], words.stop[high + length - 1]
                a, b = _joined(row[again], begin[again], stop[again])
                at = np.concatenate([first, again[a]])
                none = np.arange(len(at)) >= len(first)
                chars = np.concatenate([begin[first] << 32 | stop[first], begin[again[a]] << 32 | stop[again[b]]])
                weight = np.concatenate([times, np.ones(len(a), np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(rows.schema.get_field_index("doc_id")).take(pa.array(row[at])), pa.array(k1[row[at]]), pa.array(prefix[at], mask=none), pa.array(around[at], mask=none), pa.array(around2[at], mask=none), pa.array(pos[at], mask=none), pa.array(chars), pa.array(weight)],
                    names=["doc_id", "k1", "prefix", "around", "around2", "pos", "chars", "times"],
                )

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, k1 long, prefix long, around long, around2 long, pos long, chars long, times long")


def _second(words: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Another hash of the words from a to before b, from other hashes of the words."""
    other = mix(words.hashes ^ np.uint64(0xA0761D6478BD642F))
    sums = np.zeros(len(other) + 1, dtype=np.uint64)
    np.cumsum(other * power(_SECOND, len(other)), out=sums[1:])
    return mix((sums[b] - sums[a]) * power(_SECOND_INVERSE, len(sums))[a] + (b - a).astype(np.uint64))


def _first_of_each(row: np.ndarray, prefix: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the first of each key of a row, how often the key occurs in the row, places of all others)."""
    order = np.lexsort((np.arange(len(row)), around, prefix, row))
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[order[1:]] != row[order[:-1]]) | (prefix[order[1:]] != prefix[order[:-1]]) | (around[order[1:]] != around[order[:-1]])
    lead = np.flatnonzero(new)
    return order[lead], np.diff(np.append(lead, len(row))), np.sort(order[~new])


def _joined(row: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) places of runs of spans of a row that overlap; spans are in order."""
    if not len(row):
        return row, row
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (begin[1:] > stop[:-1])
    lead = np.flatnonzero(new)
    return lead, np.append(lead[1:] - 1, len(row) - 1)


CONTEXT = "k1 long, place long, least int, most int, several boolean, ahead string, behind string, begins array<int>, stops array<int>"


def contexts(held: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each listed suffix of rows (doc_id, k1, text, several: places), with its words.

    ahead: the words from the suffix to the end of its last window, each with a space behind it; behind: the words back to its first
    window's begin, the nearest first, in the same way. least and most: how many words of its windows lie behind it; for each such number the first and last code point
    of the window.
    """
    kind = held.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for rows, raw, offs in text_slices(batch, "text"):
                words = Words(raw, offs)
                own = word_keys(words.hashes, words.first)[0] == np.asarray(rows.column(rows.schema.get_field_index("k1")))
                listed = rows.column(rows.schema.get_field_index("places"))
                sizes = np.diff(np.asarray(listed.offsets))
                flat = listed.flatten()
                row = np.repeat(np.arange(rows.num_rows), sizes)
                pos, several = (np.asarray(flat.field(n).cast(pa.int64())) for n in ("pos", "several"))
                keep = own[row]
                row, pos, several = row[keep], pos[keep], several[keep]
                low, most, more = pos >> 32, pos >> 16 & 0xFFFF, pos & 0xFFFF
                place, least = low + most, most - more
                ahead, behind, begins, stops = [], [], [], []
                last, split = -1, []
                for k in range(len(row)):
                    r = int(row[k])
                    if r != last:
                        last, split = r, raw[offs[r] : offs[r + 1]].tobytes().split()
                    p, m, n, f = int(place[k]), int(most[k]), int(least[k]), int(words.first[r])
                    ahead.append(b" ".join(split[p : p + length - n]) + b" ")
                    behind.append(b" ".join([*split[p - m : p][::-1], b""]))
                    begins.append(words.begin[f + p - m : f + p - n + 1][::-1].astype(np.int32))
                    stops.append(words.stop[f + p - m + length - 1 : f + p - n + length][::-1].astype(np.int32))
                ids = rows.column(rows.schema.get_field_index("doc_id")).take(pa.array(row))
                ends = pa.array(np.concatenate([[0], np.cumsum(more + 1)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids, rows.column(rows.schema.get_field_index("k1")).take(pa.array(row)), pa.array(place), pa.array(least, pa.int32()), pa.array(most, pa.int32()), pa.array(several == 1),
                     pa.array(ahead, pa.binary()).cast(pa.string()), pa.array(behind, pa.binary()).cast(pa.string()), *(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *x]))) for x in (begins, stops))],
                    names=["doc_id", *(x.split()[0] for x in CONTEXT.split(", "))],
                )

    return map_arrow(held.select("doc_id", "k1", "text", "places"), run, f"doc_id {kind}, {CONTEXT}")


def common_words(texts: pa.Array) -> np.ndarray:
    """How many leading words each text shares with the next one; each word has a space behind it."""
    raw, offs = text_buffers(texts)
    n = len(offs) - 1
    out = np.zeros(max(n - 1, 0), dtype=np.int64)
    sizes = np.diff(offs)
    both = np.minimum(sizes[:-1], sizes[1:])
    first = 0
    while first < n - 1:
        last = max(int(np.searchsorted(offs, offs[first] + (1 << 20))), first + 1)
        last = min(last, n - 1)
        m = both[first:last]
        begin = np.cumsum(m) - m
        inside = np.arange(m.sum()) - np.repeat(begin, m)
        a = raw[np.repeat(offs[first:last], m) + inside]
        unlike = a != raw[np.repeat(offs[first + 1 : last + 1], m) + inside]
        # words end before the first byte that differs
        seen = np.concatenate([[0], np.cumsum(a == 32)])
        where = np.concatenate([np.flatnonzero(unlike), [len(unlike)]])
        stop = np.minimum(where[np.searchsorted(where, begin)], begin + m)
        out[first:last] = seen[stop] - seen[begin]
        first = last
    return out


def _spans_of_windows(rows: pa.Table, length: int, known: tuple[bool, bool]):
    """What neighbours tell of a run of sorted suffixes: (row, chars, leads) of repeated windows, and (row, words behind, chars) of windows that may go on elsewhere.

    known: whether no suffix before or after these shares the least words ahead.
    """
    n = rows.num_rows
    column = {c: rows.column(c).combine_chunks() for c in rows.column_names}
    place, least, most = (np.asarray(column[c]).astype(np.int64) for c in ("place", "least", "most"))
    several = np.asarray(column["several"].cast(pa.int8())) == 1
    right = common_words(column["ahead"])
    order = np.asarray(pc.sort_indices(column["behind"]))
    left = common_words(column["behind"].take(pa.array(order)))
    # suffixes beyond a border agree with a row in no more words than the row at the border does
    edge = np.zeros(n, dtype=np.int64)
    if not known[0]:
        edge = np.maximum(edge, np.minimum.accumulate(np.concatenate([[length], right])))
    if not known[1]:
        edge = np.maximum(edge, np.minimum.accumulate(np.concatenate([[length], right[::-1]]))[::-1])
    names = pa.table({"id": column["doc_id"], "k1": column["k1"], "place": column["place"]})
    rank = np.empty(n, dtype=np.int64)
    rank[np.asarray(pc.sort_indices(names, sort_keys=[("id", "ascending"), ("k1", "ascending"), ("place", "ascending")], null_placement="at_start"))] = np.arange(n)
    wide = int(most.max()) + 1
    state = np.zeros((n, wide + 1), dtype=np.int8)
    open_row, open_behind = [], []
    for d in range(int(least.min()), wide):
        own = np.flatnonzero((least <= d) & (d <= most))
        out = edge[own] >= length - d
        open_row.append(own[out])
        open_behind.append(np.full(int(out.sum()), d))
        own = own[~out]
        if not len(own):
            continue
        ahead = np.concatenate([[0], np.cumsum(right < length - d)])
        behind = np.empty(n, dtype=np.int64)
        behind[order] = np.concatenate([[0], np.cumsum(left < d)])
        key = ahead[own] * n + behind[own]
        by = np.lexsort((rank[own], key))
        new = np.ones(len(own), dtype=bool)
        new[1:] = key[by[1:]] != key[by[:-1]]
        lead = np.flatnonzero(new)
        size = np.repeat(np.diff(np.append(lead, len(own))), np.diff(np.append(lead, len(own))))
        state[own[by], d] = np.where(several[own[by]] | (size > 1), np.where(new, 1, 2), 0)
    # windows of neighbouring numbers overlap, so those that are alike are one span
    change = np.ones((n, wide + 1), dtype=bool)
    change[:, 1:] = state[:, 1:] != state[:, :-1]
    at = np.flatnonzero(change.reshape(-1))
    end = np.append(at[1:], n * (wide + 1)) - 1
    some = state.reshape(-1)[at] > 0
    row, first, last = at[some] // (wide + 1), at[some] % (wide + 1), end[some] % (wide + 1)
    begins, stops = (np.asarray(column[c].flatten()).astype(np.int64) for c in ("begins", "stops"))
    flat = np.asarray(column["begins"].offsets).astype(np.int64)
    flat = flat[:-1] - flat[0]
    chars = begins[flat[row] + last - least[row]] << 32 | stops[flat[row] + first - least[row]]
    go_row, go_behind = np.concatenate([np.zeros(0, np.int64), *open_row]), np.concatenate([np.zeros(0, np.int64), *open_behind])
    at = flat[go_row] + go_behind - least[go_row]
    return row, chars, state[row, first] == 1, go_row, go_behind, begins[at] << 32 | stops[at]


def _window_hashes(rows: pa.Table, row: np.ndarray, behind: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of the words of windows, given how many of them lie behind the suffix."""
    out = [np.zeros(len(row), np.uint64), np.zeros(len(row), np.uint64)]
    for c, many in (("ahead", length - behind), ("behind", behind)):
        raw, offs = text_buffers(rows.column(c))
        spaces = np.flatnonzero(raw == 32) if len(raw) else np.zeros(0, np.int64)
        before = np.searchsorted(spaces, offs[:-1])
        starts = offs[:-1][row]
        ends = np.where(many > 0, spaces[np.minimum(before[row] + many - 1, max(len(spaces) - 1, 0))] + 1 if len(spaces) else starts, starts)
        for k, data in enumerate((raw, LOWER_BITS[raw])):
            out[k] = mix(out[k] * np.uint64(0x9FB21C651E98DF25) + span_hashes(data, starts, ends) + many.astype(np.uint64))
    return out[0].view(np.int64), out[1].view(np.int64)


#: A permutation of the bytes, for a second hash of the same text.
LOWER_BITS = ((np.arange(256) * 167 + 91) % 256).astype(np.uint8)


def neighbours(suffix: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """The sorted suffixes compared: (doc_id, k1, s, chars, leads) of repeated windows, and with hashes w1 and w2 those whose runs reach a border."""
    total = suffix.agg(F.sum(F.octet_length("ahead") + F.octet_length("behind"))).first()[0] or 0
    parts = int(max(suffix.sparkSession.sparkContext.defaultParallelism, min(total // PART_BYTES, 100_000)))
    kind = suffix.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(x.split()[0] for x in CONTEXT.split(", "))]
    fewest, segment = length - window + 1, SEGMENT_ROWS

    def made(rows: pa.Table, known: tuple[bool, bool]):
        row, chars, leads, go, behind, open_chars = _spans_of_windows(rows, length, known)
        w1, w2 = _window_hashes(rows, go, behind, length)
        at = np.concatenate([row, go])
        none = np.arange(len(at)) < len(row)
        several = np.asarray(rows.column("several").combine_chunks().cast(pa.int8())) == 1
        s = np.concatenate([np.zeros(len(row), np.int64), np.asarray(rows.column("place").combine_chunks())[go] - behind])
        hashes = [pa.array(np.concatenate([np.zeros(len(row), np.int64), w]), mask=none) for w in (w1, w2)]
        take = pa.array(at)
        yield pa.RecordBatch.from_arrays(
            [*(rows.column(c).combine_chunks().take(take) for c in ("doc_id", "k1")), pa.array(s), pa.array(np.concatenate([chars, open_chars])), pa.array(np.concatenate([leads, several[go]])), *hashes],
            names=["doc_id", "k1", "s", "chars", "leads", "w1", "w2"],
        )

    def run(batches):
        rest: pa.Table | None = None
        known = False
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            if rest.num_rows < segment:
                continue
            # cut where neighbours share too few words for any window, or where it must be
            apart = np.flatnonzero(common_words(rest.column("ahead").combine_chunks()) < fewest)
            cut = int(apart[-1]) + 1 if len(apart) else rest.num_rows
            yield from made(rest.slice(0, cut).combine_chunks(), (known, bool(len(apart))))
            rest, known = rest.slice(cut), bool(len(apart))
        if rest is not None and rest.num_rows:
            yield from made(rest.combine_chunks(), (known, False))

    sort = suffix.select(*names).repartitionByRange(parts, "ahead", "behind").sortWithinPartitions("ahead", "behind")
    return map_arrow(sort, run, f"doc_id {kind}, k1 long, s long, chars long, leads boolean, w1 long, w2 long")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, k1, spans, removed) of each document with a repeat; spans are (start, end) in code points, end exclusive."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kept = written(suffixes(source, length, window, gram), "suffixes")
    # sides of joins that come from an aggregate are written, so that joins are of plain shuffles and hot keys can be split
    around = F.struct("around", "around2")
    near = kept.filter("prefix is not null").groupBy("prefix").agg(F.sum("times").alias("n"), F.min(around).alias("a"), F.max(around).alias("b")).filter("n > 1")
    near = written(near.select("prefix", (F.col("a") != F.col("b")).alias("mixed")), "prefixes")
    found = written(kept.join(near, "prefix"), "matches")
    place = F.struct("doc_id", "k1", "pos")
    key = ["prefix", "around", "around2"]
    same = written(found.groupBy(*key).agg(F.sum("times").alias("n"), F.min(place).alias("first")), "surroundings")
    judged = written(found.join(same, key).withColumn("leads", place.eqNullSafe(F.col("first"))).filter("n > 1 or mixed").select("doc_id", "k1", "pos", "chars", "leads", "mixed", (F.col("n") > 1).alias("several")), "judged")
    again = written(kept.filter("prefix is null").select("doc_id", "k1", "chars", F.lit(False).alias("leads")), "again")
    discard(kept, near, found, same)
    whole = judged.filter("not leads or not mixed").select("doc_id", "k1", "chars", "leads")
    # only the first suffix of each surrounding is in the array
    asked = judged.filter("leads and mixed").groupBy("doc_id", "k1").agg(F.collect_set(F.struct("pos", "several")).alias("places"))
    named = asked.filter("doc_id is not null").join(source.filter("doc_id is not null"), "doc_id")
    nameless = asked.filter("doc_id is null").join(with_keys(source.filter("doc_id is null")).select("k1", "text"), "k1")
    held = named.select("doc_id", "k1", "text", "places").unionByName(nameless.select("doc_id", "k1", "text", "places"))
    # rows alike in id and words have the same suffixes
    array = written(contexts(held, length), "suffix-array")
    compared = written(neighbours(array, length, window), "windows")
    discard(array)
    part = compared.filter("w1 is null").select("doc_id", "k1", "chars", "leads")
    border = compared.filter("w1 is not null").withColumnRenamed("leads", "several")
    spot = F.struct("doc_id", "k1", "s")
    twice = written(border.groupBy("w1", "w2").agg(F.min(spot).alias("first"), F.max(spot).alias("last"), F.max("several").alias("copied")).filter("first <> last or copied"), "border-windows")
    beyond = border.join(twice, ["w1", "w2"]).select("doc_id", "k1", "chars", spot.eqNullSafe(F.col("first")).alias("leads"))
    return merged(whole.unionByName(part).unionByName(beyond).unionByName(again))


def _union(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint spans with the same points."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), dtype=bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    at = np.flatnonzero(new)
    return np.stack([spans[at, 0], np.append(reach[at[1:] - 1], reach[-1])], axis=1)


def _without(spans: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Parts of disjoint sorted spans that lie in none of the others."""
    out = []
    for a, b in spans.tolist():
        for c, d in other[(other[:, 1] > a) & (other[:, 0] < b)].tolist():
            if c > a:
                out.append((a, c))
            a = max(a, d)
        if a < b:
            out.append((a, b))
    return np.array(out, dtype=np.int64).reshape(-1, 2)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def merged(rows: DataFrame) -> DataFrame:
    """Spans of a document together; a document has no more of them than words."""
    grouped = rows.groupBy("doc_id", "k1").agg(F.collect_list(F.struct("chars", "leads")).alias("parts"))
    schema = T.StructType([grouped.schema["doc_id"], grouped.schema["k1"]]).add("spans", SPANS).add("removed", SPANS)

    def run(batches):
        for batch in batches:
            parts = batch.column(2)
            offs = np.asarray(parts.offsets)
            flat = parts.flatten()
            chars, leads = np.asarray(flat.field("chars")), np.asarray(flat.field("leads").cast(pa.int8())) == 1
            pairs = np.stack([chars >> 32, chars & 0xFFFFFFFF], axis=1)
            offs = offs - offs[0]
            spans, removed = [], []
            for a, b in zip(offs[:-1], offs[1:], strict=True):
                own, first = pairs[a:b], leads[a:b]
                later = _without(_union(own[~first]), _union(own[first]))
                for out, found in ((spans, _union(own)), (removed, later)):
                    out.append([{"start": x, "end": y} for x, y in found.tolist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _ARROW_SPANS), pa.array(removed, _ARROW_SPANS)], names=schema.names)

    return map_arrow(grouped, run, schema)


def cut_out(text: Column, removed: Column) -> Column:
    """A text without its removed spans; what stays is joined as it stands."""
    parts = F.transform(
        F.concat(removed, F.array(F.struct(F.char_length(text).cast("long").alias("start"), F.char_length(text).cast("long").alias("end")))),
        lambda r, i: F.substring(text, F.when(i == 0, F.lit(0)).otherwise(F.get(removed, i - 1)["end"]).cast("int") + 1, (r["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(removed, i - 1)["end"])).cast("int")),
    )
    return F.when(removed.isNull() | (F.size(removed) == 0), text).otherwise(F.array_join(parts, ""))
