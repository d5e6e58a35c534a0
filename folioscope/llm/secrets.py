"""Secret scans: fixed patterns, and a password guess-cost dynamic programme for values in credential contexts.

A value's cost is the least sum of log10 guesses over its segmentations into words, dates, repeats, keyboard walks
and brute-force spans. A value of at least ``MIN_VALUE`` characters that costs ``MIN_COST`` or more is a span of kind
``guess``, unless one span of the fixed patterns contains all of it; it may overlap such spans.

Defined results: offsets are code points, ends exclusive; a null or empty text has no spans; each row is scanned by
itself, so repeated rows repeat their spans; very long values are segmented whole (the work grows with their length,
not its square). Extra columns stay; one named like a computed column is replaced.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.arrow_text import text_slices
from folioscope.llm.bpe import kept_columns, read_ranks, with_rows
from folioscope.llm.workspace import bounded_batches, map_arrow

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|(?:api|access|private|secret(?:[_-]?access)?)[_-]?key|client[_-]?secret|auth(?:orization)?|credentials?|login|bearer)[\"']?\x20*[:=]"
#: Names may have a prefix that ends in other than a letter or digit; a scheme word before a value is not part of it.
CONTEXT = re.compile(
    rf"""(?<![A-Za-z0-9]){_NAME}{{1,2}}\x20*["']?(?:(?:bearer|basic|token)\x20+(?!{_NAME}))?([^\s"'<>,;]+)""",
    re.I | re.A,
)
MIN_VALUE = 8
#: log10 of the guesses that an attacker with many machines is expected not to make.
MIN_COST = 10.0

#: Rows of a keyboard; walks follow neighbours in a row and from row to row.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")

_DATE = [
    re.compile(r"(?P<y>(?:19|20)\d\d)(?P<s>[-/._ ]?)(?P<m>0?[1-9]|1[0-2])(?P=s)(?P<d>3[01]|[12]\d|0?[1-9])"),
    re.compile(r"(?P<d>3[01]|[12]\d|0?[1-9])(?P<s>[-/._ ]?)(?P<m>0?[1-9]|1[0-2])(?P=s)(?P<y>(?:19|20)?\d\d)"),
    re.compile(r"(?P<m>0?[1-9]|1[0-2])(?P<s>[-/._ ]?)(?P<d>3[01]|[12]\d|0?[1-9])(?P=s)(?P<y>(?:19|20)?\d\d)"),
    re.compile(r"(?P<y>19\d\d|20[0-4]\d)"),
]
NOW = 2025
#: log10 of the guesses for a step of a walk that goes on in its direction; other steps cost as many as a key has neighbours.
STRAIGHT = 0.1
#: log10 of the guesses for where a brute-force span begins, so that it does not split what a pattern explains.
BRUTE = 0.3
#: Keys of a walk, characters of a repeat, and of a date at least; and characters of a date at most, which its forms have.
LEAST_WALK, LEAST_REPEAT, LEAST_DATE, MOST_DATE = 4, 3, 4, 10


def neighbours() -> dict[str, dict[str, tuple[int, int]]]:
    """Keys beside each key, in its row and the two nearest in the rows above and below, with the direction to each."""
    where = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
    near: dict[str, dict[str, tuple[int, int]]] = {c: {} for c in where}
    for c, (r, k) in where.items():
        for other, (r2, k2) in where.items():
            if (r2 == r and abs(k2 - k) == 1) or (r2 == r + 1 and k2 in (k - 1, k) and r > 0) or (r2 == r + 1 == 1 and k2 in (k - 2, k - 1)):
                near[c][other] = (r2 - r, k2 - k)
                near[other][c] = (r - r2, k - k2)
    return near


def word_costs(path: str) -> dict[str, float]:
    """log10 of the rank of each alphabetic entry of a vocabulary file that is ordered by frequency."""
    found: dict[str, float] = {}
    for token, rank in sorted(read_ranks(path).items(), key=lambda x: x[1]):
        word = token.decode("utf-8", "ignore").strip().lower()
        if len(word) >= 3 and word.isascii() and word.isalpha() and word not in found:
            found[word] = math.log10(rank + 2)
    return found


def repetitions(value: str) -> list[tuple[int, int, int]]:
    """(period, start, end) of each longest run of a unit that follows itself at least once; units are no repetitions themselves.

    A run of period u holds two equal characters u apart at a multiple of u, so n/u places are looked at for each u.
    """
    n = len(value)
    at = np.array([ord(c) for c in value], dtype=np.uint32)
    found: list[tuple[int, int, int]] = []
    for u in range(1, n // 2 + 1):
        after = at[u::u]
        hits = np.flatnonzero(at[::u][: len(after)] == after) * u
        done = -1
        for k in hits.tolist():
            if k < done:
                continue
            # inside a run of a divisor of u the unit is a repetition itself
            for p, a, b in found:
                if u % p == 0 and a <= k and k + u < b:
                    done = b - u
                    break
            else:
                start, end = k, k + u
                while start > 0 and value[start - 1] == value[start - 1 + u]:
                    start -= 1
                while end < n and value[end] == value[end - u]:
                    end += 1
                done = end - u
                if end - start >= 2 * u:
                    found.append((u, start, end))
    return found


def date_cost(value: str) -> float | None:
    """log10 of the guesses for a date that is the whole value, by its cheapest form; None where it has none."""
    costs = []
    for form in _DATE:
        m = form.fullmatch(value)
        if m:
            year = int(m["y"]) if len(m["y"]) == 4 else 2000 + int(m["y"])
            plain = form is _DATE[-1]
            costs.append(math.log10((1 if plain else 365) * max(20, abs(NOW - year)) * (1 if plain or not m["s"] else 4)))
    return min(costs, default=None)


class GuessCost:
    """The dynamic programme over a value, for one word list.

    A word costs its rank and the choice of its capitals; a date its days, years and separators; a walk its first key and each
    step; a brute-force span its start and each character's kind. A repeat goes on with units equal to the one before it and
    costs log10 of how many such units the value can hold. The cost is the least over all segmentations.
    """

    def __init__(self, words: dict[str, float]):
        self.words = words
        self.longest = max(map(len, words), default=0)
        self.near = neighbours()
        self.first = math.log10(len(self.near))
        self.turn = math.log10(sum(map(len, self.near.values())) / len(self.near))

    @staticmethod
    def _brute(c: str) -> float:
        size = 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 1000
        return math.log10(size)

    @staticmethod
    def _case(word: str) -> float:
        upper = sum(c.isupper() for c in word)
        if not upper:
            return 0.0
        if upper == len(word) or (upper == 1 and word[0].isupper()):
            return math.log10(2)
        return math.log10(sum(math.comb(len(word), k) for k in range(1, min(upper, len(word) - upper) + 1)) or 1)

    def segments(self, value: str) -> tuple[float, list[tuple[str, int, int]]]:
        """(least cost, its segmentation as (kind, start, end)); among equal costs the first found."""
        n = len(value)
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        keys = low.translate(SHIFTED)
        # the least cost of each prefix by its last part: any (best) or a brute-force span (loose)
        best: list[tuple[float, str, int]] = [(0.0, "", 0)] + [(math.inf, "", 0)] * n
        loose: list[tuple[float, int]] = [(math.inf, 0)] * (n + 1)
        starts: dict[int, list[int]] = {}
        for k, (u, a, _) in enumerate(runs := repetitions(value)):
            starts.setdefault(a + 2 * u, []).append(k)
        open_runs: list[int] = []
        copies: dict[tuple[int, int], tuple[float, int]] = {}
        walk: list[tuple[float, int]] = [(math.inf, 0)] * (LEAST_WALK + 1)
        way = None

        def offer(end: int, cost: float, kind: str, start: int) -> None:
            if cost < best[end][0]:
                best[end] = (cost, kind, start)

        self._from(value, low, 0, 0.0, offer)
        for j in range(1, n + 1):
            # words and dates that end here were offered where they start
            c, base = value[j - 1], best[j - 1][0]
            loose[j] = min((loose[j - 1][0] + self._brute(c), loose[j - 1][1]), (base + BRUTE + self._brute(c), j - 1))
            offer(j, loose[j][0], "brute", loose[j][1])
            before, way = way, self.near.get(keys[j - 2], {}).get(keys[j - 1]) if j > 1 else None
            if way:
                step = STRAIGHT if way == before else self.turn
                long = min(walk[LEAST_WALK - 1], walk[LEAST_WALK])
                walk = [walk[0], walk[0], (walk[1][0] + self.turn, walk[1][1]), *((w[0] + step, w[1]) for w in walk[2 : LEAST_WALK - 1]), (long[0] + step, long[1])]
            else:
                walk = [(math.inf, 0)] * (LEAST_WALK + 1)
            walk[1] = (base + self.first, j - 1) if keys[j - 1] in self.near else (math.inf, 0)
            if walk[LEAST_WALK][0] < math.inf:
                offer(j, walk[LEAST_WALK][0], "walk", walk[LEAST_WALK][1])
            open_runs = [k for k in open_runs if runs[k][2] >= j] + starts.get(j, [])
            for k in open_runs:
                u = runs[k][0]
                own = (best[j - u][0] + math.log10(n // u), j - u)
                longer = copies.get((k, j - u), (math.inf, 0))
                copies[k, j] = min(own, longer)
                if 3 * u >= LEAST_REPEAT:
                    offer(j, longer[0], "repeat", longer[1])
                if 2 * u >= LEAST_REPEAT:
                    offer(j, own[0], "repeat", own[1])
            self._from(value, low, j, best[j][0], offer)
        cuts, at = [], n
        while at:
            _, kind, start = best[at]
            cuts.append((kind, start, at))
            at = start
        return best[n][0], cuts[::-1]

    def _from(self, value: str, low: str, i: int, base: float, offer) -> None:
        """Offers the words and dates that start at character i."""
        n = len(value)
        if i < n and low[i].isascii() and low[i].isalpha():
            for j in range(i + 3, min(n, i + self.longest) + 1):
                cost = self.words.get(low[i:j])
                if cost is not None:
                    offer(j, base + cost + self._case(value[i:j]), "word", i)
        if i < n and value[i].isdigit():
            for j in range(i + LEAST_DATE, min(n, i + MOST_DATE) + 1):
                cost = date_cost(value[i:j])
                if cost is not None:
                    offer(j, base + cost, "date", i)

    def cost(self, value: str) -> float:
        return self.segments(value)[0]


def spans(text: str, guess: GuessCost, min_value: int = MIN_VALUE, min_cost: float = MIN_COST) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, cost of an assigned or guess value), by start and then kind."""
    found = [("assign", m.start(), m.end(), guess.cost(m[2])) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    taken = sorted((s, e) for _, s, e, _ in found)
    reach = list(itertools.accumulate((e for _, e in taken), max))
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        before = bisect.bisect_right(taken, (start, math.inf))
        if end - start >= min_value and not (before and reach[before - 1] >= end):
            cost = guess.cost(m[1])
            if cost >= min_cost:
                found.append(("guess", start, end, cost))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _suspects(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows that may hold a span: with ':' or '=', with 'AKIA', or with 32 hexadecimal digits in a row."""
    marks = np.zeros(len(raw) + 1, dtype=np.int64)
    hit = (raw == 58) | (raw == 61)
    if len(raw) >= 4:
        hit[:-3] |= (raw[:-3] == 65) & (raw[1:-2] == 75) & (raw[2:-1] == 73) & (raw[3:] == 65)
    digit = ((raw >= 48) & (raw <= 57)) | ((raw >= 97) & (raw <= 102))
    run = np.concatenate([[0], np.cumsum(digit, dtype=np.int64)])
    if len(raw) >= 32:
        hit[:-31] |= run[32:] - run[:-32] == 32
    np.cumsum(hit, out=marks[1:])
    return np.flatnonzero(marks[offs[1:]] > marks[offs[:-1]])


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cost", T.DoubleType())])
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())])


def secret_spans(df: DataFrame, words: dict[str, float], text: str = "text", with_text: bool = True, to: str = "secrets") -> DataFrame:
    """Adds each text's spans as an array of (kind, start, end, cost). ``words`` has a fixed size and goes to all tasks."""
    bounded_batches(df.sparkSession)
    keep = kept_columns(df, [to], text, with_text)
    source = df.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([source.schema[c] for c in keep]).add(to, T.ArrayType(SPAN))

    def run(batches):
        guess = GuessCost(words)
        for batch in batches:
            for rows, raw, offs in text_slices(batch, text):
                found: list[list] = [[] for _ in range(rows.num_rows)]
                for i in _suspects(raw, offs):
                    found[i] = [dict(zip(("kind", "start", "end", "cost"), s, strict=True)) for s in spans(raw[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"), guess)]
                yield with_rows(rows, keep, {to: pa.array(found, pa.list_(_ARROW_SPAN))})

    return map_arrow(source, run, schema)


def of_kind(found: Column | str, kind: str) -> Column:
    return F.filter(found, lambda s: s["kind"] == kind)


def joined(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(df: DataFrame, words: dict[str, float], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same columns, with each span of a text (overlapping ones together) replaced by ``mark``; a null text stays null."""
    scanned = secret_spans(df, words, text, to="_secrets")
    ends = F.aggregate(
        F.col("_secrets"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                F.greatest(a["at"], s["end"]).alias("at"),
                F.when(
                    (s["start"] >= a["at"]) | (a["at"] == 0),
                    F.concat(a["parts"], F.array(F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit(mark))),
                ).otherwise(a["parts"]).alias("parts"),
            )
        ),
    )
    done = F.when(F.size("_secrets") == 0, F.col(text)).otherwise(F.concat(F.array_join(ends["parts"], ""), F.expr(f"substring(`{text}`, _ends.at + 1)")))
    return scanned.withColumn("_ends", ends).withColumn(text, done).select(*df.columns)
