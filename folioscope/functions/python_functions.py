"""Functions that no native expression gives, as Pandas UDFs over Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.profiles import LEASE_MARKERS

# Tags that break lines, marks that order text, variants that stand for markers, and patterns of direct values.
BREAKS = ("br", "div", "li", "p", "table", "tr")
BIDI_MARKS = "‎‏‪‫‬‭‮⁦⁧⁨⁩"
MARKER_VARIANTS = {
    "שוכר": ("השוכר", "חשוכר", "חשוכך", "השוכך"),
    "משכיר": ("המשכיר", "חמשכיר", "חמשכיך", "המשכיך"),
    "דירה": ("הדירה", "חדירה", "חדיךה"),
    "דמי שכירות": ("דמי שכירות", "דמישכירות", "דמי שכיךות", "דמי שכירת"),
    'ש"ח': ('ש"ח', "שח", "שז"),
    'ע"י': ('ע"י', "עי", "עייי"),
    'ב"כ': ('ב"כ', "בכ", "בייכ"),
}
MIRRORED = str.maketrans("()[]{}<>", ")(][}{><")
DIRECT = {
    "bank_identifier": re.compile(r"(?<![A-Z0-9])IL(?:[ -]?\d){21}(?![A-Z0-9@])", re.I),
    "email": re.compile(r"(?<![A-Z0-9._%+-])[A-Z0-9](?:[A-Z0-9._%+-]{0,62}[A-Z0-9])?@(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,63}(?![A-Z0-9-])", re.I),
    "phone": re.compile(r"(?<!\d)(?:\+972[ -]?|0)(?:5\d|[23489]|7[0-9])[ -]?\d{3}[ -]?\d{4}(?!\d)"),
    "israeli_id": re.compile(r"(?<!\d)\d(?:[ -]?\d){8}(?!\d)"),
}
MARKER_WORD = re.compile("[\u0590-\u05FF]+(?:[\"׳'][\u0590-\u05FF]+)?")
# End of the fixed values.

ALL_BIDI_MARKS = BIDI_MARKS + "\u061c"


class _PageText(HTMLParser):
    """Collects the character data of a page, with a line break for each block tag."""

    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data):
        self.parts.append(data)

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS:
            self.parts.append("\n")

    handle_endtag = lambda self, tag: self.handle_starttag(tag, None)


def nfc_text(x: str | None) -> str | None:
    """Composed, without a leading byte order mark, white space collapsed; null for text with direction marks."""
    if x is None or any(c in BIDI_MARKS for c in x):
        return None
    return " ".join(unicodedata.normalize("NFC", x.removeprefix("﻿")).split())


def folded_text(x: str | None) -> str | None:
    """Compatibility form, without direction and combining marks; all but letters and digits is a space."""
    if x is None:
        return None
    plain = (c for c in unicodedata.normalize("NFKC", x) if c not in ALL_BIDI_MARKS and unicodedata.category(c) != "Mn")
    return " ".join("".join(c if c.isalnum() else " " for c in plain).split())


def html_text(x: str | None) -> str:
    """Text of a page: line breaks at block tags, entities decoded, white space of each line collapsed."""
    reader = _PageText()
    reader.feed(x or "")
    plain = "".join(reader.parts)
    return "\n".join(line for line in (" ".join(part.split()) for part in plain.splitlines()) if line)


def word_similarity(expected: str | None, found: str | None) -> float:
    """1 less the word edits over the longer text's words; 1 for two texts without words."""
    a, b = (expected or "").split(), (found or "").split()
    if not a and not b:
        return 1.0
    longest, least = max(len(a), len(b)), min(len(a), len(b))
    # equal ends cost nothing
    tail = next((k for k in range(least) if a[-1 - k] != b[-1 - k]), least)
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    row = np.arange(len(b) + 1)
    codes = {w: i for i, w in enumerate({*a, *b})}
    other = np.array([codes[w] for w in b], dtype=np.int64)
    for i, w in enumerate(a, 1):
        best = np.minimum(row[:-1] + (other != codes[w]), row[1:] + 1)
        # insertions run along the row: a running minimum of the costs less their place
        row = np.minimum.accumulate(np.concatenate([[i], best]) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return float(1 - row[-1] / longest)


def aligned(expected: str, found: str) -> list[tuple[str, str | None, str | None]]:
    """(operation, expected character, found character); among equal costs a pair is preferred, then a deletion."""
    a, b = (np.array([ord(c) for c in x], dtype=np.int64) for x in (expected, found))
    place = np.arange(len(b) + 1)
    cost = np.empty((len(a) + 1, len(b) + 1), dtype=np.int64)
    cost[0] = place
    for i in range(1, len(a) + 1):
        best = np.minimum(cost[i - 1, :-1] + (b != a[i - 1]), cost[i - 1, 1:] + 1)
        cost[i] = np.minimum.accumulate(np.concatenate([[i], best]) - place) + place
    i, j, out = len(a), len(b), []
    while i or j:
        here = cost[i, j]
        if i and j and here == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append(("match" if a[i] == b[j] else "substitution", expected[i], found[j]))
        elif i and here == cost[i - 1, j] + 1:
            i -= 1
            out.append(("deletion", expected[i], None))
        else:
            j -= 1
            out.append(("insertion", None, found[j]))
    return out[::-1]


def character_class(c: str) -> str:
    if "א" <= c <= "ת":
        return "hebrew"
    if c.isdigit():
        return "digits"
    if c.isascii() and c.isalpha():
        return "latin"
    if c == " ":
        return "space"
    return "punctuation_symbols" if unicodedata.category(c)[0] in "PS" else "other"


CLASSES = ("hebrew", "digits", "latin", "space", "punctuation_symbols", "other")
OPERATIONS = ("match", "substitution", "deletion", "insertion")
_classes = np.full(0x110000, 255, dtype=np.uint8)  # filled as characters occur


def _class_numbers(codes: np.ndarray) -> np.ndarray:
    for c in np.unique(codes[_classes[codes] == 255]):
        _classes[c] = CLASSES.index(character_class(chr(c)))
    return _classes[codes]


def edit_counts(a: np.ndarray, b: np.ndarray, long_a: np.ndarray, long_b: np.ndarray) -> np.ndarray:
    """Counts (class, operation) of ``aligned`` over many short pairs at once: code points (place, pair), filled up below, and lengths."""
    pairs = np.arange(a.shape[1])
    cost = np.empty((len(a) + 1, len(b) + 1, len(pairs)), dtype=np.int16)
    cost[0] = np.arange(len(b) + 1)[:, None]
    for i in range(1, len(a) + 1):
        cost[i, 0] = i
        apart = a[i - 1] != b
        for j in range(1, len(b) + 1):
            cost[i, j] = np.minimum(np.minimum(cost[i - 1, j], cost[i, j - 1]) + 1, cost[i - 1, j - 1] + apart[j - 1])
    i, j = long_a.copy(), long_b.copy()
    counts = np.zeros(len(CLASSES) * len(OPERATIONS), dtype=np.int64)
    while len(pairs):
        go = (i > 0) | (j > 0)
        i, j, pairs = i[go], j[go], pairs[go]
        up, back = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        here, x, y = cost[i, j, pairs], a[up, pairs], b[back, pairs]
        pair = (i > 0) & (j > 0) & (here == cost[up, back, pairs] + (x != y))
        delete = ~pair & (i > 0) & (here == cost[up, j, pairs] + 1)
        insert = ~pair & ~delete
        operation = np.where(pair, x != y, np.where(delete, 2, 3))
        counts += np.bincount(_class_numbers(np.where(insert, y, x)).astype(np.int64) * len(OPERATIONS) + operation, minlength=len(counts))
        i, j = i - ~insert, j - ~delete
    return counts.reshape(len(CLASSES), len(OPERATIONS))


def slice_edit_counts(texts: list[str], size: int, shift: int, at_once: int = 2048) -> np.ndarray:
    """``edit_counts`` of each run of ``size`` characters of each text (none left out) and the run that begins ``shift`` later."""
    codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) for x in texts]
    ends = np.cumsum([len(x) + size + shift for x in codes])
    full = np.concatenate([y for x in codes for y in (x, np.zeros(size + shift, dtype=np.int64))] or [np.zeros(0, dtype=np.int64)])
    starts = np.concatenate([np.arange(e - size - shift - len(x), e - size - shift, size) for x, e in zip(codes, ends, strict=True)] or [ends])
    left = np.repeat(ends - size - shift, [-(-len(x) // size) for x in codes]) - starts
    counts = np.zeros((len(CLASSES), len(OPERATIONS)), dtype=np.int64)
    for k in range(0, len(starts), at_once):
        own, rest = starts[k : k + at_once], left[k : k + at_once]
        a, b = (full[own + np.arange(at, at + size)[:, None]] for at in (0, shift))
        counts += edit_counts(a, b, np.clip(rest, 0, size), np.clip(rest - shift, 0, size))
    return counts


def slice_edits(df: DataFrame, text: str, size: int, shift: int, most: int = 1_000_000) -> DataFrame:
    """(character_class, operation, n) of ``slice_edit_counts`` over all texts; about ``most`` characters at a time."""

    def run(batches):
        for batch in batches:
            texts = [x for x in batch[text] if x]
            group = np.cumsum([len(x) for x in texts], dtype=np.int64) // most
            counts = sum((slice_edit_counts([texts[k] for k in np.flatnonzero(group == g)], size, shift) for g in np.unique(group)), np.zeros((len(CLASSES), len(OPERATIONS)), dtype=np.int64))
            yield pd.DataFrame([(CLASSES[c], OPERATIONS[o], int(counts[c, o])) for c, o in zip(*np.nonzero(counts), strict=True)], columns=["character_class", "operation", "n"])

    found = df.select(text).mapInPandas(run, "character_class string, operation string, n long")
    return found.groupBy("character_class", "operation").agg(F.sum("n").alias("n"))


def _direction(c: str) -> str:
    return {"R": "rtl", "AL": "rtl", "L": "ltr", "EN": "ltr", "AN": "ltr"}.get(unicodedata.bidirectional(c), "")


def reordered(x: str | None) -> str | None:
    """Visual to logical order of a line and back: words reversed, right-to-left words mirrored, left-to-right cores kept.

    A line without right-to-left letters stays; a word that mixes directions gives null.
    """
    if x is None or not any(_direction(c) == "rtl" for c in x):
        return x
    out = []
    for word in x.split(" ")[::-1]:
        sides = [_direction(c) for c in word]
        if "rtl" in sides and "ltr" in sides:
            return None
        if "ltr" in sides:
            a, b = sides.index("ltr"), len(sides) - sides[::-1].index("ltr")
            out.append(word[b:].translate(MIRRORED) + word[a:b] + word[:a].translate(MIRRORED))
        else:
            out.append(word[::-1].translate(MIRRORED))
    return " ".join(out)


def ctc_text(path: list[int], characters: list[str], blank: int = 0) -> str:
    """Class ids with repeats and blanks collapsed, as characters (the first character has id 1)."""
    ids = np.asarray(path, dtype=np.int64)
    if not len(ids):
        return ""
    keep = np.concatenate([[True], ids[1:] != ids[:-1]]) & (ids != blank)
    return "".join(characters[i - 1] for i in ids[keep])


_OTHER = re.compile("[^\u0590-\u05FF]+")


def _hebrew(x: str) -> str:
    return _OTHER.sub("", x)


def fuzzy_markers(x: str | None, markers: tuple[str, ...] = LEASE_MARKERS) -> dict[str, str]:
    """Markers that a text holds, as the form found: exact, a known variant, or the most similar run of words."""
    text = x or ""
    tokens = MARKER_WORD.findall(text)
    compact = _hebrew(text)
    runs: dict[int, list[tuple[str, SequenceMatcher]]] = {}  # by the number of words

    def of(k: int) -> list[tuple[str, SequenceMatcher]]:
        if k not in runs:
            joined = (" ".join(tokens[i : i + k]) for i in range(len(tokens) - k + 1))
            runs[k] = [(r, SequenceMatcher(None, "", _hebrew(r))) for r in joined]
        return runs[k]

    found = {}
    for marker in markers:
        letters = _hebrew(marker)
        plain = letters == marker
        if marker in tokens if plain else (marker in text or letters in compact):
            found[marker] = marker
            continue
        variant = next((v for v in MARKER_VARIANTS.get(marker, ()) if v in text or _hebrew(v) in compact), None)
        if variant:
            found[marker] = variant
            continue
        if len(letters) < 4:
            continue
        least = 0.80 if len(letters) <= 5 else 0.76
        n = max(1, len(marker.split()))
        best, form = least - 1e-12, ""
        for k in sorted({max(1, n - 1), n, n + 1}):
            for run, match in of(k):
                if abs(len(match.b) - len(letters)) <= max(2, len(letters) // 2):
                    match.set_seq1(letters)
                    # the cheap upper bounds first
                    if match.real_quick_ratio() > best and match.quick_ratio() > best and match.ratio() > best:
                        best, form = match.ratio(), run
        if form:
            found[marker] = form
    return found


def _digits_ok(kind: str, value: str) -> bool:
    plain = re.sub("[ -]", "", value).upper()
    if kind == "email":
        return ".." not in value.split("@")[0]
    if kind == "israeli_id":
        products = [int(c) * (1 + k % 2) for k, c in enumerate(plain)]
        return plain.isascii() and plain.isdigit() and int(plain) > 0 and sum(p - 9 * (p > 9) for p in products) % 10 == 0
    if kind == "bank_identifier":
        return plain.isascii() and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    return True


def direct_values(x: str | None) -> list[tuple[str, int, int]]:
    """(class, start, end) of values that are personal data by their form; a class earlier in the order wins an overlap."""
    text, taken = x or "", []
    for kind, pattern in DIRECT.items():
        for m in pattern.finditer(text):
            a, b = m.span()
            partial = kind != "email" and (bool(re.match(r"\d[ -]", text[max(a - 2, 0) : a])) and a >= 2 or bool(re.match(r"[ -]\d", text[b : b + 2])))
            if not partial and _digits_ok(kind, m[0]) and not any(s < b and a < e for _, s, e in taken):
                taken.append((kind, a, b))
    return sorted(taken, key=lambda s: s[1:])


nfc = F.pandas_udf(lambda s: s.map(nfc_text), T.StringType())
folded = F.pandas_udf(lambda s: s.map(folded_text), T.StringType())
html_to_text = F.pandas_udf(lambda s: s.map(html_text), T.StringType())
logical_order = F.pandas_udf(lambda s: s.map(reordered), T.StringType())
word_likeness = F.pandas_udf(lambda a, b: pd.Series([word_similarity(x, y) for x, y in zip(a, b, strict=True)]), T.DoubleType())
marker_forms = F.pandas_udf(lambda s: s.map(fuzzy_markers), T.MapType(T.StringType(), T.StringType()))
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
pii_spans = F.pandas_udf(lambda s: s.map(lambda x: [dict(zip(("kind", "start", "end"), v, strict=True)) for v in direct_values(x)]), SPAN)
EDIT = T.ArrayType(T.StructType([T.StructField("operation", T.StringType()), T.StructField("character_class", T.StringType())]))


def _edits(e: str | None, f: str | None) -> list[dict]:
    return [{"operation": op, "character_class": character_class(a if a is not None else b)} for op, a, b in aligned(e or "", f or "")]


alignment = F.pandas_udf(lambda a, b: pd.Series([_edits(x, y) for x, y in zip(a, b, strict=True)]), EDIT)


def register(spark: SparkSession) -> None:
    """Makes the functions callable from SQL."""
    for name, function in (("nfc", nfc), ("folded", folded), ("html_to_text", html_to_text), ("logical_order", logical_order), ("word_likeness", word_likeness), ("marker_forms", marker_forms), ("pii_spans", pii_spans), ("alignment", alignment)):
        spark.udf.register(name, function)
