"""Markers of personal data in a text and their relations to the values behind them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.python_functions import direct_values

# Markers by class, with the names of their detectors (the last three in any case); what may lie between a marker and its value, and how much of it.
MARKERS = {
    "israeli_id": ("marker-israeli-id-v0", ("ת.ז.", "ת.ז", 'ת"ז', "ת״ז", "מספר זהות")),
    "phone": ("marker-phone-v0", ("טלפון", "נייד")),
    "email": ("marker-email-v0", ('דוא"ל', "דוא״ל", "אימייל", "email")),
    "bank_identifier": ("marker-israeli-iban-v0", ("מספר IBAN", "IBAN")),
}
ANY_CASE = ("email", "מספר IBAN", "IBAN")
GAP, GAP_LENGTH = ":：=-‐‑‒–—―־()[]{}", 16
DIRECT_DETECTORS = {"email": "direct-email-v0", "bank_identifier": "direct-israeli-iban-v0", "israeli_id": "direct-israeli-id-v0", "phone": "direct-israeli-phone-v0"}
RELATION_DETECTORS = {"marker_to_value": "marker-to-direct-value-v0", "marker_to_visual": "marker-to-visual-v0"}
VISUAL_CLASSES = {"visual-evidence-filled-field-v0": None, "visual-evidence-handwriting-v0": None, "visual-evidence-initials-v0": "initials", "visual-evidence-signature-v0": "signature", "visual-evidence-stamp-v0": "stamp"}
# End of the fixed values.

#: A marker stands alone: no letter of its scripts and no digit beside it.
_BESIDE = r"A-Za-z֐-׿"


def _pattern(marker: str) -> re.Pattern:
    return re.compile(rf"(?<![{_BESIDE}])(?<!\d){re.escape(marker)}(?![{_BESIDE}])(?!\d)", re.I if marker in ANY_CASE else 0)


_MARKERS = {kind: [_pattern(m) for m in markers] for kind, (_, markers) in MARKERS.items()}
_BETWEEN = re.compile(rf"(?:(?![\r\n])[\s{re.escape(GAP)}]){{0,{GAP_LENGTH}}}")


def marked_places(text: str) -> list[tuple[str, int, int]]:
    """(class, start, end) of markers by place; one that lies inside another of its class is left out."""
    out = []
    for kind, patterns in _MARKERS.items():
        reach = -1
        # by start, the longest first: what ends no later than an earlier one lies inside it
        for a, b in sorted({m.span() for p in patterns for m in p.finditer(text)}, key=lambda s: (s[0], -s[1])):
            if b > reach:
                out.append((kind, a, b))
                reach = b
    return sorted(out, key=lambda m: (m[1], m[2], MARKERS[m[0]][0]))


def related_values(text: str | None) -> list[dict]:
    """Values with the nearest marker of their class before them, if nothing but a short gap lies between."""
    markers = marked_places(text or "")
    found = []
    for kind, a, b in direct_values(text):
        fits = [m for m in markers if m[0] == kind and m[2] <= a and a - m[2] <= GAP_LENGTH and _BETWEEN.fullmatch(text, m[2], a)]
        if fits:
            _, start, end = max(fits, key=lambda m: (m[2], m[1]))
            found.append({"kind": kind, "marker_start": start, "marker_end": end, "value_start": a, "value_end": b})
    return sorted(found, key=lambda r: (r["marker_start"], r["value_start"], r["value_end"]))


RELATIONS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("marker_start", "marker_end", "value_start", "value_end"))]))
marker_relations = F.pandas_udf(lambda s: pd.Series([related_values(x) for x in s]), RELATIONS)
