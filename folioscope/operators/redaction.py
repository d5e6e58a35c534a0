"""Redaction of personal data with safe counters: native expressions built from a profile."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.profiles import FIELD_VALUE, HEBREW, LEASE_HE, PLACEHOLDERS, Labelled, Pattern, Profile


def labelled_pattern(rule: Labelled) -> str:
    """Label, separator, and a value that holds no placeholder yet."""
    held = "|".join(re.escape(p) for p in PLACEHOLDERS)
    return rf"(?<![{HEBREW}])({'|'.join(rule.labels)})({rule.separator})(?![^,\n.;]{{0,119}}?(?:{held}))({FIELD_VALUE})"


def _replacement(text: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", text)


def _step(text: Column, rule: Labelled | Pattern) -> tuple[Column, Column]:
    """(text after the rule, number of replacements), both of the text before it."""
    if isinstance(rule, Labelled):
        pattern = labelled_pattern(rule)
        return F.regexp_replace(text, pattern, "$1 " + _replacement(rule.placeholder)), F.regexp_count(text, F.lit(pattern))
    if not rule.unless:
        return F.regexp_replace(text, rule.pattern, _replacement(rule.placeholder)), F.regexp_count(text, F.lit(rule.pattern))

    def spared(line: Column) -> Column:
        found = F.lit(False)
        for word in rule.unless:
            found = found | F.contains(line, F.lit(word))
        return found & ~line.rlike(rule.though) if rule.though else found

    lines = F.split(text, "(?<=\n)")
    after = F.array_join(F.transform(lines, lambda x: F.when(spared(x), x).otherwise(F.regexp_replace(x, rule.pattern, _replacement(rule.placeholder)))), "")
    count = F.aggregate(lines, F.lit(0), lambda n, x: n + F.when(spared(x), F.lit(0)).otherwise(F.regexp_count(x, F.lit(rule.pattern))))
    return after, count


def redact(df: DataFrame, profile: Profile = LEASE_HE, text: str = "text", to: str = "redacted", report: str = "report") -> DataFrame:
    """Adds the redacted text and a struct of counters with their total. A null text stays null with counters 0."""
    step_names = []
    out = df.withColumn("_t0", F.col(text))
    for k, rule in enumerate(profile.redaction):
        after, count = _step(F.col(f"_t{k}"), rule)
        out = out.withColumns({f"_t{k + 1}": after, f"_c{k}": F.coalesce(count, F.lit(0)).cast("int")})
        step_names.append(rule.counter)
    last = len(profile.redaction)
    sums = {}
    for counter in profile.counters:
        total = F.lit(0)
        for k, name in enumerate(step_names):
            if name == counter:
                total = total + F.col(f"_c{k}")
        sums[counter] = total
    whole = F.lit(0)
    for k in range(last):
        whole = whole + F.col(f"_c{k}")
    struct = F.struct(*(v.alias(c) for c, v in sums.items()), whole.alias("total"))
    return out.withColumns({to: F.col(f"_t{last}"), report: struct}).drop(*(f"_t{k}" for k in range(last + 1)), *(f"_c{k}" for k in range(last)))


def residual_findings(text: Column, patterns: dict[str, str]) -> Column:
    """Sorted names of the patterns that a text still matches."""
    return F.array_sort(F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in sorted(patterns.items())))))


def remove_tokens(text: Column, tokens: Column, placeholder: str) -> Column:
    """A text without the given tokens, longest first; tokens are literal and end at word ends."""
    ordered = F.array_sort(F.filter(tokens, lambda t: F.length(t) > 0), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))
    quoted = lambda t: F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?!\w)"))
    return F.aggregate(ordered, text, lambda x, t: F.regexp_replace(x, quoted(t), F.lit(_replacement(placeholder))))
