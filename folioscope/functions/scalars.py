"""Scalar expressions: hashes, ids, splits, checks and parsers. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id prefixes of the data tiers, the buckets of the splits, and the pattern of numbers.
TIER_PREFIX = {"synthetic": "syn_", "silver": "sil_", "gold": "gld_"}
SPLIT_BUCKETS = ((70, "train"), (85, "val"), (100, "test"))
NUMBER = r"(?U)(?<!\w)\d{1,3}(?:[,.]\d{3})*(?:/\d{1,2}/\d{2,4})?|\d+(?!\w)"
# End of the fixed values.


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a time stamp without a zone, read as UTC whatever the session's zone is."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp"))


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def bucket_split(group: Column) -> Column:
    """train, val or test by the first 32 bits of the group's SHA-256, modulo 100."""
    bucket = F.conv(F.substring(sha256(group), 1, 8), 16, 10).cast("long") % 100
    out = F.lit(None)
    for below, name in reversed(SPLIT_BUCKETS):
        out = F.when(bucket < below, name).otherwise(out)
    return out


def hash_fraction(text: Column) -> Column:
    """The first 64 bits of the SHA-256 over 2**64."""
    return (F.conv(F.substring(sha256(text), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")) / F.lit(float(1 << 64))


def sample_id(tier: Column, source: Column) -> Column:
    prefix = F.coalesce(*(F.when(tier == t, F.lit(p)) for t, p in TIER_PREFIX.items()))
    return F.concat(prefix, F.substring(sha256(source), 1, 20))


def parts_hash(*parts: Column) -> Column:
    """SHA-256 of parts that are each led by their length in bytes (8 bytes, big-endian) and a zero byte."""
    joined = F.concat(*(x for p in parts for x in (F.unhex(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0")), F.unhex(F.lit("00")), p.cast("binary"))))
    return F.sha2(joined, 256)


def git_blob_sha1(text: Column) -> Column:
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(text).cast("string").cast("binary"), F.unhex(F.lit("00")), text.cast("binary")))


def iban_valid(text: Column, country: str = "IL", length: int = 23) -> Column:
    """Whether an IBAN of a country has the right length and remainder 1 modulo 97."""
    plain = F.upper(F.regexp_replace(text, r"[\s-]", ""))
    letters = "".join(str(ord(c) - 55) for c in country)
    digits = F.concat(F.substring(plain, 5, length - 4), F.lit(letters), F.substring(plain, 3, 2))
    # two steps keep the numbers within 38 digits
    head = F.substring(digits, 1, 18).cast("decimal(38,0)") % 97
    tail = F.concat(head.cast("string"), F.substring(digits, 19, 18)).cast("decimal(38,0)") % 97
    return F.coalesce(plain.rlike(rf"^{country}[0-9]{{{length - 2}}}$") & (tail == 1), F.lit(False))


def numbers(text: Column) -> Column:
    """Distinct numbers of a text as they stand, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)))


def numbers_supported(source: Column, claim: Column, strict: bool = False) -> Column:
    """Whether the claim's numbers are among the source's; unless strict, a source or claim without numbers passes."""
    missing = F.size(F.array_except(numbers(claim), numbers(source))) == 0
    return missing if strict else missing | (F.size(numbers(source)) == 0)


#: Runs of white space, with the separators that are control characters.
WHITE = r"(?U)[\s\x1c-\x1f]+"


def squeezed(text: Column) -> Column:
    """A text without white space at its ends and with one space for each other run of it; Unicode white space counts."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def quote_exists(quote: Column, source: Column) -> Column:
    return (squeezed(quote) != "") & F.contains(squeezed(source), squeezed(quote))


def natural_key(text: Column) -> Column:
    """Lower-case runs with digits padded, so that page2 sorts before page10."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(r, 20, "0")).otherwise(r)), "")


def safe_relative_path(path: Column) -> Column:
    return F.coalesce(~path.rlike(r"(^|/)\.{1,2}(/|$)|^/|//|\\|^[A-Za-z]:|^$|/$"), F.lit(False))


def iso_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def host_allowed(url: Column, hosts: list[str]) -> Column:
    """Whether an https address is on one of the hosts or below it."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/:?#]+)", 1))
    ok = F.lit(False)
    for h in hosts:
        ok = ok | (host == h) | F.endswith(host, F.lit("." + h))
    return F.coalesce(ok, F.lit(False))


def retry_seconds(text: Column) -> Column:
    """Seconds of a retry delay: '12s', '1.5s', 'retryDelay": "7s' or a bare number; null otherwise."""
    named = F.regexp_extract(text, r'retryDelay"?\s*[:=]\s*"?([0-9.]+)s', 1)
    bare = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)s?\s*$", 1)
    return F.coalesce(F.when(named != "", named.try_cast("double")), F.when(bare != "", bare.try_cast("double")))


def error_class(code: Column, message: Column) -> Column:
    """auth, quota, rate_limit, timeout, unavailable or other, from a status code and a message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(code.isin(401, 403), "auth")
        .when((code == 429) & low.rlike("per day|daily|quota"), "quota")
        .when(code == 429, "rate_limit")
        .when((code == 504) | low.rlike("timed? ?out|deadline"), "timeout")
        .when(code >= 500, "unavailable")
        .otherwise("other")
    )


def version_key(text: Column) -> Column:
    """(major, minor, patch) of a version, null where it is none; structs compare in order."""
    pattern = r"^v?(\d+)\.(\d+)\.(\d+)$"
    return F.when(text.rlike(pattern), F.struct(*(F.regexp_extract(text, pattern, k).cast("int").alias(n) for k, n in enumerate(("major", "minor", "patch"), 1))))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-40.0)), F.lit(40.0))))


def duplicate_json_keys(json: Column) -> Column:
    """Whether an object repeats a key (or is no JSON at all)."""
    return json.isNotNull() & F.try_parse_json(json).isNull()
