"""WARC: archives from pages, read back by content length, and transactions assembled through concurrent-to identifiers.

``archive`` writes three records for each page: a request, a response (or a revisit of the response with the same payload),
and metadata, the last two concurrent to the others by record id. Of pages with equal payloads of at least
``revisit_from`` bytes, the one with the largest id is the response. ``records`` reads archives (plain, or gzip of one or many members): each
file is read whole, so ``archive`` bounds its files in bytes. ``captures`` takes concurrent-to identifiers as edges without a direction,
whichever record names the other, and gives one nested row for each component of them.

Defined results: a null payload is an empty one; a null or repeated page id is a page of its own as long as its url or payload differs
(rows alike in all three are one capture each, told apart by a number); among equal payloads and equal ids the larger url is the response.
A null url is an empty target. An empty table writes no archive and gives no rows. Extra columns are not archived. A record that
is cut short, or whose payload does not have its digest, raises ``ValueError``. Records without a concurrent one, and identifiers that no record
has, do no harm: a lone response is a capture without request and metadata. Of several records of a kind in one transaction the one with
the least id stands in the transaction's row; each other one has a row of its own with the same transaction id, so none is lost and no
group is collected. Records of other kinds are in no capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.components import connected_components
from folioscope.llm.workspace import folder, map_arrow, written

#: Records of one archive file at most, and bytes that its payloads should have at most.
FILE_RECORDS, FILE_BYTES = 3000, 1 << 26
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2025-01-01T00:00:00Z"
#: What ends a record; the text sink writes it between records.
END = "\r\n\r\n"
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits (a SHA-1): four digits for each 20 bits."""
    def four(k: int) -> list[Column]:
        bits = F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(_DIGITS), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]

    return F.concat(*(c for k in range(8) for c in four(k)))


def _record(kind: str, record: Column, others: list[Column], lines: list[tuple[str, Column]], media: str, block: Column) -> Column:
    """One record as text, without its end."""
    named = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", record), ("WARC-Date", F.lit(DATE)), *(("WARC-Concurrent-To", o) for o in others), *lines]
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *(F.concat(F.lit(f"{n}: "), v) for n, v in named), F.lit(f"Content-Type: {media}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit("\r\n\r\n"), block)


def size_class(size: Column) -> Column:
    """0 for payloads of which a file may hold ``FILE_RECORDS`` / 3, then one more for each 16 times as many bytes, 3 at most."""
    least = FILE_BYTES // (FILE_RECORDS // 3)
    return (size > least).cast("int") + (size > 16 * least).cast("int") + (size > 256 * least).cast("int")


def class_records(k: int) -> int:
    """Records of a file of a class: whole pages, of ``FILE_BYTES`` together, or one page."""
    return 3 * max(1, FILE_RECORDS // 3 // 16**k) if k < 3 else 3


def archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", revisit_from: int = 0, compression: str = "gzip") -> None:
    """Writes the archives of all pages as WARC files under ``path``."""
    html = F.coalesce(F.col(payload), F.lit(""))
    target = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\r\n]", "%0A")
    page = pages.select(F.col(page_id).alias("page_id"), target.alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    marks = written(page.select("page_id", "url", "sha1", (F.octet_length("html") >= revisit_from).alias("long"), size_class(F.octet_length("html")).alias("class")), "digests")
    who = F.struct("page_id", "url")
    chosen = written(marks.filter("long").groupBy("sha1").agg(F.max(who).alias("who"), F.count("*").alias("n")).filter("n > 1").drop("n"), "responses")

    def record_id(kind: str, key: Column) -> Column:
        h = F.md5(key.cast("binary"))
        return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ([F.lit("-")] if a > 1 else []) + [F.substring(h, a, n)]), F.lit(">"))

    def ids(kind: str, page: Column, url: Column, sha1: Column, nth: Column) -> Column:
        return record_id(kind, F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("null")), url, sha1, nth.cast("string")))

    # rows alike in id, url and payload are numbered; they are as few as a row's repetitions
    joined = page.join(chosen, "sha1", "left")
    alike = Window.partitionBy("page_id", "url", "sha1").orderBy(F.lit(0))
    counted = marks.groupBy("page_id", "url", "sha1").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    joined = joined.withColumn("nth", F.row_number().over(alike) if counted else F.lit(1))
    original = F.col("who").isNull() | ((F.struct("page_id", "url").eqNullSafe(F.col("who"))) & (F.col("nth") == 1))
    own = [F.col("page_id"), F.col("url"), F.col("sha1"), F.col("nth")]
    request, response, metadata = (ids(k, *own) for k in ("request", "response", "metadata"))
    refers = ids("response", F.col("who.page_id"), F.col("who.url"), F.col("sha1"), F.lit(1))
    digest = F.concat(F.lit("sha1:"), base32(F.col("sha1")))
    uri = [("WARC-Target-URI", F.col("url"))]
    paged = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    asked = _record("request", request, [], uri, "application/http;msgtype=request", F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")))
    answered = F.when(original, _record("response", response, [request], [*uri, ("WARC-Payload-Digest", digest)], "application/http;msgtype=response", F.concat(http, F.col("html")))).otherwise(
        _record("revisit", response, [request], [*uri, ("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", refers)], "application/http;msgtype=response", http)
    )
    described = _record("metadata", metadata, [request, response], uri, "application/warc-fields", F.concat(F.lit("pageId: "), paged, F.lit("\r\n")))
    own = size_class(F.octet_length("html"))
    # four classes at most
    for k in sorted(r["class"] for r in marks.select("class").distinct().collect()) or [0]:
        lines = joined.filter(own == k).select(F.explode(F.array(asked, answered, described)).alias("value"))
        lines.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", class_records(k)).option("compression", compression).text(path)


_FIELD = re.compile(rb"^([!-9;-~]+):[ \t]*(.*?)[ \t]*$")


def parse(data: bytes):
    """(header fields by lower-case name, block) of each record of an archive; a repeated field is a list in order."""
    if data.startswith(b"\x1f\x8b"):
        data = gzip.decompress(data)
    view, at = memoryview(data), 0
    while at < len(data):
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record starts at byte {at}")
        fields: dict[str, list[str]] = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            m = _FIELD.match(line)
            if not m:
                raise ValueError(f"a header line of the record at byte {at} is no field")
            fields.setdefault(m[1].decode().lower(), []).append(m[2].decode("utf-8"))
        length = int(fields["content-length"][0])
        end = stop + 4 + length
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, view[stop + 4 : end]
        at = end + 4


RECORD = "record_id string, type string, target string, concurrent_to array<string>, refers_to string, digest string, payload_bytes long, block string"


def records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives under a path. block: the payload of a response, or what other records say."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.string()]

    def rows(data: bytes):
        for fields, block in parse(data):
            kind = fields["warc-type"][0]
            body = bytes(block)
            digest = fields.get("warc-payload-digest", [None])[0]
            if kind == "response":
                body = body[body.index(b"\r\n\r\n") + 4 :]
                digest_is = base64.b32encode(hashlib.sha1(body).digest()).decode()
                if digest != f"sha1:{digest_is}":
                    raise ValueError(f"the payload of {fields['warc-record-id'][0]} does not have its digest")
            shown = with_payload or kind == "metadata"
            yield (
                fields["warc-record-id"][0], kind, fields.get("warc-target-uri", [""])[0], fields.get("warc-concurrent-to", []), fields.get("warc-refers-to", [None])[0],
                digest.removeprefix("sha1:") if digest else None, len(body) if kind == "response" else None, body.decode("utf-8", "replace") if shown else None,
            )

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                part = []
                for row in rows(data.as_py()):
                    part.append(row)
                    if len(part) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)
                        part = []
                if part:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz,txt,txt.gz}").load(path).select("content")
    return map_arrow(files, run, RECORD)


def transactions(found: DataFrame) -> DataFrame:
    """(record_id, transaction) of records with a concurrent one: the least identifier that concurrent-to edges reach, in any direction."""
    edges = found.select(F.col("record_id").alias("u"), F.explode(F.array_distinct("concurrent_to")).alias("v"))
    return connected_components(edges).withColumnsRenamed({"node": "record_id", "root": "transaction"})


def captures(found: DataFrame) -> DataFrame:
    """One row for each transaction: request, response (or revisit) and metadata as structs; rows for further records of a kind."""
    kind = F.when(F.col("type") == "revisit", "response").otherwise(F.col("type"))
    kinds = ("request", "response", "metadata")
    named = found.withColumn("_kind", kind).filter(F.col("_kind").isin(*kinds))
    of = written(transactions(found.select("record_id", "concurrent_to")), "transactions")
    in_one = named.join(of, "record_id", "left").withColumn("transaction", F.coalesce("transaction", "record_id"))
    whole = F.struct("record_id", "target", "refers_to", "digest", "payload_bytes", "block", "type")
    least = in_one.groupBy("transaction").agg(*(F.min(F.when(F.col("_kind") == k, whole)).alias(k) for k in kinds), *(F.count_if(F.col("_kind") == k).alias(f"_n_{k}") for k in kinds))
    least = written(least, "captures")
    several = least.filter(" or ".join(f"_n_{k} > 1" for k in kinds)).select("transaction", *(F.col(f"{k}.record_id").alias(f"_{k}") for k in kinds))
    beside = in_one.join(several, "transaction").filter(~F.col("record_id").isin(*(F.coalesce(f"_{k}", F.lit("")) for k in kinds)))
    rest = beside.select("transaction", *(F.when(F.col("_kind") == k, whole).alias(k) for k in kinds))
    return least.select("transaction", *kinds).unionByName(rest)


def page_captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", revisit_from: int = 0, with_payload: bool = False, compression: str = "gzip") -> DataFrame:
    """Archives the pages, reads the archives back, and gives each page's capture with its page_id and original."""
    spark = pages.sparkSession
    path = folder(spark, "warc")
    archive(pages, path, page_id, url, payload, revisit_from, compression)
    kind = pages.schema[page_id].dataType.simpleString()
    found = written(records(spark, path, with_payload), "records")
    number = F.regexp_extract(F.col("metadata.block"), r"pageId: (.*?)\r\n", 1)
    each = captures(found).select("*", F.when(number != "", number).cast(kind).alias("page_id"))
    # a revisit's payload is its response's; the response's metadata knows its page
    originals = written(
        each.filter("response.type = 'response'").select(F.col("response.record_id").alias("original"), F.col("page_id").alias("original_page"), F.col("response.payload_bytes").alias("original_bytes")), "originals"
    )
    return each.withColumn("original", F.coalesce("response.refers_to", "response.record_id")).join(originals, "original", "left")
