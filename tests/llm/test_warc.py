import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from folioscope.llm import queries, warc
from folioscope.llm.workspace import folder

PAGES = [
    (1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "same\r\n\r\nWARC/1.1\r\nbody"), (3, "http://a/3", "same\r\n\r\nWARC/1.1\r\nbody"), (4, None, None), (5, "http://a/5\r\nX: y", ""), (6, "http://a/6", "x" * 200_000),
    (7, "http://a/7", "same\r\n\r\nWARC/1.1\r\nbody"), (8, "http://a/8", "twice"), (8, "http://a/8", "twice"), (None, "http://a/n", "null id"), (9, "http://a/9", "漢" * 9),
]


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, record_id string")


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def wanted(rows):
    out, seen = [], set()
    for i, url, html in rows:
        same = [r for r in rows if (r[2] or "") == (html or "")]
        best = max(same, key=lambda r: (r[0] is not None, r[0] or 0))
        first = (i, url, html) == best and best not in seen
        if first:
            seen.add(best)
        out.append((i, len((html or "").encode()), sha(html), "response" if first else "revisit", None if first else best[0]))
    return sorted(out, key=str)


def test_query(spark, pages, tmp_path):
    pages(PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.QUERIES["op5_warc_transactions"](spark, str(tmp_path))
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in found.collect()), key=str) == wanted(PAGES)


def test_captures_hold_payloads(pages):
    rows = warc.page_captures(pages(PAGES), with_payload=True, compression="none").collect()
    assert len(rows) == len(PAGES)
    texts = {(i, h or "") for i, _, h in PAGES}
    for r in rows:
        assert r["request"]["type"] == "request" and r["metadata"]["type"] == "metadata"
        if r["response"]["type"] == "response":
            assert (r["page_id"], r["response"]["block"]) in texts


def test_revisits_from_a_length_on(pages):
    rows = warc.page_captures(pages(PAGES), revisit_from=6).collect()
    kinds = sorted((str(r["page_id"]), r["response"]["type"]) for r in rows)
    assert kinds.count(("8", "response")) == 2 and ("2", "revisit") in kinds and ("4", "response") in kinds and ("5", "response") in kinds


def test_empty_table(pages):
    assert warc.page_captures(pages([])).collect() == []


def test_base32(spark):
    df = spark.createDataFrame([(x,) for x in ("", "a", "é" * 50)], "t string")
    assert [r[0] for r in df.select(warc.base32(F.sha1(F.col("t").cast("binary")))).collect()] == [sha(x) for x in ("", "a", "é" * 50)]


def test_faults_are_seen(spark, pages, tmp_path):
    path = folder(spark, "w")
    warc.archive(pages(PAGES[:1]), path, compression="none")
    [data] = [bytes(r["content"]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).collect() if r["content"]]
    assert [f["warc-type"][0] for f, _ in warc.parse(data)] == ["request", "response", "metadata"]
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse(data[:-1]))
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse(b"x" + data))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.txt").write_bytes(data.replace("<p>é".encode(), "<q>é".encode()))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.records(spark, str(tmp_path / "bad")).collect()


def record(kind, name, others=(), payload="x", extra=()):
    head = b"HTTP/1.1 200 OK\r\n\r\n" if kind == "response" else b""
    body = head + payload.encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", name), *(("WARC-Concurrent-To", o) for o in others), *([("WARC-Payload-Digest", f"sha1:{sha(payload)}")] if kind == "response" else []), *extra, ("Content-Length", str(len(body)))]
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n" + body + b"\r\n\r\n"


def test_transactions_in_any_direction(spark, tmp_path):
    """Requests that name responses, chains, several ids, missing partners, lone responses, and further records of a kind."""
    records = [
        record("warcinfo", "<i>"), record("request", "<q1>", ["<r1>"]), record("response", "<r1>", payload="one"), record("metadata", "<m1>", ["<r1>"]),
        record("response", "<r2>", payload="alone"), record("response", "<r3>", ["<q3>", "<m3>"]), record("request", "<q3>"), record("metadata", "<m3>"),
        record("request", "<q4>", ["<gone>"]), record("metadata", "<m5>", ["<r5>"]), record("metadata", "<m6>", ["<r5>"]), record("response", "<r5>"), record("revisit", "<v7>", ["<v7>"]),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records[:6]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[6:]))
    rows = warc.captures(warc.records(spark, str(tmp_path))).collect()
    got = sorted([tuple(r[k]["record_id"] if r[k] else None for k in ("request", "response", "metadata")) for r in rows], key=str)
    assert got == sorted([("<q1>", "<r1>", "<m1>"), (None, "<r2>", None), ("<q3>", "<r3>", "<m3>"), ("<q4>", None, None), (None, "<r5>", "<m5>"), (None, None, "<m6>"), (None, "<v7>", None)], key=str)
    assert len({r["transaction"] for r in rows}) == 6 and {r["response"]["block"] for r in rows if r["response"] and r["response"]["type"] == "response"} == {"one", "alone", "x"}


def test_files_are_bounded_in_bytes(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 30_000)
    monkeypatch.setattr(warc, "FILE_RECORDS", 300)
    rows = [(k, f"http://a/{k}", str(k) * n) for k, n in enumerate([5] * 150 + [900] * 40 + [30_000] * 3 + [200_000] * 2)]
    path = folder(spark, "w")
    warc.archive(pages(rows).coalesce(1), path, compression="none")
    sizes = [r["length"] for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len(warc.records(spark, path).collect()) == 3 * len(rows) and len(sizes) >= 2 + 7 + 5
    assert sorted(sizes)[-5:][0] > 89_000 and sorted(sizes)[-6] < 150_000
