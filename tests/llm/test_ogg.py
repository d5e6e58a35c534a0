import hashlib
import os
import zlib

import pytest

from folioscope.llm import ogg
from tests.llm.conftest import ODD


def bitwise(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    for n in (0, 1, 7, 300):
        data = os.urandom(n)
        assert ogg.checksum(data) == bitwise(data)


@pytest.mark.parametrize("size", [64, 1024, 1088, 255 * 64, 64_000, 255 * 255 * 16])
@pytest.mark.parametrize("packet", [255, 1024, 70_000])
@pytest.mark.parametrize("segments", [3, 255])
def test_round_trip(size, packet, segments):
    payload = os.urandom(size)
    back, rate, times, count = ogg.samples(ogg.store(payload, packet=packet, segments=segments))
    assert back == payload and count == -(-size // packet) and times[-1] == (size, size / rate)


def test_streams_are_kept_apart():
    a, b = [(0, b"head"), (5, b"x" * 600)], [(0, b"other"), (1, b"y" * 255), (2, b"")]
    pages = [p for pair in zip(ogg.stream_pages(1, a, 2), ogg.stream_pages(2, b, 2) + [b""] * 9) for p in pair]
    found = ogg.packets(b"".join(pages))
    assert [d for _, d in found[1]] == [d for _, d in a] and [d for _, d in found[2]] == [d for _, d in b]
    assert found[1][-1][0] == 5


def test_faults_are_seen():
    media = ogg.store(os.urandom(4096), segments=4)
    with pytest.raises(ValueError, match="checksum"):
        ogg.samples(media[:60] + bytes([media[60] ^ 1]) + media[61:])
    with pytest.raises(ValueError):
        ogg.samples(media[:-30])
    pages = []
    at = 0
    for p in ogg.pages(media):
        size = 27 + len(p.lacing) + len(p.body)
        pages.append(media[at : at + size])
        at += size
    with pytest.raises(ValueError):
        ogg.samples(b"".join(pages[:3] + pages[4:]))


def test_columns(documents):
    docs = documents(ODD, media="mine", feature="mine")
    rows = ogg.media_columns(docs, keep_media=True).collect()
    assert len(rows) == len(ODD)
    by_text = {}
    for (i, text), r in zip(ODD, rows):
        data = (text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (i, len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert ogg.samples(bytes(r["media"]))[0] == payload and r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        by_text.setdefault(text or "", set()).add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert ogg.media_columns(documents([])).collect() == []
