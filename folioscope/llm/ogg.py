"""Media columns: Ogg. Pages, lacing, logical streams and granule positions (RFC 3533).

``store`` writes a payload as two multiplexed logical streams: 8-bit samples in packets, and an index
stream with one packet that describes them. ``pages`` reads and verifies pages, ``packets`` reassembles
and demultiplexes, ``samples`` gives the payload back.

Defined results: a null text is an empty one; the payload of an empty text is 64 zero bytes; equal texts
give equal media (serial numbers come from the payload, not from the row); a page with a wrong
checksum, a gap in a stream's page sequence or a packet without its end raises ``ValueError``.
Extra columns of the input stay; a column that has the name of a computed one is replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioscope.llm.arrow_text import text_buffers
from folioscope.llm.workspace import map_arrow

CONTINUED, BEGIN, END = 1, 2, 4
#: Samples in a second, and in a packet.
RATE = 8000
PACKET = 1024
#: Lacing values in a page; the format allows 255.
SEGMENTS = 255

_HEADER = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """The page checksum: CRC-32 of polynomial 0x04c11db7, most significant bit first, from 0.

    zlib computes the mirrored form, so bytes go in and the result comes out with their bits reversed.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    whole = head + lacing + body
    return whole[:22] + struct.pack("<I", checksum(whole)) + whole[26:]


def stream_pages(serial: int, packets: list[tuple[int, bytes]], segments: int = SEGMENTS) -> list[bytes]:
    """Pages of one logical stream. packets: (granule position after it, bytes); the first has a page of its own."""
    out: list[bytes] = []
    lacing, body, granule, flags = bytearray(), bytearray(), -1, BEGIN

    def flush(more: int) -> None:
        nonlocal lacing, body, granule, flags
        out.append(_page(flags | more, granule, serial, len(out), bytes(lacing), bytes(body)))
        lacing, body, granule, flags = bytearray(), bytearray(), -1, 0

    for k, (position, data) in enumerate(packets):
        full, rest = divmod(len(data), 255)
        at = 0
        for value in [255] * full + [rest]:
            if len(lacing) == segments:
                flush(0)
                if at:
                    flags = CONTINUED
            lacing.append(value)
            body += data[at : at + value]
            at += value
        granule = position
        if k == 0 and len(packets) > 1:
            flush(0)
    flush(END)
    return out


def store(payload: bytes, rate: int = RATE, packet: int = PACKET, segments: int = SEGMENTS) -> bytes:
    """The payload as 8-bit samples in an Ogg file of two logical streams."""
    serial = zlib.crc32(payload)
    parts = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    ends = [min(len(payload), (i + 1) * packet) for i in range(len(parts))]
    sound = stream_pages(serial, [(0, b"pcm8" + struct.pack("<IQ", rate, len(payload))), *zip(ends, parts, strict=True)], segments)
    index = stream_pages(serial ^ 0xFFFFFFFF, [(0, b"index"), (len(parts), struct.pack("<QI", len(parts), serial))], segments)
    # all first pages come before other pages; then the streams alternate
    mixed = [sound[0], index[0]]
    for k in range(1, max(len(sound), len(index))):
        mixed += [*sound[k : k + 1], *index[k : k + 1]]
    return b"".join(mixed)


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: bytes


def pages(media: bytes) -> Iterator[Page]:
    """The pages of a physical stream, each with a verified checksum."""
    at = 0
    while at < len(media):
        if len(media) < at + 27:
            raise ValueError(f"page at byte {at} is cut short")
        magic, version, flags, granule, serial, number, crc, count = _HEADER.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page starts at byte {at}")
        lacing = media[at + 27 : at + 27 + count]
        end = at + 27 + count + sum(lacing)
        if len(lacing) < count or end > len(media):
            raise ValueError(f"page at byte {at} is cut short")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        yield Page(flags, granule, serial, number, lacing, media[at + 27 + count : end])
        at = end


def packets(media: bytes) -> dict[int, list[tuple[int | None, bytes]]]:
    """Each logical stream's packets, by serial number: (granule position, bytes).

    A page's granule position belongs to the last packet that ends on it; other packets have None.
    """
    streams: dict[int, list[tuple[int | None, bytes]]] = {}
    state: dict[int, list] = {}  # serial -> next page number, pieces of an open packet, whether the stream ended
    for page in pages(media):
        if page.flags & BEGIN:
            if page.serial in state:
                raise ValueError(f"stream {page.serial} begins twice")
            state[page.serial], streams[page.serial] = [0, [], False], []
        own = state.get(page.serial)
        if own is None or own[2] or own[0] != page.number:
            raise ValueError(f"page {page.number} of stream {page.serial} is out of order")
        if bool(page.flags & CONTINUED) != bool(own[1]):
            raise ValueError(f"stream {page.serial}: a packet is not continued as announced")
        own[0] += 1
        done, at = 0, 0
        for value in page.lacing:
            own[1].append(page.body[at : at + value])
            at += value
            if value < 255:
                streams[page.serial].append((None, b"".join(own[1])))
                own[1], done = [], done + 1
        if done:
            streams[page.serial][-1] = (page.granule, streams[page.serial][-1][1])
        own[2] = bool(page.flags & END)
    for serial, (_, pieces, ended) in state.items():
        if pieces or not ended:
            raise ValueError(f"stream {serial} has no end")
    return streams


def samples(media: bytes) -> tuple[bytes, int, list[tuple[int, float]], int]:
    """(payload, rate, [(samples up to a page's end, its time in seconds)], number of sample packets).

    Positions inside a page follow from the packets' own sample counts and must meet the page's granule position.
    """
    streams = packets(media)
    sound = [s for s, found in streams.items() if found[0][1][:4] == b"pcm8"]
    index = [s for s, found in streams.items() if found[0][1] == b"index"]
    if len(sound) != 1 or len(index) != 1:
        raise ValueError("one sample stream and one index stream are expected")
    head, *data = streams[sound[0]]
    rate, length = struct.unpack("<IQ", head[1][4:])
    position, times = 0, []
    for granule, part in data:
        position += len(part)
        if granule is not None:
            if granule != position:
                raise ValueError(f"granule position {granule} where {position} samples end")
            times.append((position, position / rate))
    payload = b"".join(part for _, part in data)
    count, crc = struct.unpack("<QI", streams[index[0]][1][1])
    if len(payload) != length or count != len(data) or crc != zlib.crc32(payload):
        raise ValueError("the samples are not those that the index describes")
    return payload, rate, times, len(data)


def feature(payload: bytes, rate: int, times: list[tuple[int, float]], count: int) -> str:
    """Duration, packets, mean, root mean square and sign changes about the middle, as text."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int64) - 128
    turns = int(np.count_nonzero(np.diff(x >= 0)))
    last = times[-1][1] if times else 0.0
    return f"rate={rate};packets={count};marks={len(times)};seconds={last:.6f};mean={x.mean():.4f};rms={np.sqrt(np.mean(x * x)):.4f};turns={turns}"


COLUMNS = {
    "n_bytes": ("long", pa.int64()), "payload_bytes": ("long", pa.int64()), "payload_sha256": ("string", pa.string()),
    "tail_crc32": ("long", pa.int64()), "media_bytes": ("long", pa.int64()), "media_sha256": ("string", pa.string()), "feature": ("string", pa.string()),
}


def media_columns(df: DataFrame, text: str = "text", keep_media: bool = False, block: int = 64) -> DataFrame:
    """Store each text as Ogg, read it back and describe it; ``keep_media`` adds the file as ``media``."""
    names = [*COLUMNS, *(["media"] if keep_media else [])]
    keep = [c for c in df.columns if c.lower() not in {n.lower() for n in names} and (c != text or keep_media)]
    source = df.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([source.schema[c] for c in keep])
    for n in names:
        schema.add(n, T.BinaryType() if n == "media" else COLUMNS[n][0])

    def run(batches):
        for batch in batches:
            raw, offs = text_buffers(batch.column(batch.schema.get_field_index(text)))
            whole = raw.tobytes()
            for first in range(0, batch.num_rows, 2000):
                last = min(first + 2000, batch.num_rows)
                rows = {n: [] for n in names}
                for i in range(first, last):
                    data = whole[offs[i] : offs[i + 1]]
                    payload = data + bytes(max(block, -(-len(data) // block) * block) - len(data))
                    media = store(payload)
                    back, rate, times, count = samples(media)
                    values = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, rate, times, count))
                    for n, v in zip(COLUMNS, values, strict=True):
                        rows[n].append(v)
                    if keep_media:
                        rows["media"].append(media)
                part = batch.slice(first, last - first)
                kept = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(rows[n], pa.binary() if n == "media" else COLUMNS[n][1]) for n in names)], names=[*keep, *names])

    return map_arrow(source, run, schema)
