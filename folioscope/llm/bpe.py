"""Byte-level BPE over Arrow batches with the tokenizers library, with offsets and an exact way back.

White space of the split pattern ends a match before every plain space that a visible character follows,
so a text is cut there into pieces that can be encoded alone; a definition that does not split so (as a few probes tell) encodes whole
texts. Each distinct piece of a slice is encoded once by the library; a bounded cache keeps the pieces of earlier slices. The bytes of
a slice's ids are compared with its text, so pieces that share a hash are seen; their rows are encoded whole.

Defined results: a null or empty text has no ids; strings of special tokens are ordinary text; bytes that are no UTF-8 are read as
U+FFFD; ids outside the vocabulary raise ``ValueError`` when decoded. Rows repeat where the input repeats.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folioscope.llm.arrow_text import WHITE, span_hashes, text_slices
from folioscope.llm.workspace import map_arrow

#: Pieces in a worker's cache at most, bytes up to which pieces are told apart by the fast hash, and bytes that are encoded at once.
CACHE_PIECES = 1 << 19
PIECE_BYTES = 64
SLICE_BYTES = 1 << 21
#: Pieces in one call of the library, whose results take a hundred bytes an id.
CALL_PIECES = 1 << 12

# A piece may start with a plain space only before a byte that begins no white space: neither ASCII white space
# and control separators nor a lead byte of the other Unicode spaces.
_VISIBLE = ~WHITE & (np.arange(256) > 31) & ~np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])


#: Texts whose ids must be those of their pieces, if texts are to be cut at spaces.
PROBES = ("a b", "a  b", " a \n b", "it's 12 345\t x", "é 漢 字. ? !! a\u00a0b c", "1 2-3 (x) \r\n  y", "A B'LL c's  .", "🙂 🙂 a\u3000b c")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in shown)
    shown |= {b: chr(256 + k) for k, b in enumerate(rest)}
    return [shown[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and a rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes ``token``: what merges of lower rank leave of it."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    if len(parts) != 2:
        raise ValueError(f"no pair of tokens makes {token!r}")
    return parts[0], parts[1]


@lru_cache(maxsize=4)
def tokenizer_json_of_ranks(path: str, pattern: str) -> str:
    """A tokenizers definition that encodes each match of ``pattern`` by the ranks of the file."""
    ranks, shown = read_ranks(path), byte_characters()
    text = {t: "".join(shown[b] for b in t) for t in ranks}
    merges = [[text[a], text[b]] for t in sorted(ranks, key=ranks.get) if len(t) > 1 for a, b in [_halves(t, ranks)]]
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {text[t]: r for t, r in ranks.items()}, "merges": merges}
    split = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": split, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}, "model": model})


def tokenizer_json_of_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Ids of whole texts by one tokenizer; made once in each Python worker."""

    def __init__(self, definition: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True
        shown = {c: b for b, c in enumerate(byte_characters())}
        vocab = json.loads(definition)["model"]["vocab"]
        added = {x["id"]: x["content"].encode() for x in json.loads(definition)["added_tokens"]}
        size = max([*vocab.values(), *added]) + 1
        table: list[bytes | None] = [None] * size
        for token, i in vocab.items():
            table[i] = bytes(shown[c] for c in token)
        for i, content in added.items():
            table[i] = content
        self.token_bytes = np.array(table, dtype=object)
        self.token_sizes = np.array([-1 if t is None else len(t) for t in table], dtype=np.int64)
        self.decimals = np.array([str(i) for i in range(size)], dtype=object)
        flat = [t or b"" for t in table]
        self.flat = np.frombuffer(b"".join(flat), np.uint8)
        self.small_sizes = np.array([len(t) for t in flat], dtype=np.int32)
        self.flat_begin = np.cumsum(self.small_sizes, dtype=np.int32) - self.small_sizes
        self.most = cache_pieces
        self.keys = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int32)
        self.count = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)
        self.cuts = all(self._whole(t) == [i for x in self._spaced(t) for i in self._whole(x)] for t in PROBES)

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _fast(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts, without the offsets that the library keeps else."""
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _spaced(text: str) -> list[str]:
        raw = text.encode()
        at = [0, *(i for i in range(1, len(raw) - 1) if raw[i] == 32 and _VISIBLE[raw[i + 1]]), len(raw)]
        return [raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids of the vocabulary, as an array."""
        sizes = self.small_sizes[ids]
        ends = np.cumsum(sizes, dtype=np.int32)
        return self.flat[np.repeat(self.flat_begin[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, each row's first id and one more at the end) for UTF-8 bytes and row offsets."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        if self.cuts:
            try:
                ids, first = self._by_pieces(raw, offs)
                if np.array_equal(self.bytes_of(ids), raw):
                    return ids, first
            except ValueError:
                pass
        rows = [self._whole(raw[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        return np.array([i for r in rows for i in r], dtype=np.uint32), np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int64)

    def _by_pieces(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[:-2] = (raw[:-1] == 32) & _VISIBLE[raw[1:]]
        cut[offs] = True
        bounds = np.flatnonzero(cut)
        starts, ends = bounds[:-1], bounds[1:]
        keys = span_hashes(raw, starts, ends)
        for i in np.flatnonzero(ends - starts > PIECE_BYTES):
            keys[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        unique, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        begin, count = np.empty(len(unique), np.int64), np.empty(len(unique), np.int64)
        begin[known], count[known] = self.begin[at[known]], self.count[at[known]]
        pool = self.pool
        if len(new):
            whole = raw.tobytes()
            # pieces that start with a space end at a match's end whatever comes before: they are one text for the library
            alone = raw[starts[where[new]]] != 32
            new = np.concatenate([new[alone], new[~alone]])
            s, e = starts[where[new]].tolist(), ends[where[new]].tolist()
            k = int(alone.sum())
            texts = [whole[a:b].decode("utf-8") for a, b in zip(s[:k], e[:k], strict=True)]
            found = [ids for a in range(0, k, CALL_PIECES) for ids in self._fast(texts[a : a + CALL_PIECES])]
            count[new[:k]] = np.fromiter(map(len, found), np.int64, k)
            joined = [b"".join([whole[a:b] for a, b in zip(s[at : at + CALL_PIECES], e[at : at + CALL_PIECES], strict=True)]) for at in range(k, len(s), CALL_PIECES)]
            spaced = np.concatenate([np.zeros(0, np.uint32), *(np.array(ids, dtype=np.uint32) for ids in self._fast([x.decode("utf-8") for x in joined]))])
            if int(self.token_sizes[spaced].sum()) != sum(map(len, joined)):
                raise ValueError("a text is not valid UTF-8")
            stops = np.searchsorted(np.cumsum(self.token_sizes[spaced]), np.cumsum((ends - starts)[where[new[k:]]])) + 1
            count[new[k:]] = np.diff(stops, prepend=0)
            begin[new] = len(pool) + np.concatenate([[0], np.cumsum(count[new])[:-1]])
            pool = np.concatenate([pool, np.fromiter((i for ids in found for i in ids), np.uint32), spaced])
            new = np.sort(new)
        counts = count[inverse]
        tokens = np.concatenate([[0], np.cumsum(counts)])
        ids = pool[np.repeat(begin[inverse] - tokens[:-1], counts) + np.arange(tokens[-1])]
        if len(new):
            # a full cache stays as it is: frequent pieces come early
            if len(self.keys) + len(new) <= self.most and len(pool) < 1 << 31:
                self.pool = pool
                self.keys = np.insert(self.keys, at[new], unique[new])
                self.begin = np.insert(self.begin, at[new], begin[new].astype(np.int32))
                self.count = np.insert(self.count, at[new], count[new].astype(np.int32))
        return ids, tokens[np.searchsorted(bounds, offs)]

    def offsets(self, raw: np.ndarray, offs: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each id in code points of its own text; an id inside a character spans all of it.

        Bytes that are no UTF-8 are read as U+FFFD, as in :meth:`encode`.
        """
        if int(self.token_sizes[ids].sum()) != len(raw):
            rows = [raw[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offs[:-1], offs[1:], strict=True)]
            raw, offs = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        ends = np.cumsum(self.token_sizes[ids])
        starts = ends - self.token_sizes[ids]
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        own = np.concatenate([character, [0]])[np.minimum(offs[:-1], max(len(raw) - 1, 0))] if len(raw) else np.zeros(len(offs) - 1, np.int64)
        base = np.repeat(own, np.diff(first))
        return character[starts] - base, character[ends - 1] + 1 - base

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        if len(ids) and (int(ids.max()) >= len(self.token_sizes) or (self.token_sizes[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        return b"".join(self.token_bytes[ids].tolist())

    def decode_text(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no whole character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_parts(self, parts: list[np.ndarray]) -> list[str]:
        """Texts of consecutive runs of ids; a character split between runs comes with the run that ends it."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        return [reader.decode(self.decode_bytes(ids), final=k == len(parts) - 1) for k, ids in enumerate(parts)]


_encoders: dict[str, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """This process's encoder of a definition."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def kept_columns(df: DataFrame, made: list[str], text: str, with_text: bool) -> list[str]:
    """The input's columns that stay beside the computed ones, which win where names clash."""
    taken = {c.lower() for c in made}
    return [c for c in df.columns if c.lower() not in taken and (with_text or c != text)]


def with_rows(batch: pa.RecordBatch, keep: list[str], made: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
    return pa.RecordBatch.from_arrays([*kept, *made.values()], names=[*keep, *made])


def encode_columns(df: DataFrame, definition: str, text: str = "text", with_text: bool = True) -> DataFrame:
    """Adds ids, and starts and ends in code points, as arrays."""
    made = ["ids", "starts", "ends"]
    keep = kept_columns(df, made, text, with_text)
    source = df.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in made])

    def run(batches):
        own = encoder(definition)
        for batch in batches:
            for rows, raw, offs in text_slices(batch, text, SLICE_BYTES):
                ids, first = own.encode(raw, offs)
                starts, ends = own.offsets(raw, offs, ids, first)
                lists = {n: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(v.astype(np.int32))) for n, v in zip(made, (ids, starts, ends), strict=True)}
                yield with_rows(rows, keep, lists)

    return map_arrow(source, run, schema)


def decode_column(df: DataFrame, definition: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the decoded text of an array of ids; null ids give a null text."""
    keep = [c for c in df.columns if c.lower() != to.lower()]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(to, T.StringType())])

    def run(batches):
        own = encoder(definition)
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [None if v is None else own.decode_text(np.array(v, dtype=np.int64)) for v in values]
            yield with_rows(batch, keep, {to: pa.array(texts, pa.string())})

    return map_arrow(df, run, schema)


def round_trip_digests(df: DataFrame, definition: str, text: str = "text") -> DataFrame:
    """Encodes each text and decodes its ids: number of ids, SHA-256 of the decimal ids and of the decoded bytes.

    offsets_crc32: of the ids' starts and then their ends in code points, as little-endian 32-bit numbers.
    """
    made = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "offsets_crc32": pa.int64()}
    keep = kept_columns(df, list(made), text, False)
    source = df.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([source.schema[c] for c in keep]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("offsets_crc32", "long")

    def run(batches):
        own = encoder(definition)
        for batch in batches:
            for rows, raw, offs in text_slices(batch, text, SLICE_BYTES):
                ids, first = own.encode(raw, offs)
                digests, decoded, places = [], [], []
                starts, ends = (x.astype("<u4") for x in own.offsets(raw, offs, ids, first))
                for i in range(len(first) - 1):
                    places.append(zlib.crc32(ends[first[i] : first[i + 1]], zlib.crc32(starts[first[i] : first[i + 1]])))
                    part = ids[first[i] : first[i + 1]]
                    digests.append(hashlib.sha256(" ".join(own.decimals[part].tolist()).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode_bytes(part)).hexdigest())
                yield with_rows(rows, keep, dict(zip(made, (pa.array(np.diff(first)), pa.array(digests), pa.array(decoded), pa.array(places, pa.int64())), strict=True)))

    return map_arrow(source, run, schema)
