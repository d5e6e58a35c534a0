import hashlib
import json
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from folioscope.llm import arrow_text as A
from folioscope.llm import bpe
from tests.llm.conftest import ODD

RANKS = P.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "é", "漢", "😀", " ", " ", "　", "\x85", "1", "23", ".", "--", "'ll", "The", "the", "<|endoftext|>", "\r\n", "\x1c", "​", "ß", "I'm", "́", "\x0b", "\x00"]


@pytest.fixture(scope="module")
def definition():
    return bpe.tokenizer_json_of_ranks(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def random_texts(n):
    draw = random.Random(3)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 30))) for _ in range(n)] + [None, "", "x" * 5000, " " * 300, "the " * 1000]


def test_like_tiktoken(definition, tik):
    texts = random_texts(1500)
    own = bpe.Encoder(definition)
    raw, offs = A.text_buffers(pa.array(texts))
    for _ in range(2):  # with an empty and with a full cache
        ids, first = own.encode(raw, offs)
        for text, a, b in zip(texts, first[:-1], first[1:]):
            assert ids[a:b].tolist() == tik.encode_ordinary(text or "")
            assert own.decode_bytes(ids[a:b]) == (text or "").encode()


def test_like_the_library_and_its_offsets(definition):
    texts = random_texts(300)
    own = bpe.Encoder(bpe.tokenizer_json_of_file(P.path("byte_bpe_50k.json")), cache_pieces=50)
    raw, offs = A.text_buffers(pa.array(texts))
    ids, first = own.encode(raw, offs)
    starts, ends = own.offsets(raw, offs, ids, first)
    for text, a, b in zip(texts, first[:-1], first[1:]):
        wanted = own.library.encode(text or "", add_special_tokens=False)
        assert ids[a:b].tolist() == wanted.ids
        assert list(zip(starts[a:b].tolist(), ends[a:b].tolist())) == wanted.offsets


def test_split_characters(definition):
    own = bpe.Encoder(definition)
    ids = np.array([own.token_bytes.tolist().index(bytes([b])) for b in "é漢".encode()])
    assert own.decode_text(ids[:1]) == "�"
    assert own.decode_parts([ids[:1], ids[1:3], ids[3:]]) == ["", "é", "漢"]
    with pytest.raises(ValueError):
        own.decode_bytes(np.array([10**6]))


def test_columns(documents, definition, tik):
    docs = documents(ODD, ids="mine", n_tokens="mine")
    found = bpe.encode_columns(docs, definition)
    back = bpe.decode_column(found, definition).collect()
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_tokens", "ids", "starts", "ends"]
    for r in back:
        assert r["ids"] == tik.encode_ordinary(r["text"] or "") and r["decoded"] == (r["text"] or "")
        assert all((r["text"] or "")[a:b] for a, b in zip(r["starts"], r["ends"]))
    assert len(back) == len(ODD)


def test_digests(documents, definition, tik):
    rows = bpe.round_trip_digests(documents(ODD, n_tokens="mine").select("doc_id", "text", "n_tokens"), definition).collect()
    assert len(rows) == len(ODD)
    for (i, text), r in zip(ODD, rows):
        ids = tik.encode_ordinary(text or "")
        assert (r["doc_id"], r["n_tokens"]) == (i, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table(documents, definition):
    assert bpe.round_trip_digests(documents([]), definition).collect() == []
    assert bpe.encode_columns(documents([]), definition).collect() == []


def test_pieces_that_share_a_hash(definition, tik, monkeypatch):
    """Their rows are encoded whole, in the slice of both and behind the cache."""
    own = bpe.Encoder(definition)
    monkeypatch.setattr(bpe, "span_hashes", lambda raw, starts, ends: np.full(len(starts), 7, dtype=np.uint64))
    for texts in (["one two"], ["other words", "one two three"], ["one two"]):
        raw, offs = A.text_buffers(pa.array(texts))
        ids, first = own.encode(raw, offs)
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [tik.encode_ordinary(t) for t in texts]


def test_bytes_that_are_no_text(definition, tik):
    own = bpe.Encoder(definition)
    rows = [b"ok \xff x", b"\xc3", b" \xe6\xbc", b"fine"]
    raw, offs = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    ids, first = own.encode(raw, offs)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [tik.encode_ordinary(r.decode("utf-8", "replace")) for r in rows]
    starts, ends = own.offsets(raw, offs, ids, first)
    assert ends[first[1:] - 1].tolist() == [len(r.decode("utf-8", "replace")) for r in rows] and (starts[first[:-1]] == 0).all()


def test_definitions_that_must_not_be_cut(definition):
    assert bpe.Encoder(definition).cuts
    joined = json.loads(definition)
    joined["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[^\n]+|\n+"
    vocab = {c: k for k, c in enumerate(bpe.byte_characters())}
    joined["model"] |= {"vocab": vocab | {"a\u0120": 256, "a\u0120b": 257}, "merges": [["a", "\u0120"], ["a\u0120", "b"]]}
    own = bpe.Encoder(json.dumps(joined))
    raw, offs = A.text_buffers(pa.array(["a b or not", "a b\nc d"]))
    ids, first = own.encode(raw, offs)
    assert not own.cuts and ids[0] == 257 and [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [own.library.encode(t, add_special_tokens=False).ids for t in ("a b or not", "a b\nc d")]
