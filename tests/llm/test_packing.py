import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from folioscope.llm import bpe, packing
from tests.llm.conftest import ODD


def histograms():
    draw = random.Random(2)
    return [{}, {1: 5}, {2048: 3}, {100: 1000}, {2000: 5, 48: 7, 3: 100, 1: 1}, {draw.randint(1, 2048): draw.randint(1, 9) for _ in range(400)}, {n: draw.randint(1, 10**6) for n in range(1, 2049)}]


@pytest.mark.parametrize("histogram", histograms())
def test_patterns_hold_every_piece(histogram):
    patterns = packing.shortest_pack_first(dict(histogram))
    held = Counter()
    for p in patterns:
        assert sum(a * b for a, b in p.parts) <= 2048
        for length, each in p.parts:
            held[length] += each * p.packs
    assert held == Counter(histogram)
    assert len(patterns) <= 2 * 2048
    total, packs = sum(a * b for a, b in histogram.items()), sum(p.packs for p in patterns)
    if len(histogram) > 300:
        assert total / (packs * 2048) > 0.97


def check(rows, texts, size):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own, at = sorted(by_doc[i], key=lambda r: r["start"]), 0
        for r in own:
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size


def test_documents(documents):
    draw = random.Random(1)
    rows = [(i, t) for i, t in ODD if i not in (4, 5, None)] + [(100 + k, " ".join(f"word{draw.randint(0, 99)}" for _ in range(draw.randint(0, 300)))) for k in range(60)]
    definition = bpe.tokenizer_json_of_file(P.path("byte_bpe_50k.json"))
    for size in (2048, 64):
        found = packing.packed_documents(documents(rows, offset="mine", length="mine"), definition, size=size, with_ids=True).collect()
        check(found, dict(rows), size)
        assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] for r in found)


def test_repeated_rows_and_empty_table(documents):
    definition = bpe.tokenizer_json_of_file(P.path("byte_bpe_50k.json"))
    found = packing.packed_documents(documents([(1, "a b"), (1, "a b"), (None, None), (None, None)]), definition).collect()
    assert len(found) == 4 and len({(r["sequence_id"], r["offset"]) for r in found}) == 4
    assert packing.packed_documents(documents([]), definition).collect() == []
