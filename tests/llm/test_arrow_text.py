import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import arrow_text as A

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é漢\n\t ", max_size=30)), min_size=1, max_size=12)


def split(text):
    return [w for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_and_shingles(texts):
    raw, offs = A.text_buffers(pa.array(texts, pa.string()))
    starts, ends, first = A.word_bounds(raw, offs)
    found = [[bytes(raw[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])]
    assert found == [split(t) for t in texts]
    hashes = A.span_hashes(raw, starts, ends)
    words = [w for t in found for w in t]
    assert len({*zip(words, hashes.tolist())}) == len(set(words)) == len(set(hashes.tolist()))
    grams, begin = A.ngram_hashes(hashes, first, 3)
    wanted = [[tuple(t[i : i + 3]) for i in range(max(1, len(t) - 2))] if t else [] for t in found]
    assert np.diff(begin).tolist() == [len(w) for w in wanted]
    flat = [g for w in wanted for g in w]
    assert len({*zip(flat, grams.tolist())}) == len(set(flat)) == len(set(grams.tolist()))


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"i": list(range(50)), "text": ["x" * (k * 7) if k % 5 else None for k in range(50)]})
    seen = []
    for rows, raw, offs in A.text_slices(batch, "text", 100):
        assert len(offs) == rows.num_rows + 1 and offs[-1] == len(raw)
        seen += rows.column(0).to_pylist()
    assert seen == list(range(50))
