import collections
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import suffixes
from tests.llm.conftest import ODD


def words_of(text):
    return [(m.start(), m.end()) for m in re.finditer(r"[^\t\n\x0b\x0c\r ]+", text or "")]


def merge(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def brute(rows, length):
    """{row: (repeated spans, code points to remove)}; rows with equal ids and texts do not occur here."""
    where, held = collections.defaultdict(list), {}
    for key, text in rows:
        spans = words_of(text)
        held[key] = spans
        words = [text[a:b] for a, b in spans]
        for s in range(len(words) - length + 1):
            where[tuple(words[s : s + length])].append((key, s))
    every, first, later = (collections.defaultdict(list) for _ in range(3))
    for places in where.values():
        if len(places) > 1:
            for key, s in places:
                span = (held[key][s][0], held[key][s + length - 1][1])
                every[key].append(span)
                (first if (key, s) == min(places) else later)[key].append(span)
    points = lambda spans: {p for a, b in spans for p in range(a, b)}
    return {k: (merge(v), points(later[k]) - points(first[k])) for k, v in every.items()}


def corpus(seed, docs=40):
    draw = random.Random(seed)
    passages = [[f"p{draw.randint(0, 400)}" for _ in range(draw.randint(8, 40))] for _ in range(8)]
    rows = []
    for i in range(docs):
        text = []
        for _ in range(draw.randint(1, 6)):
            text += draw.choice(passages) if draw.random() < 0.5 else [f"é{draw.randint(0, 3000)}" for _ in range(draw.randint(1, 30))]
            if draw.random() < 0.2 and len(text) > 5:
                text[draw.randrange(len(text))] = "edit"
        rows.append((i, draw.choice([" ", "\n", "  "]).join(text)))
    rows.append((docs, "der " * 60))
    rows.append((docs + 1, "der die " * 40))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("sizes", [(10, 6, 2), (12, 10, 3), (8, 5, 2)])
def test_like_brute_force(documents, seed, sizes):
    length, window, gram = sizes
    rows = corpus(seed)
    found = suffixes.repeats(documents(rows, spans="mine", removed="mine"), length=length, window=window, gram=gram).collect()
    wanted = brute(rows, length)
    assert {r["doc_id"] for r in found} == set(wanted)
    for r in found:
        spans, removed = wanted[r["doc_id"]]
        assert [tuple(s) for s in r["spans"]] == spans
        assert {p for a, b in r["removed"] for p in range(a, b)} == removed


@pytest.mark.parametrize(("part", "segment"), [(300, 1 << 15), (1 << 24, 1), (2000, 3)])
def test_borders(spark, documents, monkeypatch, part, segment):
    """Suffixes dealt over many tasks and cut into small segments; a phrase in every text, with other words around it, and one long passage."""
    monkeypatch.setattr(suffixes, "PART_BYTES", part)
    monkeypatch.setattr(suffixes, "SEGMENT_ROWS", segment)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    draw = random.Random(11)
    some = lambda n: [f"w{draw.randint(0, 60)}" for _ in range(n)]
    phrase, passage = some(9), some(40)
    rows = [(k, " ".join(some(draw.randint(0, 12)) + (phrase if k % 3 else passage) + some(draw.randint(0, 12)))) for k in range(150)]
    try:
        found = suffixes.repeats(documents(rows), length=10, window=6, gram=2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = brute(rows, 10)
    assert {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found} == {k: v[0] for k, v in wanted.items()}
    assert all({p for a, b in r["removed"] for p in range(a, b)} == wanted[r["doc_id"]][1] for r in found)


def test_common_words():
    texts = ["", "a ", "a b ", "a bc ", "a bc ", "a bc d ", "é é ", "é è "]
    assert suffixes.common_words(pa.array(texts)).tolist() == [0, 1, 1, 2, 2, 0, 1]


def test_windows_wider_than_a_passage(documents):
    with pytest.raises(ValueError, match="window"):
        suffixes.suffixes(documents([]), length=10, window=11)


def test_wide_windows(documents):
    rows = corpus(4, docs=25)
    found = suffixes.repeats(documents(rows), length=40, window=35, gram=2).collect()
    assert {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found} == {k: v[0] for k, v in brute(rows, 40).items()}
    long = [(k, " ".join(f"x{j}" for j in range(k, 700 + k))) for k in range(2)]
    found = suffixes.repeats(documents(long), length=400, window=350, gram=2).collect()
    assert {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in found} == {k: v[0] for k, v in brute(long, 400).items()}


def test_fifty_words(documents):
    draw = random.Random(4)
    passage = " ".join(f"q{draw.randint(0, 9000)}" for _ in range(55))
    fill = lambda: " ".join(f"f{draw.randint(0, 10**6)}" for _ in range(30))
    short = " ".join(passage.split()[:49])
    rows = [(1, f"{fill()} {passage} {fill()}"), (2, f"{fill()}\n{passage}"), (3, fill()), (4, f"{fill()} {short} {fill()}"), (None, f"{passage} {fill()}")]
    found = {r["doc_id"]: r for r in suffixes.repeats(documents(rows)).collect()}
    assert set(found) == {None, 1, 2}
    texts = dict(rows)
    for i, r in found.items():
        assert [texts[i][a:b] for a, b in r["spans"]] == [passage]
    # null ids sort first, so that copy stays
    assert [len(found[i]["removed"]) for i in (None, 1, 2)] == [0, 1, 1]


def test_odd_rows(documents):
    found = {(r["doc_id"]): r for r in suffixes.repeats(documents(ODD)).collect()}
    assert set(found) == {7}
    text = dict(ODD)[7]
    a, b = found[7]["spans"][0]
    assert (a, b) == (0, len(text) - 1)
    assert [tuple(s) for s in found[7]["removed"]] == [(50 * 5 - 1, len(text) - 1)]
    assert suffixes.repeats(documents([])).collect() == []


def test_repeated_rows(documents):
    text = " ".join(f"w{k}" for k in range(80))
    found = suffixes.repeats(documents([(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], len(r["removed"])) for r in found) == [(1, 0), (2, 1)]


def test_cut_out(spark):
    df = spark.createDataFrame([("aébcdef", [(1, 3), (5, 7)]), ("abc", []), ("abc", None), ("abc", [(0, 3)])], "t string, r array<struct<start:long,end:long>>")
    assert [r[0] for r in df.select(suffixes.cut_out(F.col("t"), F.col("r"))).collect()] == ["acd", "abc", "abc", ""]
