"""Queries without a SQL twin against plain versions, on small tables of our own: no row and no text is left out."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from folioscope.functions import python_functions as Y
from folioscope.operators import learning
from folioscope.plans.catalogue import QUERIES


def lines_of(i):
    """The lines of the page that is drawn for document i, pixel by pixel."""
    dark = [[row % (4 + i % 5) >= 2 and i % 11 <= column < 30 for column in range(40)] for row in range(30)]
    out, row = [], 0
    while row < 30:
        top = row
        while row < 30 and (any(dark[row]) or (row > top and row + 1 < 30 and any(dark[row + 1]))):
            row += 1
        if row - top >= 2:
            columns = [c for c in range(40) if any(dark[r][c] for r in range(top, row))]
            out.append((min(columns), top, max(columns) + 1, row))
        row = max(row, top + 1)
    return out


def test_page_lines(spark, tmp_path):
    ids = [*range(60), 100, 123, 9_999]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["page_lines"](spark, str(tmp_path)).collect()
    wanted = [(str(i), f"{i}-L{k:04d}", k, *box) for i in ids for k, box in enumerate(lines_of(i), 1)]
    assert sorted(map(tuple, found)) == sorted(wanted)


def labelled(n):
    """(doc_id, lang, text, quality) of n documents."""
    draw = np.random.default_rng(5)
    for i in range(n):
        good = int(draw.integers(2))
        yield i, ("en", "de", "fr")[i % 3], "ab c" * int(draw.integers(1, 9)) + "1!" * int(draw.integers(1, 9 - 4 * good)), good


def by_fold(rows):
    """Scores by models of all rows of the other folds: {key: score}."""
    out = {}
    for name in {r[1] for r in rows}:
        train, own = [r for r in rows if r[1] != name], [r for r in rows if r[1] == name]
        x = np.array([r[2:4] for r in train])
        scale = learning.Scaler(x)
        beta, bias = learning.logistic_fit(scale(x), np.array([r[4] for r in train], dtype=float))
        out |= {r[0]: 1 / (1 + math.exp(-((np.array(r[2:4]) - scale.mean) / scale.scale @ beta + bias))) for r in own}
    return out


def test_leave_one_source_out(spark, tmp_path):
    rows = list(labelled(2_100))
    spark.createDataFrame([(i, lang, t, len(t)) for i, lang, t, _ in rows], "doc_id long, lang string, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r["key"]: r for r in QUERIES["leave_one_source_out"](spark, str(tmp_path)).collect()}
    wanted = by_fold([(i, lang, math.log1p(len(t)), len(re.findall("[^A-Za-zÀ-ÿ ]", t)) / len(t), y) for i, lang, t, y in rows])
    assert len(found) == 2_100 and {k: (r["fold"], r["target"]) for k, r in found.items()} == {r[0]: (r[1], r[3]) for r in rows}
    assert [found[k]["score"] for k in sorted(wanted)] == pytest.approx([wanted[k] for k in sorted(wanted)], abs=2e-6)


def test_leave_one_out_samples_only_for_fitting(spark):
    draw = np.random.default_rng(3)
    rows = [(k, (None, "a", "b")[k % 3], float(a), float(b), int(a + b > 0)) for k, (a, b) in enumerate(draw.normal(size=(900, 2)))]
    df = spark.createDataFrame(rows, "k long, f string, a double, b double, y int")
    found = learning.leave_one_out(df, "f", ["a", "b"], "y", "k", sample_rows=100).collect()
    assert sorted(r["key"] for r in found) == list(range(900)) and np.mean([(r["score"] > 0.5) == r["target"] for r in found]) > 0.9
    alone = learning.leave_one_out(df.filter("f = 'a'"), "f", ["a", "b"], "y", "k").collect()
    assert len(alone) == 300 and {r["score"] for r in alone} == {0.5}


#: Long texts of several lines, not all ASCII; lengths around whole slices.
TEXTS = ["", "a", "é" * 3, *(("née אב 1. Ünï 😀 end\n" * 40)[k:n] for k, n in ((0, 59), (1, 61), (2, 65), (0, 123), (5, 700))), None]


@pytest.fixture
def texts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_alignment_slices(spark, texts):
    wanted = Counter()
    for t in filter(None, TEXTS):
        for k in range(0, len(t), 60):
            wanted.update((Y.character_class(x if x is not None else y), op) for op, x, y in Y.aligned(t[k : k + 60], t[k + 3 : k + 63]))
    assert {(r["character_class"], r["operation"]): r["n"] for r in QUERIES["alignment_slices"](spark, texts).collect()} == wanted


def similarity(a, b):
    """The plain table of edits."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return 1 - row[-1] / max(len(a), len(b)) if a or b else 1.0


def test_word_similarities(spark, texts):
    found = {r["doc_id"]: r["similarity"] for r in QUERIES["word_similarities"](spark, texts).collect()}
    assert found == pytest.approx({i: similarity((t or "").split(), (t or "")[19:].split()) for i, t in enumerate(TEXTS)}, abs=1e-6)
    draw = np.random.default_rng(7)
    for _ in range(200):
        a, b = (" ".join(draw.choice(list("xyz"), draw.integers(0, 7))) for _ in range(2))
        assert Y.word_similarity(a, b) == pytest.approx(similarity(a.split(), b.split()))


def test_logical_order(spark, texts):
    found = {(r["doc_id"], r["line"]): r["text"] for r in QUERIES["logical_order"](spark, texts).collect()}
    assert found == {(len(TEXTS) - 1, None): None} | {(i, k): Y.reordered("(בא) " + line) for i, t in enumerate(TEXTS) if t is not None for k, line in enumerate(t.split("\n"))}


def test_priority_spans_of_long_orders(spark, tmp_path):
    rows = [(1, n, n * 7, n * 5) for n in range(1, 26)] + [(2, 1, 3, 4)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    kept = []
    for _, start, end in sorted((s % 3, p % 40, p % 40 + 3 + n) for o, n, p, s in rows if o == 1):
        if not any(a < end and start < b for a, b in kept):
            kept.append((start, end))
    found = {r["l_orderkey"]: (r["n"], r["kept"], r["starts"]) for r in QUERIES["priority_spans"](spark, str(tmp_path)).collect()}
    assert found == {1: (25, len(kept), ",".join(str(a) for a, _ in kept)), 2: (1, 1, "3")}
