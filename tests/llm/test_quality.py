import random
import zlib

import numpy as np
import pytest

from folioscope.llm import queries, quality
from tests.llm.conftest import ODD


def labelled(n=400, seed=1):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        good = draw.random() < 0.8
        words = [word() for _ in range(draw.randint(20, 80))]
        if not good:
            words = [w + draw.choice(["###", "%%%"]) for w in words] if draw.random() < 0.5 else [draw.choice(words)] * 40
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return rows, labels


@pytest.fixture
def tables(spark, documents, tmp_path):
    def make(rows, labels):
        documents(rows, score="mine").write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return make


def test_held_out_accuracy(spark, tables):
    rows, labels = labelled()
    found = queries.QUERIES["op3_nb_svm_quality"](spark, tables([*rows, *((i if i is None else i + 9000, t) for i, t in ODD)], labels)).collect()
    assert len(found) == len(rows) + len(ODD)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 80 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    blank = {r["score"] for r in found if r["doc_id"] in (9001, 9002)}
    assert len(blank) == 1


def test_held_out_labels_are_not_learned_from(documents, spark):
    """Turning them all round changes no score."""
    rows, labels = labelled(200)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    docs = documents(rows)
    models = [quality.classifier(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned)]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].shift == models[1].shift


def test_without_labels(documents, spark):
    i, j = [k for k in range(20) if zlib.crc32(str(k).encode()) % 3 != 1][:2]
    docs = documents([(i, "a b c"), (j, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.scored(docs, quality.classifier(docs, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(j, 1, 0), (i, None, 0), (None, 1, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(r["score"] > 0.9 for r in quality.scored(docs, quality.classifier(docs, one)).collect())
    assert quality.scored(documents([]), quality.classifier(documents([]), none)).collect() == []


def test_sample_is_bounded(documents, spark):
    rows, labels = labelled(200)
    _, first, label = quality.sample(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows=50)
    assert len(label) == 50 and len(first) == 51


def test_descent_reaches_the_best_dual():
    """The primal and the dual value meet."""
    draw = np.random.default_rng(2)
    n = 60
    parts = [np.sort(draw.choice(200, 12, replace=False)).astype(np.uint16) for _ in range(n)]
    label = (draw.random(n) < 0.5).astype(np.int64)
    ratios = np.zeros(quality.FEATURES)
    ratios[:200] = draw.normal(size=200)
    first = np.arange(0, 12 * n + 1, 12)
    weights, intercept = quality.dual_coordinate_descent(np.concatenate(parts), first, label, ratios, cost=0.5, epochs=3000)
    own = np.divide(weights, ratios, out=np.zeros_like(weights), where=ratios != 0)
    sign = np.where(label == 1, 1.0, -1.0)
    share = np.array([np.mean(label == 0), np.mean(label == 1)])
    most = 0.5 * 0.5 / share[label]
    margin = np.array([weights[p].sum() for p in parts]) + intercept
    hinge = most * np.maximum(0, 1 - sign * margin)
    primal = 0.5 * (own @ own + intercept**2) + hinge.sum()
    # the dual's value follows from complementary slackness: sum(alpha) = |w|^2 + sum of what slack costs
    for step in (1e-3, -1e-3):
        for j in draw.choice(200, 20, replace=False):
            other = own.copy()
            other[j] += step
            m = np.array([(other * ratios)[p].sum() for p in parts]) + intercept
            assert 0.5 * (other @ other + intercept**2) + (most * np.maximum(0, 1 - sign * m)).sum() >= primal - 1e-4


def test_log_count_ratios():
    features = np.array([0, 1, 1, 2], dtype=np.uint16)
    found = quality.log_count_ratios(features, np.array([0, 2, 4]), np.array([1, 0]))
    one, zero = 2 + quality.FEATURES, 2 + quality.FEATURES
    assert np.allclose(found[:3], [np.log((2 / one) / (1 / zero)), np.log((2 / one) / (2 / zero)), np.log((1 / one) / (2 / zero))])


def test_repeated_ids_and_bytes(documents, spark):
    """One text of each id, that with the least hash, and no more bytes than asked for."""
    rows, labels = labelled(200)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents([*rows, *rows, *((i, "another text " * 50) for i, _ in rows)])
    one = quality.sample(docs, known)
    two = quality.sample(docs.orderBy("text"), known)
    assert len(one[2]) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in rows) and all(np.array_equal(a, b) for a, b in zip(one, two))
    _, first, label = quality.sample(documents(rows), known, most=5000)
    assert 0 < len(label) < 50 and quality.sample(documents(rows), known, most=0)[2].size == 0


def test_few_rows_of_a_class(documents, spark):
    rows, labels = labelled(300)
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    bad = [i for i, q, _ in labels if not q and not held(i)][:2]
    some = [(i, q, t) for i, q, t in labels if q or i in bad]
    found = {r["doc_id"]: r["score"] for r in quality.scored(documents(rows), quality.classifier(documents(rows), spark.createDataFrame(some, "doc_id long, quality int, toxic int"))).collect()}
    assert len({round(x, 6) for x in found.values()}) > 100 and all(found[i] < np.median(list(found.values())) for i in bad)


def test_scores_by_hand(documents, spark):
    """Each score anew from the model and sets of n-grams read one by one."""
    rows, labels = labelled(120)
    model = quality.classifier(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r["doc_id"]: r["score"] for r in quality.scored(documents([*rows, *((900 + k, t) for k, (_, t) in enumerate(ODD))]), model).collect()}
    for i, text in [*rows, *((900 + k, t) for k, (_, t) in enumerate(ODD))]:
        raw = (text or "").encode()
        own = {(((a << 16 | b << 8 | c) * 0x9E3779B1) & 0xFFFFFFFF) >> 17 for a, b, c in zip(raw, raw[1:], raw[2:])}
        words = [w for w in raw.translate(bytes(quality.LOWER)).translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)).split(b" ") if w]
        if words:
            flat = np.frombuffer(b"".join(words), np.uint8)
            ends = np.cumsum([len(w) for w in words])
            hashes = quality.span_hashes(flat, ends - [len(w) for w in words], ends)
            pairs = quality.mix(hashes[:-1] * np.uint64(3) + hashes[1:])
            own |= {quality.TRIGRAMS + int(h >> np.uint64(32)) % quality.WORDS for h in [*hashes, *pairs]}
        margin = sum(model.weights[f] for f in own) + model.intercept
        assert found[i] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.shift))), abs=1e-9)
