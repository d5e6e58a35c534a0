"""Tiles, regions, bags, clarity and figures by fold against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import bags, pixels


def flood(hit):
    """Labels by a flood from each first pixel."""
    label, n = np.zeros(hit.shape, int), 0
    for y, x in zip(*np.nonzero(hit), strict=True):
        if label[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            b, a = todo.pop()
            if 0 <= b < hit.shape[0] and 0 <= a < hit.shape[1] and hit[b, a] and not label[b, a]:
                label[b, a] = n
                todo += [(b + i, a + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return label


@pytest.mark.parametrize("seed", range(12))
def test_regions(seed):
    hit = np.random.default_rng(seed).random((17, 23)) < 0.05 + 0.05 * seed
    label = flood(hit)
    assert (pixels.components(hit) == label).all()
    wanted, n = np.zeros_like(label), 0
    for k in range(1, label.max() + 1):
        if (label == k).sum() >= 4:
            n += 1
            wanted[label == k] = n
    assert (bags.regions(hit, 4) == wanted).all()


def test_components_of_one_value():
    assert (pixels.components(np.ones((3, 4), bool)) == 1).all() and (pixels.components(np.zeros((3, 4), bool)) == 0).all()
    assert (bags.regions(np.ones((3, 4), bool), 5) == 1).all() and (bags.regions(np.ones((3, 4), bool), 13) == 0).all()


def test_components_of_a_spiral():
    hit = np.zeros((61, 61), bool)
    for k in range(0, 30, 4):
        hit[k, k : 61 - k] = hit[k : 61 - k, 60 - k] = hit[60 - k, k : 61 - k] = hit[k + 2 : 61 - k, k] = True
        hit[k + 2, k : k + 5] = True
    assert (pixels.components(hit) == flood(hit)).all()


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_dilated(radius):
    hit = np.random.default_rng(radius).random((9, 14)) < 0.05
    wanted = [[hit[max(y - radius, 0) : y + radius + 1, max(x - radius, 0) : x + radius + 1].any() for x in range(14)] for y in range(9)]
    assert (bags.dilated(hit, radius) == np.array(wanted)).all()


def test_changed():
    before, after = np.zeros((1, 3, 3)), np.zeros((1, 3, 3))
    after[0, 0, 2], after[0, 1, 0] = 30, 29
    assert bags.changed(before, after).tolist() == [[True, False, False]]
    assert bags.tile_places(20, 9, 8, 8) == [(0, 0), (8, 0), (12, 0), (0, 1), (8, 1), (12, 1)] and bags.tile_places(7, 9, 8, 8) == []


def test_resized():
    page = np.random.default_rng(3).integers(0, 256, (37, 21))
    for length, size in ((37, 8), (21, 8), (5, 8), (8, 8)):
        weight = bags._triangles(length, size)
        for k in range(size):
            scale, plain = length / size, {}
            for at in range(length):
                away = abs(at + 0.5 - (k + 0.5) * scale) / max(scale, 1)
                if away < 1:
                    plain[at] = 1 - away
            total = sum(plain.values())
            assert weight[k] == pytest.approx([plain.get(at, 0) / total for at in range(length)])
    assert (bags.resized(np.full((9, 30), 77), 8) == 77).all() and (bags.resized(page[:8, :8], 8) == page[:8, :8]).all()


def test_features():
    page = np.full((8, 8), 151)
    page[:, 4:] = 100
    found = bags.features(page, 8).reshape(2, 8, 8)
    assert found[0].tolist() == [[0.0] * 4 + [1.0] * 4] * 8
    assert found[1].tolist() == [[0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0]] * 8
    assert not bags.features(np.full((9, 9), 255), 8).any()
    with pytest.raises(ValueError, match="size"):
        bags.features(page, 7)


def test_clarity():
    page = np.random.default_rng(5).integers(0, 256, (11, 17))
    edges = [[float(page[y][x]) if y in (0, 10) or x in (0, 16) else min(255, max(0, sum((8 if (i, j) == (0, 0) else -1) * page[y + i][x + j] for i in (-1, 0, 1) for j in (-1, 0, 1)))) for x in range(17)] for y in range(11)]
    flat = [v for row in edges for v in row]
    mean = sum(flat) / len(flat)
    spread = sum((v - mean) ** 2 for v in flat) / len(flat)
    wanted = 0.45 * min(page.std() / 64, 1) + 0.4 * min(math.log1p(spread) / 8, 1) + 0.15 * 11 / 24
    assert bags.clarity(page) == pytest.approx(wanted)
    assert bags.clarity(np.full((48, 2), 9)) == pytest.approx(0.15)


def test_page_operators(spark):
    rows = [("a", 16, 16, [0] * 256, [0] * 100 + [255] * 60 + [0] * 96), ("none", 16, 16, None, [0] * 256), ("short", 16, 16, [0], [0]), ("empty", 0, 0, [], []), ("small", 4, 4, [0] * 16, [9] * 16)]
    df = spark.createDataFrame(rows, "page_id string, width int, height int, before array<int>, after array<int>")
    found = bags.region_bags(df, size=8, stride=8, least_area=4, least_fraction=0.2, radius=0).collect()
    assert {(r.bag_id, r.x, r.y, r.region) for r in found} == {("a__region_001", 8, 0, 1), ("a__region_001", 0, 8, 1), ("a__region_001", 8, 8, 1)} | {(r.bag_id, r.x, r.y, None) for r in found if r.region is None}
    assert {r.page_id for r in found} == {"a"}
    assert bags.paired_bags(df.limit(0)).count() == 0 and bags.tile_features(df.withColumnRenamed("after", "pixels"), size=8).count() == 3
    with pytest.raises(ValueError, match="bounds"):
        bags.paired_bags(df, positive=0.1, negative=0.1)


def test_bag_contracts(spark):
    rows = [("a", "positive", "p"), ("a", "positive", "p"), ("b", "positive", "p"), ("b", "negative", "p"), ("c", "negative", "p"), ("c", "negative", "q"), ("d", None, "p"), ("d", "positive", "p"), (None, "negative", "p")]
    found = {r.bag: tuple(r)[1:] for r in bags.bag_contracts(spark.createDataFrame(rows, "bag string, label string, page string"), "bag", "label", "page").collect()}
    assert found == {"a": (2, 1, "p", None), "b": (2, 0, "p", "mixed_labels"), "c": (2, 0, "p", "mixed_pages"), "d": (2, 1, "p", "mixed_labels"), None: (1, 0, "p", None)}


def test_bag_scores(spark):
    rows = [("a", 1.0), ("a", -2.0), ("a", None), ("b", 800.0), ("b", 790.0), (None, 0.0), ("c", None)]
    found = {r.bag: (r.logit, r.score) for r in bags.bag_scores(spark.createDataFrame(rows, "bag string, z double"), "bag", "z").collect()}
    a = 0.5 * math.log((math.exp(2) + math.exp(-4)) / 2)
    assert found["a"] == pytest.approx((a, 1 / (1 + math.exp(-a)))) and found["b"][0] == pytest.approx(800 - 0.5 * math.log(2))
    assert found[None] == (0.0, 0.5) and found["c"] == (None, None)


def test_folds(spark):
    rng = random.Random(4)
    rows = [(fold, int(rng.random() < 0.4), round(rng.random(), 2)) for fold in "abc" for _ in range(60)] + [("no", 0, 0.4), ("yes", 1, 0.4)]
    df = spark.createDataFrame(rows, "fold string, target int, score double")
    found = {r.fold: r.threshold for r in bags.fold_thresholds(df, "fold", "target", "score", 0.7).collect()}

    def best(mine):
        order = []
        for t in {0.0, 1.0, *(s for _, _, s in mine)}:
            tp, fp = (sum(1 for _, y, s in mine if y == k and s >= t) for k in (1, 0))
            p, n = (sum(1 for _, y, _ in mine if y == k) for k in (1, 0))
            recall, rate = tp / p if p else 0, fp / n if n else 0
            order.append((recall < 0.7, rate, -recall, -t))
        return -min(order)[3]

    assert found == {f: best([r for r in rows if r[0] == f]) for f in ("a", "b", "c", "no", "yes")}
    thresholds = spark.createDataFrame([("a", 0.5), ("no", 0.5), ("yes", 0.3)], "fold string, threshold double")
    reports = bags.fold_reports(df, thresholds, "fold", "target", "score")
    rows_of_no = {r.fold: tuple(r)[2:] for r in reports.collect()}
    assert rows_of_no["no"] == (0, 0, 0, 1, 0.0, False) and rows_of_no["yes"] == (1, 0, 0, 0, 0.4, True)
    total = bags.fold_totals(reports).first()
    assert (total.pages, total.tp + total.fp + total.fn + total.tn) == (3, 62)
    none = bags.fold_totals(reports.filter(F.lit(False))).first()
    assert (none.pages, none.tp, none.page_recall) == (0, 0, 0.0)
