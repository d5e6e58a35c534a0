import random

import numpy as np
import pytest

from folioscope.llm import jaccard
from folioscope.llm.components import connected_components
from tests.llm.conftest import ODD


def brute(rows):
    """(class id, links) of each row, by all pairs."""
    sets = []
    for _, text in rows:
        w = [x for x in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    n = len(rows)
    parent, degree = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                degree[a] += 1
                degree[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, least.get(find(k)) if sets[k] else i, degree[k]) for k, (i, _) in enumerate(rows)]


def near_copies(seed=5, groups=6, size=25, words=60):
    draw = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{draw.randint(0, 5000)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 4])):
                own[draw.randrange(len(own))] = f"v{draw.randint(0, 5000)}"
            rows.append((len(rows) * 3 % 1009, " ".join(own)))
    return rows


def key(r):
    return tuple((x is None, x) for x in r)


def test_like_all_pairs(documents):
    rows = near_copies() + [(2000 + k, f"alone {k} " + " ".join(f"u{k}_{j}" for j in range(20))) for k in range(30)]
    found = jaccard.near_classes(documents(rows, class_id="mine", n_links="mine"))
    assert found.columns == ["doc_id", "class_id", "n_links"]
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(brute(rows), key=key)


def test_odd_rows(documents):
    rows = [*ODD, (11, "no id"), (None, "no id"), (12, "same id other text"), (12, "same id third text of its own"), (13, "one")]
    assert sorted((tuple(r) for r in jaccard.near_classes(documents(rows)).collect()), key=key) == sorted(brute(rows), key=key)


def test_empty_table(documents):
    assert jaccard.near_classes(documents([])).collect() == []


def test_blocks_of_large_components(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAST_SIDE", 4)
    monkeypatch.setattr(jaccard, "MOST_SIDE", 4)
    rows = near_copies(seed=9, groups=2, size=40)
    assert sorted((tuple(r) for r in jaccard.near_classes(documents(rows)).collect()), key=key) == sorted(brute(rows), key=key)


def test_bands():
    n = jaccard.bands_for(0.8, 4, 0.9999)
    assert 1 - (1 - 0.8**4) ** n >= 0.9999 > 1 - (1 - 0.8**4) ** (n - 1)


def test_verify():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 60, 50).astype(np.uint64)) for _ in range(20)]
    found = jaccard.verify(sets, np.arange(8), np.arange(8, 20), 0.5)
    for a in range(8):
        for b in range(8, 20):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            assert found[a, b - 8] == (len(x & y) >= 0.5 * len(x | y) - 1e-9)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randint(-60, 60), draw.randint(-60, 60)) for _ in range(70)] + [(k, k + 1) for k in range(100, 140)] + [(500, 500)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert found == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_buckets_of_large_components(documents, monkeypatch):
    """Components of more blocks than bands are compared bucket by bucket, each pair once."""
    monkeypatch.setattr(jaccard, "LEAST_SIDE", 1)
    monkeypatch.setattr(jaccard, "MOST_SIDE", 1)
    rows = near_copies(seed=9, groups=2, size=120)
    assert sorted((tuple(r) for r in jaccard.near_classes(documents(rows)).collect()), key=key) == sorted(brute(rows), key=key)


def test_candidates():
    draw = np.random.default_rng(3)
    left, right = draw.integers(0, 12, (9, 7)), draw.integers(0, 12, (11, 7))
    same = left[:, None, :] == right[None, :, :]
    assert (jaccard.candidates(left, right) == same.any(axis=2)).all()
    first = np.where(same.any(axis=2), same.argmax(axis=2), -1)
    assert all((jaccard.candidates(left, right, b) == (first == b)).all() for b in range(7))


def test_verified_pairs_of_boilerplate(documents):
    """20,000 texts of which 30 % is the same: few of their pairs share a band, and only those are verified."""
    draw = random.Random(8)
    shared = " ".join(f"s{k}" for k in range(30))
    rows = [(k, shared + " " + " ".join(f"u{draw.randint(0, 10**9)}" for _ in range(70))) for k in range(20_000)]
    marks = jaccard.signatures(documents(rows).repartition(8))
    names = [c for c in marks.columns if c.startswith("b")]
    table = marks.select(*names).toPandas()
    pairs = sum(int((n * (n - 1) // 2).sum()) for n in (table[c].value_counts().to_numpy() for c in names))
    assert pairs < len(rows) / 2
