import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import sharding
from tests.llm.conftest import ODD


def test_matrix_has_its_sums():
    rows = [0, 5, 100, 1, 37, 0, 64]
    found = sharding.communication_matrix(rows, 24, 3)
    assert found.sum(axis=1).tolist() == rows
    wanted = [sum(rows) // 24 + (s < sum(rows) % 24) for s in range(24)]
    assert found.sum(axis=0).tolist() == wanted


def test_matrix_is_hypergeometric():
    """Rows of the first of two equal partitions that go to the first of two shards: mean n/4, variance that of the law."""
    drawn = np.array([sharding.communication_matrix([20, 20], 2, seed)[0, 0] for seed in range(4000)])
    assert abs(drawn.mean() - 10) < 0.15 and abs(drawn.var() - 20 * 0.25 * 20 / 39) < 0.25


@pytest.mark.parametrize("parts", [None, 3])
def test_exact_sizes(documents, parts):
    rows = [*ODD, *((k, f"t{k % 7}") for k in range(500))]
    found = sharding.shuffled_shards(documents(rows, shard="mine", slot="mine"), parts=parts).collect()
    assert len(found) == len(rows)
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=key) == sorted(rows, key=key)


def test_uniform(documents):
    """Over many seeds a row is in every shard and in every part of it about as often."""
    docs = documents([(k, "x") for k in range(96)]).cache()
    shard, slot = np.zeros(24), np.zeros(4)
    for seed in range(12):
        for r in sharding.shuffled_shards(docs, seed=seed * 10, parts=4).collect():
            if r["doc_id"] < 24:
                shard[r["shard"]] += 1
                slot[r["slot"]] += 1
    assert ((shard - 12) ** 2 / 12).sum() < 60 and ((slot - 72) ** 2 / 72).sum() < 16


def test_same_twice_and_empty(documents):
    docs = documents([(k, "x") for k in range(50)])
    once, again = (sorted(map(tuple, sharding.shuffled_shards(docs).collect())) for _ in range(2))
    assert once == again
    assert sharding.shuffled_shards(documents([])).collect() == []


def test_no_python_in_the_plan(documents):
    plan = sharding.shuffled_shards(documents([(1, "a")]).repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "mapPartitions"))


def hashed(*values):
    """Spark's hash of integers (seed first), longs and strings, read anew."""
    h = 42
    for k, v in enumerate(values):
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v.to_bytes(4 if k == 0 else 8, "little", signed=True)
            h = xxhash.xxh64(raw, seed=h).intdigest()
    return h - (1 << 64) if h >= 1 << 63 else h


def test_like_python(documents):
    """Partitions, permutations and cuts computed row by row."""
    rows = [(k if k % 9 else None, f"t{k % 7}", k) for k in range(700)]
    docs = documents([(i, t) for i, t, _ in rows])
    spark = docs.sparkSession
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    found = {r["row"]: (r["shard"], r["slot"]) for r in sharding.shuffled_shards(docs, parts=5, seed=3, row="row").collect()}
    parts = [[] for _ in range(5)]
    for r in rows:
        parts[hashed(3, *r) % 5].append(r)
    matrix = sharding.communication_matrix([len(p) for p in parts], 24, 3)
    shards = [[] for _ in range(24)]
    for part, counts in zip(parts, matrix):
        at = 0
        part.sort(key=lambda r: hashed(4, *r))
        for s, n in enumerate(counts):
            shards[s] += part[at : at + n]
            at += n
    wanted = {}
    for s, own in enumerate(shards):
        # ranges are the hash's first bits, unsigned; within a range the order is signed
        own.sort(key=lambda r: (hashed(5, *r) % (1 << 64) >> 58, hashed(5, *r)))
        wanted |= {r[2]: (s, k) for k, r in enumerate(own)}
    assert found == wanted


def test_many_like_rows(spark):
    docs = spark.range(5000).selectExpr("7L as doc_id", "'same' as text", "id as row")
    parts = docs.select(F.pmod(F.xxhash64(F.lit(7), "doc_id", "text", "row"), F.lit(16)).alias("p")).groupBy("p").count().collect()
    assert len(parts) == 16 and max(r["count"] for r in parts) < 500
    found = sharding.shuffled_shards(docs, row="row").groupBy("shard").count().collect()
    assert len(found) == 24 and {r["count"] for r in found} == {208, 209}
