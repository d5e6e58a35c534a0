"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows lie in ``parts`` virtual partitions by a hash of their key. How many rows each partition sends to each shard is
drawn from the multivariate hypergeometric distribution, so every shard gets exactly its size. Each partition is
permuted by a second hash, its permutation cut by its row of the matrix, the cuts exchanged, and each shard
permuted again by a third hash. The permutation inside a shard goes by hash range, so no shard is one task's work.
DataFrame functions only; the driver sees one count for each partition, whose number has a fixed bound.

Defined results: law ``rows``: shard sizes differ by one at most, the first shards are larger. A null key or text
hashes as such, a null text has size 8 and the checksum of no bytes. Repeated rows are rows of their own; a ``row`` column that numbers
them spreads rows alike in key and text, however many there are; without it they lie in one partition and may change
places with one another. An empty table gives no rows. Extra columns stay; one named like a computed column is replaced. All else
follows from ``seed``.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 24
#: Rows that a virtual partition should have at most, and the fewest and most partitions.
PART_ROWS, FEWEST, MOST = 100_000, 256, 16_384
#: Hash ranges in which a shard is permuted.
RANGES = 64


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard: row sums ``rows``, column sums alike or one more for the first."""
    total = sum(rows)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    draw = np.random.Generator(np.random.PCG64(seed))
    matrix = np.zeros((len(rows), shards), dtype=np.int64)
    for i, n in enumerate(rows):
        matrix[i] = draw.multivariate_hypergeometric(left, n, method="marginals") if n else 0
        left -= matrix[i]
    return matrix


def _hash(*what: Column | str) -> Column:
    return F.xxhash64(*what)


def shuffled_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = 7, parts: int | None = None, row: str | None = None) -> DataFrame:
    """Adds shard and slot (gapless from 0 in its shard) to every row. row: a column that tells like rows apart, the same whenever it is read."""
    spark = df.sparkSession
    source = df.select(*(c for c in df.columns if c.lower() not in ("shard", "slot")))
    # the text is in the hash, so that rows that share a key (or have none) spread too
    what = [key, text] + ([row] if row else [])
    first = _hash(F.lit(seed), *what)
    if parts is None:
        counted = source.groupBy(F.pmod(first, F.lit(MOST)).alias("p")).agg(F.count("*").alias("n"))
        found = {r["p"]: r["n"] for r in counted.collect()}
        parts = FEWEST
        while parts < MOST and parts * PART_ROWS < sum(found.values()):
            parts *= 2
        rows = [0] * parts
        for p, n in found.items():
            rows[p % parts] += n
    else:
        counted = source.groupBy(F.pmod(first, F.lit(parts)).alias("p")).agg(F.count("*").alias("n"))
        rows = [0] * parts
        for r in counted.collect():
            rows[r["p"]] = r["n"]
    matrix = communication_matrix(rows, shards, seed)
    # 16,384 rows of as many ends as shards at most
    listed = F.from_json(F.lit(json.dumps(np.cumsum(matrix, axis=1).tolist())), "array<array<bigint>>")
    ends = spark.range(1).select(F.posexplode(listed).alias("_part", "_ends"))
    local = Window.partitionBy("_part").orderBy(_hash(F.lit(seed + 1), *what), *what)
    cut = (
        source.withColumn("_part", F.pmod(first, F.lit(parts)).cast("int"))
        .withColumn("_rank", F.row_number().over(local) - 1)
        .join(F.broadcast(ends), "_part")
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))))
        .drop("_ends", "_rank")
    )
    return _permuted(cut, what, seed).select(*source.columns, "shard", "slot")


def _permuted(cut: DataFrame, what: list[str], seed: int) -> DataFrame:
    """Adds slot: the row's place in a permutation of its shard."""
    third = _hash(F.lit(seed + 2), *what)
    dealt = cut.withColumn("_hash", third).withColumn("_range", F.shiftrightunsigned("_hash", 64 - RANGES.bit_length() + 1).cast("int"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("shard", "_range").agg(F.count("*").alias("_n")).select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("shard", "_range").orderBy("_hash", *what)
    # as many rows as shards times ranges
    return dealt.withColumn("_place", F.row_number().over(within) - 1).join(F.broadcast(bases), ["shard", "_range"]).withColumn("slot", F.col("_base") + F.col("_place"))
