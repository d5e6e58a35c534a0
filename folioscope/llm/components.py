"""Connected components of an edge table by alternating large and small stars.

Each round keeps the components and hangs more nodes directly under the least node they reach; the edges shrink to
stars in a number of rounds that grows with the logarithm of the longest path. Every round's edges are written to
the shared folder, so lineage stays short and a lost executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.workspace import dropped, folder, held_in, written


def _stars(directed: DataFrame, small: bool) -> DataFrame:
    """One star operation over (u, v) rows that hold each u's neighbours v."""
    # written, so that both sides of the join are plain shuffles and a node of many neighbours can be split
    least = written(directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    hung = directed.join(least, "u")
    if small:
        # u itself and its smaller neighbours go under the least of them
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        # larger neighbours go under the least node
        out = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge between different nodes; edges: (u, v) of one type with an order; root: the least node.

    Raises ``RuntimeError`` where the components do not settle in ``rounds`` rounds.
    """
    spark = edges.sparkSession
    kind = edges.schema["u"].dataType.simpleString()
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    path = None
    for _ in range(rounds):
        next_path = folder(spark, "stars")
        now.write.parquet(next_path)
        if path:
            dropped(spark, path)
        path = next_path
        now = spark.read.schema(f"u {kind}, v {kind}").parquet(path)
        if _are_stars(now):
            out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            return held_in(out, path)
        large = _stars(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), small=False)
        now = _stars(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), small=True)
    raise RuntimeError(f"the components did not settle in {rounds} rounds")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs under one node only, which hangs under none."""
    if not edges.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
