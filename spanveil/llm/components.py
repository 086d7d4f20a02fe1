"""Connected components of an edge table: forests within partitions, pointer jumping between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, map_batches, written

#: Edges that one task takes.
TASK_EDGES = 1 << 20


def forest(links: np.ndarray) -> np.ndarray:
    """(name, least name it is connected with by these links), a row for each name but the least ones."""
    names, ends = np.unique(links, return_inverse=True)
    ends = ends.reshape(-1, 2)
    root = np.arange(len(names))
    while len(ends):
        low = root.copy()
        both = root[ends]
        np.minimum.at(low, both[:, 0], both[:, 1])
        np.minimum.at(low, both[:, 1], both[:, 0])
        low = low[root]
        while not np.array_equal(low, low[low]):
            low = low[low]
        if np.array_equal(low, root):
            break
        root = low
    apart = np.flatnonzero(root != np.arange(len(names)))
    return np.stack([names[apart], names[root[apart]]], 1)


def contracted(edges: DataFrame, rows: int) -> DataFrame:
    """u, v (v < u): dealt by the larger end, each partition's edges become its forest, at most one for each node there."""
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_EDGES + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1) for b in batches]
        if held:
            made = forest(np.concatenate(held))
            for at in range(0, len(made), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in made[at : at + 100_000].T], ["u", "v"])

    return map_batches(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).repartition(parts, "u"), run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that can be reached) for every node of `edges` (columns u, v: long).

    In turn, edges dealt by their larger end become forests within their partitions, and ends that have a smaller
    neighbour of their own are replaced by it. It is settled when no node has two smaller neighbours and no smaller
    neighbour has one itself. A node has at most one edge from each partition, so no task gathers a hot centre's edges;
    nothing but the question whether it is settled comes to the driver. Each round is written out, so losing an
    executor repeats one round at most. An empty table gives no rows; loops and repeated edges don't matter.
    """
    spark = edges.sparkSession
    given = written(edges.select("u", "v"), "components")
    now = written(contracted(given, given.count()), "components")
    dropped(spark, given)
    while True:
        parents = now.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
        inner = parents.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        open_ends = written(parents.where("k > 1").withColumn("jump", F.lit(False)).unionByName(inner.withColumn("jump", F.lit(True))), "components")
        if not open_ends.head(1):
            dropped(spark, open_ends)
            break
        jumps = open_ends.where("jump").select(F.col("u").alias("v"), "m")
        after = written(contracted(now.join(jumps, "v", "left").select("u", F.coalesce("m", "v").alias("v")), now.count()), "components")
        for old in (now, open_ends):
            dropped(spark, old)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
