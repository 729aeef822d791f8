"""Connected components by alternating large stars and small stars; no link comes to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, splittable, stored

#: Links up to this number are joined by one task: the shuffles of each round take longer, and 4 MB hold them.
FEW = 1 << 18
LABELS = pa.schema([("node", pa.int64()), ("component", pa.int64())])


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and the smallest node that each one reaches."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    least = np.arange(len(nodes))
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[least]
        # Roots of links that aren't in one tree yet are hung under the smaller ones, then each node goes to its root.
        np.minimum.at(least, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (least[least] != least).any():
            least = least[least]


def _joined_rows(batches):
    """The rows of LABELS of all links (u, v) of a task."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        node, component = joined(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(component)], schema=LABELS)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    moved = both.filter("v > u").join(splittable(least), F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(splittable(least.withColumnRenamed("u", "x")), F.col("u") == F.col("x")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the links (u, v) are stars: each u has one v, which is no u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("is_u")).union(edges.select(F.col("v"), F.lit(0)))
    odd = ends.groupBy("x").agg(F.sum("is_u").alias("n"), F.min("is_u").alias("least")).filter("n > 1 or (n = 1 and least = 0)")
    return odd.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for the nodes of links (u, v); others aren't listed.

    Loops and repeated links do no harm; links with a null end are left out. FEW links at most are joined by one task,
    more in rounds. Each round is written to shared storage. Rounds grow with the logarithm of the longest chain, and a node of any degree is handled by partial
    aggregates and by joins that can deal it to several tasks, never gathered.
    """
    spark = edges.sparkSession
    oriented = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    given = stored(oriented.select(F.col("u").cast("long"), F.col("v").cast("long")), "links")
    if given.count() <= FEW:
        return given.coalesce(1).mapInArrow(_joined_rows, "node long, component long")
    now = stored(given.distinct(), "links")
    discard(spark, given)
    while not _settled(now):
        after = stored(_small_star(_large_star(now)), "links")
        discard(spark, now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
