"""Inner products of a set of query vectors with all vectors, block against block.

Queries are dealt to blocks of a bounded size and vectors to slices. A task holds one block of queries and
streams a slice past it, so memory doesn't follow the data; what leaves a task is a few rows for each query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import stored

#: Queries of a block, and vectors of a slice.
QUERY_BLOCK, SLICE = 8192, 1 << 16
#: Vectors that are multiplied at a time, and queries of a block that they are multiplied with.
TILE = STRIP = 1024


def usable_vectors(vectors: DataFrame, zero_counts: bool) -> DataFrame:
    """_row (a number of its own for each row), vec_id, embedding and dim, stored.

    Every row counts, also where it repeats a vec_id. Left out: null ids, null or empty vectors, vectors that hold null,
    NaN or infinity, and zero vectors unless ``zero_counts``. Components stay 32-bit floats where they are given as such,
    which halves what is shuffled; everything is computed from their values as doubles.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    v = v.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: F.coalesce(finite(x), F.lit(False))))
    if not zero_counts:
        v = v.filter(F.exists("embedding", lambda x: x != 0))
    return stored(v.select(F.monotonically_increasing_id().alias("_row"), "vec_id", "embedding", F.size("embedding").alias("dim")), "vectors")


def grid(queries: DataFrame, vectors: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Rows of queries and vectors under keys, so that each query meets each vector of its length once.

    ``_dim, _block, _slice`` is the key; kind 0 rows are queries and come first in a key. Both frames are stored
    tables. A query row is repeated for each slice, a vector row for each block of queries.
    """
    spark = vectors.sparkSession
    ship(spark)
    n_vectors, n_queries = vectors.count(), queries.count()
    blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    slices = max(1, math.ceil(n_vectors / SLICE), min(2 * spark.sparkContext.defaultParallelism, math.ceil(n_vectors / TILE)))
    places = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n, seed: F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(n)).cast("int")
    more = [F.col(c) for c in extra]
    q = queries.select(F.col("dim").alias("_dim"), deal(blocks, 1).alias("_block"), places(slices).alias("_slice"), F.lit(0).alias("_kind"), "_row", "vec_id", "embedding", *more)
    v = vectors.select(F.col("dim").alias("_dim"), places(blocks).alias("_block"), deal(slices, 2).alias("_slice"), F.lit(1).alias("_kind"), "_row", "vec_id", "embedding", *[F.lit(None).cast("long").alias(c) for c in extra])
    key = ["_dim", "_block", "_slice"]
    dealt = q.unionByName(v).repartition(min(blocks * slices, 20_000), *key)
    return dealt.sortWithinPartitions(*key, "_kind", "_row")


def tiles(batches, extra: list[str] = ()):
    """From a partition of ``grid``: (query ids, query matrix, extra columns, iterator of (ids, matrix) tiles) per key.

    Ids are (row, vec_id) pairs, and matrices hold doubles.
    """

    def runs():
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(i).to_numpy() for i in range(4)], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                part = b.slice(i, j - i)
                matrix = part.column(6).flatten().to_numpy(zero_copy_only=False).reshape(j - i, -1)
                ids = np.stack([part.column(4).to_numpy(), part.column(5).to_numpy()], 1)
                yield tuple(key[i, :3]), int(key[i, 3]), ids, matrix, [part.column(7 + k).to_numpy(zero_copy_only=False) for k in range(len(extra))]

    todo = runs()
    waiting = next(todo, None)
    joined = lambda parts: (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.float64))
    while waiting is not None:
        at, own = waiting[0], []
        while waiting is not None and waiting[0] == at and waiting[1] == 0:
            own.append(waiting)
            waiting = next(todo, None)

        def candidates():
            nonlocal waiting
            held, n = [], 0
            while waiting is not None and waiting[0] == at:
                # Batches may be smaller than a tile.
                for i in range(0, len(waiting[2]), TILE):
                    held.append((waiting[2][i : i + TILE], waiting[3][i : i + TILE]))
                    n += len(held[-1][0])
                    if n >= TILE:
                        yield joined(held)
                        held, n = [], 0
                waiting = next(todo, None)
            if held:
                yield joined(held)

        stream = candidates()
        if own:
            yield *joined([x[2:4] for x in own]), [np.concatenate([x[4][k] for x in own]) for k in range(len(extra))], stream
        for _ in stream:  # whatever was left unread
            pass


class Heaps:
    """The k best of each query as sorted arrays: by score, then smaller vec_id, then smaller row."""

    def __init__(self, n: int, k: int, dtype):
        self.k, self.scores, self.ids = k, [np.empty(0, dtype)] * n, [np.empty((0, 2), np.int64)] * n

    def floors(self, some: slice) -> np.ndarray:
        """The scores that further entries of some queries must reach; minus infinity while there is room."""
        return np.array([s[-1] if len(s) == self.k else -np.inf for s in self.scores[some]])

    def push(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, d = np.concatenate([self.scores[i], scores]), np.concatenate([self.ids[i], ids])
        # ~s falls as s rises and, unlike -s, holds for the smallest integer.
        order = np.lexsort((d[:, 0], d[:, 1], ~s if s.dtype.kind == "i" else -s))[: self.k]
        self.scores[i], self.ids[i] = s[order], d[order]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Merge the slices' heaps: the k best rows (_query, query_id, _row, vec_id, score) of each query with their rank from 1."""
    place = F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("score"), "vec_id", "_row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("_query", "query_id", "rank", "vec_id", "score")


def every(n: int) -> Column:
    """The stated query set: rows whose id is divisible by n."""
    return F.col("vec_id") % n == 0


def found_schema(score: pa.DataType) -> pa.Schema:
    return pa.schema([(c, pa.int64()) for c in ("_query", "query_id", "_row", "vec_id")] + [("score", score)])


def table_of(schema: pa.Schema, ids: np.ndarray, heaps: Heaps) -> pa.RecordBatch:
    """The heaps of queries (row, vec_id) as rows of found_schema."""
    sizes = [len(s) for s in heaps.scores]
    own = np.repeat(ids, sizes, axis=0)
    found = np.concatenate(heaps.ids) if len(ids) else np.empty((0, 2), np.int64)
    score = np.concatenate(heaps.scores) if len(ids) else np.empty(0)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (own[:, 0], own[:, 1], found[:, 0], found[:, 1])] + [pa.array(score, schema.field("score").type)], schema=schema)
