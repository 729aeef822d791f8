"""What the corpus operators share: shared storage, Arrow batches, distributed ranks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, ship, shuffles_freed, stored

__all__ = ["shared_dir", "shuffles_freed", "stored"]

#: Rows of one Arrow batch; texts are long, and a worker holds one batch at a time.
BATCH_ROWS = 256
#: Bytes of text that the vectorised kernels take at a time.
CHUNK_BYTES = 1 << 20
#: Rows that one task ranks together; larger groups are dealt to several.
RANK_ROWS = 4000


def tune(spark: SparkSession) -> None:
    """Ready the session for Python stages: the package on executors, and small Arrow batches of texts."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended
        pass


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and nothing reads any more."""
    for df in frames:
        for d in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(spark, d)


def splittable(aggregated: DataFrame) -> DataFrame:
    """An aggregate that is to be joined by its own keys with a table that may hold hot ones.

    Without this the join shares the aggregate's shuffle, and then Spark's adaptive skew join can't deal a hot key of the
    other side to several tasks. The rebalance parts the two, so that both sides of the join are shuffles of their own.
    """
    return aggregated.hint("rebalance")


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI and the path in it: local, HDFS, S3, GCS or Azure."""
    return pafs.FileSystem.from_uri(uri)


def text_chunks(texts: list[str | None], most: int = CHUNK_BYTES):
    """Slices (from, to) of texts with about ``most`` characters each; one long text stays whole."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


class GenerationCache(dict):
    """Values by key, made on first use, in two generations: memory is bounded and frequent keys stay.

    A generation ends with ``limit`` keys or ``most`` characters of keys, whichever comes first.
    """

    def __init__(self, make, limit: int, most: int = 16 << 20):
        super().__init__()
        self.make, self.limit, self.most, self.old, self.chars = make, limit, most, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        self.chars += len(key)
        return value

    def missing(self, keys) -> list:
        """The keys that have no value yet, once each; those of the older generation are taken over."""
        new = set(keys).difference(self)
        known = new.intersection(self.old)
        self.learn(known, [self.old[k] for k in known])
        return list(new - known)

    def learn(self, keys, values) -> None:
        """Keep values that were made elsewhere."""
        self.update(zip(keys, values, strict=True))
        self.chars += sum(map(len, keys))

    def turn(self) -> None:
        """Begin a new generation if this one is full; call it between texts."""
        if len(self) > self.limit or self.chars > self.most:
            self.old, self.chars = dict(self), 0
            self.clear()


def salted_rank(df: DataFrame, group: list[str], order: list[Column], uniform: Column, to: str, weight: Column | None = None) -> DataFrame:
    """Add ``to``: the rank from 0 of each row in its group, or the weight of the rows before it.

    ``uniform`` is a 64-bit hash that is fixed for a row. A group of any size is dealt to buckets of about RANK_ROWS
    rows by ranges of that hash; rows are ordered by bucket, then by ``order``, so with the hash first in ``order``
    they are in its order altogether. Only counts of buckets are gathered. Null group values form a group of their
    own. df is computed twice, so it should be a table or as good as one.
    """
    # The upper 30 bits, with the sign turned so that they rise as the signed hash does.
    spread = F.shiftrightunsigned(uniform.bitwiseXOR(F.lit(-(1 << 63))), 34)
    keys = [F.col(g) for g in group]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.ceil(F.col("_n") / RANK_ROWS).cast("long").alias("_parts"))
    same = lambda a, b: [a[g].eqNullSafe(b[f"_g{i}"]) for i, g in enumerate(group)]
    joined = df.join(counts, same(df, counts), "left") if group else df.crossJoin(counts)
    dealt = joined.withColumn("_part", F.shiftright(spread * F.coalesce("_parts", F.lit(1).cast("long")), 30)).drop("_parts", *[f"_g{i}" for i in range(len(group))])
    weighed = dealt.withColumn("_w", weight if weight is not None else F.lit(1).cast("long"))
    sums = weighed.groupBy(*keys, "_part").agg(F.sum("_w").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("_ahead", before).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), "_ahead")
    here = F.coalesce(F.sum("_w").over(Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = weighed.withColumn("_here", here)
    out = ranked.join(starts, [*same(ranked, starts), ranked["_part"] == starts["_p"]], "left")
    return out.withColumn(to, F.col("_here") + F.col("_ahead")).drop("_part", "_w", "_here", "_ahead", "_p", *[f"_g{i}" for i in range(len(group))])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def arrow_rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the schema's columns, in its order."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

