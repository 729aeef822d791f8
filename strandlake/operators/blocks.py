"""Collections of sequences: deduplication, packing to blocks, order, and places in the joined text."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Distinct (length, header) pairs that one packing takes; blocks are planned on the driver from these alone.
PLAN_ROWS = 5_000_000


def dedup_sequences(sequences: DataFrame, header: str = "header", length: str = "seq_len", first: str = "file_offset") -> DataFrame:
    """One row for each (header, length): that of the least ``first``, and of equal ones any."""
    others = [c for c in sequences.columns if c not in (header, length)]
    best = sequences.groupBy(header, length).agg(F.min_by(F.struct(*others), F.struct(F.col(first), F.struct(*[c for c in others]))).alias("_b"))
    return best.select(*[F.col(c) if c in (header, length) else F.col(f"_b.{c}").alias(c) for c in sequences.columns])


def longest_first(sequences: DataFrame, header: str = "header", length: str = "seq_len") -> DataFrame:
    return sequences.orderBy(F.desc(length), F.asc(header))


def merge_smallest(items: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    """Blocks of (length, header) items: the two smallest are joined as long as they fit the largest first block.

    An item takes its length and one; blocks are ordered by size, then by their first item (longest, then by
    header). The result has the block of the longest item first, then by size.
    """
    first = lambda item: (-item[0], item[1])
    blocks = [(n + 1, (-n, h), [(n, h)]) for n, h in set(items)]
    if not blocks:
        return []
    room = max(b[0] for b in blocks)
    heapq.heapify(blocks)
    while len(blocks) > 1:
        small, second = heapq.heappop(blocks), blocks[0]
        if small[0] + second[0] > room:
            heapq.heappush(blocks, small)
            break
        joined = sorted(small[2] + second[2], key=first)
        heapq.heapreplace(blocks, (small[0] + second[0], first(joined[0]), joined))
    return [b[2] for b in sorted(blocks, key=lambda b: (b[1][0], b[0], b[1]))]


def pack_blocks(sequences: DataFrame, header: str = "header", length: str = "seq_len") -> DataFrame:
    """(header, seq_len, block_id, ord): where each distinct (header, length) goes.

    The plan is a sequential greedy one over headers and lengths, so it is made on the driver; the bases stay where
    they are. More than PLAN_ROWS of them are an error; split the collection then.
    """
    spark = sequences.sparkSession
    pairs = sequences.select(F.col(length).cast("bigint").alias("n"), F.col(header).cast("string").alias("h")).distinct().limit(PLAN_ROWS + 1).collect()
    if len(pairs) > PLAN_ROWS:
        raise ValueError("too many sequences for one packing")
    rows = [(h, n, b, o) for b, block in enumerate(merge_smallest([(r["n"], r["h"]) for r in pairs])) for o, (n, h) in enumerate(block)]
    return spark.createDataFrame(rows, "header string, seq_len bigint, block_id bigint, ord bigint")


def block_catalog(placed: DataFrame) -> DataFrame:
    """block_id, n_sequences, block_size (lengths and one for each) and longest of placed sequences."""
    return placed.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_sequences"), F.sum(F.col("seq_len") + 1).cast("bigint").alias("block_size"), F.max("seq_len").alias("longest"))


def write_blocks(placed: DataFrame, path: str) -> None:
    """Placed sequences (block_id, ord, header, seq, ...) as Parquet by block, so that a block is read alone."""
    placed.repartition("block_id").sortWithinPartitions("block_id", "ord").write.partitionBy("block_id").parquet(path)


def cumulative_offsets(sequences: DataFrame, order: str, length: str = "seq_len", parts: int | None = None) -> DataFrame:
    """Add ``text_begin``: where each sequence begins in the joined text of all, each followed by one separator.

    Sums go by ranges of ``order``: within a range in one task, and between ranges over a row for each. There are as
    many ranges as shuffle partitions, or ``parts``. The rows are stored with their range, as ranges that are sampled
    anew would differ; so pass lengths, not the sequences themselves.
    """
    parts = parts or int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.col(length).cast("bigint") + 1
    ranged = stored(sequences.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = lambda w: F.coalesce(F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    sized = ranged.withColumn("_size", size)
    starts = sized.groupBy("_part").agg(F.sum("_size").alias("_size")).withColumn("_start", before(Window.orderBy("_part"))).select(F.col("_part").alias("_p"), "_start")
    inside = sized.withColumn("_in", before(Window.partitionBy("_part").orderBy(order)))
    return inside.join(starts, F.col("_part") == F.col("_p")).withColumn("text_begin", F.col("_in") + F.col("_start")).drop("_part", "_p", "_size", "_in", "_start")


def owner_of(positions: DataFrame, offsets: DataFrame, length: str = "seq_len", width: int = 4096) -> DataFrame:
    """Positions (text_pos) in the joined text with the sequence that holds each and ``pos``, the place in it.

    Both sides meet on stretches of ``width`` letters; a position on a separator has no owner and is left out.
    """
    end = F.col("text_begin") + F.col(length)
    spread = offsets.filter(F.col(length) > 0).withColumn("_cell", F.explode(F.sequence(F.expr(f"text_begin div {width}"), F.expr(f"(text_begin + {length} - 1) div {width}"))))
    met = positions.withColumn("_c", F.expr(f"text_pos div {width}")).join(spread, F.col("_c") == F.col("_cell"))
    return met.filter((F.col("text_pos") >= F.col("text_begin")) & (F.col("text_pos") < end)).withColumn("pos", F.col("text_pos") - F.col("text_begin")).drop("_c", "_cell")
