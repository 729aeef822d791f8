"""Overlap joins by cells, and the parts of a bin index: chunks, linear offsets, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import UNMAPPED_BIN, offset_block


def overlaps(pos: Column, end_pos: Column, begin: Column, end: Column) -> Column:
    """pos before the region's end and end_pos after its begin, both strictly, on 1-based columns."""
    return (pos < end) & (end_pos > begin)


#: Widths of cells, as powers of two; an interval's level is the first that is as wide as it is long, so it is in two cells at most.
CELLS = (6, 9, 12, 14, 17, 20, 23, 26, 29)


def _level(first: Column, last: Column) -> Column:
    length = last - first + 1
    out = F.when(length <= 1 << CELLS[0], F.lit(CELLS[0]))
    for c in CELLS[1:-1]:
        out = out.when(length <= 1 << c, F.lit(c))
    return out.otherwise(F.lit(CELLS[-1]))


def _in_cells(df: DataFrame, low: Column, high: Column, levels: list[int], prefix: str) -> DataFrame:
    """df repeated for each cell of its intervals, at their own level or at wider ones that the other side has."""
    named = df.withColumns({f"{prefix}low": low, f"{prefix}own": _level(low, high)})
    at = F.array_distinct(F.transform(F.array(*map(F.lit, levels)), lambda x: F.greatest(x, F.col(f"{prefix}own"))))
    wide = named.withColumn(f"{prefix}level", F.explode(at))
    cell = lambda c: F.call_function("shiftright", c, F.col(f"{prefix}level"))
    return wide.withColumn(f"{prefix}cell", F.explode(F.sequence(cell(F.col(f"{prefix}low")), cell(high))))


def overlap_join(records: DataFrame, regions: DataFrame) -> DataFrame:
    """Records (ref_id, pos, end_pos, ...) with the columns of the regions (region_ref, begin, end, ...) they overlap.

    Both sides meet on reference and cell, so this is an equi-join with a residual test. A pair meets at the level of
    the longer of the two, where each is in two cells at most, and in the first cell that both share; so no pair comes
    twice, and no cell is filled by what happens to lie over a boundary. Only levels come to the driver.
    """
    # Where an interval ends before it begins, as an unmapped record does, what overlaps it holds all of it, so one point does.
    pos, low = F.col("pos").cast("bigint"), F.least("begin", "end").cast("bigint")
    last, high = F.greatest(pos, F.col("end_pos").cast("bigint")), F.greatest(low, F.col("end").cast("bigint"))
    asked = sorted(r[0] for r in regions.select(_level(low, high).alias("l")).distinct().collect())
    ours = _in_cells(records, pos, last, asked or [CELLS[0]], "_r")
    theirs = _in_cells(regions, low, high, list(CELLS), "_g")
    met = ours.join(theirs, (F.col("ref_id") == F.col("region_ref")) & (F.col("_rlevel") == F.col("_glevel")) & (F.col("_rcell") == F.col("_gcell")))
    # Both are at a level only if it is the wider one of their own.
    here = F.col("_rlevel") == F.greatest("_rown", "_gown")
    first = F.col("_rcell") == F.call_function("shiftright", F.greatest("_rlow", "_glow"), F.col("_rlevel"))
    kept = met.filter(here & first & overlaps(F.col("pos"), F.col("end_pos"), F.col("begin"), F.col("end")))
    return kept.drop(*[f"_{s}{c}" for s in "rg" for c in ("low", "own", "level", "cell")])


def with_reference_names(records: DataFrame, refs: DataFrame) -> DataFrame:
    """rname and rname_next from refs (ref_id, name); ids out of range and below 0 have null."""
    own = refs.select(F.col("ref_id").alias("_r1"), F.col("name").alias("rname"))
    other = refs.select(F.col("ref_id").alias("_r2"), F.col("name").alias("rname_next"))
    base = records.drop("rname", "rname_next")
    return base.join(own, F.col("ref_id") == F.col("_r1"), "left").join(other, F.col("next_ref_id") == F.col("_r2"), "left").drop("_r1", "_r2")


def merge_chunks(chunks: DataFrame) -> DataFrame:
    """(ref_id, bin, chunk_beg, chunk_end) merged within a bin where one begins before the last ends or in its block."""
    order = Window.partitionBy("ref_id", "bin").orderBy("chunk_beg", "chunk_end")
    far = F.max("chunk_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = far.isNotNull() & (F.col("chunk_beg") > far) & (offset_block(F.col("chunk_beg")) != offset_block(far))
    marked = chunks.withColumn("_island", apart.cast("int"))
    numbered = marked.withColumn("_n", F.sum("_island").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("ref_id", "bin", "_n").agg(F.min("chunk_beg").alias("chunk_beg"), F.max("chunk_end").alias("chunk_end")).drop("_n")


def linear_index(records: DataFrame) -> DataFrame:
    """(ref_id, win, voffset): the least virtual offset of the mapped records over each 16 kb window."""
    placed = records.filter((F.col("ref_id") >= 0) & (F.col("flag").bitwiseAND(4) == 0))
    windows = F.sequence(F.shiftright(F.col("pos").cast("bigint") - 1, 14), F.shiftright(F.greatest(F.col("end_pos"), F.col("pos")).cast("bigint") - 1, 14))
    return placed.select("ref_id", F.explode(windows).alias("win"), "voffset").groupBy("ref_id", "win").agg(F.min("voffset").alias("voffset"))


def bin_counts(records: DataFrame) -> DataFrame:
    """(ref_id, bin, n_mapped, n_unmapped, first_voffset, last_voffset) of placed records."""
    unmapped = F.col("flag").bitwiseAND(4) != 0
    return records.filter("ref_id >= 0").groupBy("ref_id", "bin").agg(F.count_if(~unmapped).alias("n_mapped"), F.count_if(unmapped).alias("n_unmapped"), F.min("voffset").alias("first_voffset"), F.max("voffset_end").alias("last_voffset"))


def build_index(records: DataFrame, refs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The bins' merged chunks, the linear index, and a row of the unplaced count and the last placed offset.

    Each reference also gets the pseudo-bin: its first chunk spans its records, its second holds the numbers of
    mapped and of unmapped ones. records is to be a bounded or stored table, as it is read for each part.
    """
    unmapped = F.col("flag").bitwiseAND(4) != 0
    placed = records.filter("ref_id >= 0")
    if refs is not None:
        placed = placed.join(refs.select(F.col("ref_id").alias("_r")), F.col("ref_id") == F.col("_r"), "left_semi")
    data = placed.filter(F.col("bin") != UNMAPPED_BIN).select("ref_id", F.col("bin").cast("bigint").alias("bin"), F.col("voffset").alias("chunk_beg"), F.col("voffset_end").alias("chunk_end"))
    sums = placed.groupBy("ref_id").agg(F.min("voffset").alias("a"), F.max("voffset_end").alias("b"), F.count_if(~unmapped).alias("c"), F.count_if(unmapped).alias("d"))
    pseudo = sums.select("ref_id", F.lit(UNMAPPED_BIN).cast("bigint").alias("bin"), F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("c").alias("x"), F.col("d").alias("y")))).alias("p")).select("ref_id", "bin", F.col("p.x").alias("chunk_beg"), F.col("p.y").alias("chunk_end"))
    totals = records.agg(F.count_if(F.col("ref_id") < 0).alias("unplaced"), F.max(F.when(F.col("ref_id") >= 0, F.col("voffset_end"))).alias("last_mapped"))
    return merge_chunks(data).unionByName(pseudo), linear_index(placed), totals


def join_index(parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``build_index`` gives, from the runs' INDEX_PARTS.

    A bin's chunks that meet within a run also meet among all of its chunks, so that merging twice changes nothing.
    """
    of = lambda kind: parts.filter(F.col("kind") == kind)
    data = of("bin").select("ref_id", F.col("at").alias("bin"), F.col("low").alias("chunk_beg"), F.col("high").alias("chunk_end"))
    only = lambda kind, value: F.when(F.col("kind") == kind, F.col(value))
    told = parts.filter("kind in ('span', 'count')").groupBy("ref_id").agg(F.min(only("span", "low")).alias("a"), F.max(only("span", "high")).alias("b"), F.sum(only("count", "low")).alias("c"), F.sum(only("count", "high")).alias("d"))
    pairs = F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("c").alias("x"), F.col("d").alias("y")))
    pseudo = told.select("ref_id", F.lit(UNMAPPED_BIN).cast("bigint").alias("bin"), F.explode(pairs).alias("p")).select("ref_id", "bin", F.col("p.x").alias("chunk_beg"), F.col("p.y").alias("chunk_end"))
    linear = of("win").groupBy("ref_id", F.col("at").alias("win")).agg(F.min("low").alias("voffset"))
    totals = parts.agg(F.coalesce(F.sum(only("unplaced", "low")), F.lit(0)).alias("unplaced"), F.max(only("span", "high")).alias("last_mapped"))
    return merge_chunks(data).unionByName(pseudo), linear, totals
