"""Mixing sources to target weights by Pfair scheduling.

A source's documents are cut to blocks of about equal size. The k-th block of a source with weight w may go to slots
from floor((k - 1) / w) on and has the deadline ceil(k / w); of the blocks released, each slot takes the one with
the earliest deadline. Weights are the asked ones as exact fractions over a common denominator, whatever the input's
size. Slots are simulated block by block; when a source has no blocks left, the others go on in a new phase with their
weights scaled up to one. Within a phase no prefix deviates from the weights by a block or more. A document belongs to
the block that its first character lies in, so in characters a source is less than a block and its longest text off.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import salted_rank, stored

#: Characters of a block at least, and blocks (and sources) that a plan may have: larger inputs have larger blocks.
BLOCK_CHARS, PLAN_BLOCKS = 65_536, 1 << 20
#: Characters of a partition of mixed rows at least, and such partitions at most: larger inputs have larger ones.
PART_CHARS, PARTS = 8 << 20, 1 << 16


def exact_weights(weights: list[float]) -> list[int]:
    """Positive whole weights in exactly the proportion of the given ones, of any size."""
    if not all(0 < w < math.inf for w in weights):
        raise ValueError("weights must be positive numbers")
    parts = [Fraction(w) for w in weights]
    common = math.lcm(*(x.denominator for x in parts))
    whole = [int(x * common) for x in parts]
    most = math.gcd(*whole)
    return [w // most for w in whole]


class _Alive:
    """Which of n things are left, in their order."""

    def __init__(self, n: int):
        self.next = list(range(n + 1))

    def find(self, i: int) -> int:
        """The first one left from i on; n if there is none."""
        at = i
        while self.next[at] != at:
            at = self.next[at]
        while self.next[i] != at:
            self.next[i], i = at, self.next[i]
        return at

    def drop(self, i: int) -> None:
        self.next[i] = i + 1


def plan_slots(weights: list[int], blocks: list[int]) -> tuple[list[array], list[int]]:
    """The slot of each block of each source, by earliest deadline among released blocks, and where phases begin.

    Work is in proportion to the number of blocks (times a logarithm), however many sources and phases there are: in
    a phase's heaps are only sources that it has served. The others are released at its start, and of these the
    heaviest has the earliest deadline.
    """
    order = sorted((i for i, n in enumerate(blocks) if n), key=lambda i: (-weights[i], i))
    slots, left, alive = [array("q") for _ in blocks], list(blocks), _Alive(len(order))
    period, base, phases = sum(weights[i] for i in order), 0, []
    while (fresh := alive.find(0)) < len(order):
        phases.append(base)
        waiting: list[tuple[int, int, int, int]] = []
        released: list[tuple[int, int, int]] = []
        t = 0
        while True:
            while waiting and waiting[0][0] <= t:
                _, deadline, at, k = heapq.heappop(waiting)
                heapq.heappush(released, (deadline, at, k))
            first = (-(-period // weights[order[fresh]]), fresh, 0) if fresh < len(order) else None
            if first and (not released or first < released[0]):
                deadline, at, k = first
                fresh = alive.find(fresh + 1)
            else:
                deadline, at, k = heapq.heappop(released)
            if deadline <= t:
                raise AssertionError("a block missed its deadline")
            source = order[at]
            slots[source].append(base + t)
            left[source] -= 1
            t += 1
            if not left[source]:
                alive.drop(at)
                period -= weights[source]
                break
            w = weights[source]
            heapq.heappush(waiting, ((k + 1) * period // w, -(-(k + 2) * period // w), at, k + 1))
        base += t
    return slots, phases


def _measured(docs: DataFrame) -> list[Column]:
    """A row's units and hash."""
    units = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long")
    return [units.alias("_units"), F.xxhash64("doc_id", "text").alias("_key")]


class _Plan:
    """The plan as a small table (_source, _slots, _phases), with the sizes that it was made for.

    A row for each source comes to the driver, and the table has an entry for each block: PLAN_BLOCKS and a block for
    each source at most.
    """

    def __init__(self, spark: SparkSession, rows: DataFrame, weights: Mapping[str | None, float] | None, exponent: float, block_chars: int):
        sizes = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum("_units").alias("n")).limit(PLAN_BLOCKS + 1).collect()]
        if len(sizes) > PLAN_BLOCKS:
            raise ValueError(f"more than {PLAN_BLOCKS} sources: merge small ones")
        sizes.sort(key=lambda x: (x[0] is not None, x[0] or ""))
        if weights is None:
            asked = [n**exponent for _, n in sizes]
        else:
            mean = sum(weights.values()) / max(1, len(weights))
            asked = [weights.get(s, mean) for s, _ in sizes]
        self.units = sum(n for _, n in sizes)
        self.block = max(block_chars, -(-self.units // PLAN_BLOCKS))
        slots, phases = plan_slots(exact_weights(asked) if sizes else [], [-(-n // self.block) for _, n in sizes])
        self.slots = sum(map(len, slots))
        of, at = array("i", [0]) * self.slots, [*phases, self.slots][1:]
        for phase, (begin, end) in enumerate(zip(phases, at, strict=True)):
            of[begin:end] = array("i", [phase]) * (end - begin)
        columns = {"_source": pa.array([s for s, _ in sizes], pa.string()), "_slots": pa.array([list(s) for s in slots], pa.list_(pa.int64())), "_phases": pa.array([[of[t] for t in s] for s in slots], pa.list_(pa.int32()))}
        self.table = spark.createDataFrame(pa.table(columns))

    def slotted(self, placed: DataFrame) -> DataFrame:
        """Add _block, _slot and _phase to rows with _before."""
        blocked = placed.withColumn("_block", F.expr(f"_before div {self.block}"))
        joined = blocked.join(F.broadcast(self.table), F.col("source").eqNullSafe(F.col("_source")), "left")
        nth = F.col("_block").cast("int")
        lost = F.raise_error(F.lit("a row has no place in the plan")).cast("long")
        return joined.withColumns({"_slot": F.coalesce(F.get("_slots", nth), lost), "_phase": F.get("_phases", nth)}).drop("_source", "_slots", "_phases")

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows (source, _units, _key, ...) with _before, _block, _slot and _phase."""
        return self.slotted(salted_rank(rows, ["source"], [F.col("_key"), F.col("_units")], F.col("_key"), "_before", F.col("_units")))


def schedule(spark: SparkSession, docs: DataFrame, weights: Mapping[str | None, float] | None = None, exponent: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, source, units, block (of the source), before (units before the row in its source), phase and slot.

    Every row comes once; sorted by (slot, before), rows are mixed. A row's units are the characters of its text, one
    at least. ``weights`` gives a target for each source (a source that it doesn't name, or null, gets the mean of the
    others); by default a source's weight is its units to the power ``exponent``. Weights are held exactly. Rows of a
    source are taken in the order of a hash, and a block is ``block_chars`` units, or a PLAN_BLOCKS-th of all units
    where that is more. A null source is a source of its own; more than PLAN_BLOCKS sources are an error. Identical
    rows are interchangeable. An empty table gives no rows. Columns other than doc_id, source and text are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    slim = slim.select("doc_id", "source", *_measured(slim))
    plan = _Plan(spark, slim, weights, exponent, block_chars)
    return plan.placed(slim).select("doc_id", "source", F.col("_units").alias("units"), F.col("_block").alias("block"), F.col("_before").alias("before"), F.col("_phase").alias("phase"), F.col("_slot").alias("slot"))


def _cell(bits: Column) -> Column:
    """The first ``bits`` bits of _key, which rise as the signed hash does."""
    return F.call_function("shiftrightunsigned", F.shiftrightunsigned(F.col("_key").bitwiseXOR(F.lit(-(1 << 63))), 1), F.lit(63) - bits)


def _led(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (source, _key) with _part and _begin of the last of their source's cuts (source, _key, begin, part) at or before their hash.

    A source's hashes are dealt to about as many cells as it has cuts, and a cell's row has the few cuts that reach
    into it; so a row looks at a few cuts, however many there are. The table is at most three times the cuts.
    """
    bits = cuts.groupBy("source").agg(F.ceil(F.log2(F.count(F.lit(1)))).cast("int").alias("_bits")).withColumnRenamed("source", "_s")
    same = F.col("source").eqNullSafe(F.col("_s"))
    celled = cuts.join(F.broadcast(bits), same).withColumn("_from", _cell(F.col("_bits")))
    to = F.coalesce(F.lead("_from").over(Window.partitionBy("_s").orderBy("_key")), F.expr("shiftleft(1L, _bits) - 1"))
    spread = celled.withColumn("_to", to).select("_s", F.explode(F.sequence("_from", "_to")).alias("_c"), F.struct(F.col("_key").alias("key"), "begin", "part").alias("cut"))
    lists = spread.groupBy("_s", "_c").agg(F.array_sort(F.collect_list("cut")).alias("_cuts"))
    at = rows.join(F.broadcast(bits), same, "left").withColumn("_cell", _cell(F.col("_bits"))).drop("_s", "_bits")
    at = at.join(F.broadcast(lists), same & (F.col("_cell") == F.col("_c")), "left")
    cut = F.element_at("_cuts", F.size(F.filter("_cuts", lambda c: c["key"] <= F.col("_key"))))
    lost = F.raise_error(F.lit("a row has no place in the plan")).cast("int")
    return at.withColumn("_cut", cut).withColumns({"_part": F.coalesce("_cut.part", lost), "_begin": F.col("_cut.begin")}).drop("_cell", "_c", "_s", "_cuts", "_cut")


def mixed_documents(spark: SparkSession, docs: DataFrame, weights: Mapping[str | None, float] | None = None, exponent: float = 0.5, block_chars: int = BLOCK_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """All rows of docs, with its columns, in the order of the mix (see ``schedule``): partition by partition, row by row.

    Places are found without the texts. They tell at which hash each source enters each stretch of slots, and by that
    small table the rows with their texts go to the stretch's partition, in one shuffle. Rows of a hash that reaches over
    several stretches, as many identical rows do, are stored once and numbered, and so get places of their own.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.col("source").cast("string").alias("source"), *_measured(docs))
    slim = rows.select("source", "_units", "_key")
    plan = _Plan(spark, slim, weights, exponent, block_chars)
    places = stored(plan.placed(slim).select("source", "_key", "_before", "_slot"), "places")
    parts = max(1, min(-(-plan.units // part_chars), plan.slots, PARTS))
    width = max(1, -(-plan.slots // parts))
    part = F.expr(f"_slot div {width}").cast("int")
    bounds = places.groupBy("source", part.alias("part")).agg(F.min("_key").alias("lo"), F.max("_key").alias("hi"))
    following = F.lead("lo").over(Window.partitionBy("source").orderBy("part"))
    over = stored(bounds.withColumn("_lo", following).filter("hi = _lo").select(F.col("source").alias("_s"), F.col("hi").alias("_k")).distinct(), "split-keys")
    of = lambda df, keys, how: df.join(F.broadcast(keys), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_key") == F.col("_k")), how)
    split = not over.isEmpty()
    cuts = (of(places, over, "left_anti") if split else places).groupBy("source", part.alias("part")).agg(F.min(F.struct("_key", "_before")).alias("first"))
    cuts = stored(cuts.select("source", F.col("first._key").alias("_key"), F.col("first._before").alias("begin"), "part"), "cuts")
    known = _led(of(rows, over, "left_anti") if split else rows, cuts).withColumn("_own", F.lit(None).cast("long"))
    if split:
        first = of(places, over, "left_semi").groupBy(F.col("source").alias("_s"), F.col("_key").alias("_k")).agg(F.min("_before").alias("_begin"))
        same = stored(of(rows, over, "left_semi").withColumn("_id", F.monotonically_increasing_id()), "split-rows").withColumn("_salt", F.xxhash64("_id"))
        ranked = salted_rank(same, ["source", "_key"], [F.col("_salt"), F.col("_id")], F.col("_salt"), "_nth", F.col("_units"))
        there = of(ranked, first, "inner").withColumn("_before", F.col("_begin") + F.col("_nth"))
        known = known.unionByName(plan.slotted(there).withColumns({"_part": part, "_own": F.col("_before")}).select(*known.columns))
    dealt = known.repartitionById(parts, "_part")
    inside = Window.partitionBy("_part", "source").orderBy("_key", "_units").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.sum(F.when(F.col("_own").isNull(), F.col("_units"))).over(inside)
    placed = dealt.withColumn("_before", F.coalesce("_own", F.col("_begin") + F.coalesce(ahead, F.lit(0)))).drop("_part", "_begin", "_own")
    return plan.slotted(placed).sortWithinPartitions("_slot", "_before").select("_row.*")
