"""Packing token sequences by minimum bin slack.

A packing depends on the pieces' lengths alone, and lengths are at most the capacity. So the plan is made
from a histogram of lengths, whose size doesn't grow with the data: for each bin a bitset holds the sums
that the lengths left can make, the fullest is taken, and the same combination is repeated while pieces
last. A plan is a table of runs of ranks in each length; pieces find their bins by a join with it.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, salted_rank, stored, tune
from .token_cache import tokenizer

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length make the largest sum of at most ``room``; lengths descend.

    Subset sums as bits of an integer: bit s is set if some pieces sum to s. A length's count is split in
    powers of two. It stops as soon as the room can be filled.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for n in lengths:
        if n > room:
            continue
        left, take = min(counts[n], room // n), 1
        while left:
            take = min(take, left)
            before = reach
            reach |= (reach << take * n) & mask
            if reach != before:
                steps.append((n, take, before))
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[n] = chosen.get(n, 0) + take
            total -= take * n
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, pieces of each length) for bins that together hold every piece of the histogram.

    Each bin takes the longest piece left and the combination that leaves the least slack beside it; a
    combination is repeated until a length of it runs short, which gives the same bins one by one.
    """
    counts = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    plan, lengths = [], sorted(counts, reverse=True)
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        chosen = fullest(counts, lengths, capacity - first)
        counts[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        times = min(counts[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            counts[n] -= k * times
        plan.append((times, chosen))
        if any(not counts[n] for n in chosen):
            lengths = [n for n in lengths if counts[n]]
    return plan


def plan_rows(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of this length in a sequence, offset of the first)."""
    rows, used, sequence = [], {}, 0
    for times, chosen in plan:
        offset = 0
        for n, k in sorted(chosen.items(), reverse=True):
            begin = used.get(n, 0)
            used[n] = begin + k * times
            rows.append((n, begin, used[n], sequence, k, offset))
            offset += n * k
        sequence += times
    return rows


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Encode docs (doc_id, text), append end_id and cut at every ``capacity`` tokens: doc_id, piece, start, length, ids_crc32."""
    tune(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def cut(batches):
        code = tokenizer(vocabulary)
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = code.encode(t.as_py()) + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((d, i, at // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                yield arrow_rows(PIECES, **dict(zip(PIECES.names, zip(*out, strict=True), strict=True)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces that have a ``length`` from 1 to the capacity.

    Within a sequence offsets are gapless from 0 and never pass the capacity. The histogram that comes to the
    driver has at most ``capacity`` rows, and the plan at most a few for each length.
    """
    spark = pieces.sparkSession
    table = stored(pieces.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan_rows(plan_bins(histogram, capacity))
    plan = spark.createDataFrame(rows, "_len long, _from long, _to long, _seq long, _each long, _off long")
    ranked = salted_rank(table, ["length"], [F.col("_uid")], F.xxhash64("_uid"), "_rank")
    place = F.col("_rank") - F.col("_from")
    here = (F.col("_len") == F.col("length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    found = ranked.join(F.broadcast(plan), here).withColumns({"sequence_id": F.col("_seq") + F.expr("(_rank - _from) div _each"), "offset": F.col("_off") + F.pmod(place, F.col("_each")) * F.col("length")})
    return found.drop("_uid", "_rank", "_len", "_from", "_to", "_seq", "_each", "_off")


def best_fit_packing(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens; only longer ones are cut.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset per piece. A null or empty text
    is the end id alone. Rows without a doc_id and rows that repeat one are packed as they are. An empty
    table gives no rows. Columns other than doc_id and text are ignored.
    """
    return pack_pieces(token_pieces(docs, vocabulary, end_id, capacity), capacity)
