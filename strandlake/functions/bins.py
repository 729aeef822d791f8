"""Genomic bins and virtual offsets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shift and first number of each level of bins, finest first; level 0 is the one bin 0.
LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))
UNPLACED_BIN, UNMAPPED_BIN = 4680, 37450


def reg2bin(begin: Column, end: Column) -> Column:
    """The smallest bin that holds the positions from begin (0-based) to end (exclusive)."""
    first, last = begin.cast("bigint"), end.cast("bigint") - 1
    out = None
    for shift, base in LEVELS:
        fits = F.shiftright(first, shift) == F.shiftright(last, shift)
        value = F.lit(base).cast("bigint") + F.shiftright(first, shift)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out.otherwise(F.lit(0).cast("bigint"))


def reg2bins(begin: Column, end: Column) -> Column:
    """All bins that can hold a record overlapping begin (0-based) to end (exclusive), bin 0 with them."""
    first, last = begin.cast("bigint"), F.greatest(end.cast("bigint") - 1, begin.cast("bigint"))
    levels = [F.sequence(F.shiftright(first, s) + b, F.shiftright(last, s) + b) for s, b in reversed(LEVELS)]
    return F.concat(F.array(F.lit(0).cast("bigint")), *levels)


def record_bin(flag: Column, ref_id: Column, pos: Column, end_pos: Column) -> Column:
    """A record's bin from 1-based inclusive positions; unmapped records have bins of their own."""
    unmapped = F.when(ref_id == -1, F.lit(UNPLACED_BIN)).otherwise(F.lit(UNMAPPED_BIN)).cast("bigint")
    return F.when(flag.bitwiseAND(4) != 0, unmapped).otherwise(reg2bin(pos - 1, end_pos))


def virtual_offset(block: Column, inside: Column) -> Column:
    """A block's place in the file and a place in the inflated block, in one number."""
    return F.shiftleft(block.cast("bigint"), 16).bitwiseOR(inside.cast("bigint"))


def offset_block(voffset: Column) -> Column:
    return F.shiftright(voffset, 16)


def offset_inside(voffset: Column) -> Column:
    return voffset.bitwiseAND(F.lit(0xFFFF).cast("bigint"))


def bit_vector_bytes(bits: Column) -> Column:
    """Bytes of a bit vector with its rank counts: 8 a 65,536 bits and 2 a 512 bits, without those at the start."""
    less = bits.cast("bigint") - 1
    return F.shiftright(less, 16) * 6 + F.shiftright(less, 9) * 2 + F.shiftright(bits.cast("bigint") + 7, 3)


def sampled_index_bytes(length: Column, factor: int = 5) -> Column:
    """Bytes of a suffix array sampled at every 2**factor-th place: its mark bits and the planes of its samples."""
    samples = F.ceil(length / (1 << factor)).cast("bigint")
    planes = F.length(F.bin(samples)).cast("bigint")
    return bit_vector_bytes(length) + planes * bit_vector_bytes(samples)
