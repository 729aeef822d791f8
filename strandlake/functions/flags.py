"""Alignment flags: tests and changes of single bits, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bits of an alignment's flag.
FLAGS = {
    "has_multiple_segments": 0x1,
    "segment_properly_aligned": 0x2,
    "unmapped_segment": 0x4,
    "next_segment_unmapped": 0x8,
    "reverse_complemented": 0x10,
    "next_segment_reverse_complemented": 0x20,
    "first_segment": 0x40,
    "last_segment": 0x80,
    "secondary_alignment": 0x100,
    "not_passing_quality": 0x200,
    "optical_duplicate": 0x400,
    "supplementary_alignment": 0x800,
}


def has_flag(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(F.lit(FLAGS[name])) != 0


def set_flag(flag: Column, name: str) -> Column:
    return flag.bitwiseOR(F.lit(FLAGS[name]))


def clear_flag(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(F.lit(~FLAGS[name]))
