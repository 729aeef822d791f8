"""Scalar functions on sequences, qualities and headers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 4-bit codes of bases in alignment files, from 0 on.
BASE_CODES = "=ACMGRSVTWYHKDBN"


def reverse_complement(seq: Column) -> Column:
    """Reverse with A and T, C and G swapped; lower-case letters and other symbols stay as they are."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def rna_to_dna(seq: Column) -> Column:
    """U becomes T; lower-case u stays."""
    return F.translate(seq, "U", "T")


def gff_attributes(header: Column) -> Column:
    """``ID=first;Note=second;Note=third`` from a header's parts between bars; empty parts at its end are dropped."""
    parts = F.split(F.regexp_replace(header, r"\|+$", ""), r"\|")
    return F.concat(F.lit("ID="), F.array_join(parts, ";Note="))


def strip_line_ends(seq: Column) -> Column:
    return F.regexp_replace(seq, "[\r\n]", "")


def strip_header(line: Column) -> Column:
    """A header line without carriage returns."""
    return F.replace(line, F.lit("\r"), F.lit(""))


def wrap(seq: Column, width: int = 50) -> Column:
    """Lines of ``width`` characters; no line end after the last, so none is blank."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


def base_codes(seq: Column) -> Column:
    """The 4-bit code of each base in either case; null for a symbol without one."""
    codes = F.lit(BASE_CODES)
    return F.transform(F.filter(F.split(F.upper(seq), ""), lambda c: c != ""), lambda c: F.nullif(F.call_function("instr", codes, c), F.lit(0)).cast("bigint") - 1)


def bases_of(codes: Column) -> Column:
    """The bases of an array of 4-bit codes."""
    return F.array_join(F.transform(codes, lambda c: F.substring(F.lit(BASE_CODES), (c + 1).cast("int"), F.lit(1))), "")


def phred_of(qualities: Column) -> Column:
    """Quality numbers as characters from ``!`` on."""
    return F.array_join(F.transform(qualities, lambda q: F.char((q + 33).cast("bigint"))), "")


def qualities_of(text: Column) -> Column:
    """The quality number of each character."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: (F.ascii(c) - 33).cast("bigint"))


def quality_is_zero(qualities: Column) -> Column:
    """Whether all quality numbers are 0: such qualities say nothing."""
    return F.aggregate(qualities, F.lit(0).cast("bigint"), lambda a, q: a + q) == 0
