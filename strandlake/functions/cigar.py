"""CIGAR and MD strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The operations, those that take up the reference, and those that take up the read.
OPS = "MIDNSHP=X"
ON_REFERENCE = "MDNP=X"
TOKEN = f"([0-9]+)([{OPS}])"
MD_TOKEN = r"([0-9]+)([A-Z]|\^[A-Z]+)?"


def parse_cigar(cigar: Column) -> Column:
    """array<struct<op,len>>; text that isn't an operation is passed over, and ``*`` gives null."""
    runs = F.transform(F.regexp_extract_all(cigar, F.lit(TOKEN), F.lit(0)), lambda t: F.struct(F.right(t, F.lit(1)).alias("op"), F.regexp_extract(t, "^[0-9]+", 0).cast("bigint").alias("len")))
    return F.when(cigar != "*", runs)


def format_cigar(ops: Column) -> Column:
    """The string of parsed operations; ``*`` for null."""
    return F.coalesce(F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), ""), F.lit("*"))


def cigar_ops(ops: Column) -> Column:
    return F.transform(ops, lambda x: x["op"])


def cigar_lengths(ops: Column) -> Column:
    return F.transform(ops, lambda x: x["len"])


def reference_length(ops: Column) -> Column:
    """Bases of the reference under the operations M, D, N, P, = and X; 0 for null."""
    taken = F.filter(ops, lambda x: F.call_function("instr", F.lit(ON_REFERENCE), x["op"]) > 0)
    return F.coalesce(F.aggregate(taken, F.lit(0).cast("bigint"), lambda a, x: a + x["len"]), F.lit(0).cast("bigint"))


def alignment_end(flag: Column, pos: Column, ops: Column) -> Column:
    """Last reference position (from 1, inclusive); 0 for unmapped segments and for those without a CIGAR."""
    return F.when((flag.bitwiseAND(4) != 0) | ops.isNull(), F.lit(0).cast("bigint")).otherwise(pos.cast("bigint") + reference_length(ops) - 1)


def md_tokens(md: Column) -> Column:
    """The parts of an MD string: a number of matches, then a base or a deletion (``^`` and bases), if any."""
    return F.regexp_extract_all(md, F.lit(MD_TOKEN), F.lit(0))
