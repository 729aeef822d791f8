"""The reference sequence under an alignment, from the read, its CIGAR and its MD tag."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .cigar import MD_TOKEN, OPS


def reconstruct(seq: str | None, cigar: str | None, md: str | None) -> str:
    """The reference's bases: as in the read where it matches, those of MD elsewhere, N where nothing tells.

    Without MD, bases under M may or may not match and are in lower case. D, N and X give N, which MD may fill in; I, S
    and P pass over bases of the read. A null or ``*`` CIGAR gives an empty string; a read that is too short gives N.
    """
    if not cigar or cigar == "*":
        return ""
    read, out, at = seq or "", [], 0
    for n, op in re.findall(f"([0-9]+)([{OPS}])", cigar):
        n = int(n)
        part = read[at : at + n].ljust(n, "N")
        if op in "M=":
            out.append(part if md or op == "=" else part.lower())
        elif op in "DNX":
            out.append("N" * n)
        if op in "M=XISP":
            at += n
    bases = list("".join(out))
    place = 0
    for run, other in re.findall(MD_TOKEN, md or ""):
        place += int(run)
        letters = other.lstrip("^")
        if place + len(letters) > len(bases):
            bases += "N" * (place + len(letters) - len(bases))
        bases[place : place + len(letters)] = letters
        place += len(letters)
    return "".join(bases)


def reconstruct_reference(seq: Column, cigar: Column, md: Column) -> Column:
    """``reconstruct`` over columns."""

    @F.arrow_udf("string")
    def run(seqs: pa.Array, cigars: pa.Array, mds: pa.Array) -> pa.Array:
        return pa.array([reconstruct(*row) for row in zip(seqs.to_pylist(), cigars.to_pylist(), mds.to_pylist(), strict=True)], pa.string())

    return run(seq, cigar, md)
