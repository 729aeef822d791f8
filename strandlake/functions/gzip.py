"""Gzip members as column expressions: header fields, content with its checksum tested, and blocked files."""

from __future__ import annotations

import gzip
import io

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.bgzf import BlockWriter, MemberReader, block_starts, parse_member_header

HEADER = "struct<flags:int,mtime:bigint,xfl:int,os:int,xlen:int,block_size:bigint,file_name:string,file_comment:string,header_bytes:bigint>"
_ARROW = pa.struct([("flags", pa.int32()), ("mtime", pa.int64()), ("xfl", pa.int32()), ("os", pa.int32()), ("xlen", pa.int32()), ("block_size", pa.int64()), ("file_name", pa.string()), ("file_comment", pa.string()), ("header_bytes", pa.int64())])


def _each(kind: str, arrow: pa.DataType, f):
    """An Arrow function that applies f to each value; null stays null."""

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], arrow)

    return run


def _member(row: dict) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(row["name"] or "", "wb", fileobj=out, mtime=row["mtime"] or 0) as f:
        f.write(row["data"] or b"")
    return out.getvalue()


def _blocked(data: bytes) -> bytes:
    out = io.BytesIO()
    writer = BlockWriter(out)
    writer.write(data)
    writer.close()
    return out.getvalue()


def gzip_member(data: Column, name: Column, mtime: Column) -> Column:
    """A gzip member with a file name and a time in its header."""
    return _each("binary", pa.binary(), _member)(F.struct(data.alias("data"), name.alias("name"), mtime.alias("mtime")))


def member_header(member: Column) -> Column:
    """The header's fields; other bytes are an error."""
    return _each(HEADER, _ARROW, parse_member_header)(member)


def inflated(members: Column) -> Column:
    """The content of one or more members; a wrong checksum or size and a cut member are errors."""
    return _each("binary", pa.binary(), lambda raw: b"".join(part for _, part in MemberReader(io.BytesIO(raw), len(raw)).parts()))(members)


def blocked(data: Column) -> Column:
    """Content as blocks with an empty one at the end."""
    return _each("binary", pa.binary(), _blocked)(data)


def block_offsets(blocks: Column) -> Column:
    """Where the blocks of blocked content begin, the last empty one with them."""
    return _each("array<bigint>", pa.list_(pa.int64()), lambda raw: list(block_starts(io.BytesIO(raw), len(raw))))(blocks)
