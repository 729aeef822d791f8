"""Full-text indexes of texts as rows: built once, then counts and positions without the texts.

An index holds the Burrows-Wheeler transform of a text with its end mark, the number of smaller letters, how often each
letter has come at every STEP-th place, and the suffix array at every SAMPLE-th position of the text. Counting takes the
pattern from its last letter to the first and narrows an interval of suffixes; positions come from walking each hit back
to a sampled one. Patterns are matched as bytes of UTF-8, and positions are bytes, which are letters in ASCII text.
"""

from __future__ import annotations

import io
import struct
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .textindex import suffix_order

STEP, SAMPLE = 256, 32
#: Of a stored index: its first bytes, its letters, the end mark's place, and the bytes of the packed transform.
HEAD = struct.Struct("<4sQQQ")
#: Letters from which reading back by all samples at once pays, as a share of the text.
BULK = 64
BATCH_BYTES = 4 << 20


class FmIndex:
    """The index of one text."""

    def __init__(self, bwt: np.ndarray, end: int, marks: np.ndarray, samples: np.ndarray):
        # bwt has a letter for each suffix; at ``end`` stands the end mark, and the byte there means nothing.
        self.bwt, self.end, self.marks, self.samples = bwt, end, marks, samples
        counts = np.bincount(bwt, minlength=256)
        counts[bwt[end]] -= 1
        self.before = 1 + np.concatenate([[0], np.cumsum(counts)[:-1]])

    @cached_property
    def steps(self) -> np.ndarray:
        """How often each letter has come at every STEP-th place."""
        full = len(self.bwt) // STEP
        rows = np.zeros((full + 1, 256), np.int32 if len(self.bwt) < 1 << 31 else np.int64)
        if full:
            cells = np.arange(full * STEP) // STEP * 256 + self.bwt[: full * STEP]
            np.cumsum(np.bincount(cells, minlength=full * 256).reshape(full, 256), axis=0, out=rows[1:])
        return rows

    @cached_property
    def marked(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.marks)])

    @cached_property
    def backs(self) -> np.ndarray:
        """``back`` of every rank; 0 at the end mark's place."""
        out = np.zeros(len(self.bwt), np.int64)
        others = np.delete(np.arange(len(self.bwt)), self.end)
        out[others[np.argsort(self.bwt[others], kind="stable")]] = np.arange(1, len(self.bwt))
        return out

    @classmethod
    def of(cls, data: bytes) -> FmIndex:
        order = np.concatenate([[len(data)], suffix_order(data)]).astype(np.int64)
        text = np.frombuffer(data + b"\0", np.uint8)
        bwt = text[order - 1]
        marks = order % SAMPLE == 0
        return cls(bwt, int(np.flatnonzero(order == 0)[0]), marks, order[marks])

    def dump(self) -> bytes:
        packed = zlib.compress(self.bwt.tobytes(), 1)
        return HEAD.pack(b"FMI1", len(self.bwt), self.end, len(packed)) + packed + np.packbits(self.marks).tobytes() + (self.samples // SAMPLE).astype("<u4").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> FmIndex:
        if raw[:4] != b"FMI1":
            # As they were stored before.
            got = np.load(io.BytesIO(raw), allow_pickle=False)
            return cls(got["bwt"], int(got["end"]), np.unpackbits(got["marks"], count=len(got["bwt"])).astype(bool), got["samples"])
        _, n, end, size = HEAD.unpack_from(raw)
        marks_at = HEAD.size + size
        samples_at = marks_at + (n + 7) // 8
        marks = np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, marks_at), count=n).astype(bool)
        return cls(np.frombuffer(zlib.decompress(raw[HEAD.size : marks_at]), np.uint8), end, marks, np.frombuffer(raw, "<u4", -1, samples_at).astype(np.int64) * SAMPLE)

    def occurrences(self, letter: int, upto: int) -> int:
        """How often the letter stands in the transform before a place."""
        row = upto // STEP
        found = self.steps[row, letter] + int((self.bwt[row * STEP : upto] == letter).sum())
        return int(found) - (self.end < upto and self.bwt[self.end] == letter)

    def interval(self, pattern: bytes) -> tuple[int, int]:
        """The first rank whose suffix begins with the pattern and the one after the last; equal if none does."""
        if not pattern:
            raise ValueError("the pattern is empty")
        low, high = 0, len(self.bwt)
        for letter in reversed(pattern):
            low = int(self.before[letter]) + self.occurrences(letter, low)
            high = int(self.before[letter]) + self.occurrences(letter, high)
            if low >= high:
                return 0, 0
        return low, high

    def count(self, pattern: bytes) -> int:
        low, high = self.interval(pattern)
        return high - low

    def back(self, rank: int) -> int:
        """The rank of the suffix that begins a letter earlier."""
        letter = int(self.bwt[rank])
        return int(self.before[letter]) + self.occurrences(letter, rank)

    def position(self, rank: int) -> int:
        steps = 0
        while not self.marks[rank]:
            rank, steps = self.back(rank), steps + 1
        return int(self.samples[self.marked[rank]]) + steps

    def locate(self, pattern: bytes) -> list[int]:
        low, high = self.interval(pattern)
        return sorted(self.position(r) for r in range(low, high))

    def extract(self, begin: int, end: int) -> bytes:
        """The text's bytes from begin to end, read back from the first sampled position after them."""
        size = len(self.bwt) - 1
        end = min(end, size)
        if begin >= end:
            return b""
        if (end - begin) * BULK > size:
            return self._extract_many(begin, end, size)
        at = min(-(-end // SAMPLE) * SAMPLE, size)
        places = np.flatnonzero(self.marks)
        rank = 0 if at == size else int(places[np.flatnonzero(self.samples == at)[0]])
        out = bytearray()
        while at > begin:
            if at <= end:
                out.append(int(self.bwt[rank]))
            rank, at = self.back(rank), at - 1
        return bytes(reversed(out))

    def _extract_many(self, begin: int, end: int, size: int) -> bytes:
        """``extract`` from all sampled positions at once, each back to the one before."""
        low, high = begin // SAMPLE, -(-end // SAMPLE)
        ranks = np.zeros(size // SAMPLE + 2, np.int64)
        ranks[self.samples // SAMPLE] = np.flatnonzero(self.marks)
        out = np.zeros((high - low, SAMPLE), np.uint8)
        at, backs = ranks[low + 1 : high + 1], self.backs
        for k in range(SAMPLE - 1, -1, -1):
            out[:, k] = self.bwt[at]
            at = backs[at]
        if high * SAMPLE > size:
            # The text ends within the last part, which begins at the end mark's suffix, of rank 0.
            rank, out[-1] = 0, 0
            for k in range(size % SAMPLE - 1, -1, -1):
                out[-1, k] = self.bwt[rank]
                rank = backs[rank]
        return out.reshape(-1)[begin - low * SAMPLE : end - low * SAMPLE].tobytes()


def build_indexes(texts: DataFrame, key: str = "header", text: str = "seq") -> DataFrame:
    """(key, n_bytes, fm): the index of each text; null texts have none. An index is one task's work, so cut long texts first."""
    ship(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            held, size = [], 0
            made = lambda rows, kind=b.schema.field(0).type: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (kind, pa.int64(), pa.binary()), strict=True)], ["key", "n_bytes", "fm"])
            for k, t in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                if t is not None:
                    data = t.encode()
                    held.append((k, len(data), FmIndex.of(data).dump()))
                    size += len(held[-1][2])
                    if size > BATCH_BYTES:
                        yield made(held)
                        held, size = [], 0
            if held:
                yield made(held)

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, n_bytes bigint, fm binary")


@lru_cache(maxsize=8)
def _load(raw: bytes) -> FmIndex:
    return FmIndex.load(raw)


def loader():
    """The cached loader of the worker's own module."""
    return _load


def fm_count(fm: Column, pattern: str) -> Column:
    """Overlapping occurrences of the pattern, from the index alone."""
    sought = pattern.encode()

    @F.arrow_udf("bigint")
    def run(raws: pa.Array) -> pa.Array:
        load = loader()
        return pa.array([None if r is None else load(r).count(sought) for r in (x.as_py() for x in raws)], pa.int64())

    return run(fm)


def fm_interval(fm: Column, pattern: str) -> Column:
    """struct<sp, ep>: the first and the last rank (from 0, without the end mark's) of the suffixes that begin with the pattern; null for none."""
    sought = pattern.encode()
    if not sought:
        raise ValueError("the pattern is empty")

    @F.arrow_udf("struct<sp:bigint,ep:bigint>")
    def run(raws: pa.Array) -> pa.Array:
        load, out = loader(), []
        for r in (x.as_py() for x in raws):
            low, high = (0, 0) if r is None else load(r).interval(sought)
            out.append({"sp": low - 1, "ep": high - 2} if low < high else None)
        return pa.array(out, pa.struct([("sp", pa.int64()), ("ep", pa.int64())]))

    return run(fm)


def backward_search(indexes: DataFrame, pattern: str, key: str = "header") -> DataFrame:
    """(key, sp, ep, n): the interval of ranks whose suffixes begin with the pattern, from the indexes alone; keys without one aren't listed."""
    found = indexes.select(key, fm_interval(F.col("fm"), pattern).alias("_i")).filter("_i is not null")
    return found.select(key, "_i.sp", "_i.ep", (F.col("_i.ep") - F.col("_i.sp") + 1).alias("n"))


def fm_locate(fm: Column, pattern: str) -> Column:
    """Ascending positions of the pattern, from the index alone."""
    sought = pattern.encode()

    @F.arrow_udf("array<bigint>")
    def run(raws: pa.Array) -> pa.Array:
        load = loader()
        return pa.array([None if r is None else load(r).locate(sought) for r in (x.as_py() for x in raws)], pa.list_(pa.int64()))

    return run(fm)


def fm_extract(fm: Column, begin: int, end: int) -> Column:
    """The text between two positions, from the index alone."""

    @F.arrow_udf("string")
    def run(raws: pa.Array) -> pa.Array:
        load = loader()
        return pa.array([None if r is None else load(r).extract(begin, end).decode("utf-8", "replace") for r in (x.as_py() for x in raws)], pa.string())

    return run(fm)
