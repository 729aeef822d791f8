"""Statistics and index structures of texts: histograms, ranks, suffix arrays, transforms, code lengths."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

#: Fixed value: where the hash of headers starts.
HASH_START = 1125899906842597

def letters(texts: DataFrame, key: str = "header", text: str = "seq") -> DataFrame:
    """(key, pos, ch): a row for each letter."""
    return texts.select(key, F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("pos", "ch")).withColumn("pos", F.col("pos").cast("bigint"))


def histogram(texts: DataFrame, text: str = "seq") -> DataFrame:
    """(ch, n): how often each letter occurs in all texts; sums within rows' letters first."""
    return texts.select(F.explode(F.split(text, "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


def entropy(counts: DataFrame) -> DataFrame:
    """Bits a letter that an ideal code takes."""
    total = F.sum("n")
    return counts.agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"))


def symbol_starts(counts: DataFrame) -> DataFrame:
    """(ch, n, start): where each letter's suffixes begin among all, in the letters' order."""
    before = F.sum("n").over(Window.orderBy("ch").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("ch", "n", F.coalesce(before, F.lit(0)).cast("bigint").alias("start"))


def rank_symbol(rows: DataFrame, symbol: str, key: str = "header") -> DataFrame:
    """rows of ``letters`` with ``rank``: occurrences of the symbol up to and with the position, less one (-1: none yet)."""
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("rank", (F.count_if(F.col("ch") == symbol).over(upto) - 1).cast("bigint"))


def select_symbol(rows: DataFrame, symbol: str, n: int, key: str = "header") -> DataFrame:
    """(key, pos) of the n-th occurrence (from 1) of the symbol."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return rows.filter(F.col("ch") == symbol).withColumn("_n", nth).filter(F.col("_n") == n).select(key, "pos")


def suffix_order(data: bytes) -> np.ndarray:
    """The suffix array of bytes by prefix doubling; a suffix that is a prefix of another comes first.

    Suffixes are sorted by seven letters first; then only those that still equal others go on, each round by twice as many.
    """
    n, step = len(data), 7
    if not n:
        return np.zeros(0, np.int64)
    letters_ = np.zeros(n + step, np.int64)
    letters_[:n] = np.frombuffer(data, np.uint8)
    letters_[:n] += 1
    key = letters_[:n].copy()
    for k in range(1, step):
        key = key << 9 | letters_[k : k + n]
    order, slots, rank = np.arange(n), np.arange(n), np.zeros(n + 1, np.int64)
    while len(slots):
        # The slots of suffixes that aren't alone yet, group by group; a group's rank is its first slot, from 1.
        by = np.argsort(key)
        held, key = order[slots][by], key[by]
        order[slots] = held
        fresh = np.append(True, key[1:] != key[:-1])
        rank[held] = np.maximum.accumulate(np.where(fresh, slots, 0)) + 1
        slots = slots[~(fresh & np.append(fresh[1:], True))]
        held = order[slots]
        key = rank[held] * (n + 1) + rank[np.minimum(held + step, n)]
        # The first round compared seven letters, so the next compares fourteen.
        step *= 2
    return order


def suffix_array(texts: DataFrame, key: str = "header", text: str = "seq") -> DataFrame:
    """(key, sa_rank, pos, bwt): suffixes of each text in order of its bytes in UTF-8, and the byte's letter before each.

    A text is one row, so its index is one task's work and memory (about 40 times its bytes); cut long texts to
    blocks first. bwt is null at the suffix that is the whole text: what comes before it is the separator.
    Positions count bytes, which are letters in ASCII text.
    """
    ship(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k, t in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                data = (t or "").encode()
                order = suffix_order(data)
                if len(order):
                    before = [chr(data[p - 1]) if p else None for p in order.tolist()]
                    yield pa.RecordBatch.from_pydict({"key": pa.array([k] * len(order), b.schema.field(0).type), "sa_rank": pa.array(np.arange(len(order))), "pos": pa.array(order.astype(np.int64)), "bwt": pa.array(before, pa.string())})

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, sa_rank bigint, pos bigint, bwt string")


def sampled(sa: DataFrame, factor: int = 32) -> DataFrame:
    """The entries of a suffix array whose position is a multiple of the factor."""
    return sa.filter(F.col("pos") % factor == 0)


def common_prefixes(texts: DataFrame, key: str = "header", text: str = "seq") -> DataFrame:
    """(key, sa_rank, lcp): letters that each suffix shares with the one before it in order; 0 for the first."""
    ship(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k, t in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                data = (t or "").encode()
                order = suffix_order(data).tolist()
                place = {p: i for i, p in enumerate(order)}
                out, h = [0] * len(order), 0
                for p in range(len(order)):
                    i = place[p]
                    if i:
                        q = order[i - 1]
                        while max(p, q) + h < len(data) and data[p + h] == data[q + h]:
                            h += 1
                        out[i] = h
                    h = max(0, h - 1) if i else 0
                if out:
                    yield pa.RecordBatch.from_pydict({"key": pa.array([k] * len(out), b.schema.field(0).type), "sa_rank": pa.array(range(len(out)), pa.int64()), "lcp": pa.array(out, pa.int64())})

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, sa_rank bigint, lcp bigint")


def code_lengths(counts: dict[str, int], most: int = 15) -> dict[str, int]:
    """Lengths of an optimal prefix code of at most ``most`` bits (package-merge); a lone symbol has one bit."""
    items = sorted((n, s) for s, n in counts.items() if n > 0)
    if len(items) < 2:
        return {s: 1 for _, s in items}
    if len(items) > 1 << most:
        raise ValueError("too many symbols for this length")
    leaves = [(n, (s,)) for n, s in items]
    packages: list[tuple[int, tuple]] = []
    for _ in range(most):
        row = list(heapq.merge(leaves, packages))
        packages = [(row[i][0] + row[i + 1][0], row[i][1] + row[i + 1][1]) for i in range(0, len(row) - 1, 2)]
    out = dict.fromkeys(counts, 0)
    for _, symbols in packages[: len(items) - 1]:
        for s in symbols:
            out[s] += 1
    return {s: n for s, n in out.items() if n}


def canonical_codes(lengths: dict[str, int]) -> dict[str, str]:
    """Codes as bit strings: shorter ones first, and equal ones in the symbols' order."""
    code, last, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        last = n
        out[s] = format(code, f"0{n}b")
        code += 1
    return out


def encode_text(text: str, codes: dict[str, str]) -> bytes:
    """The letters' codes one after another, first bit first, with zeros to the last byte's end."""
    bits = "".join(map(codes.__getitem__, text))
    return int(bits + "0" * (-len(bits) % 8) or "0", 2).to_bytes(-(-len(bits) // 8))


def decode_text(data: bytes, n: int, codes: dict[str, str]) -> str:
    """The first n letters of what encode_text made."""
    letters_ = {c: s for s, c in codes.items()}
    out, code = [], ""
    for bit in format(int.from_bytes(data), f"0{8 * len(data)}b") if n else "":
        code += bit
        if code in letters_:
            out.append(letters_[code])
            code = ""
            if len(out) == n:
                return "".join(out)
    if n:
        raise EOFError("the data ends before the last letter")
    return ""


def huffman_codes(counts: DataFrame, most: int = 15) -> DataFrame:
    """(ch, n, bits, code) for a histogram (ch, n), which has a row a symbol and so comes to the driver."""
    rows = {r["ch"]: r["n"] for r in counts.collect()}
    lengths = code_lengths(rows, most)
    codes = canonical_codes(lengths)
    return counts.sparkSession.createDataFrame([(s, rows[s], n, codes[s]) for s, n in lengths.items()], "ch string, n bigint, bits bigint, code string")


def header_hash(headers: Column) -> Column:
    """A 64-bit hash of a block's headers (array<string>): times 31 plus each UTF-16 unit, wrapping around."""

    @F.arrow_udf("bigint")
    def fold(lists: pa.Array) -> pa.Array:
        out = []
        for names in lists.to_pylist():
            h = HASH_START
            for name in names or []:
                raw = name.encode("utf-16-le")
                for i in range(0, len(raw), 2):
                    h = (31 * h + int.from_bytes(raw[i : i + 2], "little")) & (1 << 64) - 1
            out.append(h - (1 << 64) if h >> 63 else h)
        return pa.array(out, pa.int64())

    return fold(headers)
