"""Exact pattern search: count, locate, extract, restore, and many patterns on both strands.

Matching is exact and case-sensitive, overlapping occurrences all count, and positions are from 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dna import gff_attributes, reverse_complement, rna_to_dna, wrap
from ..session import ship

#: Letters of a seed.
SEED = 12
#: Bases of a tile.
TILE = 1 << 20


def quoted(pattern: str) -> str:
    """The pattern as literal text of a regular expression."""
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _checked(pattern: str) -> str:
    if not pattern:
        raise ValueError("the pattern is empty")
    return pattern


def count_in(seq: Column, pattern: str) -> Column:
    """Overlapping occurrences of the pattern."""
    return F.regexp_count(seq, F.lit(f"(?={quoted(_checked(pattern))})")).cast("bigint")


def positions_in(pattern: str, most: int | None = None):
    """An Arrow function from sequences to their ascending match positions."""
    _checked(pattern)

    @F.arrow_udf("array<bigint>")
    def locate(seqs: pa.Array) -> pa.Array:
        out = []
        for s in seqs.to_pylist():
            found, at = [], s.find(pattern) if s else -1
            while at >= 0:
                found.append(at)
                at = s.find(pattern, at + 1)
            out.append(found)
        return pa.array(out, pa.list_(pa.int64()))

    return locate


def register_locate(spark: SparkSession, name: str = "locate_pattern") -> None:
    """A table function for SQL: ``SELECT header, pos FROM sequences, LATERAL locate_pattern(seq, 'ACGT')``."""

    class Locate:
        def eval(self, seq: str, pattern: str):
            if not pattern:
                raise ValueError("the pattern is empty")
            at = seq.find(pattern) if seq else -1
            while at >= 0:
                yield (at,)
                at = seq.find(pattern, at + 1)

    spark.udtf.register(name, F.udtf(Locate, returnType="pos bigint"))


def count_pattern(sequences: DataFrame, pattern: str, header: str = "header", seq: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """header and n_matches of the sequences that have the pattern, with the columns to keep; the filter reaches the Parquet scan."""
    hits = sequences.filter(F.col(seq).contains(_checked(pattern)))
    return hits.select(F.col(header), *keep, count_in(F.col(seq), pattern).alias("n_matches"))


def locate_pattern(sequences: DataFrame, pattern: str, header: str = "header", seq: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """header and pos, a row for each occurrence, with the columns to keep."""
    ship(sequences.sparkSession)
    hits = sequences.filter(F.col(seq).contains(_checked(pattern)))
    return hits.select(F.col(header), *keep, F.explode(positions_in(pattern)(F.col(seq))).alias("pos"))


def named(sequences: DataFrame, name, header: str = "header") -> DataFrame:
    """The sequences with this whole header; none is an error, raised when the query is made."""
    found = sequences.filter(F.col(header) == name)
    if found.isEmpty():
        raise LookupError(f"no sequence has the header {name!r}")
    return found


def report_lines(counts: DataFrame, header: str = "header") -> DataFrame:
    """``>header found : N`` for each sequence with matches."""
    return counts.select(F.concat(F.lit(">"), F.col(header).cast("string"), F.lit(" found : "), F.col("n_matches").cast("string")).alias("line"))


def extract_column(seq: Column, begin: int | Column = 0, end: int | Column | None = None) -> Column:
    """Bases from begin (0-based) to end (exclusive, held to the length); empty if begin isn't before it."""
    first = begin if isinstance(begin, Column) else F.lit(begin)
    last = F.length(seq) if end is None else F.least(end if isinstance(end, Column) else F.lit(end), F.length(seq))
    return F.substring(seq, (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int"))


def extract(sequences: DataFrame, name, begin: int = 0, end: int | None = None, header: str = "header", seq: str = "seq") -> DataFrame:
    """The part [begin, end) of the named sequence."""
    if begin < 0 or (end is not None and end < begin):
        raise ValueError("begin must be from 0 on, and end not before it")
    return named(sequences, name, header).select(F.col(header), extract_column(F.col(seq), begin, end).alias("bases"))


def restore(placed: DataFrame, width: int | None = 50) -> DataFrame:
    """FASTA text of sequences (block_id, ord, header, seq) with their place, wrapped at ``width``."""
    body = wrap(F.col("seq"), width) if width else F.col("seq")
    return placed.select("block_id", "ord", F.concat(F.lit(">"), F.col("header").cast("string"), F.lit("\n"), body).alias("record"))


def tiles(sequences: DataFrame, longest: int, tile: int = TILE, header: str = "header", seq: str = "seq") -> DataFrame:
    """header, tile_start, core_len and bases: overlapping tiles, so that a long sequence is many tasks' work.

    A tile has ``longest - 1`` bases of the next one at its end; a match belongs to the tile in whose core it begins.
    """
    ship(sequences.sparkSession)
    kind = sequences.schema[header].dataType

    def cut(batches):
        for b in batches:
            for h, s in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                if s is not None:
                    for at in range(0, max(1, len(s)), tile):
                        part = s[at : at + tile + longest - 1]
                        yield pa.RecordBatch.from_pydict({"header": pa.array([h], b.schema.field(0).type), "tile_start": [at], "core_len": [min(tile, len(s) - at)], "bases": [part]})

    return sequences.select(F.col(header), F.col(seq)).mapInArrow(cut, f"header {kind.simpleString()}, tile_start bigint, core_len bigint, bases string")


def locate_in_tiles(tiled: DataFrame, pattern: str) -> DataFrame:
    """header and pos, the same as without tiles."""
    hits = tiled.filter(F.col("bases").contains(_checked(pattern)))
    found = hits.select("header", "tile_start", "core_len", F.explode(positions_in(pattern)(F.col("bases"))).alias("p"))
    return found.filter("p < core_len").select("header", (F.col("tile_start") + F.col("p")).alias("pos"))


def seeds(patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """Patterns with ``k`` and ``seed``, their first k letters; empty and null ones are left out."""
    k = F.least(F.length(column), F.lit(SEED))
    return patterns.filter(F.length(column) > 0).withColumns({"k": k, "seed": F.substring(F.col(column), F.lit(1), k)})


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of the k letters from each place on."""
    out = np.zeros(max(0, len(codes) - k + 1), np.uint32)
    for j in range(k):
        out = out * np.uint32(0x01000193) + codes[j : j + len(out)]
    return out ^ (out >> np.uint32(15))


class SeedFilter:
    """Finds the places of seeds in a text by a bitmap of their hashes; a place that isn't a seed's may come along."""

    def __init__(self, maps: dict[int, bytes]):
        self.bits = (len(next(iter(maps.values()))) * 8).bit_length() - 1 if maps else 0
        # Small bitmaps are spread to a byte a bit, which is faster to look up.
        self.maps = {k: np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little").view(bool) if self.bits <= 24 else np.frombuffer(m, np.uint8) for k, m in maps.items()}

    def places(self, text: str, k: int) -> np.ndarray:
        at = _hashes(_codes(text), k) & np.uint32((1 << self.bits) - 1)
        if self.bits <= 24:
            return np.flatnonzero(self.maps[k][at])
        return np.flatnonzero(self.maps[k][at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8) & 1)


def seed_maps(seeded: DataFrame, n: int) -> dict[int, bytes]:
    """A bitmap of seeds' hashes for each length: some 64 bits a seed, from 128 KB to 16 MB, for at most SEED lengths.

    n is the number of seeds. Tasks make stretches of the bitmaps, and only these come to the driver.
    """
    bits, stretch = min(27, max(20, n.bit_length() + 6)), 13

    def each(batches):
        found: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = int(_hashes(_codes(s), k)[0]) & (1 << bits) - 1
                part = found.setdefault((k, at >> stretch + 3), np.zeros(1 << stretch, np.uint8))
                part[at >> 3 & (1 << stretch) - 1] |= 1 << (at & 7)
        if found:
            yield pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in found], pa.int32()), "part": pa.array([p for _, p in found], pa.int32()), "bits": [m.tobytes() for m in found.values()]})

    rows = seeded.select(F.col("k").cast("int"), "seed").coalesce(64).mapInArrow(each, "k int, part int, bits binary")
    maps: dict[int, np.ndarray] = {}
    for r in rows.toLocalIterator(prefetchPartitions=True):
        whole = maps.setdefault(r["k"], np.zeros(1 << bits - 3, np.uint8))
        whole[r["part"] << stretch : (r["part"] + 1) << stretch] |= np.frombuffer(r["bits"], np.uint8)
    return {k: m.tobytes() for k, m in maps.items()}


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kmers(sequences: DataFrame, maps: dict[int, bytes], windows: dict[int, int], header: str = "header", seq: str = "seq") -> DataFrame:
    """header, pos, kmer and window at each place whose k letters may be a seed by the maps of the lengths k.

    window has the letters from the place on, as many as the longest pattern with a seed of that length.
    """
    spark = sequences.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(maps)
    kind = sequences.schema[header].dataType
    step = 1 << 18

    def run(batches):
        wanted = SeedFilter(shared.value)
        for b in batches:
            for h, s in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                for k, window in windows.items():
                    for at in range(0, len(s or "") - k + 1, step):
                        part = s[at : at + step + k - 1]
                        found = wanted.places(part, k).tolist()
                        for i in range(0, len(found), 4096):
                            some = found[i : i + 4096]
                            yield pa.RecordBatch.from_pydict({"header": pa.array([h] * len(some), b.schema.field(0).type), "pos": pa.array([at + i for i in some], pa.int64()), "kmer": [part[i : i + k] for i in some], "window": [s[at + i : at + i + window] for i in some]})

    return sequences.select(F.col(header), F.col(seq)).mapInArrow(run, f"header {kind.simpleString()}, pos bigint, kmer string, window string")


def seed_join(sequences: DataFrame, patterns: DataFrame, header: str = "header", seq: str = "seq", column: str = "pattern") -> DataFrame:
    """patterns' columns with header and pos of each occurrence: an equi-join on seeds, then a check of the rest.

    Bitmaps of the seeds' hashes go to all tasks, some megabytes whatever their number, so that only places that may
    be a seed's are joined. The join deals with what the bitmaps let through.
    """
    ship(sequences.sparkSession)
    seeded = seeds(patterns, column)
    facts = seeded.groupBy("k").agg(F.max(F.length(column)).alias("longest"), F.count(F.lit(1)).alias("n")).collect()
    maps = seed_maps(seeded, sum(r["n"] for r in facts))
    joined = kmers(sequences, maps, {r["k"]: r["longest"] for r in facts}, header, seq).join(seeded, F.col("kmer") == F.col("seed"))
    return joined.filter(F.startswith(F.col("window"), F.col(column))).drop("kmer", "window", "k", "seed")


def strands(queries: DataFrame, seq: str = "seq") -> DataFrame:
    """Each query twice: as it is (``+``) and as its reverse complement (``-``), both as DNA; empty ones are left out."""
    dna = queries.filter(F.length(seq) > 0).withColumn("_dna", rna_to_dna(F.col(seq)))
    both = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("_dna").alias("pattern")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("_dna")).alias("pattern"))))
    return dna.withColumn("_s", both).select(*queries.columns, "_s.strand", "_s.pattern").drop(seq)


def gff_search(sequences: DataFrame, queries: DataFrame, source: str = "strandlake", header: str = "header", seq: str = "seq") -> DataFrame:
    """GFF rows of every hit of queries (header, seq) on both strands; a palindrome is reported on both."""
    sought = strands(queries.select(F.col("header").alias("_query"), F.col("seq").alias("_seq")), "_seq")
    hits = seed_join(sequences, sought, header, seq)
    return hits.select(F.col("header").cast("string").alias("seqid"), F.lit(source).alias("source"), F.lit("dna").alias("type"), (F.col("pos") + 1).alias("start"), (F.col("pos") + F.length("pattern")).alias("end"), F.lit("1.000").alias("score"), "strand", F.lit(".").alias("phase"), gff_attributes(F.col("_query").cast("string")).alias("attributes"))


def gff_lines(rows: DataFrame) -> DataFrame:
    """GFF rows as tab-separated lines."""
    return rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")]).alias("line"))
