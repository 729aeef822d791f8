"""Command line: ``spark-submit strandlake/cli.py -i INPUT [-o ... | -s ... | -c ...]``.

-i FASTA -o STORE             index a FASTA file: deduplicate, pack to blocks, write the store
-i STORE -o FASTA             restore all sequences
-i STORE -o FILE HEADER [FROM [TO]]   extract a part of one sequence
-i STORE -s [HEADER] PATTERN  positions of a pattern; -s FILE searches a query file on both strands and prints GFF
-i STORE -c [HEADER] PATTERN  numbers of occurrences
-idx PATH                     with -o STORE: also write full-text indexes of the sequences there;
                              with -i STORE -s or -c PATTERN: answer from these instead of the sequences
-t N                          cores; -v LEVEL log level; -h help

Of -o, -s and -c the first of that order counts.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import blocks, fmindex, search
from strandlake.sources import register, sniff


def build_store(spark: SparkSession, fasta: str, store: str) -> None:
    """Index a FASTA or FASTQ file as a store: sequences with their places, as Parquet by block."""
    sequences = spark.read.format("fasta").load(fasta)
    unique = blocks.dedup_sequences(sequences.select("header", "seq", "seq_len", "multiline", "file_offset"))
    places = blocks.pack_blocks(sequences.select("header", "seq_len"))
    placed = unique.join(places, ["header", "seq_len"])
    blocks.write_blocks(placed.select("block_id", "ord", "header", "seq", "seq_len", "multiline", "file_offset"), store)


def read_store(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("block_id bigint, ord bigint, header string, seq string, seq_len bigint, multiline boolean, file_offset bigint").parquet(store)


def write_restored(rows: DataFrame, path: str, width: int = 50) -> None:
    """Sequences in the store's order as FASTA text files."""
    search.restore(rows, width).orderBy("block_id", "ord").select("record").write.text(path)


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="strandlake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-i", "--input", dest="input")
    p.add_argument("-o", "--output", nargs="+", dest="output")
    p.add_argument("-s", "--search", nargs="+", dest="search")
    p.add_argument("-c", "--count", nargs="+", dest="count")
    p.add_argument("-idx", "--index", dest="index")
    p.add_argument("-t", "--threads", type=int, default=1, dest="threads")
    p.add_argument("-v", "--verbose", default="WARN", dest="verbose")
    if not argv:
        p.print_help()
        raise SystemExit(0)
    given = p.parse_args(argv)
    if not given.input:
        p.error("an input file is needed")
    for name, most in (("output", 4), ("search", 2), ("count", 2)):
        if len(getattr(given, name) or []) > most:
            p.error(f"--{name} takes at most {most} values")
    return given


def run(spark: SparkSession, given: argparse.Namespace, out=sys.stdout) -> None:
    """Carry out what the arguments ask for; results that aren't files are printed."""
    register(spark)
    is_store = sniff(os.path.abspath(given.input) if "://" not in given.input else given.input) == "store"
    if given.output:
        path, *rest = given.output
        if not is_store:
            build_store(spark, given.input, path)
            if given.index:
                rows = read_store(spark, path)
                keyed = rows.withColumn("_key", F.struct("block_id", "ord", "header"))
                fmindex.build_indexes(keyed, "_key").select("_key.*", "n_bytes", "fm").write.parquet(given.index)
        elif rest:
            begin, end = int(rest[1]) if len(rest) > 1 else 0, int(rest[2]) if len(rest) > 2 else None
            search.extract(read_store(spark, given.input), rest[0], begin, end).select("bases").write.text(path)
        else:
            write_restored(read_store(spark, given.input), path)
        return
    sequences = read_store(spark, given.input) if is_store else spark.read.format("fasta").load(given.input).withColumns({"block_id": F.lit(0), "ord": F.col("file_offset")})
    wanted = given.search or given.count
    if not wanted:
        return
    if given.search and len(wanted) == 1 and os.path.isfile(wanted[0]):
        queries = spark.read.format("fasta").load(wanted[0]).select("header", "seq")
        for row in search.gff_lines(search.gff_search(sequences, queries)).toLocalIterator():
            print(row["line"], file=out)
        return
    pattern, place = wanted[-1], ("block_id", "ord")
    if given.index and is_store:
        held = spark.read.parquet(given.index)
        if len(wanted) == 2:
            held = search.named(held, wanted[0])
        counts = held.select("header", *place, fmindex.fm_count(F.col("fm"), pattern).alias("n_matches")).filter("n_matches > 0")
        hits = held.select("header", *place, fmindex.fm_locate(F.col("fm"), pattern).alias("places")).filter(F.size("places") > 0)
    else:
        if len(wanted) == 2:
            sequences = search.named(sequences, wanted[0])
        counts = search.count_pattern(sequences, pattern, keep=place)
        found = sequences.filter(F.col("seq").contains(pattern))
        hits = found.select("header", *place, search.positions_in(pattern)(F.col("seq")).alias("places"))
    if given.count:
        for row in search.report_lines(counts.orderBy(*place)).toLocalIterator():
            print(row["line"], file=out)
        return
    for row in hits.orderBy(*place).toLocalIterator():
        print(f">{row['header']} found : {len(row['places'])}", *row["places"], sep="\n", file=out)


def main(argv: list[str] | None = None) -> None:
    given = arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("strandlake").master(os.environ.get("MASTER", f"local[{max(1, min(given.threads, os.cpu_count() or 1))}]")).getOrCreate()
    spark.sparkContext.setLogLevel(given.verbose.upper() if given.verbose.upper() in ("ALL", "DEBUG", "ERROR", "FATAL", "INFO", "OFF", "TRACE", "WARN") else "WARN")
    run(spark, given)


if __name__ == "__main__":
    main()
