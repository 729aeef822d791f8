"""Searching sequence files as they land in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import count_in


def landing_sequences(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of (source_file, header, seq, seq_len, multiline) from FASTA files that land in a folder.

    Files are taken whole, as records cross line ends; ``files_a_batch`` bounds a batch. Text before the first
    record and blank lines are passed over.
    """
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_a_batch).load(folder)
    body = F.regexp_replace(F.concat(F.lit("\n"), F.replace(F.col("value"), F.lit("\r"), F.lit(""))), r"^[^>]*?\n>", ">")
    record = F.explode(F.split(F.regexp_replace(body, "^>", ""), "\n>"))
    rows = files.filter(F.col("value").contains(">")).select(F.col("_metadata.file_path").alias("source_file"), record.alias("r"))
    lines = F.filter(F.split(F.col("r"), "\n"), lambda x: x != "")
    header = F.substring_index(F.col("r"), "\n", 1)
    seq_lines = F.filter(F.slice(F.split(F.col("r"), "\n"), 2, 1 << 30), lambda x: x != "")
    return rows.select("source_file", header.alias("header"), F.array_join(seq_lines, "").alias("seq"), (F.size(seq_lines) > 1).alias("multiline"), F.size(lines).alias("_n")).drop("_n").withColumn("seq_len", F.length("seq").cast("bigint"))


def landing_counts(spark: SparkSession, folder: str, pattern: str, **options) -> DataFrame:
    """A stream of header and n_matches for the landing sequences that have the pattern; it keeps no state."""
    found = landing_sequences(spark, folder, **options).filter(F.col("seq").contains(pattern))
    return found.select("source_file", "header", count_in(F.col("seq"), pattern).alias("n_matches"))


def windowed_counts(events: DataFrame, size: str = "10 minutes", late: str = "30 minutes", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Events by window and key, batch or stream; on a stream, rows later than ``late`` are dropped and windows are final then."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.window(time, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")
