"""Spark data sources for sequence and alignment files."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Make the formats fasta, fastq, bam and bai known to a session."""
    from ..session import ship
    from .bam import BaiSource, BamSource
    from .fasta import FastaSource, FastqSource

    ship(spark)
    # Filters reach Python data sources only with this setting.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FastaSource, FastqSource, BamSource, BaiSource):
        spark.dataSource.register(source)


def sniff(uri: str) -> str:
    """What a path holds, by its first bytes: bam, bai, gzip, fasta, fastq, store (a folder of blocks) or unknown."""
    import zlib

    from pyarrow import fs as pafs

    from .files import open_fs

    files, path = open_fs(uri)
    info = files.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == pafs.FileType.Directory:
        names = [i.base_name for i in files.get_file_info(pafs.FileSelector(path))]
        return "store" if any(n.startswith("block_id=") for n in names) else "unknown"
    with files.open_input_file(path) as source:
        head = source.read(1 << 16)
    if head[:4] == b"BAI\x01":
        return "bai"
    if head[:3] == b"\x1f\x8b\x08":
        content = zlib.decompressobj(31).decompress(head, 16)
        return "bam" if content[:4] == b"BAM\x01" else "gzip"
    return {b">": "fasta", b"@": "fastq"}.get(head.lstrip(b"\r\n")[:1], "unknown")
