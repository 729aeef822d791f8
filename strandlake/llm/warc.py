"""WARC archives: a writer of one gzip member per record, and a splittable reader.

The reader deals byte ranges to tasks. A task scans its range for the gzip magic; a candidate is a member only if
its header decodes and what it inflates to begins as a WARC record with its header lines. A task owns the records
whose members start inside its range, and reads past the range's end to finish the last.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, open_fs, shared_dir, splittable, stored, tune

MAGIC = b"\x1f\x8b\x08"
#: Bytes of one task's range, and of one read.
SPLIT, READ = 16 << 20, 1 << 20
#: Payloads from this size on are stored once.
LEAST_SHARED = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
RECORDS = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
DDL = "path string, offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """An HTTP response record, or a revisit record that has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_uri(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        # Header lines can't hold line ends; other control characters and the sign itself are escaped with them.
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"WARC-Payload-Digest: sha256:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The columns of RECORDS (without path and offset) of one record's bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "surrogatepass")
    block = rest[: int(fields.get("content-length", len(rest)))]
    payload, size = block, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = int(told[1]) if told else None
    kind = fields.get("warc-type")
    name, _, value = fields.get("warc-payload-digest", "").partition(":")
    digest = base64.b32decode(value).hex() if name == "sha256" else None
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if digest not in (None, found):
            raise ValueError(f"record {fields.get('warc-record-id')}: its payload doesn't have its digest")
        digest, size = found, len(payload)
    url = fields.get("warc-target-uri")
    if url is not None:
        url = re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)
    return {"record_type": kind, "page_id": page_of(fields.get("warc-record-id")), "url": url, "payload_bytes": size, "payload_digest": digest, "refers_to": page_of(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None}


class Member:
    """Inflates the member at an offset of a random-access source."""

    def __init__(self, source, at: int, size: int):
        self.source, self.at, self.size, self.end = source, at, size, None

    def parts(self, read: int = READ):
        """What the member inflates to, piece by piece; ``end`` is set once its trailer has been checked."""
        unzip, at = zlib.decompressobj(31), self.at
        while not unzip.eof:
            self.source.seek(at)
            raw = self.source.read(min(read, self.size - at))
            if not raw:
                raise zlib.error("cut short")
            at += len(raw)
            out = unzip.decompress(raw, 16 * READ)
            while out or unzip.unconsumed_tail:
                yield out
                out = unzip.decompress(unzip.unconsumed_tail, 16 * READ) if unzip.unconsumed_tail else b""
        self.end = at - len(unzip.unused_data)


def begins_record(source, at: int, size: int) -> bool:
    """Whether a gzip header at an offset decodes and its member begins as a WARC record."""
    head = b""
    try:
        for part in Member(source, at, size).parts(4096):
            head += part
            if len(head) >= 16 or not b"WARC/".startswith(head[:5]):
                break
    except zlib.error:
        return False
    return bool(re.match(rb"WARC/\d+\.\d+\r\n[A-Za-z]", head[:16]))


def owned(source, size: int, begin: int, end: int):
    """(offset, record bytes) of the records whose members start in [begin, end)."""
    at = begin
    while at < end:
        source.seek(at)
        window = source.read(min(READ + len(MAGIC) - 1, size - at))
        found = window.find(MAGIC)
        if found < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        # Members follow each other without gaps, so from the first on no scan is needed until one fails.
        while at < end and begins_record(source, at, size):
            member = Member(source, at, size)
            raw = b"".join(member.parts())
            yield at, raw
            at = member.end
        else:
            at += at < end


def write_warc(pages: DataFrame, path: str) -> DataFrame:
    """Write a WARC record for each row of pages (page_id, url, html) under a folder; returns the manifest of files.

    The payload is the html in UTF-8, empty for null. Of records with equal payloads of at least LEAST_SHARED
    bytes the one with the smallest page_id is a response and the others revisit it; rows that repeat that page_id
    are responses too. Rows without a page_id revisit if another row has one, else they are responses. A null url
    leaves its line out. Only files in the manifest count. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    tune(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"), F.sha2(html, 256).alias("digest"))
    # Who revisits whom is found by ids and digests alone, and only revisits are joined to the payloads, by id as well as
    # digest: so copies of one payload, however many, don't meet in one task.
    slim = stored(rows.filter(F.length("payload") >= LEAST_SHARED).select("page_id", "digest"), "warc-digests")
    many = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select(F.col("digest").alias("_shared"), "first")
    revisits = slim.join(splittable(many), F.col("digest") == F.col("_shared")).filter("page_id is null or page_id <> first").select("_shared", F.col("page_id").alias("_id"), F.col("first").alias("refers_to")).distinct()
    marked = rows.join(revisits, (F.col("digest") == F.col("_shared")) & F.col("page_id").eqNullSafe(F.col("_id")), "left")
    marked = marked.select("page_id", "url", "payload", "digest", "refers_to")

    def write(batches):
        files, where = open_fs(path)
        files.create_dir(where, recursive=True)
        name, sink, n, size = f"part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}.warc.gz", None, 0, 0
        for b in batches:
            sink = sink or files.open_output_stream(f"{where}/{name}", compression=None)
            for row in zip(*b.columns, strict=True):
                zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = zipper.compress(warc_record(*(x.as_py() for x in row))) + zipper.flush()
                sink.write(member)
                n, size = n + 1, size + len(member)
        if sink:
            sink.close()
            yield arrow_rows(FILES, path=[f"{path}/{name}"], n_records=[n], n_bytes=[size])

    return stored(marked.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_warc(files: DataFrame, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """The records of WARC files (path, n_bytes), in RECORDS' columns; without ``payloads`` that column is null.

    Files are cut to ranges of ``split`` bytes, so one large file is read by many tasks. payload_digest is checked
    against a response's payload; a revisit has the digest and size that it states.
    """
    tune(files.sparkSession)

    def read(batches):
        for b in batches:
            for path, size, begin in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                where_fs, where = open_fs(path)
                with where_fs.open_input_file(where) as source:
                    out, held = [], 0
                    for at, raw in owned(source, size, begin, min(size, begin + split)):
                        got = parse_record(raw) | {"path": path, "offset": at}
                        if not payloads:
                            got["payload"] = None
                        held += len(got["payload"] or b"") + 1024
                        out.append(got)
                        if held > 4 << 20:
                            yield arrow_rows(RECORDS, **{c: [r[c] for r in out] for c in RECORDS.names})
                            out, held = [], 0
                    if out:
                        yield arrow_rows(RECORDS, **{c: [r[c] for r in out] for c in RECORDS.names})

    ranges = files.filter("n_bytes > 0").select("path", F.col("n_bytes").cast("long"), F.explode(F.expr(f"sequence(0L, n_bytes - 1, {split}L)")).alias("begin"))
    n = max(1, files.select(F.sum(F.ceil(F.col("n_bytes") / split))).first()[0] or 1)
    return ranges.repartition(min(n, 100_000), F.xxhash64("path", "begin")).mapInArrow(read, DDL)


def list_warc(spark: SparkSession, path: str) -> DataFrame:
    """path and n_bytes of the .warc.gz files under a folder or glob, to give to read_warc."""
    seen = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    return seen.select("path", F.col("length").alias("n_bytes"))


def warc_round_trip(spark: SparkSession, pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as WARC and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    files = write_warc(pages, path or shared_dir(spark, "warc"))
    return read_warc(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


