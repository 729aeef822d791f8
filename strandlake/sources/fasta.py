"""FASTA and FASTQ as a Spark data source: ``spark.read.format("fasta").load(path)``.

A record begins at a line that begins with ``>`` or ``@``; lines end with LF or CR LF, and blank ones don't count. In
FASTQ a line that begins with ``+`` opens the qualities, which go on until there are as many as bases or as many
lines as sequence lines; so a quality line that begins with ``@`` is no record. Text is read as Latin-1.

Files are read in parts of ``split`` bytes: plain FASTA, blocked gzip (BGZF), and FASTQ with the option ``four_lines``
(true: each record has four lines, by which a part can tell its first). Other gzip files, and FASTQ without that
option, are a partition each. ``file_offset`` is the record's place in the text, and in BGZF its virtual offset.

More options: ``markers`` (the letters that begin a record, ``>@``; with ``>`` alone there are no qualities), ``lazy``
(true: seq and quality are null), ``offset`` (of the record to resume at), and for writing ``width`` (letters of a
line; 0: one line for a sequence; by default 50, and one line for rows whose column ``multiline`` is false) and ``gzip``
(true: BGZF files).
"""

from __future__ import annotations

import io
import uuid
import zlib
from dataclasses import dataclass
from itertools import islice

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schemas import SEQUENCES
from .bgzf import BlockWriter, MemberReader, block_at, is_gzip, parse_member_header
from .files import in_batches, list_files, open_input, open_output, remove_others

SPLIT = 64 << 20


def lines_of(parts):
    """(offset, line without its end) from (offset, bytes) parts; a line's offset is its part's and its place there."""
    held, start = [], None
    for at, part in parts:
        rows = part.split(b"\n")
        for k, row in enumerate(rows):
            if start is None and (row or k + 1 < len(rows)):
                start = at
            held.append(row)
            at += len(row) + 1
            if k + 1 < len(rows):
                yield start, b"".join(held).rstrip(b"\r")
                held, start = [], None
    if held and (line := b"".join(held)):
        yield start, line.rstrip(b"\r")


def lines_from(read, begin: int):
    """(offset, line without its end) of a byte stream; read(n) gives its next bytes."""

    def parts():
        at = begin
        while part := read(1 << 20):
            yield at, part
            at += len(part)

    return lines_of(parts())


def records(lines, keep: bool = True, markers: bytes = b">@"):
    """(header, sequence, length, multiline, quality, offset) of records; what stands before the first is passed over."""
    header = offset = None
    bases, n, rows = [], 0, 0
    quality, n_quality, q_rows, in_quality = [], 0, 0, False

    def record():
        q = b"".join(quality).decode("latin-1") if in_quality and keep else None
        return header.decode("latin-1"), b"".join(bases).decode("latin-1") if keep else None, n, rows > 1, q, offset

    for at, line in lines:
        if in_quality and n_quality < n and q_rows < rows:
            quality.append(line)
            n_quality, q_rows = n_quality + len(line), q_rows + 1
        elif line and line[0] in markers:
            if header is not None:
                yield record()
            header, offset, bases, n, rows = line[1:], at, [], 0, 0
            quality, n_quality, q_rows, in_quality = [], 0, 0, False
        elif header is None or not line or in_quality:
            continue
        elif line[:1] == b"+" and b"@" in markers:
            in_quality = True
        else:
            if keep:
                bases.append(line)
            n, rows = n + len(line), rows + 1
    if header is not None:
        yield record()


def parse(data: bytes):
    """The records of FASTA or FASTQ text in memory."""
    return records(lines_from(io.BytesIO(data).read, 0))


@dataclass
class Range(InputPartition):
    """Bytes of a file; end is None for a whole one. kind: plain, blocked or gzip."""

    path: str
    size: int
    begin: int
    end: int | None
    kind: str


def inflated(source):
    """read(n) over the content of gzip members one after another."""
    unzip = zlib.decompressobj(31)
    held = b""

    def read(n: int) -> bytes:
        nonlocal unzip, held
        while True:
            raw = held or source.read(n)
            if not raw:
                if not unzip.eof:
                    raise EOFError("a gzip member is cut short")
                return b""
            out = unzip.decompress(raw)
            held = unzip.unused_data
            if unzip.eof and (held or (held := source.read(n))):
                unzip = zlib.decompressobj(31)
            if out:
                return out

    return read


def _before(found, end: int):
    """Records that begin before ``end``."""
    for r in found:
        if r[5] >= end:
            return
        yield r


def _from_record(lines):
    """Lines from the first FASTQ record of four lines on.

    A quality line may begin as a record does, but then a record's own first line comes next, and no sequence begins so.
    """
    held = list(islice(lines, 4))
    while len(held) == 4:
        (_, a), (_, b), (_, c), (_, d) = held
        if a[:1] == b"@" and b[:1] not in (b"@", b"+", b">") and c[:1] == b"+" and len(b) == len(d):
            yield from held
            yield from lines
            return
        held = [*held[1:], *islice(lines, 1)]


class FastaReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.schema = options.get("path"), schema
        self.keep = str(options.get("lazy", "false")).lower() != "true"
        self.markers = options.get("markers", ">@").encode()
        self.four_lines = str(options.get("four_lines", "false")).lower() == "true" and b"@" in self.markers
        self.offset, self.split = int(options.get("offset", 0)), int(options.get("split", SPLIT))

    def partitions(self):
        out = []
        for path, size in list_files(self.path):
            with open_input(path) as source:
                head = source.read(1 << 16)
            kind = "plain" if not is_gzip(head) else "blocked" if parse_member_header(head)["block_size"] else "gzip"
            text = head if kind == "plain" else zlib.decompressobj(31).decompress(head, 1 << 16)
            quality = text.lstrip(b"\r\n")[:1] == b"@" and b"@" in self.markers
            if kind == "gzip" or (quality and not self.four_lines):
                out.append(Range(path, size, 0, None, kind))
            else:
                out += [Range(path, size, at, min(size, at + self.split), kind) for at in range(0, size, self.split)]
        first = lambda p: self.offset >> 16 if p.kind == "blocked" else self.offset
        return [p for p in out if p.end is None or p.end > first(p)]

    def read(self, partition):
        return in_batches(self._read(partition), self.schema)

    def _read(self, partition):
        p = partition
        with open_input(p.path) as source:
            if p.kind == "gzip":
                yield from self._rows(records(lines_from(inflated(source), 0), self.keep, self.markers), p.path, self.offset)
                return
            if p.kind == "blocked":
                lines, begin = self._blocked(source, p)
                end = None if p.end is None else p.end << 16
            else:
                begin, end = max(p.begin, self.offset), p.end
                # The byte before tells whether the range begins at a line's start.
                source.seek(max(0, begin - 1))
                lines = lines_from(source.read, max(0, begin - 1))
                if begin:
                    next(lines, None)
            if self.four_lines:
                found = records(_from_record(lines) if begin else lines, self.keep, self.markers)
                found = (r for r in found) if end is None else _before(found, end)
            else:
                found = records(self._until(lines, end), self.keep, self.markers)
            yield from self._rows(found, p.path, begin)

    def _blocked(self, source, p):
        """Lines by virtual offset, and the first that this part may have."""
        if self.offset >> 16 >= p.begin and self.offset:
            # An offset is a record's own start, and so a line's.
            return lines_of(MemberReader(source, p.size, self.offset).parts()), self.offset
        if not p.begin:
            return lines_of(MemberReader(source, p.size).parts()), 0
        # From the block before on: a line is this part's if it starts in one of its blocks.
        at = back = block_at(source, p.size, max(0, p.begin - (1 << 16)))
        while at < p.begin:
            source.seek(at)
            back, at = at, at + parse_member_header(source.read(min(1 << 12, p.size - at)))["block_size"]
        lines = lines_of(MemberReader(source, p.size, back << 16).parts())
        return ((o, line) for o, line in lines if o >> 16 >= p.begin), p.begin << 16

    def _until(self, rows, end):
        """Lines up to the first record that begins at or after ``end``."""
        for at, line in rows:
            if end is not None and at >= end and line and line[0] in self.markers:
                return
            yield at, line

    @staticmethod
    def _rows(found, path, least):
        for header, seq, n, multiline, quality, offset in found:
            if offset >= least:
                yield zlib.crc32(f"{path}:{offset}".encode()) << 31 | offset & (1 << 31) - 1, header, seq, n, multiline, quality, offset, path


def wrapped(seq: str, width: int, stops: str = ">@+"):
    """Lines of ``width`` letters, or more where a line would begin with one of ``stops``, as records and qualities do."""
    if seq and seq[0] in stops:
        raise ValueError(f"a sequence can't begin with {seq[0]!r} in this format")
    at = 0
    while at < len(seq):
        end = at + width
        while end < len(seq) and seq[end] in stops:
            end += 1
        yield seq[at:end]
        at = end


@dataclass
class Written(WriterCommitMessage):
    path: str


class FastaWriter(DataSourceWriter):
    def __init__(self, options, schema, overwrite):
        self.path, self.width, self.fixed = options.get("path"), int(options.get("width", 50)), options.get("width") is not None
        self.gzip = str(options.get("gzip", "false")).lower() == "true"
        self.stops = options.get("markers", ">@")
        self.stops += "+" * ("@" in self.stops)
        # One write's files are told from another's, also in one folder.
        self.job = uuid.uuid4().hex[:12]
        names = schema.fieldNames()
        self.header, self.seq = names.index("header"), names.index("seq")
        self.quality = names.index("quality") if "quality" in names else None
        self.multiline = names.index("multiline") if "multiline" in names else None

    def write(self, iterator):
        context = TaskContext.get()
        path = f"{self.path.rstrip('/')}/part-{context.partitionId():06d}-{self.job}-{context.taskAttemptId()}.{'fa.gz' if self.gzip else 'fa'}"
        with open_output(path) as sink:
            out = BlockWriter(sink) if self.gzip else sink
            for row in iterator:
                seq, quality = row[self.seq] or "", row[self.quality] if self.quality is not None else None
                if quality is not None:
                    text = f"@{row[self.header]}\n{seq}\n+\n{quality}\n"
                else:
                    single = not self.width or (not self.fixed and self.multiline is not None and row[self.multiline] is False)
                    text = f">{row[self.header]}\n" + "".join(x + "\n" for x in wrapped(seq, max(1, len(seq)) if single else self.width, self.stops))
                out.write(text.encode("latin-1", "replace"))
            if self.gzip:
                out.close()
        return Written(path)

    def commit(self, messages):
        remove_others(self.path, self.job, messages)

    def abort(self, messages):
        from .files import open_fs

        for m in messages:
            if m:
                files, where = open_fs(m.path)
                files.delete_file(where)


class FastaSource(DataSource):
    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return SEQUENCES

    def reader(self, schema):
        return FastaReader(self.options, schema)

    def writer(self, schema, overwrite):
        return FastaWriter(self.options, schema, overwrite)


class FastqSource(FastaSource):
    @classmethod
    def name(cls):
        return "fastq"
