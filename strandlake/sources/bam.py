"""Alignment files (BAM) and their index (BAI) as Spark data sources, and their writers.

``spark.read.format("bam").load(path)`` gives ALIGNMENTS. With an index beside a file (``x.bam.bai`` or ``x.bai``, or the
option ``index``) the file is read in parts that begin at the index's offsets, and filters on ref_id, pos and end_pos
leave out parts that can't hold a match. Without one it is read in parts of ``split`` bytes: a part finds its first record
by the chain of records that follows, and the part before checks that it ends just there; if it doesn't, that is an
error that asks for an index (``split`` 0: a file is a partition). With the option ``lazy`` (true) bases,
qualities and tags are null and not decoded. With a schema, its columns alone are read, and a column of two letters (``NM bigint``)
is that tag's value. Records are decoded and encoded in batches (``bam_batches``). The option ``part`` gives the ``header``
(line_no, line) or the ``refs`` instead. ``spark.read.format("bai")`` gives the index's chunks, or with ``part`` =
``linear`` its linear offsets. An index is made from the parts ``index``: what each run of records gives to it, without the records.
"""

from __future__ import annotations

import re
import struct
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions.bins import LEVELS, UNMAPPED_BIN, UNPLACED_BIN
from ..functions.cigar import OPS
from ..functions.dna import BASE_CODES
from ..schemas import ALIGNMENTS, BAI_BINS, BAI_LINEAR, INDEX_PARTS, REFS
from . import bam_batches
from .bgzf import END_BLOCK, BlockWriter, MemberReader, block_at
from .files import in_batches, list_files, open_fs, open_input, open_output, remove_others

FIXED = struct.Struct("<iiBBHHHiiii")
NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
PART_BYTES = 32 << 20
ALIGNMENT_NAMES = re.findall(r"(\w+) \w", ALIGNMENTS)
#: Starting a task takes longer than a small part: one reads neighbouring parts up to this share of the file, and to PART_BYTES.
TASKS = 512
#: Parts that go by the records, not by the header.
RECORDS = ("records", "index")
#: Records in a row that must fit together for a part's first to be believed, and bytes of a record at most.
CHAIN, LONGEST = 12, 256 << 20


def read_header(stream: MemberReader) -> tuple[str, list[tuple[str, int]]]:
    """The header's text and the references' names and lengths."""
    if stream.exactly(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = stream.exactly(struct.unpack("<I", stream.exactly(4))[0]).split(b"\0")[0].decode("utf-8", "replace")
    refs = []
    for _ in range(struct.unpack("<I", stream.exactly(4))[0]):
        name = stream.exactly(struct.unpack("<I", stream.exactly(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<I", stream.exactly(4))[0]))
    return text, refs


def decode_tags(raw: bytes) -> dict:
    """Tags by key: dicts of type, i, f, s, ia, fa. Integers are taken as signed or unsigned as their type says."""
    out, at = {}, 0
    while at + 3 <= len(raw):
        key, kind = raw[at : at + 2].decode("latin-1"), chr(raw[at + 2])
        at += 3
        tag = dict.fromkeys(("i", "f", "s", "ia", "fa")) | {"type": kind}
        if kind in NUMBERS:
            value = struct.unpack_from(NUMBERS[kind], raw, at)[0]
            at += struct.calcsize(NUMBERS[kind])
            tag["f" if kind == "f" else "i"] = value
        elif kind == "A":
            tag["s"], at = chr(raw[at]), at + 1
        elif kind in "ZH":
            end = raw.index(b"\0", at)
            tag["s"], at = raw[at:end].decode("latin-1"), end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            at += 5
            values = list(struct.unpack_from(f"<{n}{NUMBERS[sub][1]}", raw, at))
            at += n * struct.calcsize(NUMBERS[sub])
            tag["type"] = "B" + sub
            tag["fa" if sub == "f" else "ia"] = values
        else:
            raise ValueError(f"a tag has the unknown type {kind!r}")
        out[key] = tag
    return out


def encode_tags(tags: dict) -> bytes:
    """The bytes of tags, in the map's order."""
    out = b""
    for key, tag in (tags or {}).items():
        get = tag.get if isinstance(tag, dict) else lambda k, t=tag: getattr(t, k)
        kind = get("type")
        out += key.encode("latin-1") + kind[:1].encode()
        if kind in NUMBERS:
            out += struct.pack(NUMBERS[kind], get("f") if kind == "f" else get("i"))
        elif kind == "A":
            out += get("s")[:1].encode("latin-1")
        elif kind in "ZH":
            out += get("s").encode("latin-1") + b"\0"
        elif kind[:1] == "B":
            sub = kind[1:] or "i"
            values = get("fa") if sub == "f" else get("ia")
            out += sub.encode() + struct.pack("<i", len(values)) + struct.pack(f"<{len(values)}{NUMBERS[sub][1]}", *values)
        else:
            raise ValueError(f"a tag has the unknown type {kind!r}")
    return out


def reference_span(ops: list[tuple[int, str]]) -> int:
    return sum(n for n, op in ops if op in "MDNP=X")


def bin_of(begin: int, end: int) -> int:
    """The smallest bin that holds begin (0-based) to end (exclusive)."""
    for shift, base in LEVELS:
        if begin >> shift == (end - 1) >> shift:
            return base + (begin >> shift)
    return 0


def encode_record(r) -> bytes:
    """A record's bytes with its size, from a row of ALIGNMENTS; the bin is computed."""
    ops = [(int(n), OPS.index(op)) for n, op in re.findall(f"([0-9]+)([{OPS}])", r["cigar"] or "")] if r["cigar"] != "*" else []
    seq, name = r["seq"] or "", (r["qname"] or "*").encode("latin-1") + b"\0"
    codes = [BASE_CODES.find(c) if c in BASE_CODES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    qual = bytes(ord(c) - 33 for c in r["qual"]) if r["qual"] else b"\xff" * len(seq)
    pos, flag = (r["pos"] or 0) - 1, r["flag"] or 0
    ref_id = -1 if r["ref_id"] is None else r["ref_id"]
    span = reference_span([(n, OPS[o]) for n, o in ops])
    bin_ = (UNPLACED_BIN if ref_id == -1 else UNMAPPED_BIN) if flag & 4 else bin_of(pos, pos + max(1, span))
    body = FIXED.pack(ref_id, pos, len(name), (r["mapq"] or 0) & 255, bin_, len(ops), flag, len(seq), -1 if r["next_ref_id"] is None else r["next_ref_id"], (r["next_pos"] or 0) - 1, r["tlen"] or 0)
    body += name + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + qual + encode_tags(r["tags"])
    return struct.pack("<i", len(body)) + body


def _fits(data: bytes, at: int, n_ref: int) -> int | None:
    """The size of a record at a place if its fixed fields go together, else None; 0 if the data ends within them."""
    if at + 4 + FIXED.size > len(data):
        return 0
    size = struct.unpack_from("<i", data, at)[0]
    ref_id, pos, l_name, _, _, n_cigar, _, l_seq, next_ref, next_pos, _ = FIXED.unpack_from(data, at + 4)
    least = FIXED.size + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if not (-1 <= ref_id < n_ref and -1 <= next_ref < n_ref and pos >= -1 and next_pos >= -1 and l_name >= 1 and l_seq >= 0 and least <= size <= LONGEST):
        return None
    name = data[at + 4 + FIXED.size : at + 4 + FIXED.size + l_name]
    if len(name) == l_name and (name[-1] or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    return size + 4


def first_record(source, size: int, begin: int, n_ref: int) -> int:
    """The virtual offset of the first record that starts in a block at or after ``begin``; the file's end if none does.

    A place counts if CHAIN records, or all up to the end of what was read, follow one another from there.
    """
    block = block_at(source, size, begin)
    while block < size:
        stream = MemberReader(source, size, block << 16)
        # The first block with content is searched; what follows it serves to check the chain, and is read as the chain gets there.
        parts = stream.parts()
        here, data = next(parts, (None, b""))
        if here is None:
            return size << 16
        first, whole = len(data), stream.next >= size
        padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
        sizes = padded[:first] | padded[1 : first + 1] << 8 | padded[2 : first + 2] << 16 | padded[3 : first + 3] << 24
        # A size that goes on in the next block is left to the test.
        sizes[-3:] = FIXED.size + 1
        for at in np.flatnonzero((sizes >= FIXED.size + 1) & (sizes <= LONGEST)).tolist():
            place, n = at, 0
            while n < CHAIN:
                while not whole and place + 4 + FIXED.size + 256 > len(data) and len(data) <= 1 << 19:
                    data += next(parts, (0, b""))[1]
                    whole = stream.next >= size
                if place >= len(data):
                    break
                step = _fits(data, place, n_ref)
                if step is None or (whole and (step == 0 or place + step > len(data))):
                    break
                if step == 0:
                    n = CHAIN
                else:
                    place, n = place + step, n + 1
            if n >= CHAIN or (n and place >= len(data)):
                return here + at
        block = block_at(source, size, (here >> 16) + 1)
    return size << 16


def read_index(data: bytes) -> dict:
    """bins {(ref, bin): [(beg, end)]}, linear {ref: [offsets]}, n_ref and unplaced of an index's bytes."""
    if data[:4] != b"BAI\x01":
        raise ValueError("not a BAI file")
    at, n_ref = 8, struct.unpack_from("<I", data, 4)[0]
    bins, linear = {}, {}
    for ref in range(n_ref):
        n_bin = struct.unpack_from("<I", data, at)[0]
        at += 4
        for _ in range(n_bin):
            number, n = struct.unpack_from("<II", data, at)
            flat = struct.unpack_from(f"<{2 * n}Q", data, at + 8)
            bins[ref, number] = list(zip(flat[::2], flat[1::2], strict=True))
            at += 8 + 16 * n
        n = struct.unpack_from("<I", data, at)[0]
        linear[ref] = list(struct.unpack_from(f"<{n}Q", data, at + 4))
        at += 4 + 8 * n
    unplaced = struct.unpack_from("<Q", data, at)[0] if at + 8 <= len(data) else None
    return {"bins": bins, "linear": linear, "n_ref": n_ref, "unplaced": unplaced}


def index_bytes(n_ref: int, bins: list[tuple[int, int, int, int]], linear: list[tuple[int, int, int]], unplaced: int) -> bytes:
    """An index's bytes from (ref_id, bin, chunk_beg, chunk_end) and (ref_id, win, voffset) rows, with the unplaced count.

    A window without an offset has that of the window before it.
    """
    chunks: dict = {}
    for ref, number, a, b in bins:
        chunks.setdefault(ref, {}).setdefault(number, []).append((a, b))
    windows: dict = {}
    for ref, win, at in linear:
        windows.setdefault(ref, {})[win] = at
    out = bytearray(b"BAI\x01" + struct.pack("<I", n_ref))
    for ref in range(n_ref):
        own = chunks.get(ref, {})
        out += struct.pack("<I", len(own))
        for number in sorted(own):
            pairs = own[number] if number == UNMAPPED_BIN else sorted(own[number])
            out += struct.pack("<II", number, len(pairs)) + b"".join(struct.pack("<QQ", *p) for p in pairs)
        wins, last, offsets = windows.get(ref, {}), 0, []
        for w in range(max(wins, default=-1) + 1):
            last = wins.get(w, last)
            offsets.append(last)
        out += struct.pack("<I", len(offsets)) + struct.pack(f"<{len(offsets)}Q", *offsets)
    return bytes(out + struct.pack("<Q", unplaced))


def write_index(path: str, n_ref: int, bins: DataFrame, linear: DataFrame, totals: DataFrame) -> None:
    """Write an index built by ``build_index``; it is as long as a file's chunks and windows, and made on the driver."""
    rows = lambda df, *names: list(zip(*(c.to_pylist() for c in df.select(*names).toArrow().columns), strict=True))
    data = index_bytes(n_ref, rows(bins, "ref_id", "bin", "chunk_beg", "chunk_end"), rows(linear, "ref_id", "win", "voffset"), totals.first()["unplaced"] or 0)
    with open_output(path) as sink:
        sink.write(data)


def make_index(spark: SparkSession, path: str, to: str) -> None:
    """Write the index of a file. Its records are read once; of each run of them only its chunks, windows and counts are stored."""
    from ..operators.intervals import join_index
    from ..session import stored

    refs = spark.read.format("bam").option("part", "refs").load(path)
    parts = stored(spark.read.format("bam").option("part", "index").load(path), "places")
    write_index(to, refs.count(), *join_index(parts))


def find_index(path: str, given: str | None = None) -> str | None:
    """The index of a file: the given one, or the one beside it, or None."""
    for name in [given] if given else [path + ".bai", path.removesuffix(".bam") + ".bai"]:
        try:
            if list_files(name):
                return name
        except FileNotFoundError:
            if given:
                raise
    return None


def indexed(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """The alignments of a file, read through its index; where that is missing it is built.

    A missing index is saved to ``index`` if that is given, and otherwise for the session only, in shared storage.
    """
    from ..session import shared_dir

    try:
        found = find_index(path, index)
    except FileNotFoundError:
        found = None
    if found is None:
        found = index or f"{shared_dir(spark, 'index')}/index.bai"
        make_index(spark, path, found)
    return spark.read.format("bam").option("index", found).load(path)


@dataclass
class Part(InputPartition):
    """A file from one virtual offset to another (None: its ends), or with ``spans`` the records that start in each of those ranges of bytes."""

    path: str
    size: int
    begin: int | None
    end: int | None
    spans: list[tuple[int, int]] | None = None


class BamReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.part, self.index, self.schema = options.get("path"), options.get("part", "records"), options.get("index"), schema
        self.wanted = None
        if self.part == "records" and schema.fieldNames() != ALIGNMENT_NAMES:
            from pyspark.sql.pandas.types import to_arrow_schema

            self.wanted = to_arrow_schema(schema)
            unknown = [k for k in schema.fieldNames() if k not in ALIGNMENT_NAMES and not bam_batches.TAG_NAME.fullmatch(k)]
            if unknown:
                raise ValueError(f"alignments have no column {', '.join(unknown)}")
        self.split = int(options.get("split", PART_BYTES))
        self.keep = str(options.get("lazy", "false")).lower() != "true"
        self.ref, self.low, self.high, self.ending = None, None, None, False

    def pushFilters(self, filters):
        """Notes bounds for leaving out parts; Spark tests every row again."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if isinstance(f, EqualTo) and name == "ref_id":
                self.ref = f.value
            elif isinstance(f, (LessThan, LessThanOrEqual)) and name == "pos":
                self.high = f.value if self.high is None else min(self.high, f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name in ("pos", "end_pos"):
                self.low = f.value if self.low is None else max(self.low, f.value)
                # Records that are unmapped end at 0.
                self.ending |= name == "end_pos" and f.value >= isinstance(f, GreaterThanOrEqual)
        return filters

    def partitions(self):
        out = []
        for path, size in list_files(self.path):
            if path.endswith(".bai"):
                continue
            index = find_index(path, self.index) if self.part in RECORDS else None
            if index is None:
                if self.part in RECORDS and 0 < self.split < size:
                    spans = [(at, min(size, at + self.split)) for at in range(0, size, self.split)]
                    n = max(1, min(PART_BYTES, size // TASKS) // self.split)
                    out += [Part(path, size, None, None, spans[i : i + n]) for i in range(0, len(spans), n)]
                else:
                    out.append(Part(path, size, None, None))
                continue
            with open_input(index) as source:
                told = read_index(source.read())
            chunks = [(a, b, ref) for (ref, number), pairs in told["bins"].items() if number != UNMAPPED_BIN for a, b in pairs]
            if self.ref is not None and self.ref >= 0:
                chunks = self._chosen(told)
                out += [Part(path, size, a, b) for a, b in _joined(chunks)]
                continue
            starts = sorted({a for a, _, _ in chunks})
            cuts, last = [], None
            for a in starts:
                if last is None or (a >> 16) - (last >> 16) >= PART_BYTES:
                    cuts.append(a)
                    last = a
            # Unmapped records may lie between and after chunks, so parts cover the whole file.
            out += [Part(path, size, a, b) for a, b in zip([None, *cuts[1:]], [*cuts[1:], None], strict=True)] if cuts else [Part(path, size, None, None)]
        return out

    def _chosen(self, told):
        """Chunks of one reference whose bins can hold a record between the bounds.

        Unmapped records are in no bin but somewhere in the span of their reference, which is read where they can match.
        """
        low, high = max(0, (self.low or 1) - 1), self.high if self.high is not None else (1 << 29)
        wanted = {0} | (set() if self.ending else {UNMAPPED_BIN}) | {b for shift, base in LEVELS for b in range(base + (low >> shift), base + (max(high, low) >> shift) + 1)}
        chunks = []
        for (ref, number), pairs in told["bins"].items():
            if ref == self.ref and number in wanted:
                chunks += pairs[:1] if number == UNMAPPED_BIN else pairs
        return sorted(chunks)

    def read(self, partition):
        if self.part not in RECORDS:
            yield from in_batches(self._told(partition), self.schema)
            return
        with open_input(partition.path) as source:
            stream = MemberReader(source, partition.size)
            _, refs = read_header(stream)
            names = [name for name, _ in refs]
            if not partition.spans:
                if partition.begin is not None:
                    stream = MemberReader(source, partition.size, partition.begin)
                for run in bam_batches.Runs(stream, partition.end):
                    yield from self._batches(run, names)
                return
            for low, high in partition.spans:
                if low:
                    stream = MemberReader(source, partition.size, first_record(source, partition.size, low, len(refs)))
                runs = bam_batches.Runs(stream, high << 16)
                for run in runs:
                    yield from self._batches(run, names)
                if high < partition.size:
                    here = partition.size << 16 if runs.here is None or runs.here < high << 16 else runs.here
                    if first_record(source, partition.size, high, len(refs)) != here:
                        raise ValueError(f"{partition.path} can't be split at {high} without an index: make one, or set split to 0")

    def _batches(self, run, names):
        """A run's records, or what it gives to an index."""
        if self.part == "index":
            yield from bam_batches.index_parts(*run, len(names))
        else:
            yield bam_batches.decode(*run, names, self.keep, self.wanted)

    def _told(self, partition):
        """The header's lines, or the references."""
        with open_input(partition.path) as source:
            text, refs = read_header(MemberReader(source, partition.size))
        if self.part == "header":
            yield from ((i, line) for i, line in enumerate(x for x in text.split("\n") if x))
        else:
            yield from ((i, name, length) for i, (name, length) in enumerate(refs))


def _joined(chunks):
    """Overlapping and touching chunks as one, so that no record is read twice."""
    out: list[list[int]] = []
    for a, b in chunks:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@dataclass
class Written(WriterCommitMessage):
    path: str


class BamWriter(DataSourceArrowWriter):
    """A file for each task, each with the header given by the option ``header``; references come from its @SQ lines.

    With the option ``single`` (true) the tasks' records become one file in the partitions' order: tasks write blocks
    of records to a folder beside it, and the commit copies them, as they are, behind the header. ``level`` is zlib's (6).
    Columns named as ``NM:C`` are tags of that key and type, and save the map ``tags``.
    """

    def __init__(self, options, schema):
        self.path, self.header, self.names = options.get("path").rstrip("/"), options.get("header", ""), schema.fieldNames()
        self.single = str(options.get("single", "false")).lower() == "true"
        self.level = int(options.get("level", 6))
        self.job = uuid.uuid4().hex[:12]
        self.pieces = f"{self.path}/.pieces-{self.job}"
        fields = [dict(f.split(":", 1) for f in line.split("\t")[1:] if ":" in f) for line in self.header.split("\n") if line.startswith("@SQ")]
        self.refs = [(f["SN"], int(f["LN"])) for f in fields]

    def _write_header(self, out: BlockWriter) -> None:
        text = self.header.encode()
        out.write(b"BAM\x01" + struct.pack("<I", len(text)) + text + struct.pack("<I", len(self.refs)))
        for name, length in self.refs:
            out.write(struct.pack("<I", len(name) + 1) + name.encode() + b"\0" + struct.pack("<I", length))

    def write(self, iterator):
        context = TaskContext.get()
        path = f"{self.pieces if self.single else self.path}/part-{context.partitionId():06d}-{self.job}-{context.taskAttemptId()}.bam"
        with open_output(path) as sink:
            out = BlockWriter(sink, self.level)
            if not self.single:
                self._write_header(out)
            for batch in iterator:
                for data in bam_batches.encode(batch.rename_columns(self.names)):
                    out.write(data)
            if self.single:
                out.flush()
            else:
                out.close()
        return Written(path)

    def commit(self, messages):
        if not self.single:
            remove_others(self.path, self.job, messages)
            return
        with open_output(f"{self.path}/part-000000-{self.job}.bam") as sink:
            out = BlockWriter(sink)
            self._write_header(out)
            out.flush()
            for path in sorted(m.path for m in messages if m):
                with open_input(path) as source:
                    while part := source.read(1 << 24):
                        sink.write(part)
            sink.write(END_BLOCK)
        self._drop_pieces()

    def abort(self, messages):
        for m in messages:
            if m and not self.single:
                files, where = open_fs(m.path)
                files.delete_file(where)
        if self.single:
            self._drop_pieces()

    def _drop_pieces(self):
        files, where = open_fs(self.pieces)
        if files.get_file_info(where).type.name == "Directory":
            files.delete_dir(where)


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return {"header": "line_no bigint, line string", "refs": REFS, "index": INDEX_PARTS}.get(self.options.get("part"), ALIGNMENTS)

    def reader(self, schema):
        return BamReader(self.options, schema)

    def writer(self, schema, overwrite):
        return BamWriter(self.options, schema)


class BaiReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.linear = options.get("path"), options.get("part") == "linear"

    def read(self, partition):
        for path, _ in list_files(self.path):
            if not path.endswith(".bai"):
                continue
            with open_input(path) as source:
                told = read_index(source.read())
            if self.linear:
                yield from ((ref, w, at) for ref, offsets in told["linear"].items() for w, at in enumerate(offsets))
            else:
                yield from ((ref, number, a, b) for (ref, number), pairs in told["bins"].items() for a, b in pairs)


class BaiSource(DataSource):
    @classmethod
    def name(cls):
        return "bai"

    def schema(self):
        return BAI_LINEAR if self.options.get("part") == "linear" else BAI_BINS

    def reader(self, schema):
        return BaiReader(self.options)
