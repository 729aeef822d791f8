"""Alignment records in batches: many at a time between a BAM file's bytes and Arrow columns.

Fields, names, bases, qualities and tags are moved by numpy for a run of records at once. What that can't hold (names or
tags beyond ASCII, repeated tags, numbers out of their field's range) goes record by record through ``bam``.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.bins import LEVELS, UNMAPPED_BIN, UNPLACED_BIN
from ..functions.cigar import ON_REFERENCE, OPS
from ..functions.dna import BASE_CODES

RECORD = np.dtype([("size", "<i4"), ("ref_id", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"), ("l_seq", "<i4"), ("next_ref", "<i4"), ("next_pos", "<i4"), ("tlen", "<i4")])
#: Bytes of records handled at once; one longer record is handled alone.
RUN = 1 << 20
TYPES = {"c": "<i1", "C": "<u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4", "f": "<f4"}
TAG = pa.struct([("type", pa.string()), ("i", pa.int64()), ("f", pa.float32()), ("s", pa.string()), ("ia", pa.list_(pa.int64())), ("fa", pa.list_(pa.float32()))])
LETTERS = np.frombuffer(BASE_CODES.encode(), np.uint8)
CODES = np.full(256, 15, np.uint8)
for _i, _c in enumerate(BASE_CODES):
    CODES[ord(_c)] = CODES[ord(_c.lower())] = _i


def places(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of slices of the given begins and lengths, one slice after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(begins - before, lengths) + np.arange(int(lengths.sum()))


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _strings(flat: np.ndarray, lengths: np.ndarray, present: np.ndarray | None = None, kind=None) -> pa.Array:
    """Strings (or ``kind``) from their bytes one after another; null where not present, which then has no bytes."""
    valid = None if present is None or present.all() else pa.py_buffer(np.packbits(present, bitorder="little"))
    return pa.Array.from_buffers(kind or pa.string(), len(lengths), [valid, pa.py_buffer(offsets_of(lengths).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _latin(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings from Latin-1."""
    if not len(flat) or flat.max() < 128:
        return _strings(flat, lengths)
    text, cuts = flat.tobytes().decode("latin-1"), offsets_of(lengths).tolist()
    return pa.array([text[a:b] for a, b in zip(cuts, cuts[1:])], pa.string())


def _cached(make):
    """Short keys come again and again; long ones are made anew, so that the cache stays small."""
    kept = lru_cache(maxsize=1 << 16)(make)
    return lambda key: kept(key) if len(key) <= 64 else make(key)


# Reading


class Runs:
    """Whole records of a stream that begin before a virtual offset (None: all), in runs of about RUN bytes.

    A run is (bytes, begins, ends, virtual offsets of the begins, and of the ends). ``here`` is then the virtual offset of
    the first record that isn't in a run; None at the end of the file.
    """

    def __init__(self, stream, end: int | None):
        self.stream, self.end, self.here = stream, end, None

    def __iter__(self):
        stream, parts, total, need = self.stream, [], 0, 4
        # Of each block: the place of its first byte here, the place after its last, its place in the file, and the next block's.
        blocks: list[tuple[int, int, int, int, int]] = []
        more = stream.more()
        while more:
            if not total and self.end is not None and stream.voffset() >= self.end:
                self.here = stream.voffset()
                return
            part = stream.data[stream.at :] if stream.at else stream.data
            blocks.append((total, total + len(part), total - stream.at, stream.block, stream.next))
            stream.at = len(stream.data)
            parts.append(part)
            total += len(part)
            next_block = stream.next
            more = stream.more()
            if more and (total < need or (total < RUN and (self.end is None or next_block << 16 < self.end))):
                continue
            data = b"".join(parts)
            starts, at, step = [], 0, 4
            size_at = struct.Struct("<i").unpack_from
            while at + 4 <= total:
                step = size_at(data, at)[0] + 4
                if step <= 36:
                    raise ValueError("a record is shorter than its fixed fields")
                if at + step > total:
                    break
                starts.append(at)
                at, step = at + step, 4
            begins = np.array(starts, np.int64)
            ends = np.append(begins[1:], at) if starts else begins
            froms, tos, bases, offsets, nexts = (np.array(x, np.int64) for x in zip(*blocks, strict=True))
            i = np.searchsorted(froms, begins, "right") - 1
            v_begins = offsets[i] << 16 | (begins - bases[i])
            i = np.searchsorted(froms, ends - 1, "right") - 1
            v_ends = np.where(ends == tos[i], nexts[i] << 16, offsets[i] << 16 | (ends - bases[i]))
            n = len(begins) if self.end is None else int(np.searchsorted(v_begins, self.end))
            low = 0
            while low < n:
                high = min(n, max(low + 1, int(np.searchsorted(ends, begins[low] + RUN, "right"))))
                first = int(begins[low])
                yield data[first : int(ends[high - 1])], begins[low:high] - first, ends[low:high] - first, v_begins[low:high], v_ends[low:high]
                low = high
            if n < len(begins):
                self.here = int(v_begins[n])
                return
            if self.end is not None and at < total:
                b = int(np.searchsorted(froms, at, "right")) - 1
                here = int(offsets[b] << 16 | (at - bases[b]))
                if here >= self.end:
                    self.here = here
                    return
            parts, total, need = [data[at:]] if at < total else [], total - at, step
            blocks = [(max(a, at) - at, b - at, c - at, d, e) for a, b, c, d, e in blocks if b > at]
        if total:
            raise EOFError("the file is cut short")


@_cached
def _cigar_text(raw: bytes) -> tuple[str, int]:
    """The text of packed operations, and the bases of the reference under them."""
    ops = [(c >> 4, OPS[c & 15]) for c in struct.unpack(f"<{len(raw) // 4}I", raw)]
    return "".join(f"{n}{op}" for n, op in ops) or "*", sum(n for n, op in ops if op in ON_REFERENCE)


def _int32(values) -> pa.Array:
    return pa.array(values, pa.int64()).cast(pa.int32())


#: In a schema, a column of such a name is the tag of that key.
TAG_NAME = re.compile("[A-Za-z][A-Za-z0-9]")


def decode(data: bytes, begins: np.ndarray, ends: np.ndarray, v_begins: np.ndarray, v_ends: np.ndarray, names: list[str], keep: bool = True, wanted: pa.Schema | None = None) -> pa.RecordBatch:
    """A batch of ALIGNMENTS from records' bytes. Without ``keep``, bases, qualities and tags are null and not decoded.

    ``wanted`` tells the columns to make; those of two letters are tags.
    """
    asked = lambda name: wanted is None or name in wanted.names
    buf, n = np.frombuffer(data, np.uint8), len(begins)
    fixed = buf[begins[:, None] + np.arange(RECORD.itemsize)].view(RECORD)[:, 0]
    l_name, n_cigar, l_seq = (fixed[k].astype(np.int64) for k in ("l_name", "n_cigar", "l_seq"))
    name_at = begins + RECORD.itemsize
    cigar_at = name_at + l_name
    seq_at = cigar_at + 4 * n_cigar
    qual_at = seq_at + (l_seq + 1) // 2
    if ((l_seq < 0) | (l_name < 1) | (qual_at + l_seq > ends)).any():
        raise ValueError("a record is shorter than its fields say")
    if asked("cigar") or asked("end_pos"):
        told = _strings(buf[places(cigar_at, 4 * n_cigar)], 4 * n_cigar, kind=pa.binary()).dictionary_encode()
        texts, spans = zip(*(_cigar_text(x) for x in told.dictionary.to_pylist()), strict=True)
        span = np.array(spans, np.int64)[told.indices.to_numpy()]
    ref_id, next_ref, flag = (fixed[k].astype(np.int64) for k in ("ref_id", "next_ref", "flag"))
    pos = fixed["pos"].astype(np.int64)
    known = pa.array(names, pa.string())
    name_of = lambda ids: known.take(pa.array(ids, mask=(ids < 0) | (ids >= len(names))))
    bases = keep and l_seq.any()
    make = {
        "qname": lambda: _latin(buf[places(name_at, l_name - 1)], l_name - 1),
        "flag": lambda: _int32(flag),
        "ref_id": lambda: _int32(ref_id),
        "rname": lambda: name_of(ref_id),
        "pos": lambda: _int32(pos + 1),
        "end_pos": lambda: _int32(np.where((flag & 4 != 0) | (n_cigar == 0), 0, pos + span)),
        "mapq": lambda: pa.array(fixed["mapq"].astype(np.int16)),
        "cigar": lambda: pa.array(texts, pa.string()).take(told.indices),
        "next_ref_id": lambda: _int32(next_ref),
        "rname_next": lambda: name_of(next_ref),
        "next_pos": lambda: _int32(fixed["next_pos"].astype(np.int64) + 1),
        "tlen": lambda: pa.array(fixed["tlen"].astype(np.int32)),
        "seq": lambda: _bases(buf, seq_at, l_seq) if bases else pa.nulls(n, pa.string()),
        "qual": lambda: _qualities(buf, qual_at, l_seq) if bases else pa.nulls(n, pa.string()),
        "bin": lambda: pa.array(fixed["bin"].astype(np.int32)),
        "voffset": lambda: pa.array(v_begins),
        "voffset_end": lambda: pa.array(v_ends),
        "tags": lambda: decode_tags(buf, qual_at + l_seq, ends) if keep else pa.nulls(n, pa.map_(pa.string(), TAG)),
    }
    if wanted is None:
        return pa.RecordBatch.from_pydict({k: f() for k, f in make.items()})
    tags = pa.schema([f for f in wanted if f.name not in make])
    if tags.names:
        told_tags = tag_columns(buf, qual_at + l_seq, ends, tags) if keep else {f.name: pa.nulls(n, f.type) for f in tags}
    columns = [(f, make[f.name]() if f.name in make else told_tags[f.name]) for f in wanted]
    return pa.RecordBatch.from_pydict({f.name: x if f.name == "tags" or x.type == f.type else x.cast(f.type) for f, x in columns})


INDEX_PARTS = pa.schema([("kind", pa.string()), ("ref_id", pa.int32()), ("at", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
#: Windows of a linear index that are listed at once.
WINDOWS = 1 << 20


def _index_rows(kind: str, ref_id: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(ref_id), pa.string()), _int32(ref_id), *(pa.array(x, pa.int64()) for x in (at, low, high))], schema=INDEX_PARTS)


def index_parts(data: bytes, begins: np.ndarray, ends: np.ndarray, v_begins: np.ndarray, v_ends: np.ndarray, n_ref: int):
    """Batches of INDEX_PARTS: what a run of records gives to an index, which ``intervals.join_index`` puts together.

    Kinds: ``bin`` (a bin's chunk from low to high, merged within the run), ``win`` (a 16 kb window's least offset), ``span``
    and ``count`` (a reference's offsets from low to high, its mapped and unmapped records), ``unplaced`` (their number in low).
    """
    buf = np.frombuffer(data, np.uint8)
    fixed = buf[begins[:, None] + np.arange(RECORD.itemsize)].view(RECORD)[:, 0]
    ref_id, bins, pos, flag, n_cigar = (fixed[k].astype(np.int64) for k in ("ref_id", "bin", "pos", "flag", "n_cigar"))
    cigar_at = begins + RECORD.itemsize + fixed["l_name"]
    if (cigar_at + 4 * n_cigar > ends).any():
        raise ValueError("a record is shorter than its fields say")
    lost = np.count_nonzero(ref_id < 0)
    if lost:
        yield _index_rows("unplaced", np.array([-1]), np.zeros(1), np.array([lost]), np.zeros(1))
    unmapped, placed = flag & 4 != 0, (ref_id >= 0) & (ref_id < n_ref)
    for ref in np.unique(ref_id[placed]).tolist():
        of = ref_id == ref
        yield _index_rows("span", np.array([ref]), np.zeros(1), v_begins[of].min(keepdims=True), v_ends[of].max(keepdims=True))
        yield _index_rows("count", np.array([ref]), np.zeros(1), np.array([np.count_nonzero(of & ~unmapped)]), np.array([np.count_nonzero(of & unmapped)]))
    # Records come in the order of their offsets, so a bin's chunk goes on from its last record.
    rows = np.flatnonzero(placed & (bins != UNMAPPED_BIN))
    rows = rows[np.argsort(ref_id[rows] << 16 | bins[rows], kind="stable")]
    if len(rows):
        key, low, high = ref_id[rows] << 16 | bins[rows], v_begins[rows], v_ends[rows]
        first = np.append(True, (key[1:] != key[:-1]) | ((low[1:] > high[:-1]) & (low[1:] >> 16 != high[:-1] >> 16)))
        yield _index_rows("bin", ref_id[rows][first], bins[rows][first], low[first], high[np.append(first[1:], True)])
    rows = np.flatnonzero(placed & ~unmapped)
    if not len(rows):
        return
    told = _strings(buf[places(cigar_at[rows], 4 * n_cigar[rows])], 4 * n_cigar[rows], kind=pa.binary()).dictionary_encode()
    spans = np.array([_cigar_text(x)[1] for x in told.dictionary.to_pylist()], np.int64)[told.indices.to_numpy()]
    begin, end = pos[rows] >> 14, (pos[rows] + np.maximum(spans, 1) - 1) >> 14
    # Of neighbours over the same windows the first counts.
    ref, at = ref_id[rows], v_begins[rows]
    kept = np.flatnonzero(np.append(True, (ref[1:] != ref[:-1]) | (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])))
    ref, begin, n, at = ref[kept], begin[kept], (end - begin + 1)[kept], at[kept]
    part = np.cumsum(n) // WINDOWS
    for some in np.split(np.arange(len(kept)), np.flatnonzero(np.diff(part)) + 1):
        wins, refs = places(begin[some], n[some]), np.repeat(ref[some], n[some])
        _, first = np.unique(refs << 40 | (wins + 1), return_index=True)
        yield _index_rows("win", refs[first], wins[first], np.repeat(at[some], n[some])[first], np.zeros(len(first)))


def _bases(buf: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> pa.Array:
    packed = (lengths + 1) // 2
    flat = buf[places(at, packed)]
    both = np.empty(2 * len(flat), np.uint8)
    both[::2], both[1::2] = LETTERS[flat >> 4], LETTERS[flat & 15]
    return _strings(both[places(2 * (np.cumsum(packed) - packed), lengths)], lengths, lengths > 0)


def _qualities(buf: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> pa.Array:
    there = lengths > 0
    there[there] = buf[at[there]] != 255
    lengths = np.where(there, lengths, 0)
    flat = buf[places(at, lengths)]
    if not len(flat) or flat.max() < 128 - 33:
        return _strings(flat + np.uint8(33), lengths, there)
    cuts = offsets_of(lengths).tolist()
    return pa.array(["".join(chr(q + 33) for q in flat[a:b].tolist()) if t else None for a, b, t in zip(cuts, cuts[1:], there.tolist())], pa.string())


def _numbers(buf: np.ndarray, at: np.ndarray, kind: str) -> np.ndarray:
    form = np.dtype(TYPES[kind])
    return buf[at[:, None] + np.arange(form.itemsize)].view(form)[:, 0]


def _rounds(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """(records, places, types, array types, places of values, their sizes, array lengths): the records' first tags at once, then their second ones, and so on."""
    rows, at, zeros = np.arange(len(begins)), begins, None
    while len(rows):
        going = at + 3 <= ends[rows]
        if not going.all():
            rows, at = rows[going], at[going]
        kinds, value, size, count = buf[at + 2] if len(at) else np.zeros(0, np.uint8), at + 3, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        subs = np.zeros(len(at), np.uint8)
        codes = np.flatnonzero(np.bincount(kinds, minlength=256)).tolist()
        for code in codes:
            kind, of = chr(code), slice(None) if len(codes) == 1 else kinds == code
            if kind in TYPES:
                size[of] = int(TYPES[kind][2])
            elif kind == "A":
                size[of] = 1
            elif kind in "ZH":
                zeros = np.flatnonzero(buf == 0) if zeros is None else zeros
                found = np.append(zeros, len(buf))[np.searchsorted(zeros, value[of])]
                size[of] = found + 1 - value[of]
            elif kind == "B":
                if (value[of] + 5 > ends[rows[of]]).any():
                    raise ValueError("a tag is cut short")
                subs[of] = buf[value[of]]
                count[of] = _numbers(buf, value[of] + 1, "i")
                widths = np.zeros(256, np.int64)
                for k, form in TYPES.items():
                    widths[ord(k)] = int(form[2])
                if (count[of] < 0).any() or not widths[subs[of]].all():
                    raise ValueError("an array tag has an unknown type or a negative length")
                size[of] = 5 + count[of] * widths[subs[of]]
            else:
                raise ValueError(f"a tag has the unknown type {kind!r}")
        if (value + size > ends[rows]).any():
            raise ValueError("a tag is cut short")
        yield rows, at, kinds, subs, value, size, count
        at = value + size


def tag_columns(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, wanted: pa.Schema) -> dict[str, pa.Array]:
    """A column for each field of ``wanted``, a tag's key and the type of its value; null where a record has no such value.

    As in a map of tags, of repeated tags the last counts, and the column's type tells which of a tag's values it is:
    whole numbers, floats, text, or arrays of the first two.
    """
    n = len(begins)
    held = {f.name: [np.zeros(n, np.uint8), np.zeros(n, np.uint8), *(np.zeros(n, np.int64) for _ in range(3))] for f in wanted}
    for rows, at, *told in _rounds(buf, begins, ends):
        key = buf[at].astype(np.int32) << 8 | buf[at + 1]
        for name, columns in held.items():
            hit = np.flatnonzero(key == ord(name[0]) << 8 | ord(name[1]))
            if len(hit) == n:
                held[name] = list(told)
            elif len(hit):
                for column, x in zip(columns, told, strict=True):
                    column[rows[hit]] = x[hit]
    return {f.name: _tag_column(buf, *held[f.name], f.type) for f in wanted}


def _tag_column(buf: np.ndarray, kinds: np.ndarray, subs: np.ndarray, value: np.ndarray, size: np.ndarray, count: np.ndarray, form: pa.DataType) -> pa.Array:
    """The values of one tag in each record (type 0: none) as the given type."""
    n = len(kinds)
    if pa.types.is_string(form):
        text = (kinds == ord("Z")) | (kinds == ord("H"))
        there = text | (kinds == ord("A"))
        lengths = np.where(text, size - 1, there.astype(np.int64))
        letters = buf[places(value, lengths)]
        if len(letters) and letters.max() > 127:
            return pa.array([buf[a : a + m].tobytes().decode("latin-1") if t else None for a, m, t in zip(value.tolist(), lengths.tolist(), there.tolist())], pa.string())
        return _strings(letters, lengths, there)
    if pa.types.is_list(form):
        of = (kinds == ord("B")) & ((subs == ord("f")) == pa.types.is_floating(form.value_type))
        counts = np.where(of, count, 0)
        cuts = offsets_of(counts)
        flat = np.zeros(int(cuts[-1]), np.float32 if pa.types.is_floating(form.value_type) else np.int64)
        for code in np.flatnonzero(np.bincount(subs[of], minlength=256)).tolist():
            some, k = np.flatnonzero(of & (subs == code)), chr(code)
            each = np.repeat(value[some] + 5, counts[some]) + int(TYPES[k][2]) * places(np.zeros(len(some), np.int64), counts[some])
            if len(each):
                flat[places(cuts[some], counts[some])] = _numbers(buf, each, k)
        valid = None if of.all() else pa.py_buffer(np.packbits(of, bitorder="little"))
        values = pa.array(flat)
        return pa.Array.from_buffers(pa.list_(values.type), n, [valid, pa.py_buffer(cuts.astype(np.int32))], children=[values]).cast(form)
    if not (pa.types.is_floating(form) or pa.types.is_integer(form)):
        raise ValueError(f"a tag can't be read as {form}")
    letters = "f" if pa.types.is_floating(form) else "cCsSiI"
    out, there = np.zeros(n, np.float32 if letters == "f" else np.int64), np.zeros(n, bool)
    for k in letters:
        of = kinds == ord(k)
        if of.any():
            out[of], there = _numbers(buf, value[of], k), there | of
    return pa.array(out, mask=None if there.all() else ~there).cast(form)


def decode_tags(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Maps of tags from the bytes between begins and ends."""
    rounds = list(_rounds(buf, begins, ends))
    columns = [np.concatenate(x) for x in zip(*rounds, strict=True)] if rounds else [np.zeros(0, np.int64)] * 7
    order = np.argsort(columns[0], kind="stable")
    rows, at, kinds, subs, value, size, count = (x[order] for x in columns)
    n = len(rows)
    text = (kinds == ord("Z")) | (kinds == ord("H"))
    lengths = np.where(text, size - 1, np.where(kinds == ord("A"), 1, 0))
    letters = buf[places(value, lengths)]
    keys = buf[at[:, None] + np.arange(2)]
    same = np.sort(rows << 16 | keys[:, 0].astype(np.int64) << 8 | keys[:, 1])
    if (same[1:] == same[:-1]).any() or (n and (keys.max() > 127 or (len(letters) and letters.max() > 127))):
        from .bam import decode_tags as one

        raw = [buf[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist())]
        return pa.array([list(one(x).items()) for x in raw], pa.map_(pa.string(), TAG))
    i, f = np.zeros(n, np.int64), np.zeros(n, np.float32)
    for k in TYPES:
        of = np.flatnonzero(kinds == ord(k))
        if len(of):
            (f if k == "f" else i)[of] = _numbers(buf, value[of], k)
    arrays = kinds == ord("B")
    whole, real = arrays & (subs != ord("f")), arrays & (subs == ord("f"))
    lists = []
    for of, form in ((whole, np.int64), (real, np.float32)):
        counts = np.where(of, count, 0)
        cuts = offsets_of(counts)
        flat = np.zeros(int(cuts[-1]), form)
        for code in np.unique(subs[of]).tolist():
            some = np.flatnonzero(of & (subs == code))
            width, k = int(TYPES[chr(code)][2]), chr(code)
            each = np.repeat(value[some] + 5, counts[some]) + width * places(np.zeros(len(some), np.int64), counts[some])
            if len(each):
                flat[places(cuts[some], counts[some])] = _numbers(buf, each, k)
        lists.append(pa.Array.from_buffers(pa.list_(pa.from_numpy_dtype(form)), n, [pa.py_buffer(np.packbits(of, bitorder="little")), pa.py_buffer(cuts.astype(np.int32))], children=[pa.array(flat)]))
    is_int = np.isin(kinds, np.frombuffer(b"cCsSiI", np.uint8))
    pairs = np.stack([kinds, subs], 1).reshape(-1)[places(np.arange(n) * 2, 1 + arrays.astype(np.int64))]
    fields = [_strings(pairs, 1 + arrays.astype(np.int64)), pa.array(i, mask=~is_int), pa.array(f, mask=kinds != ord("f")), _strings(letters, lengths, text | (kinds == ord("A"))), *lists]
    items = pa.StructArray.from_arrays(fields, fields=list(TAG))
    cuts = offsets_of(np.bincount(rows, minlength=len(begins))).astype(np.int32)
    return pa.MapArray.from_arrays(pa.array(cuts), _strings(keys.reshape(-1), np.full(n, 2)), items)


# Writing


@_cached
def _cigar_ops(text: str) -> tuple[bytes, int]:
    """The packed operations of a text, and the bases of the reference under them."""
    ops = [] if text == "*" else [(int(n), op) for n, op in re.findall(f"([0-9]+)([{OPS}])", text)]
    return b"".join(struct.pack("<I", n << 4 | OPS.index(op)) for n, op in ops), sum(n for n, op in ops if op in ON_REFERENCE)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes one after another, and each row's number of them; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    cuts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    flat = np.frombuffer(raw, np.uint8)[cuts[0] : cuts[-1]] if raw else np.zeros(0, np.uint8)
    return flat, np.diff(cuts)


FIELDS = ("qname", "flag", "ref_id", "pos", "mapq", "cigar", "next_ref_id", "next_pos", "tlen", "seq", "qual", "tags")
#: A column of such a name, as ``NM:C`` or ``FZ:BS``, holds the values of a tag of that key and type, null where a record has none.
TYPED_TAG = re.compile("([A-Za-z][A-Za-z0-9]):([AcCsSiIfZH]|B[cCsSiIf])")


def encode(batch: pa.RecordBatch):
    """The bytes of a batch's records, in runs of about RUN bytes; missing columns are null, and the bin is computed.

    Tags are those of the map ``tags``, then those of columns named as TYPED_TAG, in the columns' order.
    """
    from .bam import encode_record

    names = [k for k in FIELDS if k in batch.schema.names] + [k for k in batch.schema.names if TYPED_TAG.fullmatch(k)]
    batch = batch.select(names)
    # Rows of one batch may differ in length: a part that's still long is halved.
    waiting = [batch] if batch.num_rows else []
    while waiting:
        part = waiting.pop()
        if part.num_rows > 1 and part.nbytes > 4 * RUN:
            half = part.num_rows // 2
            waiting += [part.slice(half), part.slice(0, half)]
            continue
        columns = {k: part.column(i) for i, k in enumerate(names)}
        data = _encode(columns, part.num_rows)
        if data is None:
            rows = part.to_pylist(maps_as_pydicts="lossy")
            data = b"".join(encode_record(dict.fromkeys(FIELDS) | r | {"tags": (r.get("tags") or {}) | _typed_tags(r)}) for r in rows)
        yield data


def _encode(columns: dict, n: int) -> bytes | None:
    """The records' bytes; None if they have to be made one by one."""

    def number(name: str, default: int, low: int, high: int, less: int = 0) -> np.ndarray | None:
        if name not in columns:
            return np.full(n, default - less, np.int64)
        out = columns[name].cast(pa.int64()).fill_null(default).to_numpy(zero_copy_only=False) - less
        return out if not n or (out.min() >= low and out.max() <= high) else None

    i32 = -(1 << 31), (1 << 31) - 1
    numbers = [number("flag", 0, 0, 65535), number("ref_id", -1, *i32), number("pos", 0, *i32, 1), number("mapq", 0, *i32), number("next_ref_id", -1, *i32), number("next_pos", 0, *i32, 1), number("tlen", 0, *i32)]
    if any(x is None for x in numbers):
        return None
    flag, ref_id, pos, mapq, next_ref, next_pos, tlen = numbers
    column = lambda name: columns[name] if name in columns else pa.nulls(n, pa.string())
    qname = column("qname").cast(pa.string()).fill_null("*")
    qname = pc.if_else(pc.equal(qname, ""), "*", qname)
    name, l_name = _flat(qname)
    seq, l_seq = _flat(column("seq"))
    qual, l_qual = _flat(column("qual"))
    if any(len(x) and x.max() > 127 for x in (name, seq, qual)) or (len(qual) and qual.min() < 33) or l_name.max() > 254:
        return None
    told = column("cigar").cast(pa.string()).fill_null("").dictionary_encode()
    packed_ops, spans = zip(*(_cigar_ops(x) for x in told.dictionary.to_pylist()), strict=True)
    which = told.indices.to_numpy()
    n_cigar, span = np.array([len(x) // 4 for x in packed_ops], np.int64)[which], np.array(spans, np.int64)[which]
    end = pos + np.maximum(1, span)
    bins = np.zeros(n, np.int64)
    for shift, base in reversed(LEVELS):
        bins = np.where(pos >> shift == (end - 1) >> shift, base + (pos >> shift), bins)
    bins = np.where(flag & 4 != 0, np.where(ref_id == -1, UNPLACED_BIN, UNMAPPED_BIN), bins)
    tags = encode_tags(columns.get("tags"), n)
    typed = [typed_tag(*m.groups(), x) for k, x in columns.items() if (m := TYPED_TAG.fullmatch(k))]
    if any(x is None for x in typed) or (typed and len(tags[0] if tags else "")):
        return None
    if tags is None or bins.min() < 0 or bins.max() > 65535 or n_cigar.max() > 65535:
        return None
    # Half a byte a base, so sequences begin at even places.
    packed = (l_seq + 1) // 2
    codes = np.zeros(2 * int(packed.sum()), np.uint8)
    codes[places(2 * (np.cumsum(packed) - packed), l_seq)] = CODES[seq]
    codes = codes[::2] << 4 | codes[1::2]
    n_qual = np.where(l_qual > 0, l_qual, l_seq)
    quals = np.full(int(n_qual.sum()), 255, np.uint8)
    quals[places(np.cumsum(n_qual) - n_qual, l_qual)] = qual - np.uint8(33)
    fixed = np.zeros(n, RECORD)
    tag_lengths = tags[1]
    for key, value in {"size": 32 + l_name + 1 + 4 * n_cigar + packed + n_qual + tag_lengths + sum(m for _, m in typed), "ref_id": ref_id, "pos": pos, "l_name": l_name + 1, "mapq": mapq & 255, "bin": bins, "n_cigar": n_cigar, "flag": flag, "l_seq": l_seq, "next_ref": next_ref, "next_pos": next_pos, "tlen": tlen}.items():
        fixed[key] = value
    parts = [
        _strings(fixed.view(np.uint8), np.full(n, RECORD.itemsize), kind=pa.binary()),
        qname.cast(pa.binary()),
        _strings(np.zeros(n, np.uint8), np.full(n, 1), kind=pa.binary()),
        *([pa.array(packed_ops, pa.binary()).take(told.indices)] if n_cigar.any() else []),
        *([_strings(codes, packed, kind=pa.binary()), _strings(quals, n_qual, kind=pa.binary())] if len(codes) or len(quals) else []),
        *(_strings(data, lengths, kind=pa.binary()) for data, lengths in [tags, *typed] if len(data)),
    ]
    joined = pc.binary_join_element_wise(*parts, b"")
    return joined.buffers()[2].slice(0, int(np.frombuffer(joined.buffers()[1], np.int32)[n])).to_pybytes()


PLACES = {"f": "f", "A": "s", "Z": "s", "H": "s", "B": "ia"}


def _typed_tags(row: dict) -> dict:
    """The tags of a row's columns that are named as TYPED_TAG, as ``bam.encode_tags`` takes them."""
    told = [(m.groups(), v) for k, v in row.items() if v is not None and (m := TYPED_TAG.fullmatch(k))]
    return {key: {"type": kind, "fa" if kind == "Bf" else PLACES.get(kind[0], "i"): v} for (key, kind), v in told}


def typed_tag(key: str, kind: str, column: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
    """The bytes of one tag from its values, and each row's number of them (0 for null); None if they have to be made one by one."""
    n, there = len(column), column.is_valid().to_numpy(zero_copy_only=False)
    head = np.frombuffer((key + kind).encode(), np.uint8)
    given = column.drop_null()
    m = len(given)
    if kind in "ZH":
        text, lengths = _flat(given.cast(pa.string()))
        if len(text) and text.max() > 127:
            return None
        ends = offsets_of(lengths + 4)
        out = np.zeros(int(ends[-1]), np.uint8)
        out[ends[:-1][:, None] + np.arange(3)] = head
        out[places(ends[:-1] + 3, lengths)] = text
        size = lengths + 4
    elif kind == "A":
        text, lengths = _flat(given.cast(pa.string()))
        if m and (lengths.min() < 1 or text.max() > 127):
            return None
        out, size = np.empty((m, 4), np.uint8), np.full(m, 4)
        out[:, :3], out[:, 3] = head, text[np.cumsum(lengths) - lengths]
    else:
        values = _values(given.flatten() if kind[0] == "B" else given, None, kind[-1])
        if values is None:
            return None
        width, raw = values.itemsize, np.ascontiguousarray(values).view(np.uint8)
        if kind[0] != "B":
            out, size = np.empty((m, 3 + width), np.uint8), np.full(m, 3 + width)
            out[:, :3], out[:, 3:] = head, raw.reshape(m, width)
        else:
            count = pc.list_value_length(given).to_numpy(zero_copy_only=False).astype(np.int64)
            size = 8 + width * count
            ends = offsets_of(size)
            out = np.empty(int(ends[-1]), np.uint8)
            out[ends[:-1][:, None] + np.arange(8)] = np.concatenate([np.broadcast_to(head, (m, 4)), count.astype("<i4").view(np.uint8).reshape(m, 4)], 1)
            out[places(ends[:-1] + 8, width * count)] = raw
    lengths = np.zeros(n, np.int64)
    lengths[there] = size
    return out.reshape(-1), lengths


def encode_tags(maps: pa.Array | None, n: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The bytes of maps of tags, in the maps' order, and each map's number of them; None if they have to be made one by one."""
    if maps is None or maps.null_count == n:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64)
    if not pa.types.is_map(maps.type) or not pa.types.is_struct(maps.type.item_type) or "type" not in [f.name for f in maps.type.item_type]:
        return None
    cuts = maps.offsets.to_numpy().astype(np.int64)
    valid = maps.is_valid().to_numpy(zero_copy_only=False)
    if (np.diff(cuts)[~valid] > 0).any():
        return None
    m = int(cuts[-1] - cuts[0])
    cuts, keys, items = cuts - cuts[0], maps.keys.slice(cuts[0], m), maps.items.slice(cuts[0], m)
    key, l_key = _flat(keys)
    held = {f.name: x for f, x in zip(items.type, items.flatten(), strict=True)}
    kind, l_kind = _flat(held["type"])
    if m and (l_key.min() != 2 or l_key.max() != 2 or key.max() > 127 or l_kind.min() < 1 or l_kind.max() > 2):
        return None
    first = np.cumsum(l_kind) - l_kind
    kinds = kind[first] if m else np.zeros(0, np.uint8)
    subs = np.where(l_kind == 2, kind[np.minimum(first + 1, max(0, len(kind) - 1))], ord("i")).astype(np.uint8) if m else kinds
    lengths, jobs = np.zeros(m, np.int64), []
    for code in np.unique(kinds).tolist():
        k, of = chr(code), np.flatnonzero(kinds == code)
        if k in TYPES:
            values = _values(held.get("f" if k == "f" else "i"), of, k)
            if values is None:
                return None
            lengths[of] = values.itemsize
            jobs.append((of, 3, np.ascontiguousarray(values).view(np.uint8).reshape(len(of), -1), None))
        elif k in "AZH":
            texts = held["s"].take(pa.array(of)) if "s" in held else None
            if texts is None or texts.null_count:
                return None
            flat, size = _flat(texts)
            if len(flat) and flat.max() > 127:
                return None
            if k == "A":
                if size.min() < 1:
                    return None
                lengths[of] = 1
                jobs.append((of, 3, flat[np.cumsum(size) - size][:, None], None))
            else:
                lengths[of] = size + 1
                jobs.append((of, 3, flat, size))
        elif k == "B":
            for sub in np.unique(subs[of]).tolist():
                some, s = of[subs[of] == sub], chr(sub)
                lists = held.get("fa" if s == "f" else "ia")
                if s not in TYPES or lists is None:
                    return None
                lists = lists.take(pa.array(some))
                if lists.null_count:
                    return None
                values = _values(lists.flatten(), None, s)
                if values is None:
                    return None
                count = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                width = values.itemsize
                lengths[some] = 5 + count * width
                head = np.zeros((len(some), 5), np.uint8)
                head[:, 0], head[:, 1:] = sub, count.astype("<i4").view(np.uint8).reshape(-1, 4)
                jobs.append((some, 3, head, None))
                jobs.append((some, 8, np.ascontiguousarray(values).view(np.uint8), count * width))
        else:
            return None
    ends = offsets_of(3 + lengths)
    out = np.zeros(int(ends[-1]), np.uint8)
    out[ends[:-1][:, None] + np.arange(2)] = key.reshape(m, 2)
    out[ends[:-1] + 2] = kinds
    for of, skip, data, size in jobs:
        at = ends[of] + skip
        if size is None:
            out[at[:, None] + np.arange(data.shape[1])] = data
        else:
            out[places(at, size)] = data
    return out, np.diff(ends[cuts])


def _values(column: pa.Array | None, of: np.ndarray | None, kind: str) -> np.ndarray | None:
    """A column's numbers, or those of the given rows, as the type that the letter says; None if one is missing or doesn't fit."""
    if column is None:
        return None
    column = column if of is None else column.take(pa.array(of))
    if column.null_count:
        return None
    form = np.dtype(TYPES[kind])
    if kind == "f":
        return column.cast(pa.float32(), safe=False).to_numpy(zero_copy_only=False).astype(form)
    whole = column.cast(pa.int64()).to_numpy(zero_copy_only=False)
    told = np.iinfo(form)
    return None if len(whole) and (whole.min() < told.min or whole.max() > told.max) else whole.astype(form)
