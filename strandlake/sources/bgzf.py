"""GZIP members and their blocked form (BGZF): headers, reading from a virtual offset, writing."""

from __future__ import annotations

import struct
import zlib

#: Most bytes of a block's content, and the empty block that ends a file.
BLOCK_BYTES = 65280
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
FHCRC, FEXTRA, FNAME, FCOMMENT = 2, 4, 8, 16


def parse_member_header(raw: bytes) -> dict:
    """The fields of a gzip member's header; ``block_size`` is the member's size if a BC field states it."""
    if len(raw) < 10 or raw[:3] != b"\x1f\x8b\x08":
        raise ValueError("not a gzip member")
    flags, mtime, xfl, system = struct.unpack("<BIBB", raw[3:10])
    out, at = {"flags": flags, "mtime": mtime, "xfl": xfl, "os": system, "xlen": 0, "block_size": None, "file_name": None, "file_comment": None}, 10
    if flags & FEXTRA:
        out["xlen"] = struct.unpack_from("<H", raw, at)[0]
        at, end = at + 2, at + 2 + out["xlen"]
        while at + 4 <= end:
            tag, size = raw[at : at + 2], struct.unpack_from("<H", raw, at + 2)[0]
            if tag == b"BC" and size == 2:
                out["block_size"] = struct.unpack_from("<H", raw, at + 4)[0] + 1
            at += 4 + size
        at = end
    for flag, name in ((FNAME, "file_name"), (FCOMMENT, "file_comment")):
        if flags & flag:
            end = raw.index(b"\0", at)
            out[name], at = raw[at:end].decode("latin-1"), end + 1
    if flags & FHCRC:
        if struct.unpack_from("<H", raw, at)[0] != zlib.crc32(raw[:at]) & 0xFFFF:
            raise ValueError("the gzip header has another checksum")
        at += 2
    return out | {"header_bytes": at}


def is_gzip(head: bytes) -> bool:
    return head[:3] == b"\x1f\x8b\x08"


class MemberReader:
    """A forward stream over gzip members with places as virtual offsets; checksums and sizes are checked."""

    def __init__(self, source, size: int, voffset: int = 0):
        self.source, self.size = source, size
        self.next, self.block, self.data, self.at = voffset >> 16, 0, b"", 0
        if self.next < size and self._load():
            self.at = voffset & 0xFFFF

    def _load(self) -> bool:
        """Inflate the next member; False at the end of the file."""
        while self.next < self.size:
            self.block = self.next
            self.source.seek(self.block)
            raw = self.source.read(min(1 << 17, self.size - self.block))
            unzip, parts = zlib.decompressobj(31), []
            taken = len(raw)
            parts.append(unzip.decompress(raw))
            while not unzip.eof:
                raw = self.source.read(min(1 << 20, self.size - self.block - taken))
                if not raw:
                    raise EOFError("a gzip member is cut short")
                taken += len(raw)
                parts.append(unzip.decompress(raw))
            self.next = self.block + taken - len(unzip.unused_data)
            self.data, self.at = b"".join(parts), 0
            if self.data:
                return True
        self.block, self.data, self.at = self.size, b"", 0
        return False

    def more(self) -> bool:
        """Whether a byte is left; the place is then in the block that holds it."""
        return self.at < len(self.data) or self._load()

    def voffset(self) -> int:
        """Where the next byte comes from; at a block's end that is the next block's start."""
        if self.at >= len(self.data):
            return self.next << 16
        return self.block << 16 | self.at

    def read(self, n: int) -> bytes:
        """n bytes, or fewer at the end of the file."""
        out = []
        while n:
            if self.at >= len(self.data) and not self._load():
                break
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            out.append(part)
        return b"".join(out)

    def parts(self):
        """(virtual offset, bytes) of what is left: the rest of the block, then block by block."""
        while self.at < len(self.data) or self._load():
            begin, part = self.voffset(), self.data[self.at :]
            self.at = len(self.data)
            yield begin, part

    def exactly(self, n: int) -> bytes:
        got = self.read(n)
        if len(got) < n:
            raise EOFError("the file is cut short")
        return got


def block_starts(source, size: int):
    """Offsets of the blocks of a BGZF file, by hopping from header to header."""
    at = 0
    while at < size:
        source.seek(at)
        told = parse_member_header(source.read(min(1 << 12, size - at)))
        if told["block_size"] is None:
            raise ValueError("a member has no block size")
        yield at
        at += told["block_size"]


def block_at(source, size: int, begin: int) -> int:
    """The offset of the first block that starts at or after ``begin``; the file's size if there is none.

    A block is told from bytes that look like one by its header's block size, which leads to another block or to the end.
    """
    at = begin
    while at < size:
        source.seek(at)
        window = source.read(min(1 << 17, size - at))
        found = window.find(b"\x1f\x8b\x08\x04")
        if found < 0:
            at += max(1, len(window) - 3)
            continue
        at += found
        hops, here = 0, at
        while here < size and hops < 3:
            source.seek(here)
            try:
                told = parse_member_header(source.read(min(1 << 12, size - here)))["block_size"]
            except (ValueError, IndexError, struct.error):
                told = None
            if not told or told < 26:
                break
            here, hops = here + told, hops + 1
        if hops == 3 or (hops and here == size):
            return at
        at += 1
    return size


class BlockWriter:
    """Writes BGZF: a member for each BLOCK_BYTES of content, and the empty block at the end."""

    def __init__(self, sink, level: int = 6):
        self.sink, self.level, self.held, self.at = sink, level, bytearray(), 0

    def more(self) -> bool:
        """Whether a byte is left; the place is then in the block that holds it."""
        return self.at < len(self.data) or self._load()

    def voffset(self) -> int:
        return self.at << 16 | len(self.held)

    def write(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= BLOCK_BYTES:
            self._flush(bytes(self.held[:BLOCK_BYTES]))
            del self.held[:BLOCK_BYTES]

    def _flush(self, part: bytes) -> None:
        zipper = zlib.compressobj(self.level, zlib.DEFLATED, -15)
        body = zipper.compress(part) + zipper.flush()
        if len(body) > 65510:
            zipper = zlib.compressobj(0, zlib.DEFLATED, -15)
            body = zipper.compress(part) + zipper.flush()
        member = struct.pack("<BBBBIBBHBBHH", 31, 139, 8, FEXTRA, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
        self.sink.write(member)
        self.at += len(member)

    def flush(self) -> None:
        """End the block that was begun."""
        if self.held:
            self._flush(bytes(self.held))
            self.held.clear()

    def close(self) -> None:
        self.flush()
        self.sink.write(END_BLOCK)
        self.at += len(END_BLOCK)
