"""Bit vectors, bit streams and wavelet trees in numpy, for codecs and index files."""

from __future__ import annotations

import numpy as np


class BitWriter:
    """Bits from the lowest of each byte on; numbers are written lowest bit first."""

    def __init__(self):
        self.value = self.size = 0
        self.done = bytearray()

    def write(self, number: int, bits: int) -> None:
        self.value |= (number & (1 << bits) - 1) << self.size
        self.size += bits
        while self.size >= 8:
            self.done.append(self.value & 255)
            self.value >>= 8
            self.size -= 8

    def align(self) -> None:
        """Fill the byte that was begun with zeros."""
        if self.size:
            self.write(0, 8 - self.size)

    def bytes(self) -> bytes:
        self.align()
        return bytes(self.done)


class BitReader:
    """Reads what BitWriter wrote; places count bits."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, bits: int) -> int:
        """The next bits without taking them; zeros stand after the end."""
        part = int.from_bytes(self.data[self.at >> 3 : (self.at + bits + 7) >> 3], "little")
        return part >> (self.at & 7) & (1 << bits) - 1

    def read(self, bits: int) -> int:
        if self.at + bits > 8 * len(self.data):
            raise EOFError("no bits are left")
        value = self.peek(bits)
        self.at += bits
        return value

    def align(self) -> None:
        self.at = (self.at + 7) & ~7


class BitVector:
    """Bits with ranks and selects; counts are kept at every 512 bits."""

    STEP = 512

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        self.packed = np.packbits(np.asarray(bits, np.uint8), bitorder="little")
        full = np.add.reduceat(np.asarray(bits, np.int64), np.arange(0, self.n, self.STEP)) if self.n else np.zeros(0, np.int64)
        self.counts = np.concatenate([[0], np.cumsum(full)])

    def get(self, i: int) -> int:
        return int(self.packed[i >> 3] >> (i & 7) & 1)

    def rank(self, bit: int, upto: int) -> int:
        """How many bits before a place are 1, or 0."""
        step = upto // self.STEP
        part = np.unpackbits(self.packed[step * self.STEP // 8 : (upto + 7) // 8], bitorder="little")[: upto - step * self.STEP]
        ones = int(self.counts[step]) + int(part.sum())
        return ones if bit else upto - ones

    def select(self, bit: int, nth: int) -> int:
        """The place of the nth (from 1) bit of its kind, or -1."""
        kept = self.counts if bit else np.arange(len(self.counts)) * self.STEP - self.counts
        total = self.rank(bit, self.n)
        if not 1 <= nth <= total:
            return -1
        if not bit:
            kept = np.minimum(kept, total)
        step = int(np.searchsorted(kept, nth, "left")) - 1
        part = np.unpackbits(self.packed[step * self.STEP // 8 : (step + 1) * self.STEP // 8], bitorder="little")[: self.n - step * self.STEP]
        return step * self.STEP + int(np.flatnonzero(part == bit)[nth - int(kept[step]) - 1])


class WaveletTree:
    """Letters of a text by prefix codes: a bit vector for each inner node of the codes' tree."""

    def __init__(self, data: bytes, codes: dict[int, str]):
        self.codes, self.nodes, self.n = codes, {}, len(data)
        text = np.frombuffer(data, np.uint8)
        todo = [("", text)]
        while todo:
            prefix, part = todo.pop()
            inside = [s for s, c in codes.items() if c.startswith(prefix)]
            if len(inside) < 2 and prefix:
                continue
            right = np.isin(part, [s for s in inside if codes[s].startswith(prefix + "1")])
            self.nodes[prefix] = BitVector(right)
            todo += [(prefix + b, part[right == (b == "1")]) for b in "01" if any(codes[s].startswith(prefix + b) and codes[s] != prefix + b for s in inside)]

    def get(self, i: int) -> int:
        """The letter at a place."""
        letters = {c: s for s, c in self.codes.items()}
        prefix = ""
        while prefix not in letters:
            node = self.nodes[prefix]
            bit = node.get(i)
            i, prefix = node.rank(bit, i), prefix + str(bit)
        return letters[prefix]

    def rank(self, letter: int, upto: int) -> int:
        """How often a letter stands before a place."""
        code = self.codes.get(letter)
        if code is None:
            return 0
        for k, bit in enumerate(code):
            upto = self.nodes[code[:k]].rank(int(bit), upto)
        return upto

    def select(self, letter: int, nth: int) -> int:
        """The place of a letter's nth occurrence (from 1), or -1."""
        code = self.codes.get(letter)
        if code is None or nth < 1:
            return -1
        for k in range(len(code) - 1, -1, -1):
            at = self.nodes[code[:k]].select(int(code[k]), nth)
            if at < 0:
                return -1
            nth = at + 1
        return nth - 1


def inverse(order: np.ndarray) -> np.ndarray:
    """Where each number stands in a permutation."""
    out = np.empty_like(order)
    out[order] = np.arange(len(order))
    return out
