"""Sets of five-word shingles of whole texts as sorted 64-bit hashes, many texts at a time in numpy."""

from __future__ import annotations

import numpy as np

from .common import mix64, text_chunks

WORDS = 5
#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes that part words: space and 9 to 13. In UTF-8 they occur as these characters alone.
IS_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_PLACE = mix64(np.arange(1001, 1001 + WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _POWERS.get(str(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 1 << 22:
            _POWERS[str(base)] = have
    return have[:n]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct shingles of each text as ascending hashes.

    A word is a run of bytes other than white space (space, 9 to 13), with A-Z lower-cased. A text of fewer than
    five words has its whole sequence as the one shingle; without words the set is empty.
    """
    out: list[np.ndarray] = []
    for i, j in text_chunks(texts):
        out += _sets(texts[i:j])
    return out


def _sets(texts: list[str | None]) -> list[np.ndarray]:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b" ".join(raw).translate(LOWER) + b" ", np.uint8)
    edges = np.diff(np.concatenate([[False], IS_WORD[joined]]).astype(np.int8))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(begin):
        return [np.empty(0, np.uint64) for _ in texts]
    # A word's hash is a polynomial of its bytes, from sums over the whole string brought back to the word's place.
    sums = np.cumsum(_BYTE[joined] * _powers(_BASE, len(joined)), dtype=np.uint64)
    before = np.where(begin > 0, sums[begin - 1], np.uint64(0))
    words = mix64((sums[end - 1] - before) * _powers(_BACK, len(joined))[begin] + (end - begin).astype(np.uint64))
    first = np.cumsum([0, *(len(r) + 1 for r in raw)])
    cuts = np.searchsorted(begin, first)
    counts = np.diff(cuts)
    full = max(0, len(words) - WORDS + 1)
    mixed = np.full(full, WORDS, np.uint64)
    for k in range(WORDS):
        mixed += words[k : k + full] * _PLACE[k]
    mixed = mix64(mixed)
    out = []
    for at, n in zip(cuts.tolist(), counts.tolist(), strict=False):
        if n >= WORDS:
            s = np.sort(mixed[at : at + n - WORDS + 1])
            out.append(s if len(s) < 2 else s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            out.append(mix64(np.array([(words[at : at + n] * _PLACE[:n]).sum(dtype=np.uint64) + np.uint64(n)])))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * size of the intersection >= 75 * size of the union, for ascending sets of which none is empty."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < 75 * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)
