"""The tokenizers library behind a cache of words, so that a frequent word is encoded once."""

from __future__ import annotations

import json
import os
import re
from array import array

from .common import GenerationCache

#: Words of printable Latin-1 characters; they are in composed form already and lower-case letter by letter.
PLAIN = re.compile("[!-~¡-ÿ]+").fullmatch
LETTERS, NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
#: The split pattern and normaliser that a tokenizer file must name for the short way below.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+").findall


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level tokenizers use for each byte: itself, or the next free one from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in kept}
    return table | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in table)}


class CachedTokenizer:
    """Ids of whole texts, the same as ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Holds for tokenizers that drop white space before they look up words (as word_bpe_49k.json): then a
    text's ids are those of its parts between spaces, one after another. A part keeps any other white
    space, and the library itself deals with that. For Latin-1 words only the library's merge model is
    called, as the rest of its pipeline is plain there; other words go through all of it.
    """

    def __init__(self, path: str, limit: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (told.get("normalizer") or {}).get("normalizers", [])]
        cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        if steps != ["NFC", "Replace", "Lowercase"] or cuts[0].get("behavior") != "Removed":
            raise ValueError(f"{path} doesn't drop white space before it looks up words")
        self.short = cuts[0].get("pattern") == {"Regex": SPLIT} and len(cuts) == 2
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.parts = GenerationCache(self._part, limit // 2)
        self.words = GenerationCache(self._word, limit)

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        if self.short and PLAIN(word) and "<|" not in word:
            found = PARTS(word.lower())
            return self.parts[found[0]] if len(found) == 1 else b"".join([self.parts[p] for p in found])
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers; a null text has none."""
        if not text:
            return b""
        self.words.turn()
        self.parts.turn()
        if self.short and "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()  # letter by letter in Latin-1, so that it can be done before as well
            except UnicodeEncodeError:
                pass
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


_LOADED: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    """The tokenizer of a file, loaded once by each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = CachedTokenizer(path)
    return _LOADED[path]
