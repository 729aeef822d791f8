"""Token counts of a unigram tokenizer without its tokens: a count-only Viterbi pass over each word.

Aho-Corasick lists the vocabulary pieces that end at each character, longest first. The dynamic programme
carries the best score and its number of pieces. Ties follow the tokenizers library's Unigram model: of
equal scores the piece that begins first wins, a character that is no piece costs the lowest score less 10,
it is tried after all pieces, and neighbouring unknown characters count as one.
"""

from __future__ import annotations

import math

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GenerationCache, arrow_rows, tune

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])


def piece_scores(stated: list[float]) -> list[float]:
    """Log probabilities of pieces from a file's scores.

    A unigram model's scores are taken as they are. A merge model states ranks instead (0, -1, -2, ...), in order of
    frequency; Zipf's law, p ~ 1 / rank, gives these a probability.
    """
    if any(s != -i for i, s in enumerate(stated)):
        return stated
    total = math.log(sum(1 / r for r in range(1, len(stated) + 1))) if stated else 0.0
    return [-math.log(r) - total for r in range(1, len(stated) + 1)]


def unigram_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """(piece, log probability) for each piece of a SentencePiece file in its order, and the unknown piece's place.

    Control and byte pieces aren't matched in text and are left out. The file's normaliser isn't applied: texts are
    counted as they are.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    scored = list(zip(map(model.id_to_piece, ids), piece_scores([model.get_score(i) for i in ids]), strict=True))
    return [(model.id_to_piece(model.unk_id()), min(s for _, s in scored)), *scored], 0


class UnigramCounter:
    """Counts pieces and unknown runs of words (without their leading space mark)."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int, limit: int = 200_000):
        self.found = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            self.found.add_word(piece, (len(piece), score, i == unknown))
        self.found.make_automaton()
        self.worst = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.words = GenerationCache(self.count_word, limit)

    def count_word(self, word: str) -> complex:
        """Pieces, and as the imaginary part unknown runs among them, of a word with the space mark before it."""
        text = SPACE + word
        size = len(text)
        best, pieces, runs, unknown = [0.0] * (size + 1), [0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        last = 0

        def step(end: int, ends: list) -> None:
            top = start = None
            lone = flag = False
            for n, score, is_unknown in ends:
                lone = lone or n == 1
                if top is None or score + best[end - n] > top:
                    top, start, flag = score + best[end - n], end - n, is_unknown
            if not lone and (top is None or self.worst + best[end - 1] > top):
                top, start, flag = self.worst + best[end - 1], end - 1, True
            best[end] = top
            fused = flag and unknown[start]
            pieces[end] = pieces[start] + (not fused)
            runs[end] = runs[start] + (flag and not fused)
            unknown[end] = flag

        ends: list = []
        for at, piece in self.found.iter(text):
            while last < at:
                last += 1
                step(last, ends)
                ends = []
            ends.append(piece)
        while last < size:
            last += 1
            step(last, ends)
            ends = []
        return complex(pieces[size], runs[size])

    def count(self, text: str | None) -> complex:
        if not text:
            return 0j
        self.words.turn()
        return sum(map(self.words.__getitem__, text.split()), 0j)


_LOADED: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    """The counter of a vocabulary file, built once by each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = UnigramCounter(*unigram_vocabulary(path))
    return _LOADED[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens and n_unknown (runs of characters outside the vocabulary) of each row of docs (doc_id, text).

    Words are what white space separates; each gets a leading space mark. Null and empty texts and texts of
    white space count 0. A null doc_id stays null, and repeated rows are counted each. Columns other than
    doc_id and text are ignored. Nothing is shuffled.
    """
    tune(docs.sparkSession)

    def run(batches):
        count = counter(vocabulary).count
        for b in batches:
            got = [count(t.as_py()) for t in b.column(1)]
            yield arrow_rows(COUNTS, doc_id=b.column(0), n_tokens=[int(c.real) for c in got], n_unknown=[int(c.imag) for c in got])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, n_tokens long, n_unknown long")
