"""Toxicity by averaged subword embeddings under a linear softmax, both trained together in numpy.

A word is the bag of its character n-grams, between marks for its ends, hashed to rows of an embedding table.
A text is the mean of its words' n-grams; a softmax over two classes reads that mean. A misspelling that was
never seen shares n-grams with words that were. The mean and the softmax's margin are linear, so that a trained
model is one number per n-gram row, and scoring a text needs its words' sums alone.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GenerationCache, arrow_rows, mix64, tune

#: The n-grams' lengths in bytes of UTF-8, end marks included.
GRAMS = (2, 3, 4)
#: Labelled rows that a model is fitted to at most: those of the smallest hashes of doc_id.
TRAIN_ROWS = 6000
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def gram_rows(words: list[str], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n-grams of all words, word by word, and the number of each word's; rows is a power of two."""
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    codes = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner, at = np.repeat(np.arange(len(raw)), sizes), np.arange(len(codes))
    value, found, whose = np.zeros(len(codes), np.uint64), [], []
    for n in range(1, max(GRAMS) + 1):
        here = at[: len(codes) - n + 1]
        value = value[: len(here)] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in GRAMS:
            inside = here + n <= ends[: len(here)]
            found.append(mix64(value[inside] + np.uint64(n)) & np.uint64(rows - 1))
            whose.append(owner[: len(here)][inside])
    whole = np.add.reduceat(mix64(codes * np.uint64(0x9E3779B97F4A7C15) + (at - (ends - sizes[owner])).astype(np.uint64)), np.cumsum(sizes) - sizes) if len(raw) else np.empty(0, np.uint64)
    found.append(mix64(whole) & np.uint64(rows - 1))
    whose.append(np.arange(len(raw)))
    owners = np.concatenate(whose)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.bincount(owners, minlength=len(raw))


class SubwordModel:
    """One number for each n-gram row, and the bias: what the embeddings and the softmax come to."""

    def __init__(self, margins: np.ndarray, bias: float, limit: int = 100_000):
        self.margins, self.bias, self.limit, self.words = margins, bias, limit, None

    def __getstate__(self):
        return {"margins": self.margins, "bias": self.bias, "limit": self.limit, "words": None}

    def score(self, texts: list[str | None]) -> list[float]:
        """The probability of label 1 for each text; one without words has the bias alone."""
        if self.words is None:
            self.words = GenerationCache(None, self.limit)
        split = [t.lower().split() if t else [] for t in texts]
        self.words.turn()
        new = self.words.missing(itertools.chain.from_iterable(split))
        if new:
            rows, counts = gram_rows(new, len(self.margins))
            sums = np.add.reduceat(self.margins[rows], np.cumsum(counts) - counts)
            self.words.learn(new, list(map(complex, sums.tolist(), counts.tolist())))
        get, out = self.words.__getitem__, []
        for ws in split:
            total = sum(map(get, ws), 0j)
            out.append(float(1 / (1 + np.exp(-np.clip(self.bias + (total.real / total.imag if ws else 0.0), -500, 500)))))
        return out


def train_weights(texts: list[str | None], labels: list[int], rows: int, size: int = 4, steps: int = 480, rate: float = 1.0, batch: int = 128, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and biases, fitted together by minibatches with a step size for each weight (Adagrad).

    The loss is cross-entropy, and the number of steps doesn't depend on that of texts. Texts' n-grams are held as
    (row, weight) pairs, so memory follows the number of distinct n-grams of the training texts.
    """
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (rows, size))
    softmax, bias = rng.normal(0, 0.5, (2, size)), np.zeros(2)
    bags = []
    for t in texts:
        words = t.lower().split() if t else []
        at, n = gram_rows(words, rows) if words else (np.zeros(0, np.int64), None)
        ids, counts = np.unique(at, return_counts=True)
        bags.append((ids.astype(np.int32), (counts / max(1, len(at))).astype(np.float32)))
    y = np.array(labels)
    g_table, g_softmax, g_bias = np.full((rows, size), 1e-8), np.full((2, size), 1e-8), np.full(2, 1e-8)
    epochs = -(-steps // -(-len(bags) // batch))
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            ids, weights = np.concatenate([bags[j][0] for j in some]), np.concatenate([bags[j][1] for j in some])
            owner = np.repeat(np.arange(len(some)), [len(bags[j][0]) for j in some])
            used, local = np.unique(ids, return_inverse=True)
            mean = np.stack([np.bincount(owner, table[ids, k] * weights, len(some)) for k in range(size)], 1)
            logits = mean @ softmax.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            d_mean = p @ softmax
            d_table = np.stack([np.bincount(local, d_mean[owner, k] * weights, len(used)) for k in range(size)], 1)
            g_table[used] += d_table**2
            table[used] -= pace * d_table / np.sqrt(g_table[used])
            d_softmax, d_bias = p.T @ mean, p.sum(0)
            g_softmax += d_softmax**2
            g_bias += d_bias**2
            softmax -= pace * d_softmax / np.sqrt(g_softmax)
            bias -= pace * d_bias / np.sqrt(g_bias)
    return table, softmax, bias


def train(texts: list[str | None], labels: list[int], rows: int = 1 << 16, **options) -> SubwordModel:
    """The model of ``train_weights``; labels of one kind alone give every text their share."""
    if len(set(labels)) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        return SubwordModel(np.zeros(rows), float(np.log(share / (1 - share))))
    table, softmax, bias = train_weights(texts, labels, rows, **options)
    return SubwordModel(table @ (softmax[1] - softmax[0]), float(bias[1] - bias[0]))


def held_out(doc_id) -> F.Column:
    """True for rows that no model may learn from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, **options) -> SubwordModel:
    """Fit a model to at most train_rows labelled texts that aren't held out.

    labels has doc_id and toxic (1: toxic); rows with a null in either are left out, and of several labels of a
    document the largest counts. Documents that repeat an id are one example each.
    """
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    spread = F.xxhash64("doc_id")
    chosen = marks.filter(~held_out(F.col("doc_id"))).orderBy(spread, "doc_id").limit(train_rows)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(spread, "doc_id", "text").limit(train_rows)

    def run(batches):
        texts, toxic = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            toxic += b.column(1).to_pylist()
        model = train(texts, toxic, **options)
        yield pa.RecordBatch.from_pydict({"margins": pa.array([model.margins.tobytes()], pa.binary()), "bias": [model.bias]})

    # The bounded sample is one partition; a task trains on it, and the driver gets the model alone.
    tune(docs.sparkSession)
    row = known.select("text", (F.col("_toxic") == 1).cast("int").alias("y")).mapInArrow(run, "margins binary, bias double").first()
    return SubwordModel(np.frombuffer(row["margins"]), row["bias"]) if row else train([], [], **options)


def toxicity(spark: SparkSession, docs: DataFrame, model: SubwordModel) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs, from its whole text alone.

    Null and empty texts and texts of white space get the bias's score. A null doc_id stays null and repeated
    rows are scored each; an empty table gives no rows. Columns other than doc_id and text are ignored.
    Nothing is shuffled; the model (a fixed half megabyte) is broadcast.
    """
    tune(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield arrow_rows(SCORES, doc_id=b.column(0), score=shared.value.score(b.column(1).to_pylist()))

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, score double")


def kept_documents(spark: SparkSession, docs: DataFrame, model: SubwordModel, threshold: float) -> DataFrame:
    """The rows of docs whose score is below the threshold, with docs' columns; works row by row, ids may repeat."""
    tune(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([s < threshold for s in shared.value.score(b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def scored_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from the threshold on) of every document, by a model fitted here."""
    scores = toxicity(spark, docs, fit(docs, labels, train_rows))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
