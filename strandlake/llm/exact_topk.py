"""Exact top-k search by a three-phase uniform threshold.

A vector's components are split into lists (segments); a pair's score is the sum of its lists' partial scores.
Phase 1: every slice gathers the best entries of each list, resolves them and sends its k best for each query; the
k-th best of all is a safe cutoff, as k candidates reach it. Phase 2: the cutoff, split evenly over the lists,
travels with the query to every slice. A candidate below its share in every list can't reach the cutoff and is
left out; the others are sufficient, and have an upper bound: the lists that reach the share as they are and the
share for each that doesn't. Phase 3: the slice's own k-th best raises the cutoff as it goes; candidates whose bound
reaches that are resolved exactly where they lie, and slices send at most k of them for each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vector_blocks import STRIP, Heaps, every, found_schema, grid, ranked, table_of, tiles, usable_vectors

FOUND = found_schema(pa.int64())
LISTS = 4
#: Largest and smallest 64-bit integers; scores beyond them are held at these.
TOP, BOTTOM = (1 << 63) - 1, -(1 << 63)


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of double components, held at the largest double where that is beyond it."""
    most = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(256.0 * x), -most, most)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of q with the rows of x: exact, and held at the ends of the 64-bit range."""
    with np.errstate(over="ignore"):
        reach = float(np.abs(q).max() * np.abs(x).max() * len(q)) if len(x) else 0.0
    if reach < 2.0**53:
        return (x @ q).astype(np.int64)
    left = [int(c) for c in q]
    return np.array([min(TOP, max(BOTTOM, sum(a * int(b) for a, b in zip(left, row, strict=True)))) for row in x.tolist()], np.int64)


def segments(dim: int) -> list[slice]:
    """The lists: up to LISTS runs of components of about equal length."""
    cuts = np.linspace(0, dim, min(LISTS, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def slack(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How far a rounded partial score of each query can be from the true one; 0 while sums stay below 2**53."""
    with np.errstate(over="ignore"):
        reach = np.abs(q).max(1) * np.abs(x).max() * q.shape[1]
        return np.where(reach < 2.0**53, 0.0, reach * q.shape[1] * 2.0**-50)


def gather(ids, queries, stream, k: int) -> Heaps:
    """Phase 1 in a slice: the k best of the entries that lead in some list."""
    heaps, lists = Heaps(len(ids), k, np.int64), segments(queries.shape[1])
    for v_ids, x in stream:
        for begin in range(0, len(ids), STRIP):
            q = queries[begin : begin + STRIP]
            own = ids[begin : begin + STRIP, None, 0] == v_ids[None, :, 0]
            leads = []
            for part in lists:
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = np.where(own, -np.inf, q[:, part] @ x[:, part].T)
                n = min(k, scores.shape[1])
                leads.append(np.argpartition(scores, -n, axis=1)[:, -n:])
            for i, row in enumerate(np.concatenate(leads, axis=1)):
                row = np.unique(row)
                row = row[~own[i, row]]
                heaps.push(begin + i, exact_scores(q[i], x[row]), v_ids[row])
    return heaps


def resolve(ids, queries, cutoffs, stream, k: int) -> Heaps:
    """Phases 2 and 3 in a slice: candidates that the uniform threshold can't exclude, resolved; the k best.

    Tests are written so that a sum that overflows (NaN) excludes nothing.
    """
    heaps, lists = Heaps(len(ids), k, np.int64), segments(queries.shape[1])
    for v_ids, x in stream:
        for begin in range(0, len(ids), STRIP):
            s = slice(begin, begin + STRIP)
            q, spare, raised = queries[s], slack(queries[s], x), np.maximum(cutoffs[s], heaps.floors(s))
            share = cutoffs[s] / len(lists)
            bound, out = np.zeros((len(q), len(x))), np.ones((len(q), len(x)), bool)
            with np.errstate(over="ignore", invalid="ignore"):
                for part in lists:
                    scores = q[:, part] @ x[:, part].T + spare[:, None]
                    below = scores < share[:, None]
                    out &= below
                    bound += np.where(below, share[:, None], scores)
                fits = ~out & ~(bound < (raised - 1e-6 * np.abs(raised))[:, None])
            rows, cols = np.nonzero(fits & (ids[s, None, 0] != v_ids[None, :, 0]))
            cuts = np.searchsorted(rows, np.arange(len(q) + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                near = cols[cuts[i] : cuts[i + 1]]
                heaps.push(begin + i, exact_scores(q[i], x[near]), v_ids[near])
    return heaps


def exact_topk(vectors: DataFrame, k: int = 5, query_every: int = 50) -> DataFrame:
    """query_id, rank, vec_id and score: the k highest integer inner products for each query.

    Each component x counts as floor(256 * x), held at the largest double. Queries are the rows whose vec_id is
    divisible by ``query_every``; candidates are all rows but the query's own, ties go to the smaller vec_id, and with
    fewer candidates than k all are returned. Vectors without an id, null or empty ones, and those that hold null, NaN
    or infinity take no part; zero vectors do. Vectors of different lengths don't meet. Rows that repeat a vec_id
    are rows like others: each is a candidate, also of the others, and each is a query, with ranks of its own. Scores
    beyond 64 bits are held at the ends of that range. Columns other than vec_id and embedding are ignored.
    """
    table = usable_vectors(vectors, zero_counts=True)
    queries = table.filter(every(query_every))

    def phase1(batches):
        for ids, q, _, stream in tiles(batches):
            yield table_of(FOUND, ids, gather(ids, whole_numbers(q), ((d, whole_numbers(x)) for d, x in stream), k))

    def phase23(batches):
        for ids, q, extra, stream in tiles(batches, ["cutoff"]):
            # A query with fewer than k gathered entries has no cutoff: everything is sufficient then.
            cutoffs = np.where(np.isnan(extra[0].astype(float)), -np.inf, extra[0].astype(float))
            yield table_of(FOUND, ids, resolve(ids, whole_numbers(q), cutoffs, ((d, whole_numbers(x)) for d, x in stream), k))

    kind = "_query long, query_id long, _row long, vec_id long, score long"
    gathered = ranked(grid(queries, table).mapInArrow(phase1, kind), k)
    cutoffs = gathered.filter(F.col("rank") == k).select("_query", F.col("score").alias("cutoff"))
    armed = stored(queries.join(cutoffs, F.col("_row") == F.col("_query"), "left").drop("_query"), "cutoffs")
    return ranked(grid(armed, table, ["cutoff"]).mapInArrow(phase23, kind), k).drop("_query")
