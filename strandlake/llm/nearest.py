"""Nearest neighbours by a block matrix join of int8 codes with error bounds.

Each vector is coded as integers from -127 to 127 times a scale of its own. The product of two codes times
both scales is the inner product up to an error that the codes' residues bound (Cauchy-Schwarz). A pair whose
upper bound doesn't reach the k-th best lower bound so far is out; the others are computed from the original
vectors, and heaps keep the best. So no neighbour is lost, whatever the codes' precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .vector_blocks import STRIP, Heaps, every, found_schema, grid, ranked, table_of, tiles, usable_vectors

FOUND = found_schema(pa.float64())


def int8_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the norms of what the codes stand for and of what they leave out."""
    top = np.abs(x).max(1)
    scale = np.where(top > 0, top, 1) / 127.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of q with the rows of x in double precision, summed from the first component to the last."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += q[k] * x[:, k]
    return total


def search_block(ids, queries, stream, k: int) -> Heaps:
    """The k nearest of each query in a stream of tiles.

    A block's queries are taken in strips, so that the bounds of a tile stay within some tens of megabytes.
    """
    heaps = Heaps(len(ids), k, np.float64)
    q_codes, q_scale, q_norm, q_rest = int8_codes(queries)
    # Products of int8 codes are whole numbers below 2**24 for up to 1040 components, so float32 holds them exactly.
    kind = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64
    left = q_codes.astype(kind)
    for v_ids, x in stream:
        codes, scale, norm, rest = int8_codes(x)
        right = codes.astype(kind).T
        for begin in range(0, len(ids), STRIP):
            s = slice(begin, begin + STRIP)
            own = ids[s, None, 0] == v_ids[None, :, 0]
            rough = (left[s] @ right).astype(np.float64) * q_scale[s, None] * scale[None, :]
            error = q_norm[s, None] * rest[None, :] + q_rest[s, None] * (norm + rest)[None, :]
            error += 1e-9 * (np.abs(rough) + error) + 1e-300
            low = np.where(own, -np.inf, rough - error)
            bar = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)
            bar = np.maximum(bar, heaps.floors(s))
            rows, cols = np.nonzero(~(rough + error < bar[:, None]) & ~own)
            cuts = np.searchsorted(rows, np.arange(len(low) + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                near = cols[cuts[i] : cuts[i + 1]]
                heaps.push(begin + i, exact_products(queries[begin + i], x[near]), v_ids[near])
    return heaps


def nearest_neighbours(vectors: DataFrame, k: int = 20, query_every: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: the k vectors with the largest inner product for each query.

    Queries are the rows whose vec_id is divisible by ``query_every``; candidates are all rows but the query's own.
    Ties go to the smaller vec_id. With fewer candidates than k all are returned, and a query without any gives
    no row. Vectors without an id, null or empty ones, zero ones, and those that hold null, NaN or infinity take
    no part; vectors of different lengths don't meet. Rows that repeat a vec_id are rows like others: each is a
    candidate, also of the others, and each is a query, with ranks of its own. Columns other than vec_id and
    embedding are ignored. Codes are made where tiles meet, which is a query block's part of a product's work.
    """
    table = usable_vectors(vectors, zero_counts=False)

    def run(batches):
        for ids, queries, _, stream in tiles(batches):
            yield table_of(FOUND, ids, search_block(ids, queries, stream, k))

    found = grid(table.filter(every(query_every)), table).mapInArrow(run, "_query long, query_id long, _row long, vec_id long, score double")
    return ranked(found, k).drop("_query")
