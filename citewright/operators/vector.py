"""Exact nearest neighbours by L2 distance, for a whole batch of queries."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.operators.blocks import UNITS, blockwise_topk, first_k

MAX_BROADCAST_QUERIES = 4096
_CELLS = 8_000_000
_PAIRS = 65_536


def _matrix(column: pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """A list column as a float64 matrix; all rows must have the same size."""
    flat = column.combine_chunks()
    sizes = np.unique(flat.value_lengths().to_numpy(zero_copy_only=False)) if len(flat) else []
    if len(sizes) > 1 or (dims is not None and len(sizes) and sizes[0] != dims):
        raise ValueError(f"embedding sizes {list(sizes)} do not match {dims}")
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else np.zeros((0, dims or 0))


def _exact_keys(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of the given pairs, summed directly."""
    out = np.empty(len(rows), dtype=np.int64)
    for a in range(0, len(rows), _PAIRS):
        b = a + _PAIRS
        diff = q[rows[a:b]] - x[cols[a:b]]
        out[a:b] = np.floor(np.sqrt((diff * diff).sum(axis=1)) * UNITS + 0.5)
    return out


def nearest(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the ``k`` nearest of ``x``, equal ones by position in ``x``.

    The matrix product only narrows the candidates: its rounding error is bounded,
    so whatever could still be among the best ``k`` is measured again directly.
    """
    squares = (x * x).sum(axis=1)
    rough = (q * q).sum(axis=1)[:, None] + squares[None, :] - 2.0 * (q @ x.T)
    if x.shape[0] > k:
        scale = 1.0 + float(rough.max(initial=0.0)) + float(squares.max(initial=0.0))
        slack = scale * (1e-11 + 4 / UNITS)
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero(rough <= limit + slack)
    else:
        rows, cols = np.nonzero(np.ones(rough.shape, dtype=bool))
    keys = _exact_keys(q, x, rows, cols)
    keep = first_k(keys, rows, cols, k)
    return rows[keep], cols[keep], keys[keep]


class _L2:
    query_columns = ("embedding",)
    corpus_columns = ("embedding",)

    def narrow(self, corpus: DataFrame, query_rows: pa.Table) -> DataFrame:
        return corpus

    def prepare(self, query_rows: pa.Table) -> tuple[pa.Array, np.ndarray]:
        return query_rows["query_id"].combine_chunks(), _matrix(query_rows["embedding"])

    def slice_rows(self, state: np.ndarray) -> int:
        return min(2048, max(64, _CELLS // max(len(state), 1)))

    def best(self, state: np.ndarray, part: pa.Table, k: int):
        return nearest(state, _matrix(part["embedding"], state.shape[1]), k)


def vector_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    ids: Sequence[str] = ("accession", "start_offset"),
    max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
) -> DataFrame:
    """``query_id, *ids, vector_rank, vector_distance`` of the ``k`` nearest per query.

    ``queries`` has ``query_id`` and ``embedding``; ``corpus`` has ``ids``, which
    order equal distances, and ``embedding``.
    """
    found = blockwise_topk(queries, corpus, ids, k, _L2(), max_broadcast_queries)
    return found.select(
        "query_id",
        *ids,
        F.col("rank").alias("vector_rank"),
        (F.col("key") / F.lit(UNITS)).alias("vector_distance"),
    )
