"""Best ``k`` of a corpus for each of many queries, without a pair table.

Each task scores the rows it holds against a block of queries and keeps the best
``k`` per query, so what is shuffled is ``k`` rows per query and task. A batch of
queries that is small enough goes to the tasks as a broadcast and the corpus is
not moved at all; a larger batch is cut into blocks that meet blocks of the
corpus in a co-grouped shuffle. How a block is scored is up to the scorer.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewright.session import materialise

# Scores and distances are compared in billionths; equal ones go by the ids.
UNITS = 1e9

CORPUS_BLOCK = 50_000
# Blocks in a shuffle may be this many times larger than a broadcast, which every
# task holds: the larger the query blocks, the fewer copies of the corpus meet them.
SHUFFLE_BLOCKS = 8
_BUFFER_ROWS = 100_000


class Scorer(Protocol):
    """Scores corpus rows against query rows that were prepared once per task."""

    query_columns: Sequence[str]
    corpus_columns: Sequence[str]

    def narrow(self, corpus: DataFrame, query_rows: pa.Table) -> DataFrame:
        """``corpus`` without what cannot score against a broadcast block of queries."""

    def prepare(self, query_rows: pa.Table) -> tuple[pa.Array, Any]:
        """The ids of the queries, in the order scores refer to them, and a state."""

    def slice_rows(self, state: Any) -> int:
        """How many corpus rows to score at once."""

    def best(self, state: Any, part: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, rows of ``part`` and keys (least is best) of the best ``k``
        per query; equal keys go by position in ``part``."""


class _Best:
    """The best ``k`` rows per query so far."""

    def __init__(self, ids: Sequence[str], k: int) -> None:
        self.order = [(name, "ascending") for name in ("query_no", "key", *ids)]
        self.k = k
        self.parts: list[pa.Table] = []
        self.rows = self.settled = 0

    def add(self, part: pa.Table) -> None:
        self.parts.append(part)
        self.rows += part.num_rows
        if self.rows > _BUFFER_ROWS + 4 * self.settled:
            self.parts = [self.result()]
            self.rows = self.settled = self.parts[0].num_rows

    def result(self) -> pa.Table:
        table = pa.concat_tables(self.parts).sort_by(self.order)
        numbers = table["query_no"].to_numpy()
        place = np.arange(len(numbers)) - np.searchsorted(numbers, numbers, side="left")
        return table.filter(pa.array(place < self.k))


def _scan(
    tables: Iterable[pa.Table], query_rows: pa.Table, ids: Sequence[str], k: int, scorer: Scorer
) -> pa.Table | None:
    query_ids, state = scorer.prepare(query_rows)
    step = scorer.slice_rows(state)
    best = _Best(ids, k)
    for table in tables:
        for at in range(0, table.num_rows, step):
            part = table.slice(at, step).sort_by([(name, "ascending") for name in ids])
            numbers, rows, keys = scorer.best(state, part, k)
            picked = part.select(list(ids)).take(pa.array(rows))
            best.add(
                picked.append_column("query_no", pa.array(numbers, pa.int64())).append_column(
                    "key", pa.array(keys, pa.int64())
                )
            )
    if not best.parts:
        return None
    found = best.result()
    found = found.append_column("query_id", query_ids.take(found["query_no"]))
    return found.select(["query_id", *ids, "key"])


def first_k(keys: np.ndarray, numbers: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` least keys per query number, equal ones by row."""
    order = np.lexsort((rows, keys, numbers))
    grouped = numbers[order]
    place = np.arange(len(order)) - np.searchsorted(grouped, grouped, side="left")
    return order[place < k]


def best_scores(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, columns and keys of the ``k`` largest positive scores per row, equal ones by column."""
    keys = -np.floor(scores * UNITS + 0.5).astype(np.int64)
    if scores.shape[1] > k:
        limit = np.partition(keys, k - 1, axis=1)[:, k - 1 : k]
        numbers, rows = np.nonzero((keys <= limit) & (scores > 0))
    else:
        numbers, rows = np.nonzero(scores > 0)
    keys = keys[numbers, rows]
    keep = first_k(keys, numbers, rows, k)
    return numbers[keep], rows[keep], keys[keep]


def _broadcast(
    head: pa.Table, corpus: DataFrame, schema: T.StructType, ids: Sequence[str], k: int, scorer: Scorer
) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = (pa.Table.from_batches([batch]) for batch in batches)
        found = _scan(tables, shared.value, ids, k, scorer)
        if found is not None:
            yield from found.to_batches()

    return corpus.mapInArrow(run, schema)


def _cogroup(
    queries: DataFrame,
    corpus: DataFrame,
    schema: T.StructType,
    ids: Sequence[str],
    k: int,
    scorer: Scorer,
    block: int,
) -> DataFrame:
    """Both sides cut into blocks by hash; each pair of blocks meets in one group."""
    query_blocks = max(1, math.ceil(queries.count() / (SHUFFLE_BLOCKS * block)))
    corpus_blocks = max(1, math.ceil(corpus.count() / CORPUS_BLOCK))
    left = queries.withColumns(
        {
            "qb": F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)),
            "cb": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(corpus_blocks - 1).cast("long"))),
        }
    )
    right = corpus.withColumns(
        {
            "cb": F.pmod(F.xxhash64(*ids), F.lit(corpus_blocks)),
            "qb": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))),
        }
    )

    def run(query_rows: pa.Table, corpus_rows: pa.Table) -> pa.Table:
        found = None
        if query_rows.num_rows and corpus_rows.num_rows:
            found = _scan([corpus_rows], query_rows, ids, k, scorer)
        if found is not None:
            return found
        nothing = {"query_id": query_rows["query_id"].slice(0, 0)}
        nothing.update({name: corpus_rows[name].slice(0, 0) for name in ids})
        return pa.table({**nothing, "key": pa.array([], pa.int64())})

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(run, schema)


def blockwise_topk(
    queries: DataFrame,
    corpus: DataFrame,
    ids: Sequence[str],
    k: int,
    scorer: Scorer,
    max_broadcast_rows: int,
) -> DataFrame:
    """``query_id, *ids, key, rank`` with the ``k`` least keys per query.

    A query may take several rows; all rows of one query share its block.
    """
    query_side = queries.select("query_id", *scorer.query_columns)
    corpus_side = corpus.select(*ids, *scorer.corpus_columns)
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            *[T.StructField(name, corpus.schema[name].dataType) for name in ids],
            T.StructField("key", T.LongType()),
        ]
    )
    head = query_side.limit(max_broadcast_rows + 1).toArrow()
    if head.num_rows == 0:
        found = corpus.sparkSession.createDataFrame([], schema)
    elif head.num_rows <= max_broadcast_rows:
        found = _broadcast(head, scorer.narrow(corpus_side, head), schema, ids, k, scorer)
    else:
        query_side = materialise(query_side, "query-rows")
        found = _cogroup(query_side, corpus_side, schema, ids, k, scorer, max_broadcast_rows)
    order = Window.partitionBy("query_id").orderBy("key", *ids)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
