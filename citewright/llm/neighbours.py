"""Approximate nearest neighbours along shifted Hilbert curves.

Vectors are projected at random to a few dimensions, shifted, and put in the order of
a Hilbert curve; several curves, each with its own projection and shift, are range
partitioned and sorted by Spark. A curve is cut into blocks of equal size. A query
is compared exactly with the vectors of its block and of the blocks on both sides,
on every curve; the best of all windows are merged and ranked by distance.

How far a window reaches follows from the number of entries, by one rule at every
size: the windows of a query on all curves hold as many entries together, repeats
counted, as the table. Where neighbours are hardly nearer than the rest, recall
depends on the share of the table that is seen, so a fixed window would lose it as
the table grows. Blocks grow up to what a task holds, then a window takes more of them.

Every row is in the index. Equal vectors are one entry of it with the least ids
that carry it, so a vector that a third of all rows share is neither a large block
nor a lost tie. Blocks hold the same number of entries whatever the data are.

* Vectors that are null, zero, or hold a null, NaN or infinite component take no
  part, neither do those whose length is not the most common one (of two such, the
  smaller). Neither do rows without an id.
* Equal distances go to the smaller id; of rows with the same id and vector one
  counts, of those with the same id and different vectors the nearer one.
* A query has fewer than ``k`` rows only if there are fewer other rows in its
  windows. Empty tables give none. Only the id and the vector are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewright.llm.shared import partitions_for, written

CURVES = 16
DIMENSIONS = 6
BITS = 8
# Entries of a block, least and most; a query sees its own and ``reach`` blocks on each side of a curve.
BLOCK = 2_048
MOST_IN_BLOCK = 32_768
# Entries in all windows of a query together, by those of the table.
COVER = 1.0
# Coordinates beyond so many standard deviations lie on the border of the curve's cube.
REACH = 3.0
# The share of the cube that shifts take up.
SHIFT = 0.25
SEED = 7


def windows_for(entries: int, curves: int) -> tuple[int, int]:
    """``block, reach``: entries of a block, and blocks on each side of a query's own that it sees."""
    window = COVER * entries / curves
    block = min(MOST_IN_BLOCK, max(BLOCK, math.ceil(window / 3)))
    return block, max(1, math.ceil((window / block - 1) / 2))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of cells (rows of coordinates below ``2**bits``) along a Hilbert curve.

    The cube is walked from coarse to fine; at each level the axes are exchanged or
    reflected as the curve turns, and the bits left are a Gray code of the place.
    """
    axes = [column.astype(np.uint64) for column in cells.T]
    zero = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for n, axis in enumerate(axes):
            turned = (axis & bit) != 0
            swap = np.where(turned, zero, (axes[0] ^ axis) & below)
            axes[0] = np.where(turned, axes[0] ^ below, axes[0] ^ swap)
            if n:
                axes[n] = axis ^ swap
    for n in range(1, len(axes)):
        axes[n] = axes[n] ^ axes[n - 1]
    flip = zero
    for level in range(bits - 1, 0, -1):
        flip = np.where((axes[-1] & np.uint64(1 << level)) != 0, flip ^ np.uint64((1 << level) - 1), flip)
    key = zero
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << np.uint64(1)) | (((axis ^ flip) >> np.uint64(level)) & np.uint64(1))
    return key.view(np.int64)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vector``: the rows that take part."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), "length").first()
    return rows.filter(F.size("vector") == (first["length"] if first else 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _moments(entries: DataFrame, projections: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of every projected coordinate, over all entries."""
    width = projections.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, squares = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            values = _matrix(batch.column("vector"), len(projections)) @ projections
            count += len(values)
            total += values.sum(axis=0)
            squares += (values**2).sum(axis=0)
        at = pa.array(range(width), pa.int32())
        sizes = pa.array([count] * width, pa.int64())
        yield pa.RecordBatch.from_arrays([at, sizes, pa.array(total), pa.array(squares)], names=["at", "n", "s", "q"])

    sums = entries.select("vector").mapInArrow(run, "at int, n long, s double, q double")
    rows = sums.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("at")
    found = rows.toPandas()  # one row per coordinate
    mean = found.s.to_numpy() / found.n.to_numpy()
    return mean, np.sqrt(np.maximum(found.q.to_numpy() / found.n.to_numpy() - mean**2, 1e-30))


def curve_places(entries: DataFrame, width: int, curves: int, dimensions: int, bits: int, size: int) -> DataFrame:
    """``curve, block, entry, is_query, vector``: every entry on every curve, in blocks of ``size``."""
    rng = np.random.default_rng(SEED)
    projections = rng.standard_normal((width, curves * dimensions))
    shifts = rng.random(curves * dimensions) * SHIFT
    mean, spread = _moments(entries, projections)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                unit = ((_matrix(part.column("vector"), width) @ projections - mean) / spread / REACH + 1) / 2
                place = np.clip(unit, 0, 1) * (1 - SHIFT) + shifts
                cells = np.minimum(place * (1 << bits), (1 << bits) - 1).astype(np.int64)
                for curve in range(curves):
                    keys = hilbert_keys(cells[:, curve * dimensions : (curve + 1) * dimensions], bits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), curve, np.int32)), pa.array(keys), *part.columns],
                        names=["curve", "key", *part.schema.names],
                    )

    spark = entries.sparkSession
    keyed = entries.select("entry", "is_query", "vector").mapInArrow(
        run, "curve int, key long, entry long, is_query boolean, vector array<double>"
    )
    order = ["curve", "key", "entry"]
    sorted_ = keyed.repartitionByRange(partitions_for(spark), *order).sortWithinPartitions(*order)
    numbered = sorted_.select(
        "curve", "entry", "is_query", "vector",
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"),
    )
    numbered = written(numbered, "curves")
    # A row for each partition and curve in it, to count on from one to the next.
    parts = numbered.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("curve").orderBy("part")) - F.col("n")
    parts = parts.select("curve", "part", (before - F.col("first")).alias("offset"))
    placed = numbered.join(F.broadcast(parts), ["curve", "part"])
    block = F.floor((F.col("at") + F.col("offset")) / size)
    return placed.select("curve", block.alias("block"), "entry", "is_query", "vector")


def _best_in_blocks(places: DataFrame, k: int, reach: int) -> DataFrame:
    """``query, entry, score``: the ``k`` nearest entries of each block to the queries that see it."""
    around = F.sequence(F.col("block") - reach, F.col("block") + reach)
    asked = places.filter("is_query").select(
        F.col("curve").alias("on"),
        F.explode(around).alias("seen"),
        F.col("entry").alias("query"),
        F.col("vector").alias("wanted"),
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, found, scores = [], [], []
        if left.num_rows and right.num_rows:
            width = len(right["vector"][0])
            entries = right["entry"].to_numpy()
            vectors = _matrix(right["vector"].combine_chunks(), width)
            for query, vector in zip(left["query"].to_numpy(), _matrix(left["wanted"].combine_chunks(), width)):
                score = np.sqrt(((vectors - vector) ** 2).sum(axis=1))
                best = np.lexsort((entries, score))[:k]
                queries.append(np.full(len(best), query))
                found.append(entries[best])
                scores.append(score[best])
        join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"query": join(queries, pa.int64()), "entry": join(found, pa.int64()), "score": join(scores, pa.float64())})

    entries = places.select("curve", "block", "entry", "vector")
    return asked.groupBy("on", "seen").cogroup(entries.groupBy("curve", "block")).applyInArrow(
        run, "query long, entry long, score double"
    )


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    curves: int = CURVES,
    dimensions: int = DIMENSIONS,
    bits: int = BITS,
) -> DataFrame:
    """``query_id, rank, key, score``: the ``k`` nearest rows found of every row that ``is_query``
    (a condition on the key, as column ``id``), itself excepted."""
    rows = usable(vectors, key, vector).distinct()
    # The least ids of each different vector: k others and the query itself.
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    members = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    members = written(members.withColumn("entry", F.first("id").over(Window.partitionBy("vector").orderBy("id"))), "members")
    queries = rows.filter(is_query)
    entries = members.filter("place = 1").select(F.col("id").alias("entry"), "vector")
    asked = queries.select("vector").distinct().withColumn("is_query", F.lit(True))
    entries = written(
        entries.join(asked, "vector", "left").select("entry", "vector", F.coalesce("is_query", F.lit(False)).alias("is_query")),
        "entries",
    )
    # A row may share its id with one of another vector; an entry is then named by both.
    held = entries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    empty = f"query_id long, rank int, `{key}` long, score double"
    if not held["n"]:
        return vectors.sparkSession.createDataFrame([], empty)
    size, reach = windows_for(held["n"], curves)
    found = _best_in_blocks(curve_places(entries, held["width"], curves, dimensions, bits, size), k + 1, reach)
    found = found.groupBy("query", "entry").agg(F.min("score").alias("score"))
    nearer = Window.partitionBy("query").orderBy("score", "entry")
    best = found.withColumn("n", F.row_number().over(nearer)).filter(F.col("n") <= k + 1)
    hits = best.join(members.select("entry", "id"), "entry").select("query", "id", "score")
    of = queries.join(entries.select(F.col("entry").alias("query"), "vector"), "vector").select("query", F.col("id").alias("query_id"))
    pairs = of.join(hits, "query").filter(F.col("id") != F.col("query_id"))
    pairs = pairs.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score"
    )
