"""A stored inverted index and exact BM25 top-k over it, as joins.

The index holds one row per term and block of chunks: the entries of the block that have
the term, and what bounds their gain (the largest count, the shortest chunk). An entry
names its chunk by its place in the block; one more row per block, without a term, holds
the keys and lengths of its chunks, so that neither is repeated per term. Rows are
partitioned by a hash of the term and sorted by it, so a question reads its terms' rows
only; a common term has as many rows as there are blocks, and they are dealt to many
tasks when the index is built and when it is read.

All entries of a chunk are in its block, so a block is scored as a whole, against all
queries at once, and gives the ``k`` best chunks per query: what is shuffled are the
entries of asked terms, once, and ``k`` rows per query and block.

A query ranks blocks by the sum of its terms' bounds, which needs no entries. The blocks
of the largest bounds are scored first; the ``k``-th score there is a floor. Other blocks
are scored only where their bound reaches the floor, so nothing is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from citewright.operators.blocks import UNITS, best_scores
from citewright.session import MAX_BROADCAST_ROWS, materialise

# Chunks of a block, which places of two bytes must hold, and partitions by term.
BLOCK = 10_000
TERM_BUCKETS = 16
# Tasks that share the building of one of those partitions: so many at least, and one more per so many chunks.
SHARES = 4
SHARE_CHUNKS = 400_000
# Blocks of the largest bounds that set the floor.
FIRST = 2
# Terms of queries that meet one block at once, and scores held at once.
MAX_PAIRS = 100_000
_CELLS = 4_000_000


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def _block(part: pa.Table, number: int, ids: Sequence[str], by: Sequence[str]) -> pa.RecordBatch:
    """A row per term of one block of chunks, its entries by chunk, and a last one of its keys."""
    lists = part["terms"].combine_chunks()
    coded = lists.flatten().dictionary_encode()
    rows = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    pairs = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * part.num_rows + rows
    pairs, times = np.unique(pairs, return_counts=True)
    codes, rows = np.divmod(pairs, max(1, part.num_rows))
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    tf, n_terms = times.astype(np.int32), part["n_terms"].to_numpy()[rows].astype(np.int32)
    ends = pa.array(np.append(starts, len(codes)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(values)) for values in (rows.astype(np.int16), tf)]
    fields = {name: part[name].combine_chunks() for name in (*ids, "n_terms")}
    keys = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    made = len(starts)
    last = lambda values, value: pa.concat_arrays([values, pa.array([value], values.type)])
    columns = {name: part[name].combine_chunks().slice(0, 1).take(pa.array(np.zeros(made + 1, np.int32))) for name in by}
    columns |= {
        "term": last(coded.dictionary.take(pa.array(codes[starts])), None),
        "block": pa.array(np.full(made + 1, number, np.int64)),
        "df": last(pa.array(np.diff(np.append(starts, len(codes)))), 0),
        "max_tf": last(pa.array(np.maximum.reduceat(tf, starts) if made else tf), None),
        "min_terms": last(pa.array(np.minimum.reduceat(n_terms, starts) if made else n_terms), None),
        "keys": pa.concat_arrays([
            pa.nulls(made, pa.list_(keys.type)),
            pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), keys),
        ]),
        "entries": last(pa.StructArray.from_arrays(lists, names=["row", "tf"]), None),
    }
    return pa.RecordBatch.from_pydict(columns)


def posting_blocks(chunks: DataFrame, ids: Sequence[str], *by: str) -> DataFrame:
    """``*by, term_bucket, term, block, df, max_tf, min_terms, keys, entries`` of ``chunks``
    with ``ids``, ``terms`` and ``n_terms``.

    A block is a run of chunks as a task reads them, all of one value of ``by``, so it is
    complete where it is made, and nothing is shuffled.
    """
    rows = chunks.select(*by, *ids, F.col("n_terms").cast("int").alias("n_terms"), "terms")
    key = T.StructType([*(rows.schema[name] for name in ids), T.StructField("n_terms", T.IntegerType())])
    entry = T.StructType().add("row", T.ArrayType(T.ShortType())).add("tf", T.ArrayType(T.IntegerType()))
    schema = T.StructType([rows.schema[name] for name in by])
    for name, kind in (("term", "string"), ("block", "long"), ("df", "long"), ("max_tf", "integer"), ("min_terms", "integer")):
        schema = schema.add(name, kind)
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            table = pa.Table.from_batches([batch])
            parts = [table]
            for name in by:
                parts = [part.filter(pc.equal(part[name], value)) for part in parts for value in part[name].unique()]
            for part in parts:
                for at in range(0, part.num_rows, most):
                    yield _block(part.slice(at, most), number, ids, by)
                    number += 1

    made = rows.mapInArrow(run, schema.add("keys", T.ArrayType(key)).add("entries", entry))
    # Rows of keys have no term and are dealt by their block.
    return made.withColumn("term_bucket", term_bucket(F.coalesce("term", F.col("block").cast("string"))))


def dealt(made: DataFrame, n_chunks: int) -> DataFrame:
    """Rows of the index, those of a part of the terms together and sorted by term.

    The number of tasks grows with the chunks, so that each sorts a bounded share.
    """
    shares = max(SHARES, math.ceil(n_chunks / SHARE_CHUNKS))
    by_term = made.repartition(TERM_BUCKETS * shares, "term_bucket", F.pmod(F.xxhash64("block"), F.lit(shares)))
    return by_term.sortWithinPartitions("term_bucket", "term", "block")


def directory(postings: DataFrame) -> DataFrame:
    """The rows of keys, one per block."""
    return postings.filter(F.col("term").isNull()).drop("term", "entries", "df", "max_tf", "min_terms")


def gain(tf: Column, n_terms: Column, mean_terms: Column, k1: float, b: float) -> Column:
    length = F.lit(1.0 - b) + F.lit(b) * n_terms / mean_terms
    return tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * length)


def reaching(ranked: DataFrame, floors: DataFrame) -> DataFrame:
    """Blocks after the first whose bound reaches the floor of their query, where it has one."""
    # One unit of room, since sums of the same numbers may differ in their last digits.
    reach = -F.floor(F.col("bound") * UNITS + 0.5) - 1
    rest = ranked.filter(F.col("place") > FIRST).join(floors, "query_id")
    return rest.filter(F.col("floor").isNull() | (reach <= F.col("floor")))


def _scorer(ids: Sequence[str], schema: pa.Schema, k: int, k1: float, b: float, single: bool, again: bool):
    """Scores one block: its row of keys and the rows of the terms that are asked there."""

    def run(table: pa.Table) -> pa.Table:
        lists = table.filter(pc.is_valid(table["entries"]))
        held = table.filter(pc.is_valid(table["keys"]))
        if not lists.num_rows or not held.num_rows:
            return schema.empty_table()
        keys = held["keys"].combine_chunks().flatten()
        named = pa.table({name: keys.field(name) for name in ids})
        # Chunks in the order of their keys, which ranks equal scores.
        order = pc.sort_indices(named, [(name, "ascending") for name in ids], null_placement="at_start")
        place = np.empty(len(keys), np.int64)
        place[order.to_numpy()] = np.arange(len(keys))
        entries = lists["entries"].combine_chunks()
        rows = entries.field("row").flatten().to_numpy().astype(np.int64)
        tf = entries.field("tf").flatten().to_numpy()
        sizes = entries.field("row").value_lengths().to_numpy()
        n_terms = keys.field("n_terms").to_numpy(zero_copy_only=False)[rows]
        gains = tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * n_terms / lists["mean_terms"][0].as_py()))
        rows, first = place[rows], np.append(0, np.cumsum(sizes))
        pairs = lists["asked"].combine_chunks()
        asked = np.append(0, np.cumsum(pairs.value_lengths().to_numpy()))
        queries = pairs.flatten().field("query_id").dictionary_encode(null_encoding="encode")
        weights = pairs.flatten().field("weight").to_numpy()
        codes, queries = queries.indices.to_numpy(zero_copy_only=False), queries.dictionary
        wanted = np.ones(len(queries), bool)
        if held["only"][0].is_valid:
            wanted = pc.is_in(queries, value_set=held["only"][0].values).to_numpy(zero_copy_only=False)
        repeated = np.zeros(len(keys), bool)
        if held["again"][0].is_valid:
            repeated[place[held["again"][0].values.to_numpy()]] = True
        step = max(1, _CELLS // len(keys))
        found = []
        for low in range(0, len(queries), step):
            scores = np.zeros((min(step, len(queries) - low), len(keys)))
            for term in range(len(sizes)):
                numbers, weight = codes[asked[term] : asked[term + 1]] - low, weights[asked[term] : asked[term + 1]]
                mine = (numbers >= 0) & (numbers < len(scores))
                here = slice(first[term], first[term + 1])
                scores[numbers[mine][:, None], rows[here]] += weight[mine][:, None] * gains[here]
            scores[~wanted[low : low + step]] = 0
            if again and repeated.any():
                numbers, at = np.nonzero((scores > 0) & repeated)
                found.append((numbers + low, at, scores[numbers, at]))
            if single:
                scores[:, repeated] = 0
                numbers, at, _ = best_scores(scores, k)
                found.append((numbers + low, at, scores[numbers, at]))
        if not found:
            return schema.empty_table()
        numbers, at, scores = (np.concatenate(parts) for parts in zip(*found))
        picked = named.take(order.take(pa.array(at)))
        columns = [queries.take(pa.array(numbers)), *(picked[name] for name in ids), pa.array(scores)]
        return pa.table(columns, names=["query_id", *ids, "score"]).cast(schema)

    return run


def postings_topk(
    weighted: DataFrame,
    postings: DataFrame,
    blocks: DataFrame,
    ids: Sequence[str],
    k: int,
    k1: float,
    b: float,
    *by: str,
    prune: bool = True,
    repeated: DataFrame | None = None,
) -> DataFrame:
    """``query_id, *ids, key, rank`` of the ``k`` best chunks per query.

    ``weighted`` has ``query_id, term, weight, mean_terms``; ``postings`` may be narrowed to
    its terms, ``blocks`` is the ``directory`` of all. ``by`` names columns that keep blocks
    of equal number apart. Without ``prune`` every entry of an asked term is scored, which
    takes two passes less. ``repeated`` has the ``ids`` that several chunks share, if any do:
    those are one chunk whose score is the sum, wherever their blocks are.
    """
    place = [*by, "block"]
    best = Window.partitionBy("query_id").orderBy("key", *ids)
    n_pairs = weighted.count()
    part = F.pmod(F.xxhash64("query_id"), F.lit(max(1, math.ceil(n_pairs / MAX_PAIRS)))).cast("int").alias("part")
    asked = weighted.withColumn("part", part).groupBy("term", "part").agg(
        F.collect_list(F.struct("query_id", "weight")).alias("asked"), F.first("mean_terms").alias("mean_terms")
    )
    if n_pairs <= MAX_BROADCAST_ROWS:
        asked = F.broadcast(asked)
    parts = F.array(*[F.lit(n) for n in range(max(1, math.ceil(n_pairs / MAX_PAIRS)))])
    query = weighted.schema["query_id"].dataType
    held = blocks.select(*place, "keys", F.explode(parts).alias("part"))
    again = F.lit(None).cast("array<int>")
    if repeated is not None:
        rows = blocks.select(*place, F.posexplode("keys").alias("row", "key"))
        same = [F.col(f"key.{name}").eqNullSafe(repeated[name]) for name in ids]
        met = rows.join(repeated, same, "left_semi").groupBy(*place).agg(F.collect_list("row").alias("again"))
        held, again = held.join(met, place, "left"), F.col("again")
    types = {field.name: field.dataType for field in blocks.schema["keys"].dataType.elementType}
    schema = T.StructType([T.StructField("query_id", query)])
    for name in ids:
        schema = schema.add(name, types[name])
    schema = schema.add("score", T.DoubleType())

    def scored(pairs: DataFrame | None, single: bool = True, also_again: bool = True) -> DataFrame:
        """The best of all blocks, or of those that ``pairs`` names with their queries."""
        terms = postings.select("term", *place, "entries").join(asked, "term").drop("term")
        keys, only = held, F.lit(None).cast(T.ArrayType(query))
        if pairs is not None:
            wanted = pairs.select(*place, "query_id", part).groupBy(*place, "part").agg(F.collect_list("query_id").alias("only"))
            keys, only = keys.join(wanted, [*place, "part"]), F.col("only")
            terms = terms.join(wanted, [*place, "part"], "left_semi")
        keys = keys.select(*place, "part", "keys", again.alias("again"), only.alias("only"))
        group = terms.unionByName(keys, allowMissingColumns=True).groupBy(*place, "part")
        run = _scorer(tuple(ids), to_arrow_schema(schema), k, k1, b, single, also_again)
        found = group.applyInArrow(run, schema)
        sums = found.groupBy("query_id", *ids).agg(F.sum("score").alias("score")) if repeated is not None else found
        keyed = sums.select("query_id", *ids, (-F.floor(F.col("score") * UNITS + 0.5)).cast("long").alias("key"))
        return keyed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    if not prune:
        return scored(None)
    bound = F.sum(F.col("weight") * gain(F.col("max_tf"), F.col("min_terms"), F.col("mean_terms"), k1, b))
    met = postings.drop("entries", "keys").join(F.broadcast(weighted) if n_pairs <= MAX_BROADCAST_ROWS else weighted, "term")
    bounds = met.groupBy("query_id", *place).agg(bound.alias("bound"))
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), *place)
    ranked = materialise(bounds.withColumn("place", F.row_number().over(by_bound)), "ranked-blocks")

    first = materialise(scored(ranked.filter(F.col("place") <= FIRST), also_again=False).drop("rank"), "first-blocks")
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("key")).alias("floor"))
    found = first.unionByName(scored(reaching(ranked, floors), also_again=False).drop("rank"))
    if repeated is not None:
        found = found.unionByName(scored(None, single=False).drop("rank"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
