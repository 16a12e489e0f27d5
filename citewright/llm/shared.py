"""Text hashing over Arrow batches, and scratch tables, for the operators beside it.

Words and bytes are hashed for a whole slice of documents at once with numpy, so
a task touches each byte a few times and holds a slice and its hashes, whatever
the partition's size. A slice is cut between rows; one very long text is a slice
of its own.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Iterable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewright.session import materialise

SLICE_BYTES = 1 << 20
# Odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
# A group is never trusted less or more than so many of its members.
STRENGTHS = 1.0, 10_000.0
SPACES = b" \t\n\x0b\x0c\r"

_U = np.uint64


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and no lineage behind it."""
    return materialise(df, name)


_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, kept by the worker until another key is asked for.

    Workers outlive the stages they serve, so a stage must not leave its tables to the next.
    """
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Give back what the worker holds; for tasks that need the memory for something else."""
    if _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def rows_key(key: str, text: str) -> Column:
    """``k``, a struct of ``doc, row``: the place of a document among all, and a hash that tells
    texts of one id apart. A null id comes before all others."""
    ident, value = F.col(f"`{key}`").cast("long"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    doc = F.coalesce(ident, F.lit(-(1 << 63)))
    return F.struct(doc.alias("doc"), F.xxhash64(ident, value).alias("row")).alias("k")


def keyed(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``doc, row, text, id`` of every document; a null text is empty."""
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = documents.select(rows_key(key, text), value.alias("text"), F.col(f"`{key}`").cast("long").alias("id"))
    return rows.select("k.doc", "k.row", "text", "id")


def discard(table: DataFrame) -> None:
    """Remove a table that ``written`` made and nothing reads any more."""
    spark = table.sparkSession
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``text`` compressed, for shuffles that carry whole texts; ``unpacked`` reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, text):
            data = [shrink((value or "").encode()) for value in batch.column(text).to_pylist()]
            yield extended(batch, **{text: pa.array(data, pa.binary())})

    return rows.mapInArrow(run, with_fields(rows.schema, T.StructField(text, T.BinaryType())))


def unpacked(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of batches, with the texts that ``packed`` compressed as bytes again."""
    grow = zstandard.ZstdDecompressor().decompress
    for batch in slices(batches, text, SLICE_BYTES // 2):
        data = [grow(value) for value in batch.column(text).to_pylist()]
        yield extended(batch, **{text: pa.array(data, pa.binary())})


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (splitmix64)."""
    x = values.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=4)
def _byte_values(lower: bool) -> np.ndarray:
    byte = np.arange(256, dtype=_U)
    if lower:
        upper = (byte >= 65) & (byte <= 90)
        byte = np.where(upper, byte + _U(32), byte)
    return mix(byte + _U(0xA5A5A5A5))


@lru_cache(maxsize=1)
def _space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SPACES)] = True
    return table


class _Powers:
    """``BASE**i`` and its inverses, grown to the longest slice seen by a worker."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            size = max(size, SLICE_BYTES + 1)
            inverse = _U(pow(int(BASE), -1, 1 << 64))
            for name, base in (("up", BASE), ("down", inverse)):
                steps = np.full(size, base, _U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:size], self.down[:size]


_powers = _Powers()


def slices(
    batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches again, in runs of rows with at most ``limit`` bytes of ``text`` (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null is empty."""
    wide = pa.large_binary()
    filled = pc.fill_null(column.cast(wide) if column.type != wide else column, b"")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    _, offsets, data = filled.buffers()
    ends = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """``p`` with ``p[j] - p[i]`` the hash of bytes ``i`` to ``j``, times ``BASE**i``."""
    up, _ = _powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_byte_values(lower)[data] * up[: len(data)], out=total[1:])
    return total


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans that depend on their content only."""
    _, down = _powers.upto(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U))


def words(
    data: np.ndarray, offsets: np.ndarray, lower: bool = False
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``starts, ends, hashes, first``: the words of all rows in order, by byte place.

    A word is a run of bytes other than white space; it ends with its row. Words
    ``first[r]`` to ``first[r + 1]`` belong to row ``r``.
    """
    inside = ~_space_table()[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    hashes = span_hash(prefix_hash(data, lower), starts, ends) if len(starts) else np.zeros(0, _U)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def window_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` hashes; runs may cross rows, the caller knows which do."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, _U)
    up, down = _powers.upto(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, _U)
    np.cumsum(mix(hashes) * up[: len(hashes)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[:count] + _U(size))


def within_rows(first: np.ndarray, size: int) -> np.ndarray:
    """Which runs of ``size`` consecutive items lie within one row, by the run's start."""
    total = int(first[-1])
    if total < size:
        return np.zeros(0, bool)
    room = np.repeat(first[1:], np.diff(first))
    return np.arange(total - size + 1) + size <= room[: total - size + 1]


def least_of(values: np.ndarray, size: int) -> np.ndarray:
    """Least of each run of ``size`` values, by doubling."""
    reach, out = 1, values
    while 2 * reach <= size:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    rest = size - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(order: np.ndarray, valid: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``places, firsts, lasts``: the minimizers of all valid windows of ``size`` values.

    The minimizer of a window is its least value, the leftmost of equal ones, so
    equal windows choose the same place in them. A place is the minimizer of the
    windows that start at ``firsts`` to ``lasts``, all in one row; every valid
    window belongs to exactly one place.
    """
    if not valid.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    bits = max(1, int(len(order)).bit_length())
    low = _U((1 << bits) - 1)
    tagged = (order & ~low) | np.arange(len(order), dtype=_U)
    where = (least_of(tagged, size) & low).astype(np.int64)
    starts = np.flatnonzero(valid)
    where = where[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(starts)) - 1
    return where[heads], starts[heads], starts[tails]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)


def with_fields(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """``schema`` with ``fields`` at its end; a column of the same name makes way."""
    names = {field.name.lower() for field in fields}
    return T.StructType([*(f for f in schema if f.name.lower() not in names), *fields])


def extended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """``batch`` with further columns, as ``with_fields`` orders them; their names are lower case."""
    kept = [name for name in batch.schema.names if name.lower() not in columns]
    return pa.RecordBatch.from_arrays(
        [*(batch.column(name) for name in kept), *columns.values()], names=[*kept, *columns]
    )


def shrunk(groups: DataFrame) -> DataFrame:
    """``groups`` (``good`` of ``n``, prior mean ``prior``) with ``strength``, ``mean``.

    With rates spread around their priors as beta variables of strength ``s``, the
    squared deviations of the counts are larger than binomial ones by ``(n - 1) / (s + 1)``.
    """
    variance = F.col("prior") * (1 - F.col("prior"))
    deviation = F.pow(F.col("good") - F.col("n") * F.col("prior"), 2) / F.col("n")
    sums = groups.filter("n > 0").agg(
        F.sum(deviation - variance).alias("extra"), F.sum(variance * (F.col("n") - 1)).alias("scale")
    ).first()
    share = sums["extra"] / sums["scale"] if sums["scale"] else 1.0
    low, high = STRENGTHS
    strength = min(high, max(low, 1 / share - 1)) if share > 0 else high
    mean = (F.col("good") + strength * F.col("prior")) / (F.col("n") + strength)
    return groups.withColumns({"strength": F.lit(float(strength)), "mean": mean})
