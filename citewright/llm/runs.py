"""Repeated byte strings, by a run-length index over the repetitive parts of a corpus.

A window minimizer chooses places in every text, so that two equal windows of
``length`` bytes contain the same chosen string (an anchor) at the same place.
Anchors that occur once cannot lie in a repeat. Around the others the corpus is cut
into segments, and equal segments are indexed once.

The windows of the different segments around one anchor are put in suffix order, to
the depth of a window, ties in order of document and place. The bytes before them
in that order are the transform; it is kept run-compressed, with the source
position of each run's ends sampled (``run_length_index``). Streaming over the
order gives the matching statistics, capped at the window: a window equal to the
one before it in the order has a full match at an earlier place, and its bytes go.

The usual way, one transform of the whole corpus searched byte by byte, has no
parallel form that Spark could shuffle; anchors cut the same order into
parts that share no window, and equality is that of the bytes.

* A null or empty text has no bytes, nothing to remove, no spans and the digest of
  nothing; very long texts are indexed whole.
* Rows with equal ids count as one document: of equal windows at the same place
  neither is earlier. A null id comes before all others.
* Only the id and the text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewright.llm.shared import (
    anchors,
    discard,
    keyed,
    lists,
    mix,
    packed,
    partitions_for,
    prefix_hash,
    release,
    rows_key,
    signed,
    slices,
    span_hash,
    text_bytes,
    unpacked,
    within_rows,
    written,
)

LENGTH = 100
ANCHOR = 32
# Anchors that a task holds before it passes them on.
HELD_ANCHORS = 1 << 20
# An anchor with more pieces than this, and more than one in so many of all pieces, is
# not compared within a task. So there are at most MOST_WIDE such anchors.
PIECES_IN_TASK = 10_000
MOST_WIDE = 10_000
# Pieces that are put in order at once.
BLOCK_PIECES = 1_500

_U = np.uint64


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """Hash, row, and first and last window of each anchor of all rows."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none, none
    starts = np.arange(len(data) - anchor + 1)
    grams = span_hash(prefix_hash(data), starts, starts + anchor)
    places, firsts, lasts = anchors(grams, within_rows(offsets, length), length - anchor + 1)
    rows = np.searchsorted(offsets, places, side="right") - 1
    return grams[places], rows, firsts, lasts


def _packed(bucket: np.ndarray, edges: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket, with the anchors and documents in it as raw 64-bit numbers."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    parts = np.split(order, cuts) if len(order) else []
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(bucket[part[0]]) for part in parts], pa.int32()),
            pa.array([edges[part].tobytes() for part in parts], pa.binary()),
            pa.array([docs[part].tobytes() for part in parts], pa.binary()),
        ],
        names=["bucket", "edges", "docs"],
    )


def _repeats(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of ``edges``, and in it which are equal to a neighbour, and which are the first of their kind."""
    order = np.argsort(edges)
    same = edges[order][1:] == edges[order][:-1]
    first = np.concatenate([[True], ~same])[: len(order)]
    again = np.concatenate([[False], same])[: len(order)] | np.concatenate([same, [False]])[: len(order)]
    return order, again, first


def _scan(rows: DataFrame, length: int, anchor: int):
    """A function for ``mapInArrow``, and its schema: the anchors of texts, dealt into buckets.

    A task keeps those that it saw twice itself (bucket -1) and sends one of each kind
    on, so a string in a third of all documents is a row per task in the shuffle.
    """
    count = 4 * partitions_for(rows.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            edges, docs = (np.concatenate(part) for part in zip(*held))
            held.clear()
            order, again, first = _repeats(edges)
            known, sent = order[again], order[first]
            yield _packed(np.full(len(known), -1), edges[known], docs[known])
            yield _packed(((edges[sent] >> _U(32)) % _U(count)).astype(np.int64), edges[sent], docs[sent])

        for batch in slices(batches, "text"):
            edges, of, _, _ = _anchors(*text_bytes(batch.column("text")), length, anchor)
            held.append((edges, batch.column("doc").to_numpy(zero_copy_only=False)[of]))
            if sum(len(edges) for edges, _ in held) >= HELD_ANCHORS:
                yield from out()
        if held:
            yield from out()

    return scan, "bucket int, edges binary, docs binary"


def repeated_anchors(seen: DataFrame) -> DataFrame:
    """``doc, edges``: the anchors of each document that occur more than once in the corpus."""

    def numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        edges, docs = (b"".join(batch.column(name).to_pylist()) for name in ("edges", "docs"))
        return np.frombuffer(edges, _U), np.frombuffer(docs, np.int64)

    def plain(edges: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(signed(edges))], names=["doc", "edge"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield plain(*numbers(batch))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Batches come in order of their bucket; a bucket is settled when the next one begins.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                if held and held[0].column("bucket") != row.column("bucket"):
                    yield settled(held)
                    held = []
                held.append(row)
        if held:
            yield settled(held)

    def settled(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        edges, docs = (np.concatenate(part) for part in zip(*map(numbers, held)))
        order, again, _ = _repeats(edges)
        return plain(edges[order[again]], docs[order[again]])

    dealt = seen.filter("bucket >= 0").repartition(partitions_for(seen.sparkSession), "bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(merged, "doc long, edge long").unionByName(
        seen.filter("bucket < 0").mapInArrow(local, "doc long, edge long")
    )
    return found.groupBy("doc").agg(F.collect_set("edge").alias("edges"))


def segments(rows: DataFrame, repeated: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``doc, row, start, size, before, data, edges, sizes``: the parts of texts around repeated anchors.

    A segment has ``size`` consecutive windows from byte ``start`` on, of which the
    first ``sizes[0]`` belong to ``edges[0]`` and so on; ``before`` is the byte in
    front of it, or -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            data, offsets = text_bytes(batch.column("text"))
            edges, of, firsts, lasts = _anchors(data, offsets, length, anchor)
            wanted = batch.column("edges")
            owner = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            marks = wanted.flatten().to_numpy(zero_copy_only=False).view(_U) ^ mix(owner.astype(_U))
            take = np.flatnonzero(np.isin(edges ^ mix(of.astype(_U)), marks))
            edges, of, firsts, stops = edges[take], of[take], firsts[take], lasts[take] + 1
            if not len(take):
                continue
            joined = (of[1:] == of[:-1]) & (firsts[1:] == stops[:-1])
            heads = np.flatnonzero(np.concatenate([[True], ~joined]))
            tails = np.append(heads[1:], len(take)) - 1
            begin, end = firsts[heads], stops[tails]
            text = data.tobytes()
            inner = begin > offsets[of[heads]]
            before = np.where(inner, data[begin - 1].astype(np.int32), np.int32(-1))
            rows_of = pa.array(of[heads])
            parts = np.diff(np.append(heads, len(take)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(rows_of),
                    batch.column("row").take(rows_of),
                    pa.array((begin - offsets[of[heads]]).astype(np.int64)),
                    pa.array((end - begin).astype(np.int64)),
                    pa.array(before),
                    pa.array([text[b : e + length - 1] for b, e in zip(begin.tolist(), end.tolist())], pa.binary()),
                    lists(signed(edges), parts),
                    lists((stops - firsts).astype(np.int32), parts),
                ],
                names=["doc", "row", "start", "size", "before", "data", "edges", "sizes"],
            )

    schema = "doc long, row long, start long, size long, before int, data binary, edges array<long>, sizes array<int>"
    return packed(rows.select("doc", "row", "text")).join(repeated, "doc").mapInArrow(run, schema)


def _pieces(different: DataFrame, length: int, only: frozenset[int] = frozenset(), apart: bool = False) -> DataFrame:
    """``edge, seg, check, doc, start, at, n, piece``: the windows around each anchor, a byte before
    them first. Either without the anchors in ``only``, or those alone (``apart``)."""
    named = different.sparkSession.sparkContext.broadcast(np.array(sorted(only), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data"):
            counts = batch.column("edges").value_lengths().to_numpy(zero_copy_only=False)
            sizes = batch.column("sizes").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(np.arange(batch.num_rows), counts)
            ends = np.cumsum(sizes)
            heads = np.cumsum(counts) - counts
            at = ends - sizes - (ends - sizes)[heads][of]
            edges = batch.column("edges").flatten()
            here = np.flatnonzero(np.isin(edges.to_numpy(zero_copy_only=False), named.value) == apart)
            of, at, sizes, edges = of[here], at[here], sizes[here], edges.take(pa.array(here))
            data, before = batch.column("data").to_pylist(), batch.column("before").to_pylist()
            framed = [bytes([max(b, 0)]) + d for d, b in zip(data, before)]
            pieces = [
                framed[n][a : a + size + length] for n, a, size in zip(of.tolist(), at.tolist(), sizes.tolist())
            ]
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [
                    edges,
                    *(batch.column(name).take(take) for name in ("seg", "check", "doc", "start")),
                    pa.array(at),
                    pa.array(sizes),
                    pa.array(pieces, pa.binary()),
                ],
                names=["edge", "seg", "check", "doc", "start", "at", "n", "piece"],
            )

    schema = "edge long, seg long, check long, doc long, start long, at long, n long, piece binary"
    return different.mapInArrow(run, schema)


class Order:
    """Windows of some pieces in suffix order; equal ones in order of document and place."""

    def __init__(self, table: pa.Table, length: int) -> None:
        data, offsets = text_bytes(table["piece"].combine_chunks())
        sizes = table["n"].to_numpy()
        doc, place = table["doc"].to_numpy(), table["start"].to_numpy() + table["at"].to_numpy()
        edge = table["edge"].to_numpy()
        self.of = np.repeat(np.arange(len(sizes)), sizes)
        self.within = np.arange(len(self.of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.doc, self.place = doc[self.of], place[self.of] + self.within
        self.edge = edge[self.of]
        at = offsets[:-1][self.of] + 1 + self.within
        self.before = data[at - 1] if len(at) else data
        source = np.lexsort((self.place, self.doc))
        strings = np.lib.stride_tricks.sliding_window_view(data, length)[at[source]] if len(at) else np.zeros((0, length), np.uint8)
        strings = np.ascontiguousarray(strings).view(f"S{length}").ravel()
        order = np.argsort(strings, kind="stable")
        self.order, ordered = source[order], strings[order]
        #: Matching statistics reach the whole window: it equals the one before it in the order.
        self.matched = np.zeros(len(order), bool)
        self.matched[1:] = ordered[1:] == ordered[:-1]

    def later(self) -> np.ndarray:
        """Which windows, in their first order, start earlier somewhere else."""
        heads = np.flatnonzero(~self.matched)
        group = np.cumsum(~self.matched) - 1
        doc, place = self.doc[self.order], self.place[self.order]
        after = (doc != doc[heads][group]) | (place != place[heads][group])
        out = np.zeros(len(self.order), bool)
        out[self.order] = after
        return out

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last place, in the order, of each run of equal bytes before the windows."""
        before = self.before[self.order]
        new = np.ones(len(before), bool)
        new[1:] = before[1:] != before[:-1]
        heads = np.flatnonzero(new)
        return heads, np.append(heads[1:], len(before)) - 1


def _in_blocks(pieces: DataFrame, each: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``each`` over blocks of pieces in which all pieces of an anchor are together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while batch.num_rows:
                room = max(0, BLOCK_PIECES - sum(part.num_rows for part in held))
                edges = batch.column("edge").to_numpy(zero_copy_only=False)
                stop = room
                if room < batch.num_rows:
                    # On to the end of the anchor that the block is in.
                    last = edges[room - 1] if room else held[-1].column("edge")[-1].as_py()
                    stop = room + int(np.searchsorted(edges[room:], last, side="right"))
                held.append(batch.slice(0, stop))
                batch = batch.slice(stop)
                if batch.num_rows:
                    yield each(pa.Table.from_batches(held))
                    held = []
        if held:
            yield each(pa.Table.from_batches(held))

    dealt = pieces.repartition(partitions_for(pieces.sparkSession), "edge").sortWithinPartitions("edge")
    return dealt.mapInArrow(run, schema)


def _spans_of(table: pa.Table, later: np.ndarray, of: np.ndarray, within: np.ndarray) -> pa.RecordBatch:
    at = within + table["at"].to_numpy()[of]
    starts = later & np.concatenate([[True], ~later[:-1] | (of[1:] != of[:-1])])[: len(later)]
    stops = later & np.concatenate([~later[1:] | (of[1:] != of[:-1]), [True]])[: len(later)]
    take = pa.array(of[starts])
    return pa.RecordBatch.from_arrays(
        [
            table["seg"].combine_chunks().take(take),
            table["check"].combine_chunks().take(take),
            pa.array(at[starts]),
            pa.array(at[stops] + 1),
        ],
        names=["seg", "check", "from", "to"],
    )


def _marked(pieces: DataFrame, length: int) -> DataFrame:
    """``seg, check, from, to``: windows of the segments that start earlier somewhere else."""

    def each(table: pa.Table) -> pa.RecordBatch:
        order = Order(table, length)
        return _spans_of(table, order.later(), order.of, order.within)

    return _in_blocks(pieces, each, "seg long, check long, from long, to long")


def _merged(seg: np.ndarray, check: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Runs of consecutive windows of a segment, as ``seg, check, from, to``."""
    order = np.lexsort((at, check, seg))
    seg, check, at = seg[order], check[order], at[order]
    new = np.ones(len(order), bool)
    new[1:] = (seg[1:] != seg[:-1]) | (check[1:] != check[:-1]) | (at[1:] > at[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(order))[: len(heads)] - 1
    columns = [pa.array(seg[heads]), pa.array(check[heads]), pa.array(at[heads]), pa.array(at[tails] + 1)]
    return pa.RecordBatch.from_arrays(columns, names=["seg", "check", "from", "to"])


#: A window on its way: two hashes of its bytes, where it starts, and its segment and place there.
_WINDOW = np.dtype([(name, np.int64) for name in ("window", "half", "doc", "place", "seg", "check", "at")])


def _firsts(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each kind of window those that start where the first one does, and the later ones."""
    order = np.lexsort((windows["place"], windows["doc"], windows["half"], windows["window"]))
    windows = windows[order]
    new = np.ones(len(windows), bool)
    new[1:] = (windows["window"][1:] != windows["window"][:-1]) | (windows["half"][1:] != windows["half"][:-1])
    heads = windows[new]
    own = np.cumsum(new) - 1
    later = (windows["doc"] != heads["doc"][own]) | (windows["place"] != heads["place"][own])
    return windows[~later], windows[later]


def _marked_apart(pieces: DataFrame, length: int) -> DataFrame:
    """The same, by two hashes of each window. Windows travel as arrays, a row for each bucket of
    hashes; a task marks those that it saw earlier itself and sends one of each kind on."""
    spark = pieces.sparkSession
    count = 4 * partitions_for(spark)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            heads, later = _firsts(np.concatenate(held))
            held.clear()
            for windows, sign in ((heads, 1), (later, -1)):
                bucket = mix(windows["window" if sign > 0 else "seg"].view(_U)) % _U(count)
                order = np.argsort(bucket, kind="stable")
                parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
                # Below zero: known to be later, and only on its way.
                names = [sign * (1 + int(bucket[part[0]])) for part in parts]
                data = [windows[part].tobytes() for part in parts]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

        for batch in slices(batches, "piece"):
            data, offsets = text_bytes(batch.column("piece"))
            sizes = batch.column("n").to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(batch.num_rows), sizes)
            within = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            begin, total = offsets[:-1][of] + 1 + within, prefix_hash(data)
            windows = np.zeros(len(of), _WINDOW)
            windows["window"] = signed(span_hash(total, begin, begin + length))
            windows["half"] = signed(span_hash(total, begin + length // 2, begin + length))
            windows["at"] = within + batch.column("at").to_numpy(zero_copy_only=False)[of]
            for name in ("doc", "seg", "check"):
                windows[name] = batch.column(name).to_numpy(zero_copy_only=False)[of]
            windows["place"] = windows["at"] + batch.column("start").to_numpy(zero_copy_only=False)[of]
            held.append(windows)
            if sum(map(len, held)) >= HELD_ANCHORS:
                yield from out()
        if held:
            yield from out()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        of = 0

        def out() -> pa.RecordBatch:
            windows = np.frombuffer(b"".join(held), _WINDOW)
            held.clear()
            later = windows if of < 0 else _firsts(windows)[1]
            return _merged(later["seg"], later["check"], later["at"])

        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
                if held and bucket != of:
                    yield out()
                of = bucket
                held.append(data)
        if held:
            yield out()

    dealt = pieces.mapInArrow(deal, "bucket int, data binary")
    dealt = dealt.repartition(partitions_for(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(settle, "seg long, check long, from long, to long")


def _different(found: DataFrame) -> DataFrame:
    """Each different segment once, with its first document and place."""
    content = ["before", "data", "edges", "sizes"]
    first = F.min(F.struct("doc", "start")).alias("place")
    kept = found.groupBy("seg", "check").agg(first, *[F.first(name).alias(name) for name in content])
    return kept.select("seg", "check", "place.doc", "place.start", *content)


def found_segments(rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``segments`` with two hashes, ``seg`` and ``check``, of the byte before each and its content; written once."""
    seen = written(rows.select("doc", "text").mapInArrow(*_scan(rows, length, anchor)), "anchors")
    found = segments(rows, repeated_anchors(seen), length, anchor)
    hashes = {"seg": F.xxhash64("data", "before"), "check": F.xxhash64(F.lit(1), "before", "data")}
    found = written(found.withColumns(hashes), "segments")
    discard(seen)
    return found


def run_length_index(
    documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR
) -> DataFrame:
    """The run-compressed transform of the repetitive parts of the corpus, a row per run.

    ``edge`` and ``run`` order the runs; ``byte`` stands before each of ``size``
    windows; ``first_doc, first_place`` and ``last_doc, last_place`` are where the
    windows at the ends of the run start.
    """
    found = found_segments(keyed(documents, key, text), length, anchor)

    def each(table: pa.Table) -> pa.RecordBatch:
        order = Order(table, length)
        heads, tails = order.runs()
        first, last = order.order[heads], order.order[tails]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(heads), order.edge[0] if len(heads) else 0)),
                pa.array(np.arange(len(heads))),
                pa.array(order.before[first].astype(np.int32)),
                pa.array(tails - heads + 1),
                *(pa.array(values[which]) for which in (first, last) for values in (order.doc, order.place)),
            ],
            names=["edge", "run", "byte", "size", "first_doc", "first_place", "last_doc", "last_place"],
        )

    schema = "edge long, run long, byte int, size long, first_doc long, first_place long, last_doc long, last_place long"
    return _in_blocks(_pieces(_different(found), length), each, schema)


def _wide(different: DataFrame, least: int) -> frozenset[int]:
    """The few anchors with so many pieces that they are compared apart."""
    pieces = different.select(F.explode("edges").alias("edge")).groupBy("edge").agg(F.count("*").alias("n"))
    pieces = written(pieces.filter("n > 1"), "piece-counts")
    total = pieces.agg(F.sum("n").alias("n")).first()["n"] or 0
    return frozenset(row["edge"] for row in pieces.filter(F.col("n") > max(least, total / MOST_WIDE)).collect())


def repeated_spans(
    rows: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, pieces_in_task: int | None = None
) -> DataFrame:
    """``doc, row, spans``: arrays of ``from, to``, the starts of windows that also start earlier."""
    found = found_segments(rows, length, anchor)
    different = written(_different(found), "different-segments")
    own = written(found.select("doc", "row", "start", "size", "seg", "check"), "segment-places")
    discard(found)
    wide = _wide(different, PIECES_IN_TASK if pieces_in_task is None else pieces_in_task)
    marks = _marked(_pieces(different, length, wide), length)
    if wide:
        marks = marks.unionByName(_marked_apart(_pieces(different, length, wide, apart=True), length))
    spans = marks.groupBy("seg", "check").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    first = own.groupBy("seg", "check").agg(F.min(F.struct("doc", "start")).alias("least"))
    placed = own.join(first, ["seg", "check"]).join(spans, ["seg", "check"], "left")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("size").alias("to")))
    mine = F.when(F.struct("doc", "start") > F.col("least"), all_of_it).otherwise(F.col("spans"))
    shift = F.col("start")
    moved = F.transform(mine, lambda s: F.struct((s["from"] + shift).alias("from"), (s["to"] + shift).alias("to")))
    kept = placed.select("doc", "row", moved.alias("spans")).filter(F.size("spans") > 0)
    return kept.groupBy("doc", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _without(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Bytes, removed bytes and removed runs of each row, and what is left of its text."""
    data, offsets = text_bytes(batch.column("text"))
    column = batch.column("spans")
    of = np.repeat(np.arange(batch.num_rows), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    spans = column.flatten()
    begin, end = (spans.field(n).to_numpy(zero_copy_only=False) + offsets[of] for n in range(2))
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, begin, 1)
    np.add.at(change, end + length - 1, -1)
    gone = np.zeros(len(data) + 1, bool)
    gone[1:] = np.cumsum(change[:-1]) > 0
    rises = gone[1:] & ~gone[:-1]
    # A run that goes on from one document to the next is a run in each.
    inner = offsets[1:-1][offsets[1:-1] < len(data)]
    rises[inner] = gone[1:][inner]
    removed, runs = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone[1:], rises))
    left = data[~gone[1:]].tobytes()
    ends = (offsets - removed).tolist()
    return np.diff(offsets), np.diff(removed), np.diff(runs), [left[a:b] for a, b in zip(ends, ends[1:])]


def remove_repeated(
    documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR
) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256, kept``: each document without the bytes of
    ``length``-byte strings that also start earlier, in a smaller key or further up. ``kept`` is
    binary: a cut may go through a character."""
    rows = keyed(documents, key, text)
    marks = repeated_spans(rows, length, anchor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            size, removed, spans, kept = _without(batch, length)
            digests = pa.array([hashlib.sha256(value).hexdigest() for value in kept], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size), pa.array(removed), pa.array(spans), digests, pa.array(kept, pa.binary())],
                names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    schema = f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return packed(rows).join(marks, ["doc", "row"], "left").select("id", "text", "spans").mapInArrow(run, schema)


def cleaned(
    documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR
) -> DataFrame:
    """``documents`` with repeated bytes taken out of their texts, as ``remove_repeated`` does.

    A character that a cut went through is left out. Null texts stay null.
    """
    rows = keyed(documents, key, text)
    marks = repeated_spans(rows, length, anchor)
    others = [name for name in documents.columns if name != text]
    carried = documents.select(
        rows_key(key, text), F.struct(*[F.col(f"`{name}`") for name in others], F.col(f"`{text}`").isNull().alias(" null")).alias("carried"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    ).select("k.doc", "k.row", "carried", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            kept = [value.decode("utf-8", "ignore") for value in _without(batch, length)[3]]
            yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array(kept, pa.string())], names=["carried", "text"])

    joined = packed(carried).join(marks, ["doc", "row"], "left").select("carried", "text", "spans")
    kind = joined.schema["carried"].dataType
    schema = T.StructType([T.StructField("carried", kind), T.StructField("text", T.StringType())])
    done = joined.mapInArrow(run, schema)
    left = F.when(~F.col("carried")[" null"], F.col("text")).alias(text)
    return done.select(*[left if name == text else F.col("carried")[name].alias(name) for name in documents.columns])
