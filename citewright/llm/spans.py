"""Repeated token spans, by compaction of a de Bruijn graph of sampled k-mers.

Edges are k-mers of tokens at the places a window minimizer chooses, so two equal
windows contain an equal edge at the same place. Edges found in several documents
form the graph: an edge leads to the next repeated one of a document. Where that
next edge is the only one, and has no other before it, the two belong to one
nonbranching path; joins that double their reach find each edge's path and its
place in it. A document then walks along paths, and the windows of its walks, read
again at their source coordinates, are compared place by place within a path: a
window is removed if an equal one starts in a document with a smaller id.

Equality of windows is equality of an edge hash, a place in a path and a window
hash, 64 bits each. Walks that are equal as a whole are compared once, whatever
their number, and paths with very many different walks are compared window by
window in a shuffle that aggregates first, so no path has to fit into a task.

* Null and empty texts have no words, nothing to remove and the digest of nothing;
  very long ones are read whole.
* Rows with equal ids count as one document: they remove nothing from each other.
  A null id comes before all others.
* Only the id and the text are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citewright.llm.shared import (
    anchors,
    discard,
    keyed,
    lists,
    packed,
    partitions_for,
    signed,
    slices,
    text_bytes,
    unpacked,
    window_hash,
    within_rows,
    words,
    written,
)

WINDOW = 50
EDGE = 8
# Joins that look for the head of a path; each doubles the edges it looks back. An
# edge whose hash is a multiple of CUT is always a head, so few paths are longer; an
# edge further from its head is a path by itself, which changes no result.
DOUBLINGS = 7
CUT = 32
# Different walks of one path that are compared within a task.
WALKS_IN_TASK = 20_000

_U = np.uint64


def _edges(column: pa.Array, window: int, edge: int):
    """Words and their hashes by row, and each chosen edge with the windows it stands for."""
    starts, ends, hashes, first = words(*text_bytes(column))
    grams = window_hash(hashes, edge)
    valid = within_rows(first, window)
    places, firsts, lasts = anchors(grams, valid, window - edge + 1)
    rows = np.searchsorted(first, places, side="right") - 1
    return hashes, first, grams, rows, places, firsts, lasts


def edge_occurrences(rows: DataFrame, window: int = WINDOW, edge: int = EDGE) -> DataFrame:
    """``edge, doc, row, at``: the sampled token k-mers of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, first, grams, of, places, _, _ = _edges(batch.column("text"), window, edge)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(grams[places])) if len(places) else pa.array([], pa.int64()),
                    batch.column("doc").take(take),
                    batch.column("row").take(take),
                    pa.array((places - first[of]).astype(np.int32)),
                ],
                names=["edge", "doc", "row", "at"],
            )

    return rows.select("doc", "row", "text").mapInArrow(run, "edge long, doc long, row long, at int")


def paths(repeated: DataFrame) -> DataFrame:
    """``edge, path, place``: the nonbranching path of each repeated edge, and its place in words.

    ``repeated`` has the occurrences ``edge, doc, row, at`` of the edges.
    """
    along = Window.partitionBy("doc", "row").orderBy("at")
    after = repeated.select(
        "edge", F.lead("edge").over(along).alias("next"), (F.lead("at").over(along) - F.col("at")).alias("gap")
    )
    arcs = written(after.filter("gap > 0").distinct(), "arcs")
    only_next = arcs.groupBy("edge").agg(F.count("*").alias("ways")).filter("ways = 1").select("edge")
    only_before = arcs.groupBy("next").agg(F.count("*").alias("ways")).filter("ways = 1").select("next")
    plain = (
        arcs.join(only_next, "edge", "left_semi")
        .join(only_before, "next", "left_semi")
        .filter((F.col("edge") != F.col("next")) & (F.pmod("next", F.lit(CUT)) != 0))
    )
    back = plain.select(F.col("next").alias("edge"), F.col("edge").alias("head"), F.col("gap").cast("long").alias("place"))
    back = written(back, "path-back")
    for _ in range(DOUBLINGS):
        further = back.select(
            F.col("edge").alias("head"), F.col("head").alias("beyond"), F.col("place").alias("more")
        )
        longer = back.join(further, "head", "left").select(
            "edge",
            F.coalesce("beyond", "head").alias("head"),
            (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"),
        )
        shorter, back = back, written(longer, "path-back")
        discard(shorter)
    # A head that has an edge before it was not reached to the end.
    ended = back.join(back.select(F.col("edge").alias("head")), "head", "left_anti")
    return ended.select("edge", F.col("head").alias("path"), "place")


def walks(rows: DataFrame, found: DataFrame, window: int = WINDOW, edge: int = EDGE) -> DataFrame:
    """``doc, row, path, place, start, windows``: what documents have of each path.

    ``found`` has ``doc, row, at, path, place`` of the repeated edges. ``windows`` are
    the hashes of consecutive windows, the first at word ``start`` of the document
    and ``place`` words after the head of the path.
    """
    spots = F.array_sort(F.collect_set(F.struct("at", "path", "place")))
    wanted = packed(rows.select("doc", "row", "text")).join(found.groupBy("doc", "row").agg(spots.alias("spots")), ["doc", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            hashes, first, _, _, places, firsts, lasts = _edges(batch.column("text"), window, edge)
            column = batch.column("spots")
            of = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy(zero_copy_only=False))
            spot = column.flatten()
            at, path, place = (spot.field(n).to_numpy(zero_copy_only=False) for n in range(3))
            chosen = np.searchsorted(places, first[of] + at)
            start, stop = firsts[chosen], lasts[chosen] + 1
            place = place + (start - places[chosen])
            joins = (of[1:] == of[:-1]) & (path[1:] == path[:-1]) & (start[1:] == stop[:-1])
            joins &= place[1:] - place[:-1] == start[1:] - start[:-1]
            heads = np.flatnonzero(np.concatenate([[True], ~joins]))
            tails = np.append(heads[1:], len(at)) - 1
            sizes = stop[tails] - start[heads]
            ends = np.cumsum(sizes)
            flat = np.arange(ends[-1]) + np.repeat(start[heads] - ends + sizes, sizes)
            take = pa.array(of[heads])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc").take(take),
                    batch.column("row").take(take),
                    pa.array(path[heads]),
                    pa.array(place[heads]),
                    pa.array((start[heads] - first[of[heads]]).astype(np.int32)),
                    lists(signed(window_hash(hashes, window)[flat]), sizes),
                ],
                names=["doc", "row", "path", "place", "start", "windows"],
            )

    schema = "doc long, row long, path long, place long, start int, windows array<long>"
    return wanted.mapInArrow(run, schema)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _compared(different: DataFrame) -> DataFrame:
    """``walk, check, doc, marks``: which windows of each different walk an earlier document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            paths_of = batch.column("path").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(paths_of, paths_of[-1]))
            if cut and size + batch.num_rows > 2_000:
                yield _marks(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield _marks(pa.Table.from_batches(held))

    ordered = different.repartition(partitions_for(different.sparkSession), "path").sortWithinPartitions("path")
    return ordered.select("path", "place", "walk", "check", "doc", "windows").mapInArrow(
        run, "walk long, check long, doc long, marks array<int>"
    )


def _marks(table: pa.Table) -> pa.RecordBatch:
    column = table["windows"].combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(of)) - starts[of]
    path, place, doc = (table[name].to_numpy() for name in ("path", "place", "doc"))
    place = place[of] + within
    order = np.lexsort((column.flatten().to_numpy(zero_copy_only=False), place, path[of]))
    sorted_by = [values[order] for values in (column.flatten().to_numpy(zero_copy_only=False), place, path[of])]
    new = np.ones(len(order), bool)
    new[1:] = np.any([values[1:] != values[:-1] for values in sorted_by], axis=0)
    least = np.minimum.reduceat(doc[of][order], np.flatnonzero(new)) if len(order) else np.zeros(0, np.int64)
    later = np.zeros(len(order), bool)
    later[order] = doc[of][order] > least[np.cumsum(new) - 1]
    marked = np.flatnonzero(later)
    return pa.RecordBatch.from_arrays(
        [
            table["walk"].combine_chunks(),
            table["check"].combine_chunks(),
            table["doc"].combine_chunks(),
            lists(within[marked].astype(np.int32), np.bincount(of[marked], minlength=len(sizes))),
        ],
        names=["walk", "check", "doc", "marks"],
    )


def _compared_apart(different: DataFrame) -> DataFrame:
    """The same as ``_compared``, a row per window; equal windows of a task meet before the shuffle."""
    each = different.select("walk", "check", "doc", "path", "place", F.posexplode("windows").alias("at", "window"))
    each = each.withColumn("place", F.col("place") + F.col("at"))
    spot = ["path", "place", "window"]
    earlier = each.groupBy(*spot).agg(F.min("doc").alias("least"))
    later = each.join(earlier, spot).filter("doc > least")
    marks = later.groupBy("walk", "check").agg(F.array_sort(F.collect_set("at")).alias("marks"))
    return different.select("walk", "check", "doc").join(marks, ["walk", "check"], "left")


def repeated_windows(
    rows: DataFrame, window: int = WINDOW, edge: int = EDGE, walks_in_task: int | None = None
) -> DataFrame:
    """``doc, row, at``: arrays of the starts of all windows that an earlier document has too."""
    seen = written(edge_occurrences(rows, window, edge), "edges")
    # Written, so that a join may split the rows of an edge that very many documents have.
    common = seen.groupBy("edge").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    common = written(common.filter("least < most").select("edge"), "common-edges")
    repeated = written(seen.join(common, "edge"), "repeated-edges")
    discard(seen)
    path = written(paths(repeated), "paths")
    found = repeated.join(path, "edge", "left").select(
        "doc", "row", "at", F.coalesce("path", "edge").alias("path"), F.coalesce("place", F.lit(0)).alias("place")
    )
    walked = walks(rows, found, window, edge).withColumns(
        {"walk": F.xxhash64("path", "place", "windows"), "check": F.xxhash64("windows", "place", F.lit(1))}
    )
    walked = written(walked, "walks")
    same = ["walk", "check", "path", "place"]
    different = walked.groupBy(*same).agg(F.min("doc").alias("doc"), F.first("windows").alias("windows"))
    different = written(different, "different-walks")
    per_path = different.groupBy("path").agg(F.count("*").alias("ways"))
    wide = per_path.filter(F.col("ways") > (walks_in_task or WALKS_IN_TASK)).select("path")
    marks = _compared(different.join(wide, "path", "left_anti")).unionByName(
        _compared_apart(different.join(wide, "path", "left_semi"))
    )
    own = walked.select("doc", "row", "walk", "check", "start", F.size("windows").alias("size"))
    marked = own.join(marks.withColumnRenamed("doc", "least"), ["walk", "check"], "left")
    everything = F.sequence(F.lit(0), F.col("size") - 1)
    at = F.when(F.col("doc") > F.col("least"), everything).otherwise(F.col("marks"))
    shifted = marked.select("doc", "row", F.transform(at, lambda x: x + F.col("start")).alias("at"))
    return shifted.filter(F.size("at") > 0).groupBy("doc", "row").agg(F.flatten(F.collect_list("at")).alias("at"))


def remove_repeated(
    documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, edge: int = EDGE
) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256, kept``: each document without the words that
    lie in a window of ``window`` words which also starts in a document with a smaller key."""
    rows = keyed(documents, key, text)
    marks = repeated_windows(rows, window, edge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            data, offsets = text_bytes(batch.column("text"))
            starts, ends, _, first = words(data, offsets)
            column = batch.column("at")
            of = np.repeat(np.arange(batch.num_rows), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + first[of]
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
            keep = np.cumsum(change[:-1]) == 0
            text_of = data.tobytes()
            counts, removed, kept = [], [], []
            for n in range(batch.num_rows):
                mine = keep[first[n] : first[n + 1]]
                where = first[n] + np.flatnonzero(mine)
                counts.append(len(mine))
                removed.append(len(mine) - len(where))
                kept.append(b" ".join([text_of[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array([hashlib.sha256(value).hexdigest() for value in kept], pa.string()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=[key, "n_words", "n_removed", "kept_sha256", "kept"],
            )

    schema = f"`{key}` long, n_words long, n_removed long, kept_sha256 string, kept string"
    return packed(rows).join(marks, ["doc", "row"], "left").select("id", "text", "at").mapInArrow(run, schema)
