"""Exact Jaccard similarity join of documents, as a metric-space join over pivots.

The distance of two sets, one minus their Jaccard similarity, is a metric; documents
link up to the distance ``r``. Regions are made around pivots, in two layers.

*Shingle pivots.* Documents that are not near copies have distance one from each
other, so documents as pivots would put everything into every region. Here a pivot is
the set of one shingle: a document is nearer to those it contains than to all others,
and a global order (rare shingles first) decides between them. A document lies in the
Voronoi region of its first shingle and is copied into those of the next ones as far
as the triangle inequality lets a partner's first common shingle be (its prefix). A
document whose prefix holds shingles of its own only has no partner and goes nowhere.
Frequencies are exact counts over all documents, of the shingles that come first by
hash, a third more of them than a prefix has.

*Document pivots.* A region with more than a few documents takes one of them as pivot:
that which lies in most large regions, so that the regions of one group of near copies
have few pivots. What lies within ``r`` of a pivot links to it. The others are compared
by their differences from the pivot, ``A xor P``: ``A xor B`` is the symmetric difference
of these too, but what all copies share is in none of them. Two documents that link, and
do not both link to the pivot, have a difference in common: with ``|A xor P|`` beyond
what a link allows, disjoint differences put ``B`` still farther away. So differences are
pivots of a second layer of regions, rarest first and counted exactly within the pivot's
regions, and a pair is made where the differences that come before the first common one,
and the numbers of those that follow, leave room for a link. Classes that are connected
around a pivot already are not compared; small regions are compared pair by pair.

Equal sets are one class throughout. Links between classes give the components. For
components, pairs that link to the same pivot need not be compared with each other.

* A document without words, or null, is empty: it links with nothing, not even with
  another empty one, and is its own component. Fewer words than a shingle make one.
* Rows with equal ids are documents of their own that share the id. A null id comes
  before all others; a component with one is null.
* Very long texts are taken whole. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewright.llm.shared import (
    SLICE_BYTES,
    discard,
    keyed,
    lists,
    mix,
    packed,
    partitions_for,
    release,
    rows_key,
    slices,
    text_bytes,
    unpacked,
    window_hash,
    words,
    written,
)

SIZE = 4
# Sets link if 100 * intersection >= share * union; the share unless another is given.
LINK = 85
# Documents of a region that are compared pair by pair.
SMALL = 8
# Pivots that a large region has, one after the other. Those after the first only connect more
# of the region before its pairs are made.
LEVELS = 1
# Shingles that a task holds before it passes them on, and bytes of text that it hashes at once.
HELD = 1 << 18
HASHED = SLICE_BYTES // 4

_U = np.uint64
_TOP = _U(1 << 63)


def _counted(share: int) -> int:
    """The part of all hashes, in 256ths, whose frequencies are counted: a third more than a prefix."""
    return min(255, -(-(100 - share) * 52 // 15))


def _prefix(sizes: np.ndarray, share: int) -> np.ndarray:
    """Shingles of which a linked set must have one: all but those that it needs to share, and one."""
    return sizes - (share * sizes + 99) // 100 + 1


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The different shingle hashes of each row, ascending."""
    _, _, hashes, first = words(*text_bytes(column), lower=True)
    grams = window_hash(hashes, size)
    for start, stop in zip(first.tolist(), first[1:].tolist()):
        if stop - start >= size:
            yield np.unique(grams[start : stop - size + 1])
        elif stop > start:
            yield window_hash(hashes[start:stop], stop - start)
        else:
            yield np.zeros(0, _U)


def _ordered(hashes: np.ndarray) -> np.ndarray:
    """Hashes as signed numbers in the same order."""
    return (hashes ^ _TOP).view(np.int64)


def _described(rows: DataFrame, size: int, share: int, seed: int) -> DataFrame:
    """``doc, row, id, n, class, check, n_counted, sent``: each document's set, its class and first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        salt = mix(np.array([seed], _U))[0]
        first = _U(_counted(share) << 56)
        for batch in slices(batches, "text", HASHED):
            sizes, classes, checks, counted, sent = [], [], [], [], []
            for shingles in _sets(batch.column("text"), size):
                n = len(shingles)
                few = int(np.searchsorted(shingles, first))
                sizes.append(n)
                classes.append(int(mix(shingles ^ salt).sum().view(np.int64)))
                checks.append(int(mix(shingles + salt).sum().view(np.int64)))
                counted.append(few)
                sent.append(_ordered(shingles[: max(few, int(_prefix(np.int64(n), share)) if n else 0)]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    batch.column("row"),
                    batch.column("id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(classes, pa.int64()),
                    pa.array(checks, pa.int64()),
                    pa.array(counted, pa.int64()),
                    pa.array(sent, pa.binary()),
                ],
                names=["doc", "row", "id", "n", "class", "check", "n_counted", "sent"],
            )

    schema = "doc long, row long, id long, n long, class long, check long, n_counted long, sent binary"
    return rows.select("doc", "row", "id", "text").mapInArrow(run, schema)


def _numbers(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's numbers, of a column of their bytes or of lists."""
    if pa.types.is_binary(column.type):
        yield from (np.frombuffer(data or b"", np.int64) for data in column.to_pylist())
    else:
        yield from (row.values.to_numpy(zero_copy_only=False) for row in column)


def _shared_shingles(described: DataFrame) -> DataFrame:
    """``class, shingle, n_classes`` of the sent shingles that several classes have.

    Shingles and classes travel as arrays, a row for each bucket of hashes; a task
    sends each pair once, however many copies of a document it has.
    """
    spark = described.sparkSession
    buckets = 4 * partitions_for(spark)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()

        def out() -> pa.RecordBatch:
            shingles, classes = (np.concatenate(part) for part in zip(*held))
            held.clear()
            bucket = mix(shingles.view(_U)) % _U(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            parts = np.split(order, cuts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(bucket[part[0]]) for part in parts], pa.int32()),
                    pa.array([shingles[part].tobytes() for part in parts], pa.binary()),
                    pa.array([classes[part].tobytes() for part in parts], pa.binary()),
                ],
                names=["bucket", "shingles", "classes"],
            )

        size = 0
        for batch in batches:
            for name, shingles in zip(batch.column("class").to_pylist(), _numbers(batch.column("sent"))):
                if len(shingles) and name not in seen:
                    if len(seen) >= HELD:
                        seen.clear()
                    seen.add(name)
                    held.append((shingles, np.full(len(shingles), name, np.int64)))
                    size += len(shingles)
                    if size >= HELD:
                        yield out()
                        size = 0
        if held:
            yield out()

    def settled(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        join = lambda name: np.frombuffer(b"".join(v for part in held for v in part.column(name).to_pylist()), np.int64)
        shingles, classes = join("shingles"), join("classes")
        order = np.lexsort((classes, shingles))
        shingles, classes = shingles[order], classes[order]
        new = np.ones(len(order), bool)
        new[1:] = shingles[1:] != shingles[:-1]
        other = new.copy()
        other[1:] |= classes[1:] != classes[:-1]
        shingles, classes, new = shingles[other], classes[other], new[other]
        times = np.diff(np.append(np.flatnonzero(new), len(new)))
        times = np.repeat(times, times)
        kept = times > 1
        return pa.RecordBatch.from_arrays(
            [pa.array(classes[kept]), pa.array(shingles[kept]), pa.array(times[kept].astype(np.int64))],
            names=["class", "shingle", "n_classes"],
        )

    def count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
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

    dealt = described.select("class", "sent").mapInArrow(deal, "bucket int, shingles binary, classes binary")
    dealt = dealt.repartition(partitions_for(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count_up, "class long, shingle long, n_classes long")


def _regions(described: DataFrame, share: int) -> DataFrame:
    """``shingle, class, n, before``: the classes of each region of a shingle pivot that has several.

    ``before`` shingles of the class, at least, come before this one in the order.
    """
    counted = (F.shiftrightunsigned("shingle", 56).bitwiseXOR(F.lit(128))) < _counted(share)
    rank = F.when(counted, F.col("n_classes")).otherwise(F.lit((1 << 63) - 1))
    shared = _shared_shingles(described).withColumn("spot", F.struct(rank.alias("rank"), "shingle", counted.alias("counted")))
    of_class = shared.groupBy("class").agg(F.array_sort(F.collect_list("spot")).alias("spots"))
    sizes = described.filter("n > 0").select("class", "n", "n_counted").distinct()
    length = F.col("n") - F.floor((share * F.col("n") + 99) / 100) + 1
    alone = F.col("n_counted") - F.size(F.filter("spots", lambda s: s["counted"]))
    room = F.when(F.col("n_counted") >= length, F.greatest(length - alone, F.lit(0))).otherwise(F.size("spots"))
    prefix = F.posexplode(F.slice("spots", F.lit(1), room.cast("int"))).alias("at", "s")
    spots = of_class.join(sizes, "class").select("class", "n", alone.alias("alone"), prefix)
    spots = written(spots.select("s.shingle", "class", "n", (F.col("alone") + F.col("at")).alias("before")), "prefixes")
    several = spots.groupBy("shingle").agg(F.count("*").alias("members")).filter("members > 1").select("shingle")
    return written(spots.join(written(several, "regions"), "shingle"), "region-members")


def _all_pairs(members: DataFrame, share: int) -> DataFrame:
    """``a, b`` of each small region; a region's classes are few and lie in one array."""
    named = members.groupBy("shingle").agg(F.array_sort(F.collect_list(F.struct("class", "n", "before", "root"))).alias("m"))
    left = named.select("m", F.posexplode("m").alias("at", "a"))
    pairs = left.select("a", F.explode(F.slice("m", F.col("at") + 2, F.size("m"))).alias("b"))
    first = _may_meet_first(*[F.col(f"{x}.{y}") for x in "ab" for y in ("n", "before")], share)
    pairs = pairs.filter((F.col("a.root") != F.col("b.root")) & first)
    return pairs.select(F.col("a.class").alias("a"), F.col("b.class").alias("b"))


def _sizes_allow(n: Column, m: Column, share: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * share


def _may_meet_first(n: Column, before_n: Column, m: Column, before_m: Column, share: int) -> Column:
    """Whether a shingle can be the first that two linked sets share: what comes before it in either
    is not shared, and the rest must be enough. Linked sets pass where that shingle is."""
    needed = F.ceil((n + m) * share / (100 + share))
    return _sizes_allow(n, m, share) & (n - before_n >= needed) & (m - before_m >= needed)


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, shared, total``: sizes of intersection and union, counted on the whole sets."""
    one = sets.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("set_b"))
    both = pairs.distinct().join(two, "b").join(one, "a")
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    both = both.select("a", "b", shared.alias("shared"), (F.col("n_a") + F.col("n_b")).alias("sum"))
    return both.select("a", "b", "shared", (F.col("sum") - F.col("shared")).alias("total"))


def _class_sets(rows: DataFrame, described: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """``class, n, shingles``: the whole sets of the classes in regions, each read from one document."""
    active = members.select("class").distinct()
    one = described.select("class", "n", "doc", "row").join(active, "class")
    one = one.groupBy("class", "n").agg(F.min(F.struct("doc", "row")).alias("of")).select("class", "n", "of.doc", "of.row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in unpacked(batches):
            sets = list(_sets(batch.column("text"), size))
            flat = _ordered(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
            shingles = lists(flat, np.array([len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("n"), shingles], names=["class", "n", "shingles"])

    texts = packed(rows.select("doc", "row", "text")).join(one, ["doc", "row"]).select("class", "n", "text")
    return written(texts.mapInArrow(run, "class long, n long, shingles array<long>").dropDuplicates(["class"]), "class-sets")


def _linked(share: int) -> Column:
    return F.col("shared") * 100 >= F.col("total") * share


def _merged_roots(links: list[DataFrame], nothing: DataFrame) -> DataFrame:
    """``class, root`` of all classes that the links found so far connect."""
    roots = components(reduce(DataFrame.unionByName, links, nothing))
    return roots.withColumnRenamed("node", "class")


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` of regions that hold more than one component, with their ``root``."""
    named = members.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = written(named.select("shingle", "class", "n", "root"), "region-members")
    mixed = named.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return named.join(written(mixed.filter("low != high").select("shingle"), "mixed-regions"), "shingle")


def _stars(members: DataFrame) -> DataFrame:
    """``shingle, pivot, class, n``: the classes of each region and its pivot, that of them in most regions."""
    weights = members.groupBy("class").agg(F.count("*").alias("weight"))
    weighed = members.join(weights, "class").groupBy("shingle").agg(F.max(F.struct("weight", "class")).alias("p"))
    stars = members.select("shingle", "class", "n").join(weighed.select("shingle", F.col("p.class").alias("pivot")), "shingle")
    return written(stars.filter("class != pivot"), "region-stars")


def _around(stars: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """``pivot, class, n, linked, differ, sent``: in how many shingles, its own and the pivot's, each class
    differs from its pivot, and in which, as numbers that differ between pivots."""
    pivots = sets.select(F.col("class").alias("pivot"), F.col("n").alias("n_pivot"), F.col("shingles").alias("around"))
    both = stars.select("pivot", "class").distinct().join(sets, "class").join(pivots, "pivot")
    differing = F.concat(F.array_except("shingles", "around"), F.array_except("around", "shingles"))
    both = both.select("pivot", "class", "n", "n_pivot", differing.alias("differing"))
    differ = F.size("differing").cast("long")
    linked = _differ_little(differ, F.col("n") + F.col("n_pivot"), share)
    sent = F.transform("differing", lambda at: F.xxhash64("pivot", at))
    return both.select("pivot", "class", "n", linked.alias("linked"), differ.alias("differ"), sent.alias("sent"))


def _differ_little(differing: Column, sizes: Column, share: int) -> Column:
    """Whether sets that differ in so many shingles, and have so many together, link."""
    return differing * (100 + share) <= sizes * (100 - share)


def _most_before(share: int) -> Column:
    """Shingles of a set of ``n`` that a linked one may lack, at most."""
    return F.floor(F.col("n") * (100 - share) / share)


def _differences(around: DataFrame, share: int) -> DataFrame:
    """``difference, class, n, differ, before``: the regions of differences from a pivot that several have.

    ``differ`` is the number of all differences of the class, of which ``before`` come before this one.
    """
    around = around.withColumn("member", F.xxhash64("pivot", "class"))
    shared = _shared_shingles(around.select(F.col("member").alias("class"), "sent")).withColumnRenamed("class", "member")
    spots = shared.groupBy("member").agg(F.array_sort(F.collect_list(F.struct("n_classes", "shingle"))).alias("spots"))
    spots = spots.join(around.drop("sent"), "member").withColumn("alone", F.col("differ") - F.size("spots"))
    room = F.greatest(_most_before(share) + 1 - F.col("alone"), F.lit(0)).cast("int")
    prefix = F.posexplode(F.slice("spots", F.lit(1), room)).alias("at", "s")
    spots = spots.select("class", "n", "differ", "alone", prefix)
    return spots.select(F.col("s.shingle").alias("difference"), "class", "n", "differ", (F.col("alone") + F.col("at")).alias("before"))


def _pairs_by_differences(around: DataFrame, roots: DataFrame, share: int) -> DataFrame:
    """``a, b``: what may link in the regions of one pivot, and is not connected yet."""
    named = _differences(around, share).join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = written(named, "differences")
    of = lambda x: named.select("difference", *[F.col(name).alias(f"{name}_{x}") for name in ("class", "n", "differ", "before", "root")])
    rest = lambda x: F.col(f"differ_{x}") - F.col(f"before_{x}")
    apart = F.col("before_a") + F.col("before_b") + F.abs(rest("a") - rest("b"))
    may = _differ_little(apart, F.col("n_a") + F.col("n_b"), share)
    pairs = of("a").join(of("b"), "difference").filter((F.col("class_a") < F.col("class_b")) & (F.col("root_a") != F.col("root_b")) & may)
    return pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))


def class_links(rows: DataFrame, described: DataFrame, size: int = SIZE, share: int = LINK) -> DataFrame:
    """``a, b``: links between classes that give the components of all links."""
    nothing = described.sparkSession.createDataFrame([], "a long, b long")
    members = _regions(described, share)
    sets = _class_sets(rows, described, members, size)
    counts = written(members.groupBy("shingle").agg(F.count("*").alias("members")), "region-sizes")
    small = members.join(counts.filter(F.col("members") <= SMALL).select("shingle"), "shingle")
    links, pairs = [nothing], _all_pairs(small.withColumn("root", F.col("class")), share)
    members = members.join(counts.filter(F.col("members") > SMALL).select("shingle"), "shingle")
    for level in range(LEVELS if counts.filter(F.col("members") > SMALL).take(1) else 0):
        stars = _stars(members)
        around = _around(stars, sets, share)
        around = written(around.drop("sent") if level else around, "pivot-distances")
        links.append(around.filter("linked").select(F.col("pivot").alias("a"), F.col("class").alias("b")))
        roots = written(_merged_roots(links, nothing), "roots")
        first = around if level == 0 else first
        if level + 1 < LEVELS:
            members = _apart(stars.join(around.filter("not linked").select("pivot", "class"), ["pivot", "class"]), roots)
            if not members.take(1):
                break
    if len(links) > 1:
        pairs = pairs.unionByName(_pairs_by_differences(first, roots, share))
    found = _measured(pairs, sets)
    return reduce(DataFrame.unionByName, links, found.filter(_linked(share)).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the least node of each linked node's component.

    Every node hangs its larger neighbours, then its smaller ones and itself, on the
    least node it knows, until nothing changes. The rounds are logarithmic in practice.
    """
    edges = written(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    before = sign(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        large = written(large.filter("a != b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("root").alias("b"))
        after = written(small.filter("a != b").distinct(), "edges")
        for old in (edges, large):
            discard(old)
        edges, known, before = after, before, sign(after)
        if before == known:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _classified(rows: DataFrame, size: int, share: int) -> tuple[DataFrame, DataFrame]:
    """Every document's set (``_described``), and ``class, root``, the component of each class."""
    for seed in count(1):
        described = written(_described(rows, size, share, seed), "shingle-sets")
        classes = described.filter("n > 0").groupBy("class", "check", "n").agg(F.min("doc").alias("least"))
        # Two sets with one class number: choose other numbers.
        if not classes.groupBy("class").count().filter("count > 1").take(1):
            break
    roots = components(class_links(rows, described, size, share)).withColumnRenamed("node", "class")
    every = described.filter("n > 0").select("class").distinct()
    return described, written(every.join(roots, "class", "left").select("class", F.coalesce("root", "class").alias("root")), "roots")


def _with_least(rows: DataFrame, size: int, share: int) -> DataFrame:
    """``id, doc, row, n, root, least``: the first ``doc, row`` of each document's component."""
    described, roots = _classified(rows, size, share)
    own = F.struct("doc", "row")
    first = described.join(roots, "class").groupBy("root").agg(F.min(own).alias("least"))
    known = written(roots.join(first, "root").select("class", "root", "least"), "components")
    found = described.select("id", "doc", "row", "n", F.when(F.col("n") > 0, F.col("class")).alias("class"))
    return found.join(known, "class", "left").withColumn("least", F.coalesce("least", own))


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, share: int = LINK
) -> DataFrame:
    """``key, n_shingles, component_id``: of each document, and the least key reachable by links."""
    found = _with_least(keyed(documents, key, text), size, share)
    component = F.nullif(F.col("least.doc"), F.lit(-(1 << 63)))
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(
    documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, share: int = LINK
) -> DataFrame:
    """``documents`` with one of each component: that with the least key. Repeated rows are one."""
    found = _with_least(keyed(documents, key, text), size, share)
    kept = found.filter(F.struct("doc", "row") == F.col("least")).select("doc", "row").distinct()
    kept = written(kept, "kept")
    rows = documents.select(rows_key(key, text), F.struct("*").alias("carried")).select("k.doc", "k.row", "carried")
    rows = rows.join(kept, ["doc", "row"], "left_semi")
    place = F.row_number().over(Window.partitionBy("doc", "row").orderBy("doc"))
    return rows.withColumn("place", place).filter("place = 1").select("carried.*")
