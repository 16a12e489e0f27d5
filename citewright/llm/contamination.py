"""Benchmark decontamination: size-partitioned MinHash containment search, exactly verified.

Test items are short and documents long, so the similarity that counts is the share
of an item's shingles that a document contains. Of an item with ``n`` shingles, a
document with the wanted share lacks at most ``m``, so it contains one of any
``m + 1``: the signature of an item is its ``m + 1`` least hashes (its MinHashes),
``m`` being that of its size class, which holds the sizes up to the next power of
two. No document is missed that way. A document that shares a signature shingle,
and enough shingles of all items together for the size in question, is a candidate;
the item's shingles that it contains are then counted, as text.

Only column functions are used. A document is read once: of its shingles those stay
whose hash falls into a bucket that some item shingle has. The buckets are
broadcast; there are ``2**BUCKETS`` at most, whatever the tables' size. What is
shuffled is the small rest.

* Items or documents that are null or have no word match nothing. An item with fewer
  words than a shingle is one shingle of all its words; for the lengths that such
  items have, documents are cut into shingles of that length, too.
* For ``contained``, rows with equal ids are one item or document, with the shingles
  of all of them; so are rows whose id is null. ``without`` judges every row by itself.
* Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewright.llm.shared import rows_key, written

WORDS = 5
# The share of an item's shingles that a document must contain, in hundredths.
SHARE = 80
# Buckets of hashes, as a power of two.
BUCKETS = 18

NO_ID = -(1 << 63)


def _by_id(key: str) -> Column:
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_ID))


def _rows(table: DataFrame, ident: Column, text: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.col(f"`{text}`").cast("string")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return table.select(ident.alias("id"), words.alias("words")).filter(F.size("words") > 0)


def _hashes(rows: DataFrame, size: int, shorter: Sequence[int] = ()) -> DataFrame:
    """``id, words, hash, at, width``: every shingle of every row, of ``size`` words (or all, if
    there are fewer) and of each of the ``shorter`` numbers of words."""

    def shingles(width: int) -> Column:
        def shingle(at: Column) -> Column:
            hashed = F.xxhash64(*[F.get("words", at + k) for k in range(width)])
            return F.struct(hashed.alias("hash"), at.alias("at"), F.lit(width).alias("width"))

        last = F.size("words") - width
        if width == size:
            return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), shingle)
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), shingle)).otherwise(F.array())

    each = shingles(size) if not shorter else F.concat(*map(shingles, (size, *shorter)))
    return rows.select("id", "words", F.explode(each).alias("s")).select("id", "words", "s.*")


def _texts(shingles: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", F.slice("words", F.col("at") + 1, F.col("width")))
    return shingles.select("id", text.alias("shingle")).distinct()


def _bucket(hash_: str) -> Column:
    return F.shiftrightunsigned(F.col(hash_), 64 - BUCKETS)


def _found(documents: DataFrame, items: DataFrame, size: int, share: int) -> DataFrame:
    """``id, item, n, needed, n_shared`` of all pairs with enough shingles, ``id`` and ``item`` as the rows name them."""
    hashed = _hashes(items, size)
    wanted = written(_texts(hashed).withColumnRenamed("id", "item"), "item-shingles")
    # Fewer than ``size`` different lengths.
    short = items.select(F.size("words").alias("n")).filter(F.col("n") < size).distinct()
    shorter = sorted(row.n for row in short.collect())
    buckets = F.broadcast(hashed.select(_bucket("hash").alias("bucket")).distinct())

    seen = _hashes(documents, size, shorter).withColumn("bucket", _bucket("hash"))
    near = _texts(seen.join(buckets, "bucket", "left_semi"))
    hits = written(near.join(wanted.select("shingle").distinct(), "shingle", "left_semi"), "shingle-hits")

    of_item = Window.partitionBy("item")
    sized = wanted.withColumn("n", F.count("*").over(of_item))
    needed = F.ceil(F.col("n") * share / 100).cast("long")
    largest = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    lacking = F.floor(largest * (100 - share) / 100)
    least = F.row_number().over(of_item.orderBy(F.xxhash64("shingle"), "shingle"))
    signature = sized.withColumns({"needed": needed, "rank": least}).filter(F.col("rank") <= lacking + 1)

    enough = hits.groupBy("id").agg(F.count("*").alias("found"))
    candidates = (
        hits.join(signature.select("item", "shingle", "n", "needed"), "shingle")
        .select("id", "item", "n", "needed")
        .distinct()
        .join(enough, "id")
        .filter("found >= needed")
    )
    shared = candidates.join(wanted, "item").join(hits, ["id", "shingle"])
    return shared.groupBy("id", "item", "n", "needed").agg(F.count("*").alias("n_shared")).filter("n_shared >= needed")


def contained(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    item: str = "item_id",
    text: str = "text",
    size: int = WORDS,
    share: int = SHARE,
) -> DataFrame:
    """``key, item, n_shingles, n_shared``: each item of which a document contains at least
    ``share`` hundredths of the different shingles."""
    counted = _found(_rows(documents, _by_id(key), text), _rows(items, _by_id(item), text), size, share)
    back = lambda name: F.nullif(F.col(name), F.lit(NO_ID))
    return counted.select(back("id").alias(key), back("item").alias(item), F.col("n").alias("n_shingles"), "n_shared")


def without(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    item: str = "item_id",
    text: str = "text",
    size: int = WORDS,
    share: int = SHARE,
) -> DataFrame:
    """``documents`` that contain no item. Rows that share an id, or have none, are told apart by their texts."""
    ident = lambda name: rows_key(name, text).alias("id")
    found = _found(_rows(documents, ident(key), text), _rows(items, ident(item), text), size, share)
    leaks = written(found.select("id").distinct(), "leaks")
    rows = documents.select(ident(key), F.struct("*").alias("carried"))
    return rows.join(leaks, "id", "left_anti").select("carried.*")
