"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the constant added to each rank.
RRF_K = 60


def rank_fusion(
    lists: DataFrame, ids: Sequence[str], n_lists: int, k: int = RRF_K, top: int | None = None
) -> DataFrame:
    """``query_id, *ids, fused_rank, rrf, ranks`` from ``query_id, *ids, list_no, rank``.

    An id scores ``1 / (k + rank)`` for each time a list names it, added in list
    order; ``ranks`` has one entry per list, null where the list lacks the id.
    Equal scores go by the ids.
    """
    entries = F.array_sort(F.collect_list(F.struct("list_no", "rank")))
    fused = (
        lists.groupBy("query_id", *ids)
        .agg(entries.alias("entries"))
        .select(
            "query_id",
            *ids,
            F.aggregate(
                "entries", F.lit(0.0), lambda acc, e: acc + F.lit(1.0) / (F.lit(k) + e["rank"])
            ).alias("rrf"),
            F.transform(
                F.sequence(F.lit(0), F.lit(n_lists - 1)),
                lambda i: F.array_max(
                    F.transform(
                        F.filter("entries", lambda e: e["list_no"] == i), lambda e: e["rank"]
                    )
                ),
            ).alias("ranks"),
        )
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), *ids)
    ranked = fused.withColumn("fused_rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("fused_rank") <= top)
    return ranked.select("query_id", *ids, "fused_rank", "rrf", "ranks")


def fuse_two(
    vector: DataFrame, keyword: DataFrame, ids: Sequence[str], top: int, k: int = RRF_K
) -> DataFrame:
    """Fuse a vector and a keyword list, keeping ranks and distance of each winner."""
    absent = F.lit(None)
    both = vector.select(
        "query_id", *ids, "vector_rank", "vector_distance", absent.cast("int").alias("keyword_rank")
    ).unionByName(
        keyword.select(
            "query_id",
            *ids,
            absent.cast("int").alias("vector_rank"),
            absent.cast("double").alias("vector_distance"),
            "keyword_rank",
        )
    )
    share = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    merged = (
        both.groupBy("query_id", *ids)
        .agg(*[F.max(c).alias(c) for c in ("vector_rank", "vector_distance", "keyword_rank")])
        .withColumn("rrf", share("vector_rank") + share("keyword_rank"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), *ids)
    return merged.withColumn("fused_rank", F.row_number().over(order)).filter(
        F.col("fused_rank") <= top
    )
