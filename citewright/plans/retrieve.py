"""Hybrid retrieval: vector top-k and keyword top-k, fused and hydrated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.functions.embed import Embedder, HashEmbedder, embed_column
from citewright.operators.fusion import RRF_K, fuse_two
from citewright.operators.keyword import CHUNK_KEY, Index, bm25_topk
from citewright.operators.upsert import bucket_of
from citewright.operators.vector import vector_topk
from citewright.session import MAX_BROADCAST_ROWS, materialise, pinned

PROVENANCE = (
    "chunk_id", "cik", "accession", "company", "form", "filing_date",
    "section_id", "section_label", "start_offset", "end_offset",
)

# Up to this many winners, their accessions become a filter on the chunk scan.
FEW = 64


@dataclass(frozen=True)
class RetrieveOptions:
    """How much each list and the fused list hold. Defaults are fixed values."""

    top_k: int = 8
    vector_k: int = 20
    keyword_k: int = 20
    rrf_k: int = RRF_K


def embed_queries(queries: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    return queries.select(
        "query_id", embed_column(F.col("query"), embedder or HashEmbedder()).alias("embedding")
    )


def hybrid_ranking(
    queries: DataFrame,
    index: Index,
    embedder: Embedder | None = None,
    options: RetrieveOptions | None = None,
) -> DataFrame:
    """Fused winners per query, by chunk key only: texts stay out of the ranking.

    ``queries`` has ``query_id`` and ``query``.
    """
    opts = options or RetrieveOptions()
    embedded = embed_queries(queries, embedder)
    if embedder is not None and embedder.remote:
        embedded = materialise(embedded, "embedded")
    vector = vector_topk(embedded, index.chunks, opts.vector_k, CHUNK_KEY)
    keyword = bm25_topk(queries, index, opts.keyword_k)
    return fuse_two(vector, keyword, CHUNK_KEY, opts.top_k, opts.rrf_k)


def hydrate(ranking: DataFrame, index: Index, small: bool) -> DataFrame:
    """Join winners with their chunk rows; a winner without a row is dropped.

    Winners of a ``small`` batch are broadcast, so the chunk table is read but not
    shuffled. Buckets prune that read to the winners' buckets, and a handful of
    winners also to their row groups. Those of a large batch are written once.
    """
    if small:
        winners, small = pinned(ranking)
    else:
        winners = materialise(ranking, "winners")
    bucket = ["bucket"] if index.buckets else []
    rows = index.chunks.select(*PROVENANCE, "text", *bucket)
    if bucket:
        winners = winners.withColumn("bucket", bucket_of(F.col("accession"), index.buckets))
    if small:
        for column, most in [("accession", FEW), *[(name, index.buckets) for name in bucket]]:
            values = [row[0] for row in winners.select(column).distinct().limit(most + 1).collect()]
            if 0 < len(values) <= most:
                rows = rows.filter(F.col(column).isin(sorted(values)))
    return rows.join(winners, [*bucket, *CHUNK_KEY]).drop(*bucket)


def hybrid_retrieve(
    queries: DataFrame,
    index: Index,
    embedder: Embedder | None = None,
    options: RetrieveOptions | None = None,
) -> DataFrame:
    """One row per query and retrieved chunk, with text, provenance and scores."""
    opts = options or RetrieveOptions()
    most = MAX_BROADCAST_ROWS // max(opts.top_k, 1)
    small = queries.limit(most + 1).count() <= most
    return hydrate(hybrid_ranking(queries, index, embedder, opts), index, small)


def retrieved_array(queries: DataFrame, retrieved: DataFrame) -> DataFrame:
    """``queries`` plus ``retrieved``, an array in rank order that may be empty.

    A query holds at most ``top_k`` chunks, so the groups are small by construction.
    """
    item = F.struct(
        "fused_rank", *PROVENANCE, "text",
        "vector_rank", "vector_distance", "keyword_rank", "rrf",
    )
    grouped = retrieved.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("retrieved"))
    none = F.array().cast(grouped.schema["retrieved"].dataType)
    return queries.join(grouped, "query_id", "left").withColumn(
        "retrieved", F.coalesce("retrieved", none)
    )
