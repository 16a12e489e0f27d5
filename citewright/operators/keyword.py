"""Keyword index and BM25 top-k for a whole batch of queries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewright.functions.tokens import index_terms, query_terms
from citewright.operators.blocks import UNITS, best_scores, blockwise_topk
from citewright.operators.postings import dealt, directory, posting_blocks, postings_topk, term_bucket
from citewright.session import materialise, pinned

CHUNK_KEY = ("accession", "start_offset")

# BM25 parameters, and the least weight a common term may have.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6

MAX_BROADCAST_TERMS = 100_000
# Up to this many distinct terms, they become a filter on the chunk scan.
MAX_LITERAL_TERMS = 10_000
# Entries that are all scored sooner than their blocks are ranked.
FEW_ENTRIES = 5_000_000
_CELLS = 4_000_000


def postings_of(chunks: DataFrame) -> DataFrame:
    """The index by term: ``accession, start_offset, term, tf, n_terms``.

    Terms are counted on the map side first, so each chunk ships its distinct
    terms once.
    """
    return (
        chunks.select(*CHUNK_KEY, index_terms(F.col("text")).alias("terms"))
        .select(*CHUNK_KEY, F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
        .groupBy(*CHUNK_KEY, "n_terms", "term")
        .agg(F.count("*").alias("tf"))
        .select(*CHUNK_KEY, "term", "tf", "n_terms")
    )


def query_term_counts(queries: DataFrame) -> DataFrame:
    """``query_id, term, times``: each time a query repeats a term counts again."""
    return (
        queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("times"))
    )


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)))
    return F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR))


def term_frequency(chunks: DataFrame, *by: str) -> DataFrame:
    """``*by, term, df``: in how many chunks each term occurs.

    Counts are combined before the shuffle, so a term that most chunks share
    ships one row per task.
    """
    terms = chunks.select(*by, F.explode(F.array_distinct("terms")).alias("term"))
    return terms.groupBy(*by, "term").agg(F.count("*").alias("df"))


def chunk_totals(chunks: DataFrame, *by: str) -> DataFrame:
    """``*by, n, n_terms``: how many chunks there are and how long they are together."""
    return chunks.groupBy(*by).agg(F.count("*").alias("n"), F.sum("n_terms").alias("n_terms"))


@dataclass(frozen=True)
class Index:
    """What retrieval reads: chunks, and the counts that weigh their terms.

    The counts may be split by bucket; they are added up per queried term.
    ``buckets`` is set where the chunks are partitioned by a bucket column. Keyword
    queries read ``postings`` where there are any, and the terms of all chunks where not.
    ``repeated`` has the keys that several of the chunks share, if there are such.
    """

    chunks: DataFrame
    frequency: DataFrame
    totals: DataFrame
    buckets: int | None = None
    postings: DataFrame | None = None
    repeated: DataFrame | None = None

    @classmethod
    def of(cls, chunks: DataFrame) -> Index:
        """Index ``chunks`` by term once and keep the counts."""
        totals = materialise(chunk_totals(chunks), "totals")
        n_chunks = totals.agg(F.sum("n")).first()[0] or 0
        postings = materialise(dealt(posting_blocks(chunks, CHUNK_KEY), n_chunks), "postings", "term_bucket")
        keys = directory(postings).select(F.inline("keys")).groupBy(*CHUNK_KEY).agg(F.count("*").alias("n"))
        repeated = materialise(keys.filter("n > 1").drop("n"), "repeated-keys")
        frequency = postings.filter(F.col("term").isNotNull()).select("term_bucket", "term", "df")
        return cls(chunks, frequency, totals, None, postings, None if repeated.isEmpty() else repeated)


def _listed(terms: list[str]) -> str:
    """Terms as SQL literals; query terms are ASCII letters and digits only.

    One expression text parses faster than that many literal columns are built.
    """
    return ", ".join(f"'{term}'" for term in sorted(terms))


def _of_terms(table: DataFrame, terms: list[tuple[str, int]]) -> DataFrame:
    """The rows of ``table`` that have one of the given terms, by partition and by pushed-down filter."""
    if not 0 < len(terms) <= MAX_LITERAL_TERMS:
        return table
    if "term_bucket" in table.columns:
        table = table.filter(F.col("term_bucket").isin(sorted({bucket for _, bucket in terms})))
    return table.filter(F.expr(f"term IN ({_listed([term for term, _ in terms])})"))


def weighted_terms(asked: DataFrame, index: Index) -> DataFrame:
    """``query_id, term, weight, mean_terms, df`` of the asked terms that occur at all."""
    asked, small = pinned(asked)
    frequency = index.frequency
    if small:
        terms = asked.select("term", term_bucket(F.col("term")).alias("term_bucket")).distinct().collect()
        frequency = _of_terms(frequency, [tuple(row) for row in terms])
    found = frequency.join(asked, "term")
    counted = found.groupBy("query_id", "term", "times").agg(F.sum("df").cast("double").alias("df"))
    totals = index.totals.agg(
        F.sum("n").cast("double").alias("n"),
        (F.sum("n_terms") / F.sum("n")).cast("double").alias("mean_terms"),
    )
    return counted.select(
        "query_id",
        "term",
        (F.col("times") * idf(totals.select("n").scalar(), F.col("df"))).alias("weight"),
        totals.select("mean_terms").scalar().alias("mean_terms"),
        "df",
    )


@dataclass
class _Block:
    vocabulary: pa.Array
    first: np.ndarray
    numbers: np.ndarray
    weights: np.ndarray
    mean_terms: float
    n_queries: int


class _Bm25:
    """Adds up what each term gives to each pair of a chunk and a query that share it."""

    query_columns = ("term", "weight", "mean_terms")
    corpus_columns = ("terms", "n_terms")

    def narrow(self, corpus: DataFrame, query_rows: pa.Table) -> DataFrame:
        """Only asked terms leave the JVM."""
        asked = pc.unique(query_rows["term"]).to_pylist()
        if len(asked) > MAX_LITERAL_TERMS:
            return corpus
        return corpus.withColumn("terms", F.expr(f"filter(terms, t -> t IN ({_listed(asked)}))"))

    def prepare(self, query_rows: pa.Table) -> tuple[pa.Array, _Block]:
        ids = query_rows["query_id"].combine_chunks().dictionary_encode()
        terms = query_rows["term"].combine_chunks().dictionary_encode()
        codes = terms.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        block = _Block(
            terms.dictionary,
            np.searchsorted(codes[order], np.arange(len(terms.dictionary) + 1)),
            ids.indices.to_numpy(zero_copy_only=False)[order],
            query_rows["weight"].to_numpy()[order],
            query_rows["mean_terms"][0].as_py(),
            len(ids.dictionary),
        )
        return ids.dictionary, block

    def slice_rows(self, state: _Block) -> int:
        return max(64, _CELLS // state.n_queries)

    def best(self, state: _Block, part: pa.Table, k: int):
        lists = part["terms"].combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        codes = pc.index_in(lists.flatten(), value_set=state.vocabulary)
        hit = codes.is_valid().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(sizes)), sizes)[hit]
        pairs = codes.drop_null().to_numpy(zero_copy_only=False).astype(np.int64) * len(sizes) + rows
        pairs, tf = np.unique(pairs, return_counts=True)
        codes, rows = np.divmod(pairs, len(sizes)) if len(pairs) else (pairs, pairs)
        n_terms = part["n_terms"].to_numpy()
        length = 1.0 - B + B * n_terms[rows] / state.mean_terms
        gains = tf * (K1 + 1.0) / (tf + K1 * length)
        scores = np.zeros((state.n_queries, len(sizes)))
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        for a, b in zip(starts, np.append(starts[1:], len(codes))):
            asked = slice(state.first[codes[a]], state.first[codes[a] + 1])
            scores[state.numbers[asked][:, None], rows[a:b]] += (
                state.weights[asked][:, None] * gains[a:b]
            )
        return best_scores(scores, k)


def bm25_topk(
    queries: DataFrame, index: Index, k: int, max_broadcast_terms: int = MAX_BROADCAST_TERMS
) -> DataFrame:
    """``query_id, accession, start_offset, keyword_rank, keyword_score``.

    ``queries`` has ``query_id`` and ``query``. A chunk that shares no term with a
    query is not in its list.
    """
    weighted = weighted_terms(query_term_counts(queries), index)
    found = None if index.postings is None else _from_postings(weighted, index, k)
    if found is None:
        found = blockwise_topk(weighted, index.chunks, CHUNK_KEY, k, _Bm25(), max_broadcast_terms)
    return _named(found)


def _from_postings(weighted: DataFrame, index: Index, k: int) -> DataFrame | None:
    """The best chunks by the inverted index.

    Nothing where the batch asks for more entries than the corpus has terms: then one
    scan that meets all queries at once reads less.
    """
    weighted, small = pinned(weighted)
    if not small:
        return None
    every = index.totals.select(F.sum("n_terms")).scalar()
    work = weighted.agg(F.sum("df").alias("entries"), F.first(every).alias("terms")).first()
    if (work["entries"] or 0) > (work["terms"] or 0):
        return None
    terms = weighted.select("term", term_bucket(F.col("term")).alias("term_bucket")).distinct().collect()
    postings = _of_terms(index.postings, [tuple(row) for row in terms])
    prune = (work["entries"] or 0) > FEW_ENTRIES
    by = ["bucket"] if index.buckets else []
    blocks = directory(index.postings)
    return postings_topk(weighted, postings, blocks, CHUNK_KEY, k, K1, B, *by, prune=prune, repeated=index.repeated)


def _named(found: DataFrame) -> DataFrame:
    return found.select(
        "query_id",
        *CHUNK_KEY,
        F.col("rank").alias("keyword_rank"),
        (-F.col("key") / F.lit(UNITS)).alias("keyword_score"),
    )
