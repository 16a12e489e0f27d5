from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citewright.functions.tokens import index_terms
from citewright.operators.fusion import fuse_two, rank_fusion
from citewright.operators.keyword import (
    Index,
    _from_postings,
    bm25_topk,
    chunk_totals,
    query_term_counts,
    term_frequency,
    weighted_terms,
)
from citewright.operators.postings import reaching
from citewright.operators.vector import nearest, vector_topk
from citewright.plans.retrieve import RetrieveOptions, hybrid_retrieve, retrieved_array
from citewright.session import materialise

RNG = np.random.default_rng(7)


def vectors(spark, name, matrix):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>").repartition(3)


def test_nearest_is_exact_with_ties():
    x = RNG.integers(0, 3, (400, 5)).astype(float)
    q = RNG.integers(0, 3, (30, 5)).astype(float)
    rows, cols, _ = nearest(q, x, 7)
    for i in range(30):
        keys = np.floor(np.sqrt(((x - q[i]) ** 2).sum(axis=1)) * 1e9 + 0.5)
        assert cols[rows == i].tolist() == np.lexsort((np.arange(400), keys))[:7].tolist()


@pytest.mark.parametrize("limit", [1000, 4])
def test_vector_topk_either_way(spark, limit, monkeypatch):
    """The broadcast and the co-grouped form agree with brute force."""
    monkeypatch.setattr("citewright.operators.blocks.CORPUS_BLOCK", 40)
    monkeypatch.setattr("citewright.operators.blocks.SHUFFLE_BLOCKS", 1)
    x = RNG.integers(0, 4, (150, 6)).astype(np.float32)
    q = RNG.integers(0, 4, (11, 6)).astype(np.float32)
    q[0] = 0
    found = vector_topk(
        vectors(spark, "query_id", q), vectors(spark, "vec_id", x), 5, ["vec_id"], limit
    ).collect()
    got = {(r.query_id, r.vector_rank): (r.vec_id, r.vector_distance) for r in found}
    assert len(got) == 55
    for i in range(11):
        d = np.sqrt(((x.astype(float) - q[i]) ** 2).sum(axis=1))
        for rank, j in enumerate(np.lexsort((np.arange(150), np.round(d, 9)))[:5], start=1):
            assert got[i, rank][0] == j
            assert math.isclose(got[i, rank][1], d[j], abs_tol=1e-8)


def test_vector_sizes_must_agree(spark):
    with pytest.raises(Exception, match="do not match"):
        vector_topk(
            vectors(spark, "query_id", np.ones((1, 3))), vectors(spark, "vec_id", np.ones((2, 4))), 1, ["vec_id"]
        ).collect()


def test_no_queries_no_rows(spark, index):
    none = spark.createDataFrame([], "query_id long, query string")
    assert hybrid_retrieve(none, index).count() == 0


WORDS = "the frost harvest cider robot dock lease the the freight élan pruning".split()


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [" ".join(RNG.choice(WORDS, RNG.integers(1, 15))) for _ in range(120)]
    rows = [(f"{i % 9:03d}", i, t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "accession string, start_offset int, text string")
    chunks = chunks.withColumn("terms", index_terms(F.col("text"))).withColumn("n_terms", F.size("terms"))
    return rows, Index.of(materialise(chunks.repartition(3), "corpus"))


def plain_bm25(rows, query, k):
    folded = [t.replace("é", "e").split() for _, _, t in rows]
    mean = sum(map(len, folded)) / len(folded)
    scores = {}
    for term in [t for t in query.split() if len(t) > 1]:
        df = sum(term in doc for doc in folded)
        idf = max(math.log((len(rows) - df + 0.5) / (df + 0.5)), 0) or 1e-6
        for row, doc in zip(rows, folded):
            tf = Counter(doc)[term]
            if tf:
                gain = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean))
                scores[row[:2]] = scores.get(row[:2], 0) + gain
    ranked = sorted(scores, key=lambda key: (-round(scores[key], 9), key))[:k]
    return [(key, round(scores[key], 6)) for key in ranked]


@pytest.mark.parametrize("limit", [1000, 3])
def test_bm25_either_way(spark, corpus, limit, monkeypatch):
    monkeypatch.setattr("citewright.operators.blocks.CORPUS_BLOCK", 30)
    monkeypatch.setattr("citewright.operators.blocks.SHUFFLE_BLOCKS", 1)
    rows, index = corpus
    index = Index(index.chunks, index.frequency, index.totals)
    asked = ["frost frost robot", "the", "dock x lease elan", "unknown words", "", "cider harvest the freight"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    found = bm25_topk(queries, index, 6, limit).orderBy("query_id", "keyword_rank").collect()
    for i, query in enumerate(asked):
        got = [((r.accession, r.start_offset), round(r.keyword_score, 6)) for r in found if r.query_id == i]
        assert got == plain_bm25(rows, query, 6)


@pytest.mark.parametrize("block, first, literals, few", [(1024, 2, 10_000, 10**6), (7, 1, 10_000, 0), (3, 2, 0, 0)])
def test_bm25_from_postings(spark, corpus, monkeypatch, block, first, literals, few):
    """Blocks below the floor are left out and nothing is lost, ties included."""
    monkeypatch.setattr("citewright.operators.postings.BLOCK", block)
    monkeypatch.setattr("citewright.operators.postings.FIRST", first)
    monkeypatch.setattr("citewright.operators.keyword.MAX_LITERAL_TERMS", literals)
    monkeypatch.setattr("citewright.operators.keyword.FEW_ENTRIES", few)
    rows, index = corpus
    index = Index.of(index.chunks)
    asked = ["frost frost robot", "the", "dock x lease elan", "unknown words", "", "cider harvest the freight"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    weighted = weighted_terms(query_term_counts(queries), index)
    assert _from_postings(weighted, index, 6) is not None
    found = bm25_topk(queries, index, 6).orderBy("query_id", "keyword_rank").collect()
    for i, query in enumerate(asked):
        got = [((r.accession, r.start_offset), round(r.keyword_score, 6)) for r in found if r.query_id == i]
        assert got == plain_bm25(rows, query, 6)


def test_blocks_below_the_floor_are_left_out(spark):
    bounds = [(1, 0, 9.0, 1), (1, 1, 8.0, 2), (1, 2, 5.0, 3), (1, 3, 5.0 - 2e-9, 4), (2, 0, 3.0, 1), (2, 1, 1.0, 3)]
    ranked = spark.createDataFrame(bounds, "query_id long, block long, bound double, place int")
    floors = spark.createDataFrame([(1, -5_000_000_000), (2, None)], "query_id long, floor long")
    assert sorted((r.query_id, r.block) for r in reaching(ranked, floors).collect()) == [(1, 2), (2, 1)]


def test_a_question_reads_its_terms_only(spark, corpus, capsys):
    _, index = corpus
    queries = spark.createDataFrame([(1, "frost")], "query_id long, query string")
    bm25_topk(queries, index, 2).explain("formatted")
    scans = [part for part in capsys.readouterr().out.split("\n\n") if "Scan parquet" in part and "entries" in part]
    assert scans
    for scan in scans:
        assert "term_bucket" in scan.split("PartitionFilters:")[1].split("\n")[0]
        assert "frost" in scan.split("PushedFilters:")[1].split("\n")[0]


def test_counts_may_be_split_by_bucket(spark, corpus):
    _, index = corpus
    parted = index.chunks.withColumn("bucket", F.col("start_offset") % 4)
    split = Index(index.chunks, term_frequency(parted, "bucket"), chunk_totals(parted, "bucket"))
    queries = spark.createDataFrame([(1, "frost robot lease")], "query_id long, query string")
    key = lambda i: sorted(map(tuple, bm25_topk(queries, i, 6).collect()))
    assert key(split) == key(index)


def ranked(spark, *lists):
    rows = [(0, i, n, r) for n, ids in enumerate(lists) for r, i in enumerate(ids, start=1)]
    return spark.createDataFrame(rows, "query_id int, id int, list_no int, rank int")


def test_fusion_goldens(spark):
    top = rank_fusion(ranked(spark, [1, 3, 4], [2, 3, 5]), ["id"], 2).orderBy("fused_rank").first()
    assert top.id == 3 and math.isclose(top.rrf, 2 / 62)
    ranks = {r.id: r.ranks for r in rank_fusion(ranked(spark, [10, 20], [20, 30]), ["id"], 2).collect()}
    assert ranks[20] == [2, 1] and ranks[30] == [None, 2]
    tie = rank_fusion(ranked(spark, [5], [3]), ["id"], 2).orderBy("fused_rank").collect()
    assert [r.id for r in tie] == [3, 5]
    twice = rank_fusion(ranked(spark, [7, 7]), ["id"], 1).first()
    assert math.isclose(twice.rrf, 1 / 61 + 1 / 62) and twice.ranks == [2]


def test_two_lists_agree_with_many(spark):
    a, b = [4, 1, 9, 2], [2, 8, 4]
    many = rank_fusion(ranked(spark, a, b), ["id"], 2, top=5)
    vector = spark.createDataFrame([(0, i, r, 0.5) for r, i in enumerate(a, 1)],
                                   "query_id int, id int, vector_rank int, vector_distance double")
    keyword = spark.createDataFrame([(0, i, r) for r, i in enumerate(b, 1)],
                                    "query_id int, id int, keyword_rank int")
    two = fuse_two(vector, keyword, ["id"], 5)
    key = lambda df: sorted(map(tuple, df.select("id", "fused_rank", "rrf").collect()))
    assert key(two) == key(many)


def test_retriever_finds_the_section(spark, index):
    asked = [(1, "orchard cider takings cider"), (2, "pruning robots frost risk"), (3, "freight volumes warehouses")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    rows = hybrid_retrieve(queries, index).filter("fused_rank = 1").orderBy("query_id").collect()
    assert [(r.company.split()[0], r.section_id) for r in rows] == [
        ("Orchard", "part-i-item-1"), ("Orchard", "part-ii-item-1a"), ("Harbor", "part-ii-item-7"),
    ]
    assert all(r.vector_rank and r.keyword_rank and r.rrf > 0.02 for r in rows)


def test_retrieved_array_is_in_rank_order_and_may_be_empty(spark, index):
    queries = spark.createDataFrame([(1, "frost"), (2, "freight")], "query_id long, query string")
    found = hybrid_retrieve(queries, index, options=RetrieveOptions(top_k=3)).filter("query_id = 1")
    rows = {r.query_id: r.retrieved for r in retrieved_array(queries, found).collect()}
    assert [c.fused_rank for c in rows[1]] == [1, 2, 3] and rows[2] == []
