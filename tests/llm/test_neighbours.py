from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from citewright.llm import neighbours


def by_hand(rows, k=10, step=100):
    usable = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8]
    out = {}
    for query, vector in usable:
        if query % step == 0:
            best = sorted({(float(np.sqrt(((v - vector) ** 2).sum())), i) for i, v in usable if i != query})
            first: dict = {}
            for score, i in best:
                first.setdefault(i, score)
            out[query] = sorted((s, i) for i, s in first.items())[:k]
    return out


def test_curve_visits_neighbouring_cells():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = neighbours.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_exact_where_windows_cover_all(spark):
    rng = np.random.default_rng(5)
    rows = [(n, rng.standard_normal(8).round(2).tolist()) for n in range(900)]
    hot = rows[17][1]
    rows += [(1000 + n, hot) for n in range(400)] + [(2000, hot), (17, hot)]
    rows += [(3000, None), (3100, [0.0] * 8), (3200, [1.0] * 7 + [None]), (3300, [math.nan] * 8), (3400, [math.inf] * 8), (3500, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"entry": F.lit(1), "score": F.lit("x")})
    got: dict = {}
    for row in neighbours.nearest(df, F.col("id") % 100 == 0).orderBy("query_id", "rank").collect():
        assert row["rank"] == len(got.setdefault(row.query_id, [])) + 1
        got[row.query_id].append((row.score, row.vec_id))
    want = by_hand(rows)
    assert got.keys() == want.keys()
    for query in want:
        assert [i for _, i in got[query]] == [i for _, i in want[query]], query
        assert np.allclose([s for s, _ in got[query]], [s for s, _ in want[query]])
    empty = neighbours.nearest(df.limit(0), F.col("id") % 100 == 0)
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.count() == 0


def test_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = vectors.toPandas().sort_values("vec_id")
    ids, matrix = table.vec_id.to_numpy(), np.vstack(table.embedding.to_numpy()).astype(float)
    got = neighbours.nearest(vectors, F.col("id") % 100 == 0).toPandas().groupby("query_id").vec_id.apply(set)
    hits = []
    for at in np.flatnonzero(ids % 100 == 0):
        scores = np.sqrt(((matrix - matrix[at]) ** 2).sum(axis=1))
        scores[at] = np.inf
        hits.append(len(got[ids[at]] & set(ids[np.lexsort((ids, scores))[:10]].tolist())) / 10)
    assert np.mean(hits) >= 0.9


def test_windows_follow_the_table():
    for curves in (1, 16):
        for entries in (1, 10_256, 51_282, 98_304, 300_000, 5_000_000, 10**9):
            block, reach = neighbours.windows_for(entries, curves)
            assert neighbours.BLOCK <= block <= neighbours.MOST_IN_BLOCK and reach >= 1
            assert curves * (2 * reach + 1) * block >= entries


@pytest.mark.parametrize("n, block, most", [(30_000, 200, 200), (300_000, neighbours.BLOCK, neighbours.MOST_IN_BLOCK)])
def test_recall_beyond_the_least_windows(spark, monkeypatch, tmp_path, n, block, most):
    """Three times what 16 windows of three least blocks hold, in noise around ten centres as the given tables have."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "MOST_IN_BLOCK", most)
    rng = np.random.default_rng(11)
    width = 64
    centres = rng.standard_normal((10, width))
    centres /= 4 * np.linalg.norm(centres, axis=1, keepdims=True)
    matrix = centres[rng.integers(0, 10, n)] + rng.standard_normal((n, width)) * 0.12
    matrix = (matrix / np.linalg.norm(matrix, axis=1, keepdims=True)).astype(np.float32)
    lists = pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), width).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": lists}), tmp_path / "vectors.parquet")
    vectors = spark.read.parquet(str(tmp_path / "vectors.parquet"))
    found = neighbours.nearest(vectors, F.col("id") % (n // 100) == 0).toPandas()
    got = found.groupby("query_id").vec_id.apply(set)
    asked = np.arange(0, n, n // 100)
    assert sorted(got.index) == asked.tolist() and (found["rank"] <= 10).all()
    hits = []
    for at in asked:
        scores = ((matrix - matrix[at]) ** 2).sum(axis=1)
        scores[at] = np.inf
        hits.append(len(got[at] & set(np.argpartition(scores, 10)[:10].tolist())) / 10)
    print(f"recall at {n}: {np.mean(hits):.3f}")
    assert np.mean(hits) >= 0.9
