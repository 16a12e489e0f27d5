from __future__ import annotations

import math
import time
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from citewright.llm import language

PATH = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.01"


def by_segmentations(word: str, weights: np.ndarray) -> np.ndarray:
    known, reach = language.pieces(PATH)
    word = language.MARK + word

    @lru_cache(None)
    def ways(at: int):
        if at == len(word):
            return np.ones(weights.shape[1])
        total = np.zeros(weights.shape[1])
        for end in range(at + 1, min(len(word), at + reach) + 1):
            piece = known.get(word[at:end], len(known) + 1 if end - at == 1 else len(known))
            total = total + weights[piece] * ways(end)
        return total

    return np.log(ways(0))


@pytest.fixture(scope="module")
def weights():
    known, _ = language.pieces(PATH)
    values = np.random.default_rng(1).random((len(known) + 2, 3)) + 0.01
    values[-2] = 0
    return values / values.sum(axis=0)


def test_words_sum_over_all_segmentations(weights):
    words = ["a", "the", "thing", "naïve", "日本語", "x" * 40, "extraordinarily", "of", "ab" * 30, "q" * 64]
    for word, score in language.word_scores(words, weights, PATH):
        assert np.allclose(score, by_segmentations(word, weights)), word


def test_words_are_runs_of_letters():
    assert language.letter_runs("Don't x²y ½ Straße9 日本 _a_ " + chr(0x1F600)) == ["don", "t", "x", "y", "straße", "日本", "a"]
    assert language.letter_runs(None) == []


def test_expected_counts_cover_each_word(weights):
    words = ["the", "thing", "thing", "extraordinarily"]
    langs, counts = np.array([0, 1, 2, 0]), np.array([2.0, 1.0, 3.0, 1.0])
    total = language.expected_counts(words, langs, counts, weights, PATH)
    known, _ = language.pieces(PATH)
    sizes = np.array([len(piece) for piece in known] + [0, 1])
    letters = [sum(c * (len(w) + 1) for w, c, k in zip(words, counts, langs) if k == lang) for lang in range(3)]
    assert np.allclose(sizes @ total, letters)


def test_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = language.predict(documents, PATH).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == documents.count()
    assert (got.held_out == [zlib.crc32(str(k).encode()) % 4 == 2 for k in got.doc_id]).all()
    assert got.score.between(0, 1).all()
    unseen = got[got.held_out & (got.lang_pred != "und")]
    assert (unseen.lang == unseen.lang_pred).mean() > 0.97


def test_edges(spark):
    rows = [(i, "the one and the other of it", "en") for i in range(20)]
    rows += [(i, "der eine und die andere davon", "de") for i in range(20, 40)]
    rows += [(50, None, "en"), (51, "", None), (52, "12 !! 34 ² ½ Ⅷ _", "de"), (None, "the one", "en"), (53, "und die " * 50_000, None)]
    rows += [(1, "the one and the other of it", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = language.predict(df, PATH).collect()
    assert len(got) == len(rows)
    found = {row.doc_id: (row.lang_pred, row.score) for row in got}
    assert found[50] == found[51] == found[52] == ("und", 0.0)
    assert found[None][0] == "en" and found[53][0] == "de" and found[1][0] == "en"
    assert not math.isnan(found[53][1])
    empty = language.predict(df.limit(0), PATH)
    assert empty.columns == ["doc_id", "held_out", "lang_pred", "score"] and empty.count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {row.lang_pred for row in language.predict(unlabelled, PATH).collect()} == {"und"}


def test_long_words_are_learned_and_scored_in_linear_time(weights):
    rng = np.random.default_rng(5)
    words = list(language._stretches(["".join(rng.choice(list("abcdé漢"), 50_000)), "short"]))
    assert "".join(words[:-1]).endswith(words[-2]) and max(map(len, words)) == language.LONGEST_LEARNED
    began = time.perf_counter()
    many = np.ones(len(words))
    total = language.expected_counts(words, np.zeros(len(words), int), many, weights, PATH)
    (score,) = (score for _, score in language.word_scores(["".join(words[:-1])], weights, PATH))
    assert np.isfinite(total).all() and np.isfinite(score).all() and time.perf_counter() - began < 120


def test_rows_without_a_key_are_not_sampled_together(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(language, "_count_words", lambda rows: asked.append(rows.count()) or rows.selectExpr("lang", "'word' word", "1L n"))
    rows = [(None if i % 3 else i, f"word {i}", "en") for i in range(3000)]
    language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PATH, texts_per_language=300)
    assert 200 < asked[0] < 400


def test_what_is_remembered_gives_the_same_scores(weights, monkeypatch):
    monkeypatch.setattr(language, "MEMO_WORDS", 3)
    model = language.Model(("a", "b", "c"), weights, np.zeros(3), PATH)
    scorer = language._Scorer(model)
    texts = ["the thing", "of the", None, "naive words here", "the of", "thing"]
    for at in range(0, 6, 2):
        for text, total in zip(texts[at : at + 2], scorer.totals(texts[at : at + 2])):
            alone = language._Scorer(model).totals([text])[0]
            assert (total is None and alone is None) or np.allclose(total, alone)
