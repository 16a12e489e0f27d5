from __future__ import annotations

import random

import corpus_pipeline
from citewright.llm.shared import written
from pyspark.sql import functions as F
from tests.llm import test_contamination, test_jaccard, test_runs


def test_each_stage_does_what_its_operator_says(spark, tmp_path):
    rng = random.Random(8)
    word = lambda lang: rng.choice({"en": ["the", "of", "and", "with", "house"], "de": ["der", "und", "nicht", "haus", "mit"]}[lang]) + rng.choice("abcdefgh")
    sentence = lambda lang, n: " ".join(word(lang) for _ in range(n))
    item = sentence("en", 30)
    passage = sentence("de", 60)
    rows = []
    for key in range(80):
        lang = "en" if key % 2 else "de"
        text = sentence(lang, rng.randint(20, 120))
        if key % 9 == 0:
            text += " " + item
        if key % 7 == 0:
            text += " " + passage
        rows.append((key, text, lang, "src", len(text), "more"))
    rows += [(100, rows[5][1], "en", "src", 1, "more"), (101, rows[5][1] + " end", "en", "src", 1, None), (5, *rows[5][1:])]
    rows += [(102, "12 34 !!", "en", "src", 8, None), (103, None, "en", "src", 0, None), (104, "", None, None, 0, None), (None, sentence("en", 40), "en", "src", 0, "x")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, carried string"
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, columns)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "decontamination", "byte_bpe"]
    pairs = lambda df: sorted([(r.doc_id, r.text) for r in df.collect()], key=str)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = pairs(docs)
        after = written(stage(spark, docs, str(tmp_path)), "stage")
        if number < 4:
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        if number == 0:
            assert pairs(after) == [row for row in before if row[1] and any(c.isalpha() for c in row[1])]
        elif number == 1:
            keep = {}
            for (key, _, component), row in zip(test_jaccard.by_hand(before), sorted(before, key=lambda r: str(r[:1]))):
                keep.setdefault(component, key)
            assert sorted(key for key, _ in pairs(after) if key is not None) == sorted(k for k in keep if k is not None)
        elif number == 2:
            sizes = {key: (n, gone) for key, n, gone, _, _ in test_runs.by_hand(before)}
            assert all(len(text.encode()) == sizes[key][0] - sizes[key][1] for key, text in pairs(after))
            assert any(gone for _, gone in sizes.values())
            assert after.filter(F.length("text") != F.col("n_chars")).count() == 0
        elif number == 3:
            bad = {key for key, *_ in test_contamination.by_hand(before, [(1, item)], 80)}
            assert bad and pairs(after) == [row for row in before if row[0] not in bad]
        else:
            assert after.count() == len(before) and after.filter("not exact").count() == 0
        docs = after


def test_run_over_a_table(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and out.filter("not exact").count() == 0
