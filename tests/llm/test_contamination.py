from __future__ import annotations

import math
import random
import re

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from citewright.llm import contamination, queries


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(text, size=5):
    words = words_of(text)
    return {" ".join(words[at : at + size]) for at in range(max(1, len(words) - size + 1))} if words else set()


def by_hand(documents, items, share):
    sets: dict = {}
    wanted: dict = {}
    short = {len(words_of(text)) for _, text in items} & {1, 2, 3, 4}
    for key, text in items:
        wanted.setdefault(key, set()).update(shingles(text))
    for key, text in documents:
        sets.setdefault(key, set()).update(shingles(text), *(shingles(text, size) for size in short))
    out = []
    for key, mine in sets.items():
        for item, theirs in wanted.items():
            if theirs and len(theirs & mine) >= math.ceil(len(theirs) * share / 100):
                out.append((key, item, len(theirs), len(theirs & mine)))
    return sorted(out, key=str)


@pytest.mark.parametrize("share", [80, 50])
def test_equals_brute_force(spark, share):
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyzé") + rng.choice(["", "1"])
    items = [(n, " ".join(word() for _ in range(rng.randint(1, 60)))) for n in range(40)]
    items += [(50, None), (51, ""), (52, "?!"), (None, items[3][1]), (4, items[5][1]), (7, items[7][1])]
    documents = []
    for key in range(120):
        words = [word() for _ in range(rng.choice([0, 3, 50, 400]))]
        if key % 2:
            leak = items[key % 40][1].split()
            for _ in range(rng.randint(0, 4)):
                leak[rng.randrange(len(leak))] = word()
            at = rng.randint(0, len(words))
            words[at:at] = leak
        documents.append((key, (", " if key % 3 else " \n").join(words).upper()))
    documents += [(200, None), (201, ""), (None, items[9][1]), (5, documents[5][1]), (202, items[1][1] + " word" * 40_000)]
    docs = spark.createDataFrame(documents, "doc_id long, text string").withColumns({"item": F.lit(1), "shingle": F.lit(2)})
    tests = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit("clash"))
    got = contamination.contained(docs, tests, share=share)
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(documents, items, share)
    if share == 80:
        assert contamination.contained(docs.limit(0), tests).count() == 0
        assert contamination.contained(docs, tests.limit(0)).count() == 0


def test_items_of_a_few_words_are_found_in_long_documents(spark):
    items = [(1, "secret answer here"), (2, "Forty-two"), (3, "alone"), (4, "one two three four"), (5, "one two three four five"), (6, None)]
    documents = [
        (10, "long before the secret answer, here and after"), (11, "secret answers here"), (12, "it is forty two."), (13, "ALONE"),
        (14, "zero one two three four"), (15, "one two three"), (16, "none of them at all in this one"), (17, "secret answer here"),
        (18, "two forty"), (19, "one two three four five six"), (20, "the word " * 3_000 + "secret answer here" + " more" * 3_000),
    ]
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, contamination.contained(docs, tests).collect()))
    pairs = [(10, 1), (12, 2), (13, 3), (14, 4), (17, 1), (19, 4), (19, 5), (20, 1)]
    assert got == [(*pair, 1, 1) for pair in pairs] == by_hand(documents, items, 80)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("benchmark", tests.toPandas())
    assert got == sorted(con.execute(queries.OP9_SQL).fetchall())


def test_stage_judges_every_row_by_itself(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(n))
    items = [(1, text(40)), (2, text(30)), (2, text(30)), (None, text(30)), (None, text(30)), (3, None)]
    words = items[0][1].split()
    clean = [(None, text(60)) for _ in range(30)] + [(7, text(60)) for _ in range(30)] + [(n, text(60)) for n in range(100, 130)]
    # Two halves of an item, which only together hold enough of it.
    clean += [(8, " ".join(words[:24])), (8, " ".join(words[16:])), (9, None), (None, None), (9, ""), (None, clean[0][1])]
    leaking = [(None, text(5) + " " + items[0][1]), (7, items[0][1] + " " + text(5))]
    # Of items that share an id, or have none, one each.
    leaking += [(200 + n, text(20) + " " + item + " " + text(20)) for n, (_, item) in enumerate(items[1:5])]
    columns = "doc_id long, text string, id string"
    docs = spark.createDataFrame([(*row, "x") for row in clean + leaking], columns)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert kept.dtypes == docs.dtypes
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(*row, "x") for row in clean], key=str)
