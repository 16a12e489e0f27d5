from __future__ import annotations

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from citewright.llm import jaccard


def shingles(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[at : at + 4]) for at in range(max(1, len(words) - 3))} if words else set()


def by_hand(rows):
    order = lambda key: -1 if key is None else key
    sets = [shingles(text) for _, text in rows]
    label = list(range(len(rows)))

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for n in range(len(rows)):
        for m in range(n):
            if sets[n] and sets[m] and 100 * len(sets[n] & sets[m]) >= 85 * len(sets[n] | sets[m]):
                label[max(root(n), root(m))] = min(root(n), root(m))
    least: dict = {}
    for n, (key, _) in enumerate(rows):
        least[root(n)] = min(least.get(root(n), order(key)), order(key))
    out = []
    for n, (key, _) in enumerate(rows):
        found = least[root(n)]
        out.append((key, len(sets[n]), None if found == -1 else found))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghijk") + rng.choice("xyzéÄ") + rng.choice("ABC")
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(rng.choice([3, 8, 40, 120, 300]))] for _ in range(25)]
    rows = []
    for key in range(260):
        text = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            text[rng.randrange(len(text))] = word()
        if key % 5 == 0:
            text = [word() for _ in range(rng.randint(30, 80))] + passage
        rows.append((1000 - key, " ".join(text)))
    chain = [word() for _ in range(200)]
    for key in range(40):
        chain = list(chain)
        for _ in range(3):
            chain[rng.randrange(len(chain))] = word()
        rows.append((2000 + key, "\t".join(chain).upper() if key % 2 else " ".join(chain)))
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one"), (3004, "ONE "), (3005, "one two"), (3006, "a b c d"), (3007, "A b c d")]
    rows += [(None, rows[3][1]), (1000, rows[0][1]), (1000, rows[7][1]), (3008, "same word " * 40_000), (3009, "same word " * 300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small, levels", [(8, 4), (2, 2), (2, 30)])
def test_equals_brute_force(spark, monkeypatch, small, levels):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "LEVELS", levels)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"class": F.lit("clash"), "n": F.lit(1)})
    got = jaccard.near_duplicates(df).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(df).columns == ["doc_id", "n_shingles", "component_id"]
    assert jaccard.near_duplicates(df).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = jaccard.components(links).collect()
    assert len(roots) == 300 and {row.root for row in roots} == {0}


def grams(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[at : at + size]) for at in range(max(1, len(words) - size + 1))} if words else set()


def kept_by_hand(rows, size, share):
    """The least key of each component, by brute force."""
    sets = [grams(text, size) for _, text in rows]
    label = list(range(len(rows)))

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for n in range(len(rows)):
        for m in range(n):
            if sets[n] and sets[m] and 100 * len(sets[n] & sets[m]) >= share * len(sets[n] | sets[m]):
                label[max(root(n), root(m))] = min(root(n), root(m))
    least: dict = {}
    for n, (key, _) in enumerate(rows):
        key = -1 if key is None else key
        least[root(n)] = min(least.get(root(n), key), key)
    return sorted(least.values())


@pytest.mark.parametrize("small, levels", [(8, 4), (2, 2)])
def test_stage_links_at_five_words_and_four_fifths(spark, monkeypatch, small, levels):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "LEVELS", levels)
    one = [f"w{n}" for n in range(100)]
    two = [*one[:30], "other", *one[31:70], "another", *one[71:]]
    # 86 of 106 five-word shingles, 89 of 105 four-word ones.
    pair = [(5000, " ".join(one)), (5001, " ".join(two))]
    rows = corpus() + pair
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("clash"))
    got = corpus_pipeline.near_duplicates(spark, df, "")
    keys = sorted(-1 if row.doc_id is None else row.doc_id for row in got.collect())
    want = kept_by_hand(rows, 5, 80)
    assert keys == want and 5000 in keys and 5001 not in keys
    assert want != kept_by_hand(rows, 4, 85)


def test_pairs_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Documents with three changed words of their own are too far from each other and from the first."""
    rng = random.Random(3)
    base = [f"w{n}" for n in range(150)]
    rows = [(0, " ".join(base))]
    for key in range(1, 240):
        text = list(base)
        for at in rng.sample(range(2, 148, 5), 3 if key % 4 else 1):
            text[at] = f"own{key}x{at}"
        rows.append((key, " ".join(text)))
    # Half of them have a partner with the same changes and one more.
    rows += [(1000 + key, text.replace("w0 ", f"other{key} ")) for key, text in rows[1::2]]
    made, measured = [], jaccard._measured

    def counted(pairs, sets):
        made.append(pairs.count())
        return measured(pairs, sets)

    monkeypatch.setattr(jaccard, "_measured", counted)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows)
    assert sum(made) < 20 * len(rows)
