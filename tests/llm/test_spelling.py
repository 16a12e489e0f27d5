from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from citewright.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def edits(word: str, letters: str) -> set[str]:
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b}
    out |= {a + c + b for a, b in cuts for c in letters}
    out |= {a + c + b[1:] for a, b in cuts if b for c in letters}
    return out - {word}


def counted(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            mark = crc32(f"{'' if key is None else key}:{run}".encode())
            if mark % 97 == 0:
                at = mark % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                found[run] += 1
    return {word: n for word, n in found.items() if n >= 3}


def expected(rows):
    words = counted(rows)
    letters = "".join(sorted({c for word in words for c in word}))
    forms, near = {}, {}
    for word, n in words.items():
        around = [w for w in edits(word, letters) if w in words]
        near[word] = len(around)
        best = min(around, key=lambda w: (-words[w], w), default=None)
        forms[word] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for word, n in words.items():
        root = word
        while forms[root]:
            root = forms[root]
        form = forms[word]
        out.append((word, form, root, n, near[word], words[form] if form else None))
    return sorted(out)


def got(frame):
    return sorted(map(tuple, frame.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(row["doc_id"], row["text"]) for row in docs.collect()]
    want = expected(rows)
    assert any(row[1] for row in want)
    assert got(spelling.grouped(docs)) == want


@pytest.mark.parametrize("most", [65_536, 40, 4])
def test_crowded_cells_part_down_to_halves(spark, monkeypatch, most):
    """Words of few letters share cells and leaves; nothing is lost or met twice."""
    monkeypatch.setattr(spelling, "MOST_ROWS", most)
    assert spelling.MOST_LEAF < 100
    rng = random.Random(4)
    words = {"".join(rng.choice("bfhé") for _ in range(rng.randint(5, 7))) for _ in range(900)}
    words |= {"".join(rng.sample("bfhbfhw", 7)) for _ in range(200)}
    frame = spark.createDataFrame([(word, 3) for word in words], "word string, n long")
    pairs = [tuple(sorted((row["word"], row["other"]))) for row in spelling.near_words(frame).collect()]
    letters = "".join(sorted({c for word in words for c in word}))
    want = {tuple(sorted((a, b))) for a in words for b in edits(a, letters) if b in words}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_one_edit():
    rng = random.Random(8)
    for _ in range(20_000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(len(a), 7)))
        assert spelling.one_edit(a, b) == (b in edits(a, "abc")), (a, b)


def test_chains_ties_and_edges(spark):
    texts = ["Words " * 3, "words WORDX " * 2, "word-wordxy " * 3, None, "", "x" * 50_000 + " naïve naive naïve naïve naive naive"]
    chain = "aaaaab " * 3 + "aaaabb " * 6 + "aaabbb " * 12 + "aabbbb " * 24 + "abbbbb " * 48 + "cbbbbb " * 48 + "bbbbbb " * 96
    rows = [(i, text) for i, text in enumerate([*texts, chain, chain, "Ünïcode × Ünïcode ÿÿÿÿÿ ÿÿÿÿÿ ÿÿÿÿÿ 漢字"])] + [(None, "words words")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    assert got(spelling.grouped(docs)) == expected(rows)
    assert got(spelling.grouped(docs.limit(0))) == []


def test_spilled_words_add_up(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_WORDS", 1)
    rows = [(i, "alpha beta gamma alphas " * 2) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["word"]: r["n"] for r in spelling.counted(docs).collect()} == counted(rows)
