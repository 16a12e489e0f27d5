from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from citewright.llm import spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(rows, size=50):
    """The removed words of each row, from every window of every document."""
    first: dict[tuple, int] = {}
    order = lambda key: -(1 << 63) if key is None else key
    split = [(order(key), WORD.findall(text or "")) for key, text in rows]
    for key, words in split:
        for at in range(len(words) - size + 1):
            window = tuple(words[at : at + size])
            first[window] = min(key, first.get(window, key))
    out = []
    for (ident, _), (key, words) in zip(rows, split):
        gone = set()
        for at in range(len(words) - size + 1):
            if first[tuple(words[at : at + size])] < key:
                gone.update(range(at, at + size))
        kept = " ".join(word for at, word in enumerate(words) if at not in gone)
        out.append((ident, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyzé")
    passage = [word() for _ in range(70)]
    other = [word() for _ in range(130)]
    rows = []
    for key in range(60):
        text = [word() for _ in range(rng.randint(0, 120))]
        if key % 3 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = passage[: rng.choice([49, 50, 51, 70])]
        if key % 4 == 0:
            text += other[rng.randint(0, 30) :][: rng.randint(50, 100)]
        if key % 7 == 0:
            text += ["same"] * rng.randint(40, 180)
        rows.append((key, " ".join(text).replace(" a", "\n\t a")))
    copies = [(100 + n, rows[8][1]) for n in range(30)] + [(200, rows[8][1] + " tail"), (201, "head " + rows[8][1])]
    edges = [(300, None), (301, ""), (302, " \n "), (303, "word " * 3000), (304, "word " * 3000), (None, rows[4][1])]
    rows += copies + edges + [rows[8], rows[8], (8, "head " + rows[12][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [20_000, 3])
def test_equals_brute_force(spark, limit):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("clash"), "at": F.lit(1)})
    marks = spans.repeated_windows(spans.keyed(df, "doc_id", "text"), walks_in_task=limit)
    assert marks.count() > 0
    before, spans.WALKS_IN_TASK = spans.WALKS_IN_TASK, limit
    try:
        got = spans.remove_repeated(df).drop("kept").collect()
    finally:
        spans.WALKS_IN_TASK = before
    assert sorted(map(tuple, got), key=str) == by_hand(rows)
    assert spans.remove_repeated(df.limit(0)).count() == 0
