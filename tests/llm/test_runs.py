from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from citewright.llm import runs


def by_hand(rows, size=100):
    order = lambda key: -(1 << 63) if key is None else key
    first: dict[bytes, tuple] = {}
    texts = [(key, (text or "").encode()) for key, text in rows]
    for key, data in texts:
        for at in range(len(data) - size + 1):
            window = data[at : at + size]
            first[window] = min((order(key), at), first.get(window, (order(key), at)))
    out = []
    for key, data in texts:
        gone = bytearray(len(data))
        for at in range(len(data) - size + 1):
            if first[data[at : at + size]] < (order(key), at):
                gone[at : at + size] = b"\1" * size
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for at, g in enumerate(gone) if g and not (at and gone[at - 1]))
        out.append((key, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé \0") for _ in range(n))
    passage, other = text(260), text(400)
    rows = []
    for key in range(60):
        value = text(rng.randint(0, 300))
        if key % 3 == 0:
            at = rng.randint(0, len(value))
            value = value[:at] + passage[: rng.choice([85, 99, 100, 260])] + value[at:]
        if key % 4 == 0:
            value += other[rng.randint(0, 80) :][: rng.randint(90, 300)]
        if key % 10 == 0:
            value += "ab" * rng.randint(40, 300)
        if key % 6 == 0:
            value += value[: rng.randint(0, 200)]
        rows.append((key, value))
    rows += [(100 + n, rows[8][1]) for n in range(20)] + [(200, rows[8][1] + "!"), (201, "?" + rows[8][1])]
    rows += [(300, None), (301, ""), (302, "x" * 5000), (303, "x" * 5000), (None, rows[4][1])]
    rows += [rows[8], rows[8], (8, "head" + rows[12][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [10_000, 4])
def test_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(runs, "PIECES_IN_TASK", limit)
    monkeypatch.setattr(runs, "BLOCK_PIECES", 16)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("clash"), "edges": F.lit(1)})
    found = runs.remove_repeated(df)
    got = found.collect()
    assert sorted((tuple(row)[:5] for row in got), key=str) == by_hand(rows)
    assert all(hashlib.sha256(row.kept).hexdigest() == row.kept_sha256 for row in got)


def test_index_is_run_compressed(spark):
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(900))
    rows = [(n, text if n % 2 else f"{n} {text} {n}") for n in range(40)]
    index = runs.run_length_index(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    windows = index["size"].sum()
    assert windows > 10_000 and len(index) < windows / 8
    for run in index.itertuples():
        for doc, place in ((run.first_doc, run.first_place), (run.last_doc, run.last_place)):
            before = rows[doc][1].encode()[place - 1] if place else 0
            assert before == run.byte


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert runs.remove_repeated(df).count() == 0
