from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citewright.llm import stripes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 10]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def rates(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 10**9 * (counter[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: rates(counts[lang, s]) for s in sources}, rates(whole)
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda item: (-item[1], item[0].encode()))
                out += [(lang, s, part, *item, i + 1) for i, item in enumerate(items) if part == "pair" or i < 10]
    return sorted(out)


def got(frame):
    return sorted(map(tuple, frame.select("lang", "source", "part", "item", "value", "rank").collect()))


def made(rng, count):
    words = ["the", "Of", "élan", "漢字", "x", "don't", "a1b", "Zoë", "𝒜", "tie", "eit", *(f"w{c}" for c in "abcdefghij")]
    for _ in range(count):
        lang = rng.choice(["en", "en", "en", "fr", None, ""])
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", None, "é", "z"])
        yield lang, source, rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))])


@pytest.mark.parametrize("cells, entries", [(1 << 21, 200_000), (8, 3)])
def test_against_brute_force(spark, monkeypatch, cells, entries):
    monkeypatch.setattr(stripes, "MOST_CELLS", cells)
    monkeypatch.setattr(stripes, "MOST_ENTRIES", entries)
    rows = list(made(random.Random(7), 300))
    rows += [rows[0]] * 40 + [("de", "a", "nur einmal"), ("de", "b", None), ("it", "only", None), ("en", "long", "Of the " * 30_000)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    docs = docs.withColumn("term", F.lit(1)).withColumn("share", F.lit(2)).withColumn("value", F.lit("x")).repartition(3)
    assert got(stripes.audited(docs)) == expected(rows)
    assert got(stripes.audited(docs.limit(0))) == []


def test_rates_are_exact_beyond_64_bits():
    counts = np.array([0, 5 * 10**9, 9 * 10**9, 4 * 10**12], np.int64)
    total = int(counts.sum())
    assert stripes._rates(counts, total, 4).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 8) for c in counts]
