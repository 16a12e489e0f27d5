from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from citewright.llm import quality

FOLDER = "/root/testdata/sf0.01"


def test_trigrams_stay_within_rows():
    of, bucket = quality.trigrams(pa.array(["abcd", None, "ab", "", "abc"]))
    assert of.tolist() == [0, 0, 4] and bucket[0] == bucket[2] != bucket[1]


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(20_000)
    good = rng.random(20_000) < 1 / (1 + np.exp(-(0.7 + 2 * x)))
    offset, slope = quality.logistic(x, np.ones(20_000), good.astype(float))
    assert abs(offset - 0.7) < 0.1 and abs(slope - 2) < 0.1


def test_held_out_accuracy(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    seen = labels.filter("doc_id % 3 > 0")
    got = quality.judged(documents, seen)
    assert got.count() == documents.count()
    rest = labels.filter("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("label"))
    unseen = got.join(rest, "doc_id").toPandas()
    assert (unseen.keep == (unseen.label == 1)).mean() > 0.9


def test_sites_shrink_towards_their_hosts(spark):
    text = "the same words everywhere"
    rows = [(n, text, "good", "a") for n in range(100)] + [(100 + n, text, "bad", "a") for n in range(100)]
    rows += [(300, text, "good", "new"), (301, text, "bad", "new"), (302, text, None, None), (303, None, "good", "a"), (304, "", "bad", "a")]
    rows += [(None, text, "good", "a"), (1, text, "good", "a"), (305, "w " * 200_000, "good", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"x": F.lit("clash"), "good": F.lit(1)})
    labels = [(n, int(n % 10 > 0)) for n in range(100)] + [(100 + n, int(n % 10 == 0)) for n in range(100)] + [(3, None), (None, 1), (5, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.judged(df, marks).collect()
    assert len(got) == len(rows)
    site = {row.doc_id: row.site for row in got}
    assert site[300] > 0.75 and site[301] < 0.25 and 0.3 < site[302] < 0.7
    keep = {row.doc_id: row.keep for row in got}
    assert keep[303] and not keep[304] and {row.evidence for row in got if row.doc_id in (303, 304)} == {0.0}
    assert quality.judged(df.limit(0), marks).count() == 0
    assert {row.quality for row in quality.judged(df, marks.limit(0)).collect()} == {0.5}
