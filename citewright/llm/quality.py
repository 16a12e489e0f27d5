"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A document's own evidence comes from naive Bayes on hashed byte trigrams: the mean log
ratio of its trigrams' frequencies in good and in bad labelled documents, scaled by
a logistic fit. Where it stands is evidence, too: the rate of good documents of its
path leans on that of its host, and that on the rate of all, with beta-binomial
strengths estimated from the data (see ``shared.shrunk``). The two add up in log odds.

The classifier is fitted on a bounded sample of the labelled documents (``FIT_ROWS``, the
least hashes of their ids): one half gives the trigrams' frequencies, the other, which
they have not seen, the two parameters of the logistic fit. The sample's ids are
broadcast at every size, so no text is shuffled. Rates of hosts and paths are counted
over all labels by grouped aggregation. What reaches the driver is a number per bucket
and class, and a number per document of the second half.

* A null or very short text has no evidence of its own and stands by its path. Very
  long texts are read whole. A null host or path is the empty one.
* A document with several labels counts once for each, null labels not at all; rows with
  equal ids share their labels. Without labels, every document stands at one half.
* Empty tables give none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewright.llm.shared import shrunk, slices, text_bytes, within_rows, written

BUCKETS = 1 << 14
THRESHOLD = 0.5
# So many different ids at most fit the classifier.
FIT_ROWS = 100_000
_MULTIPLIER = np.uint32(2654435761)


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every byte trigram within a row."""
    data, offsets = text_bytes(column)
    valid = np.flatnonzero(within_rows(offsets, 3))
    wide = data.astype(np.uint32)
    code = (wide[valid] << np.uint32(16)) | (wide[valid + 1] << np.uint32(8)) | wide[valid + 2]
    bucket = ((code * _MULTIPLIER) >> np.uint32(18)).astype(np.int64)
    return np.searchsorted(offsets, valid, side="right") - 1, bucket


def _frequencies(labelled: DataFrame) -> np.ndarray:
    """``[class, bucket]``: trigrams of bad and good documents, once for each label.

    ``labelled`` has ``text``, ``n`` and ``good``, the numbers of its labels and of the good ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * BUCKETS, np.int64)
        for batch in slices(batches, "text"):
            of, bucket = trigrams(batch.column("text"))
            labels, good = (batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("n", "good"))
            for kind, times in enumerate((labels - good, good)):
                sums = np.bincount(bucket, times[of], minlength=BUCKETS).astype(np.int64)
                total[kind * BUCKETS : (kind + 1) * BUCKETS] += sums
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    sums = labelled.select("n", "good", "text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * BUCKETS)
    out[sums["at"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(2, BUCKETS)


def _scored(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``rows`` with ``x``, the mean weight of the text's trigrams, in place of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    kept = [name for name in rows.columns if name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            of, bucket = trigrams(batch.column("text"))
            sums = np.bincount(of, shared.value[bucket], minlength=batch.num_rows)
            sizes = np.bincount(of, minlength=batch.num_rows)
            mean = sums / np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in kept), pa.array(mean, mask=sizes == 0)], names=[*kept, "x"]
            )

    return rows.mapInArrow(run, f"{schema}, x double")


def logistic(x: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Offset and slope of the log odds of ``good`` of ``n``, slightly regularised, by Newton steps."""
    inputs, fit = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    penalty = np.diag([1e-3, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(inputs @ fit, -30, 30)))
        slope = inputs.T @ (good - n * p) - penalty @ fit
        step = np.linalg.solve((inputs * (n * p * (1 - p))[:, None]).T @ inputs + penalty, slope)
        fit += np.clip(step, -10, 10)
        if np.abs(step).max() < 1e-8:
            break
    return float(fit[0]), float(fit[1])


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def judged(
    documents: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    path: str = "lang",
    label: str = "quality",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``key, evidence, site, quality, keep``: log odds of the text, rate of the path, and both together."""
    blank = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    rows = documents.select(
        F.col(f"`{key}`").cast("long").alias("id"), blank(host).alias("host"), blank(path).alias("path"), blank(text).alias("text")
    )
    marks = labels.select(F.col(f"`{key}`").cast("long").alias("id"), (F.col(f"`{label}`") == 1).cast("int").alias("good"))
    marks = marks.filter("good is not null and id is not null")

    by_id = marks.groupBy("id").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    by_id = by_id.withColumn("hash", F.xxhash64("id")).orderBy("hash", "id").limit(FIT_ROWS)
    sample = written(by_id.withColumn("part", F.pmod(F.col("hash"), F.lit(2))).drop("hash"), "sample")
    part = lambda number: F.broadcast(sample.filter(F.col("part") == number).drop("part"))

    counts = _frequencies(rows.select("id", "text").join(part(0), "id")) + 1.0
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    scored = written(_scored(rows, logs[1] - logs[0]), "evidence")
    known = written(scored.join(marks, "id").select("id", "host", "path", "x", "good"), "labelled")

    total = known.agg(F.count("*").alias("n"), F.sum("good").alias("good")).first()
    rate = ((total["good"] or 0) + 1) / (total["n"] + 2)
    # Rows that share an id are one observation: their mean evidence.
    seen = scored.filter("x is not null").join(part(1), "id").groupBy("id", "n", "good").agg(F.avg("x").alias("x"))
    fit = seen.select("x", "n", "good").toPandas()
    offset, slope = logistic(*(fit[name].to_numpy(float) for name in ("x", "n", "good"))) if len(fit) else (0.0, 0.0)
    # What the sample's own rate contributes is the site's to say.
    centre = np.log(rate / (1 - rate)) if len(fit) else 0.0

    by_path = scored.select("host", "path").distinct().join(
        known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("good")), ["host", "path"], "left"
    )
    by_path = written(by_path.na.fill(0, ["n", "good"]), "paths")
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("prior", F.lit(float(rate)))
    hosts = shrunk(written(by_host, "hosts")).select("host", F.col("mean").alias("prior"))
    paths = shrunk(written(by_path.join(hosts, "host"), "path-priors")).select("host", "path", F.col("mean").alias("site"))

    evidence = F.coalesce(F.lit(offset - float(centre)) + F.col("x") * slope, F.lit(0.0))
    found = scored.join(written(paths, "sites"), ["host", "path"]).withColumn("evidence", evidence)
    quality = 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("site")))))
    return found.select(F.col("id").alias(key), "evidence", "site", quality.alias("quality")).withColumn(
        "keep", F.col("quality") >= threshold
    )
