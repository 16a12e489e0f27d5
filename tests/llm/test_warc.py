from __future__ import annotations

import gzip
import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from citewright.llm import warc


def by_hand(rows):
    best = {}
    for key, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            best[data] = max([k for k in (best.get(data), key) if k is not None], default=None)
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        kept = best.get(data, key)
        revisit = kept != key
        out.append((key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", kept if revisit else None))
    return sorted(out, key=str)


def test_pages_go_and_come_back(spark, tmp_path):
    page = "<p>é" * 400
    rows = [(n, f"http://a.example/{n}", page) for n in range(9)]
    rows += [(20, None, None), (21, "", ""), (22, "http://x/\r\nWARC-Type: revisit", "short"), (23, "http://x/ y", "short")]
    rows += [(24, "http://long", "z" * 3_000_000), (25, "u", "\r\n\r\nWARC/1.0\r\n" * 100), (8, "again", page), (None, "none", page)]
    rows += [(30, "u", "y" * 999), (31, "u", "y" * 999), (32, "u", "y" * 1000), (33, "u", "y" * 1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"size": F.lit("x"), "payload": F.lit(1)})
    folder = f"file://{tmp_path}/archives"
    got = warc.archived(df.repartition(3), folder).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(rows)
    read = spark.read.format("warc").load(folder)
    assert {r.target_uri for r in read.filter("record_id = 'urn:page:22'").collect()} == {"http://x/%0D%0AWARC-Type:%20revisit"}
    names = os.listdir(tmp_path / "archives")
    assert names and all(name.endswith(".warc.gz") for name in names)
    # Another tool's view of the same bytes, and archives that do not note lengths.
    plain = b"".join(gzip.decompress((tmp_path / "archives" / name).read_bytes()) for name in names)
    assert plain.count(b"WARC/1.1\r\n") == len(rows)
    records = [b"WARC/1.1\r\n" + part for part in plain.split(b"WARC/1.1\r\n")[1:]]
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.warc").write_bytes(b"".join(records[:5]))
    (other / "b.warc.gz").write_bytes(b"".join(gzip.compress(part) for part in records[5:]))
    (other / "c.txt").write_bytes(b"no archive")
    for options in ({}, {"payload": "false"}):
        columns = [c for c in warc.COLUMNS if c != "payload" or not options]
        views = [
            sorted(map(tuple, spark.read.format("warc").options(**options).load(f"file://{at}").select(columns).collect()), key=str)
            for at in (tmp_path / "archives", other)
        ]
        assert len(views[0]) == len(rows) and views[0] == views[1]


def test_filters_reach_the_reader(spark, tmp_path):
    rows = [(n, f"http://h{n % 3}.example/", "p" * (900 + 100 * (n % 4))) for n in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.archived(df, f"file://{tmp_path}/a")
    read = spark.read.format("warc").load(f"file://{tmp_path}/a")
    everything = read.collect()
    conditions = {
        "warc_type = 'revisit'": lambda r: r.warc_type == "revisit",
        "warc_type != 'revisit'": lambda r: r.warc_type != "revisit",
        "target_uri like 'http://h1%' and warc_type in ('response', 'x')": lambda r: r.target_uri.startswith("http://h1") and r.warc_type == "response",
        "refers_to is null": lambda r: r.refers_to is None,
        "payload_length > 1000": lambda r: r.payload_length > 1000,
        "record_id >= 'urn:page:3'": lambda r: r.record_id >= "urn:page:3",
    }
    for condition, test in conditions.items():
        kept = read.filter(condition)
        assert sorted(map(str, kept.collect())) == sorted(str(r) for r in everything if test(r)), condition
    plan = read.filter("warc_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)


def test_aborted_and_empty(spark, tmp_path):
    warc.register(spark)
    bad = spark.range(4).select(F.raise_error(F.lit("stop")).cast("string").alias("record_id"))
    with pytest.raises(Exception):
        bad.write.format("warc").mode("append").save(f"file://{tmp_path}/b")
    assert not [name for _, _, files in os.walk(tmp_path) for name in files]
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(df, f"file://{tmp_path}/c").count() == 0
