"""What the physical plans must and must not hold, whatever the size of the data."""

from __future__ import annotations

import contextlib
import io
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from citewright import session as session_module
from citewright.operators.audit import audit_filter
from citewright.operators.vector import vector_topk
from citewright.plans.ingest import canonical_filings
from citewright.session import materialise, spread
from citewright.sources.tables import tables
from citewright.workloads import registered

FOLDER = contract.SMOKE_DIR
CROSS = ("CartesianProduct", "BroadcastNestedLoopJoin")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plan(frame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", list(registered()))
def test_no_query_pairs_everything_with_everything(spark, name):
    text = plan(registered()[name](spark, FOLDER))
    assert not any(node in text for node in CROSS)


def test_text_work_needs_no_shuffle(spark, raw):
    assert "Exchange" not in plan(canonical_filings(raw))


def test_corpus_is_not_shuffled_for_a_small_batch(spark):
    t = tables(spark, FOLDER)
    queries = t.chunks.select(F.col("chunk_id").alias("query_id"), "embedding").limit(3)
    text = plan(vector_topk(queries, t.chunks, 20))
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1
    assert "hashpartitioning(query_id" in text
    assert "MapInArrow" in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    t = tables(spark, FOLDER)
    t.audit_log().write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    text = plan(audit_filter(log, verdict="refused", since="2024").select("request_id"))
    assert "EqualTo(verdict,refused)" in text and "GreaterThanOrEqual(created_at,2024)" in text
    assert "retrieved_json" not in text.split("ReadSchema")[1].split("\n")[0]


def test_spread_leaves_many_splits_alone(spark):
    many = spark.range(0, 100, 1, spark.sparkContext.defaultParallelism)
    assert spread(many) is many
    assert spread(many.coalesce(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


class FakeSession:
    """A session with the given master and checkpoint folder."""

    def __init__(self, master, folder=None):
        self.conf = type("Conf", (), {"get": lambda _, key, default: folder or default})()
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})


def test_scratch_folder_is_the_configured_one(spark):
    assert session_module.scratch_dir(FakeSession("yarn", "hdfs:///shared")) == "hdfs:///shared"
    own = session_module.scratch_dir(FakeSession("local[2]"))
    assert os.path.isdir(own) and session_module.scratch_dir(FakeSession("local[2]")) == own
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session_module.scratch_dir(FakeSession("yarn"))
    assert materialise(spark.range(3), "n").count() == 3
