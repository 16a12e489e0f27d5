"""Times the headline queries and prints one JSON line.

Each query runs once to warm up, which also writes the shared index tables, and
then three times against a sink that evaluates every column; the median counts.
Building the index from the raw tables is timed as a query of its own.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.plans.retrieve import hybrid_retrieve
from citewright.session import local_session
from citewright.sources.tables import Tables, tables
from citewright.workloads import registered

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    "extract_text_pages pii_redact section_detect chunk_windows ingest_pages "
    "tokenize_documents hash_embedding_norm vector_topk_centres vector_topk_chunks bm25_topk_chunks "
    "rrf_n_list hybrid_retrieve_chunks citation_resolve answer_or_refuse "
    "audit_list_page audit_totals audit_duplicate_check reingest_upsert snapshot_texts"
).split()


def build_index(spark: SparkSession, folder: str) -> DataFrame:
    """Redact, section, chunk, embed, tokenise and count every document, and write it all."""
    return Tables(spark, folder).index.frequency


def single_query(spark: SparkSession, folder: str) -> DataFrame:
    """Hybrid retrieval for one question over the whole index."""
    t = tables(spark, folder)
    return hybrid_retrieve(t.queries().filter(F.col("query_id") == 0), t.index)


def seconds(build, spark: SparkSession) -> float:
    began = time.perf_counter()
    build(spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    spark = local_session(CPUS)
    known = registered()
    todo = {"build_index": build_index, "hybrid_single_query": single_query}
    todo.update({name: known[name] for name in HEADLINE})
    times = {}
    for name, build in todo.items():
        seconds(build, spark)
        times[name] = round(statistics.median(seconds(build, spark) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cores": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
