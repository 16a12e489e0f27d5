"""Session settings, shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of keys or scores that a side may have to be broadcast.
MAX_BROADCAST_ROWS = 100_000

# Folders of local sessions that name none, by application.
_own_folders: dict[str, str] = {}


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("citewright")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may do without: it gets a folder of its own, once.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_folders:
        _own_folders[context.applicationId] = tempfile.mkdtemp(prefix="citewright-")
    return _own_folders[context.applicationId]


def materialise(df: DataFrame, name: str, *partition_by: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, not the whole pipeline,
    and so that several consumers do not compute the same rows again.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path, compression=compression)
    # By the schema, since a partitioned table without rows has no file to take it from.
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Use all cores where a scan has too few splits for its per-row work.

    A table of many files already has more splits than cores and is left alone,
    so this adds a shuffle to small inputs only.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys) if keys else scan.repartition(cores)


def pinned(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` computed once and marked for broadcast, and True, if it is small.

    Rows are fetched up to just beyond ``max_rows``; where there are more, the
    answer is ``df`` as it was, and False, and joins shuffle it.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return df, False
    return F.broadcast(df.sparkSession.createDataFrame(head, df.schema)), True
