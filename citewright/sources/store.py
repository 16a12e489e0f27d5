"""The index on shared storage: parquet tables under one root folder.

``filings`` and ``chunks`` are partitioned by a hash bucket of the accession, so
that ingesting a filing again rewrites only the buckets it touches; ``frequency``
and ``totals`` count the terms and chunks of each bucket, and ``blocks`` is its
inverted index, sorted by term. ``audit`` only ever
grows. ``meta`` pins the vector size and the number of buckets: choose the latter
so that one bucket is what a single ingest may rewrite.

An ingest deals new filings to their buckets once; chunks are cut and indexed where
those lie, and kept rows are copied in place, so that of a chunk nothing is shuffled.
It writes the touched buckets of every table under a version of its own and
publishes them together with one small manifest, which names the version of each
bucket. Readers take the newest manifest: they see an ingest whole or not at all,
a bucket that lost its last row reads as empty, and an ingest that failed has left
nothing but files that no manifest names (``vacuum`` removes those).

Manifests are numbered files, and a number can be taken once. An ingest that finds
its number taken looks at what the rival changed: other buckets, and it goes on from
there; a bucket of its own, and it raises ``ConcurrentIngest`` with nothing published.
This needs a file system whose rename refuses an existing target, as HDFS does. A
local folder only checks first, so two writers there may meet in between.

Filings whose fields break a rule fail an ingest, or go to ``rejects`` with the
names of those fields if asked to.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewright.functions.chunk import ChunkOptions
from citewright.functions.embed import Embedder, HashEmbedder
from citewright.operators.audit import audit_records, duplicate_requests, to_audit_rows
from citewright.operators.keyword import CHUNK_KEY, Index, chunk_totals, term_frequency
from citewright.operators.postings import posting_blocks
from citewright.operators.upsert import BUCKETS, bucket_of, without_keys
from citewright.plans.ingest import (
    canonical_filings,
    chunk_filings,
    parted_by_validity,
    require_valid_meta,
    with_features,
)
from citewright.session import MAX_BROADCAST_ROWS, materialise

META_SCHEMA = "key string, value string"
MANIFEST_SCHEMA = "number bigint, bucket int, version string"
RAW_SCHEMA = "cik string, accession string, company string, form string, filing_date string, html string"
TABLES = ("filings", "chunks", "frequency", "totals", "blocks")
# Tables are mostly text, which this packs to two thirds of the default's size.
CODEC = "zstd"
# Bytes of a bucket that one task copies, and buckets that are copied at once.
COPIED_BYTES = 64 << 20
COPIED_AT_ONCE = 4
# The inverted index as earlier releases wrote it, which is not read any more.
OLD_POSTINGS = "postings"

AUDIT_SCHEMA = """
    request_id string, created_at string, query string, verdict string, refusal_reason string,
    answer string, retrieved_json string, claims_json string, verification_json string,
    embedder_id string, generation_model string, verifier_id string,
    cost_usd double, latency_ms bigint
"""

REJECTS_SCHEMA = """
    cik string, accession string, company string, form string, filing_date string,
    reasons array<string>, rejected_at string
"""


class ConcurrentIngest(RuntimeError):
    """Another writer has published a bucket that this ingest had read before."""


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str
    dimensions: int
    buckets: int

    @classmethod
    def create(cls, spark: SparkSession, root: str, dimensions: int, buckets: int = BUCKETS) -> Store:
        """Open ``root``, setting it up if it is new; the vector size must agree."""
        pinned = _pinned(spark, root)
        if pinned is None:
            pinned = {"embedding_dimensions": dimensions, "buckets": buckets}
            rows = [(key, str(value)) for key, value in pinned.items()]
            meta = spark.createDataFrame(rows, META_SCHEMA).coalesce(1)
            meta.write.mode("append").json(f"{root}/meta")
        elif pinned["embedding_dimensions"] != dimensions:
            raise ValueError(
                f"store was built with {pinned['embedding_dimensions']} dimensions, not {dimensions}"
            )
        return cls(spark, root, dimensions, pinned["buckets"])

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Store:
        """Open an existing store and read its vector size from it."""
        pinned = _pinned(spark, root)
        if pinned is None:
            raise FileNotFoundError(f"no store at {root}")
        return cls(spark, root, pinned["embedding_dimensions"], pinned["buckets"])

    def filings(self, accession: str | None = None) -> DataFrame:
        """The canonical texts; of one filing, a read of its bucket only."""
        return self._one(self._read("filings"), accession)

    def chunks(self, accession: str | None = None) -> DataFrame:
        """The chunks; of one filing, a read of its bucket only."""
        return self._one(self._read("chunks"), accession)

    def index(self, embedder: Embedder | None = None) -> Index:
        """Chunks and counts, with the bucket column pruning reads of single chunks.

        ``embedder`` is what queries will be embedded with: chunks that another one
        made would rank without meaning, so they are an error.
        """
        chunks = self.chunks()
        if embedder is not None:
            others = chunks.filter(F.col("embedder_id") != embedder.id).select("embedder_id").take(1)
            if others:
                raise ValueError(f"chunks were embedded by {others[0]['embedder_id']}, not {embedder.id}")
        postings = None if self._has_old_postings() else self._read("blocks")
        return Index(chunks, self._read("frequency"), self._read("totals"), self.buckets, postings)

    def _has_old_postings(self) -> bool:
        """Whether an earlier release wrote a bucket that is current: then chunks are scanned."""
        folder, system = self._path(OLD_POSTINGS)
        if not system.exists(folder):
            return False
        current = {f"version={version}" for version in self._manifest()[1].values()}
        return any(entry.getPath().getName() in current for entry in system.listStatus(folder))

    def _one(self, table: DataFrame, accession: str | None) -> DataFrame:
        if accession is None:
            return table
        bucket = bucket_of(F.lit(accession), self.buckets)
        return table.filter((F.col("bucket") == bucket) & (F.col("accession") == accession))

    def _manifest(self) -> tuple[int, dict[int, str]]:
        """The number of the newest manifest, and the version of each bucket it names."""
        numbered = self._numbered()
        # Without a numbered file: one file per ingest, as earlier releases left them.
        path = f"{self.root}/manifest" + (f"/{_manifest_file(numbered[-1])}" if numbered else "")
        try:
            rows = self.spark.read.schema(MANIFEST_SCHEMA).json(path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return 0, {}
            raise
        newest = rows.agg(F.max("number")).first()[0]
        if newest is None:
            return 0, {}
        named = rows.filter(F.col("number") == newest).select("bucket", "version").limit(self.buckets).collect()
        return newest, {row["bucket"]: row["version"] for row in named}

    def _numbered(self) -> list[int]:
        """The numbers of the manifests that are there, ascending."""
        path, system = self._path("manifest")
        names = [entry.getPath().getName() for entry in system.listStatus(path)] if system.exists(path) else []
        return sorted(int(name.removesuffix(".json")) for name in names if name.removesuffix(".json").isdigit())

    def _path(self, name: str):
        """A folder or file of the store, and the file system that has it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _schema(self, name: str) -> T.StructType:
        return _schemas(self.spark, self.dimensions)[name]

    def _read(self, name: str, versions: dict[int, str] | None = None) -> DataFrame:
        """The published rows of a table, or those of the given versions."""
        if versions is None:
            _, versions = self._manifest()
        schema = self._schema(name)
        stored = T.StructType([field for field in schema if field.name != "bucket"])
        stored = stored.add("version", T.StringType()).add("bucket", T.IntegerType())
        table = _read(self.spark, f"{self.root}/{name}", stored) if versions else None
        if table is None:
            return self.spark.createDataFrame([], schema)
        by_version: dict[str, list[int]] = {}
        for bucket, version in versions.items():
            by_version.setdefault(version, []).append(bucket)
        current = F.lit(False)
        for version, buckets in by_version.items():
            current = current | ((F.col("version") == version) & F.col("bucket").isin(buckets))
        return table.filter(current).drop("version")

    def audit(self) -> DataFrame:
        log = _read(self.spark, f"{self.root}/audit", AUDIT_SCHEMA)
        return self.spark.createDataFrame([], AUDIT_SCHEMA) if log is None else log

    def records(self) -> DataFrame:
        """The audit log with its nested parts parsed."""
        return audit_records(self.audit())

    def ingest(
        self,
        raw: DataFrame,
        embedder: Embedder | None = None,
        options: ChunkOptions | None = None,
        ingested_at: str | None = None,
        reject: bool = False,
    ) -> DataFrame:
        """Ingest ``cik, accession, company, form, filing_date, html``.

        Gives back the new filings. Texts are redacted before anything is written,
        and each later table is built from the one written before it. A filing
        without headings has no chunks; ingested again, it loses those it had.

        An invalid filing fails the ingest or, with ``reject``, is noted in ``rejects``
        while the others go on. Rejects are noted before the ingest is published, so
        one that is run again after a failure notes them again.
        """
        emb = embedder or HashEmbedder()
        if emb.dimensions != self.dimensions:
            raise ValueError(f"store holds {self.dimensions} dimensions, embedder gives {emb.dimensions}")
        bucket = bucket_of(F.col("accession"), self.buckets)
        when = F.lit(ingested_at) if ingested_at else F.date_format(
            F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
        )
        if reject:
            raw, refused = parted_by_validity(raw)
            noted = refused.withColumn("rejected_at", when)
            noted.write.mode("append").parquet(f"{self.root}/rejects")
        base = self._manifest()
        filings = materialise(
            canonical_filings(require_valid_meta(raw))
            .withColumn("ingested_at", when)
            .withColumn("bucket", bucket),
            "filings",
            compression=CODEC,
        )
        _require_unique(filings)
        touched = {row["bucket"]: row["count"] for row in filings.groupBy("bucket").count().collect()}
        if not touched:
            return filings
        version = uuid.uuid4().hex
        self._write("filings", version, _dealt(filings, "accession"), ["accession"])
        # Chunks are cut where the dealt filings lie. The files listed here are those of the new filings only.
        stored = self._written("filings", version)
        cut = chunk_filings(stored, options).withColumn("bucket", bucket)
        self._write("chunks", version, cut, ["accession", "start_offset"], lambda rows: _featured(rows, emb))
        for name, order in (("chunks", ["accession", "start_offset"]), ("filings", ["accession"])):
            self._copy_kept(name, version, base[1], stored, touched, order)
        written = self._written("chunks", version)
        if written is not None:
            self._write("totals", version, chunk_totals(written, "bucket"), [])
            self._write("blocks", version, posting_blocks(written, CHUNK_KEY, "bucket"), ["term_bucket", "term", "block"])
            # Counted from the index, which has a row per term and block, not one per term and chunk.
            counted = self._written("blocks", version).filter(F.col("term").isNotNull()).select("bucket", "term", "df")
            frequency = _dealt(counted, "term").groupBy("bucket", "term").agg(F.sum("df").alias("df"))
            self._write("frequency", version, frequency, ["term"])
        self._publish(version, [*touched], base)
        return filings

    def _written(self, name: str, version: str) -> DataFrame | None:
        """What was written of a version so far; files that are added later are not seen."""
        schema = self._schema(name)
        stored = T.StructType([field for field in schema if field.name != "bucket"]).add("bucket", T.IntegerType())
        return _read(self.spark, f"{self.root}/{name}/version={version}", stored)

    def _write(
        self, name: str, version: str, rows: DataFrame, order: list[str], finish: Callable[[DataFrame], DataFrame] | None = None
    ) -> None:
        """Write rows to their buckets, sorted where they are, so that scans can skip files and row groups.

        ``finish`` adds columns to rows in place, after they were sorted without them.
        """
        ordered = rows.sortWithinPartitions("bucket", *order)
        finished = finish(ordered) if finish else ordered
        path = f"{self.root}/{name}/version={version}"
        finished.write.mode("append").option("compression", CODEC).partitionBy("bucket").parquet(path)

    def _copy_kept(
        self, name: str, version: str, base: dict[int, str], changed: DataFrame, touched: dict[int, int], order: list[str]
    ) -> None:
        """Copy what the touched buckets hold of filings that are not among the ``changed``.

        Each bucket is copied by itself, in the order it has: rows with their features
        are neither shuffled nor sorted. Only where more of a bucket's filings have
        changed than may be broadcast, they meet in a shuffle. ``touched`` has those numbers.
        """
        schema = T.StructType([field for field in self._schema(name) if field.name != "bucket"])

        def copy(bucket: int) -> None:
            folder = f"{name}/version={base[bucket]}/bucket={bucket}"
            kept = _read(self.spark, f"{self.root}/{folder}", schema)
            if kept is None:
                return
            few = touched[bucket] <= MAX_BROADCAST_ROWS
            if few:
                # The files that earlier ingests left are put together.
                path, system = self._path(folder)
                kept = kept.coalesce(math.ceil(system.getContentSummary(path).getLength() / COPIED_BYTES) or 1)
            rest = without_keys(kept, changed.filter(F.col("bucket") == bucket), ["accession"], broadcast=few)
            ordered = rest if few else rest.repartitionByRange(*order).sortWithinPartitions(*order)
            to = f"{self.root}/{name}/version={version}/bucket={bucket}"
            ordered.write.mode("append").option("compression", CODEC).parquet(to)

        inherit = inheritable_thread_target(self.spark)
        with ThreadPoolExecutor(COPIED_AT_ONCE) as pool:
            # Without pinned threads there is nothing to inherit, and it is no function.
            list(pool.map(inherit(copy) if callable(inherit) else copy, sorted(set(touched) & set(base))))

    def _publish(self, version: str, touched: list[int], base: tuple[int, dict[int, str]]) -> None:
        """Make the version current, unless a touched bucket has changed since ``base``."""
        while True:
            number, versions = self._manifest()
            lost = [bucket for bucket in touched if versions.get(bucket) != base[1].get(bucket)]
            if lost:
                raise ConcurrentIngest(f"buckets {sorted(lost)[:5]} were ingested by another writer")
            versions |= dict.fromkeys(touched, version)
            rows = [{"number": number + 1, "bucket": b, "version": name} for b, name in sorted(versions.items())]
            if self._claimed(number + 1, "".join(json.dumps(row) + "\n" for row in rows)):
                return

    def _claimed(self, number: int, text: str) -> bool:
        """Whether the manifest of this number could be put in place; False if there is one."""
        target, _ = self._path(f"manifest/{_manifest_file(number)}")
        draft, system = self._path(f"manifest/_{uuid.uuid4().hex}")
        out = system.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        files = self.spark._jvm.org.apache.hadoop.fs
        context = files.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark._sc._gateway.new_array(getattr(files, "Options$Rename"), 0)
        try:
            context.rename(draft, target, plain)
        except Py4JJavaError as error:
            system.delete(draft, False)
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def vacuum(self) -> None:
        """Remove the files of versions that the newest manifest does not name.

        Older manifests go as well. Readers of those must have ended, and no ingest may be running.
        """
        _, versions = self._manifest()
        for number in self._numbered()[:-1]:
            path, system = self._path(f"manifest/{_manifest_file(number)}")
            system.delete(path, False)
        for name in (*TABLES, OLD_POSTINGS):
            folder, system = self._path(name)
            for entry in system.listStatus(folder) if system.exists(folder) else []:
                if entry.getPath().getName().removeprefix("version=") not in set(versions.values()):
                    system.delete(entry.getPath(), True)

    def rejects(self) -> DataFrame:
        """Filings that were refused, and the names of the fields that broke a rule."""
        noted = _read(self.spark, f"{self.root}/rejects", REJECTS_SCHEMA)
        return self.spark.createDataFrame([], REJECTS_SCHEMA) if noted is None else noted

    def append_audit(self, answers: DataFrame) -> None:
        """Add one row per answer; a request id that is taken already is an error."""
        rows = materialise(to_audit_rows(answers), "audit")
        taken = duplicate_requests(rows, self.audit()).limit(5).collect()
        if taken:
            raise ValueError(f"request ids already used: {[row['request_id'] for row in taken]}")
        rows.write.mode("append").parquet(f"{self.root}/audit")


def _manifest_file(number: int) -> str:
    return f"{number:012d}.json"


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    """Rows in ranges of their buckets, as many as their size asks for, so that no bucket is one task."""
    return rows.repartitionByRange("bucket", *order)


def _featured(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    return with_features(chunks, embedder).withColumn("embedder_id", F.lit(embedder.id))


@lru_cache(maxsize=4)
def _schemas(spark: SparkSession, dimensions: int) -> dict[str, T.StructType]:
    """What each table holds, from the plans that make it; no data is read."""
    raw = spark.createDataFrame([], RAW_SCHEMA)
    filings = canonical_filings(raw).withColumns({"ingested_at": F.lit(""), "bucket": F.lit(0)})
    # From here on by type only, so that the long plan is analysed once.
    filings = spark.createDataFrame([], filings.schema)
    chunks = _featured(chunk_filings(filings), HashEmbedder(dimensions)).withColumn("bucket", F.lit(0))
    chunks = spark.createDataFrame([], chunks.schema)
    tables = filings, chunks, term_frequency(chunks, "bucket"), chunk_totals(chunks, "bucket"), posting_blocks(chunks, CHUNK_KEY, "bucket")
    return {name: table.schema for name, table in zip(TABLES, tables)}


def _require_unique(filings: DataFrame) -> None:
    again = filings.groupBy("accession").count().filter("count > 1").limit(5).collect()
    if again:
        raise ValueError(f"accessions given twice: {[row['accession'] for row in again]}")


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _pinned(spark: SparkSession, root: str) -> dict[str, int] | None:
    try:
        meta = spark.read.schema(META_SCHEMA).json(f"{root}/meta")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return {row["key"]: int(row["value"]) for row in meta.limit(10).collect()} or None
