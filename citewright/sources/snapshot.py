"""A read-only export of filings, cited texts and the audit log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.operators.audit import CLAIMS, RETRIEVED, VERIFICATION, audit_list

@dataclass(frozen=True)
class Snapshot:
    filings: DataFrame
    texts: DataFrame
    audit: DataFrame
    generated_at: str | None = None


def cited_accessions(answers: DataFrame) -> DataFrame:
    """Accessions that some claim cites.

    Distinct within a row before anything is exploded. The outer form keeps the
    optimizer from computing the claims a second time for a filter on their size.
    """
    cites = F.flatten(F.transform("claims", lambda c: c["citations"]))
    named = F.array_distinct(F.transform(cites, lambda x: x["provenance"]["accession"]))
    found = answers.select(F.explode_outer(named).alias("accession"))
    return found.filter("accession is not null").distinct()


def list_filings(filings: DataFrame) -> DataFrame:
    return filings.select("cik", "accession", "company", "form", "filing_date").orderBy(
        "company", F.desc("filing_date"), "accession"
    )


def build_snapshot(
    filings: DataFrame, log: DataFrame, cited: DataFrame | None = None, audit_limit: int | None = None
) -> Snapshot:
    """``cited`` keeps only the texts of those accessions, ``audit_limit`` only the newest audit rows."""
    texts = filings.select("accession", "canonical_text")
    if cited is not None:
        texts = texts.join(cited, "accession", "left_semi")
    return Snapshot(list_filings(filings), texts, audit_list(log, limit=audit_limit))


def write_snapshot(snapshot: Snapshot, path: str, generated_at: str) -> None:
    """Write a folder of JSON lines for each part, whatever their size."""
    spark = snapshot.filings.sparkSession
    parts = {"filings": snapshot.filings, "texts": snapshot.texts, "audit": snapshot.audit}
    for name, part in parts.items():
        part.write.json(f"{path}/{name}")
    spark.createDataFrame([(generated_at,)], META_SCHEMA).coalesce(1).write.json(f"{path}/meta")


def write_document(snapshot: Snapshot, path: str, generated_at: str) -> None:
    """Write one JSON document. It passes through one task: for snapshots that are known to be small."""
    document(snapshot, generated_at).coalesce(1).write.text(path)


def document(snapshot: Snapshot, generated_at: str) -> DataFrame:
    """The snapshot as one row of JSON."""
    order = F.struct(F.col("company"), F.col("filing_date"), F.col("accession"))
    filing = F.struct("cik", "accession", "company", "form", F.col("filing_date").alias("filingDate"))
    filings = snapshot.filings.agg(
        F.transform(
            F.array_sort(
                F.collect_list(F.struct(order.alias("o"), filing.alias("f"))),
                lambda a, b: F.when(a["o"]["company"] < b["o"]["company"], -1)
                .when(a["o"]["company"] > b["o"]["company"], 1)
                .when(a["o"]["filing_date"] > b["o"]["filing_date"], -1)
                .when(a["o"]["filing_date"] < b["o"]["filing_date"], 1)
                .when(a["o"]["accession"] < b["o"]["accession"], -1)
                .otherwise(1),
            ),
            lambda x: x["f"],
        ).alias("filings")
    )
    texts = snapshot.texts.agg(
        F.map_from_entries(F.collect_list(F.struct("accession", "canonical_text"))).alias("texts")
    )
    row = F.struct(*snapshot.audit.columns).alias("row")
    newest_first = F.reverse(
        F.sort_array(F.collect_list(F.struct("created_at", "request_id", row)))
    )
    audit = snapshot.audit.agg(F.transform(newest_first, lambda a: a["row"]).alias("audit"))
    body = F.struct(
        F.lit(generated_at).alias("generatedAt"),
        filings.select("filings").scalar().alias("filings"),
        texts.select("texts").scalar().alias("canonicalTexts"),
        audit.select("audit").scalar().alias("audit"),
    )
    spark: SparkSession = snapshot.filings.sparkSession
    return spark.range(1).select(F.to_json(body, {"pretty": "true"}).alias("value"))


META_SCHEMA = "generated_at string"
FILINGS_SCHEMA = "cik string, accession string, company string, form string, filing_date string"
TEXTS_SCHEMA = "accession string, canonical_text string"
_TEXT_FIELDS = (
    "request_id created_at query verdict refusal_reason answer embedder_id generation_model verifier_id"
).split()
_AUDIT_FIELDS = [
    *((name, "string") for name in _TEXT_FIELDS),
    ("cost_usd", "double"),
    ("latency_ms", "bigint"),
    ("retrieved", RETRIEVED),
    ("claims", CLAIMS),
    ("verification", VERIFICATION),
]
AUDIT_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in _AUDIT_FIELDS)

_FILING = "struct<cik:string,accession:string,company:string,form:string,filingDate:string>"
_AUDIT = ",".join(f"{name}:{kind}" for name, kind in _AUDIT_FIELDS)
DOCUMENT_SCHEMA = f"""
    generatedAt string, filings array<{_FILING}>, canonicalTexts map<string,string>, audit array<struct<{_AUDIT}>>
"""


def read_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """What ``write_snapshot`` wrote. Rows have no order of their own; sort them anew."""
    part = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    meta = part("meta", META_SCHEMA).first()
    return Snapshot(
        part("filings", FILINGS_SCHEMA),
        part("texts", TEXTS_SCHEMA),
        part("audit", AUDIT_SCHEMA),
        meta["generated_at"] if meta else None,
    )


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_document`` wrote, as one row."""
    return spark.read.schema(DOCUMENT_SCHEMA).json(path, multiLine=True)
