"""The audit log: append-only rows, newest-first listing, filters and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_audit_rows(answers: DataFrame) -> DataFrame:
    """Answers as audit rows, their nested parts as JSON text."""
    return answers.select(
        "request_id",
        "created_at",
        "query",
        "verdict",
        "refusal_reason",
        "answer",
        F.to_json("retrieved").alias("retrieved_json"),
        F.to_json("claims").alias("claims_json"),
        F.to_json("verification").alias("verification_json"),
        "embedder_id",
        "generation_model",
        "verifier_id",
        "cost_usd",
        "latency_ms",
    )


def duplicate_requests(incoming: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Request ids that ``incoming`` repeats or that ``log`` already holds."""
    repeated = (
        incoming.groupBy("request_id").agg(F.count("*").alias("times")).filter("times > 1")
    ).select("request_id")
    if log is None:
        return repeated
    known = log.select("request_id").join(incoming.select("request_id"), "request_id", "left_semi")
    return repeated.union(known).distinct()


RETRIEVED = """array<struct<chunk_id:string,company:string,accession:string,section_id:string,
    section_label:string,rrf:double,vector_rank:int,keyword_rank:int,vector_distance:double>>"""

_PROVENANCE = """struct<cik:string,accession:string,company:string,form:string,filing_date:string,
    section_id:string,section_label:string,start_offset:int,end_offset:int>"""

CLAIMS = f"""array<struct<text:string,citations:array<struct<chunk_id:string,chunk_found:boolean,
    quote:string,quote_found:boolean,span:struct<start_offset:int,end_offset:int>,
    provenance:{_PROVENANCE}>>,supported:boolean>>"""

VERIFICATION = """struct<verdict:string,claims:array<struct<claim:string,deterministic_ok:boolean,
    judge:struct<entailed:boolean,confidence:double,rationale:string>,verified:boolean>>,
    verifier_id:string,cost_usd:double>"""


def audit_records(log: DataFrame) -> DataFrame:
    """The log with its JSON parts as nested columns; an absent part stays null."""
    return log.withColumns(
        {
            "retrieved": F.from_json("retrieved_json", RETRIEVED),
            "claims": F.from_json("claims_json", CLAIMS),
            "verification": F.from_json("verification_json", VERIFICATION),
        }
    ).drop("retrieved_json", "claims_json", "verification_json")


def audit_filter(
    log: DataFrame,
    verdict: str | None = None,
    since: str | None = None,
    until: str | None = None,
    query_contains: str | None = None,
    accession: str | None = None,
) -> DataFrame:
    """Rows that meet all given filters; an empty filter is no filter.

    Times compare as text, both ends included. The query filter is a plain
    substring whatever the case, with no wildcards. ``accession`` keeps rows that
    retrieved from that filing and needs ``retrieved`` as an array.
    """
    kept = log
    if verdict:
        kept = kept.filter(F.col("verdict") == verdict)
    if since:
        kept = kept.filter(F.col("created_at") >= since)
    if until:
        kept = kept.filter(F.col("created_at") <= until)
    if query_contains:
        kept = kept.filter(F.lower("query").contains(query_contains.lower()))
    if accession:
        kept = kept.filter(F.exists("retrieved", lambda r: r["accession"] == accession))
    return kept


def audit_list(
    log: DataFrame, limit: int | None = None, offset: int = 0, tie: str = "request_id", **filters: str | None
) -> DataFrame:
    """The filtered log, newest first; a page of it, if ``limit`` is given."""
    page = audit_filter(log, **filters).orderBy(F.desc("created_at"), F.desc(tie))
    if offset:
        page = page.offset(offset)
    return page if limit is None else page.limit(limit)


def audit_by_request(log: DataFrame, request_id: str) -> DataFrame:
    return log.filter(F.col("request_id") == request_id)


def audit_totals(log: DataFrame) -> DataFrame:
    """Rows, answered, everything else, and what it all cost."""
    answered = F.count_if(F.col("verdict") == "answered")
    return log.agg(
        F.count("*").alias("total"),
        answered.alias("answered"),
        (F.count("*") - answered).alias("refused"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
    )


def display_document(verdict: Column, retrieved: Column) -> Column:
    """The first retrieved company of an answered row, else a dash."""
    return F.when(
        verdict == "answered", F.coalesce(F.get(retrieved, F.lit(0))["company"], F.lit("—"))
    ).otherwise(F.lit("—"))
