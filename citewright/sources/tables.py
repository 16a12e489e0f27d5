"""The given tables as filings, queries and an audit log.

The tables hold no filings, so every document becomes the text of one, with the
headings and personal data a filing has, and every page becomes its HTML. Each
view covers the whole table and is a row-by-row projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewright.operators.keyword import Index
from citewright.plans.ingest import chunk_filings, redacted_texts, with_features
from citewright.session import materialise, spread


def _digits(number: Column, size: int) -> Column:
    return F.lpad(number.cast("string"), size, "0")


def _meta(key: str, company: Column) -> list[Column]:
    n = F.col(key)
    return [
        _digits(n % 9973, 10).alias("cik"),
        F.concat(_digits(n, 10), F.lit("-24-"), _digits(n % 1000000, 6)).alias("accession"),
        F.concat(F.lit("Issuer "), company).alias("company"),
        F.when(n % 2 == 0, F.lit("10-Q")).otherwise(F.lit("10-K")).alias("form"),
        F.concat(
            F.lit("2024-"), _digits(n % 12 + 1, 2), F.lit("-"), _digits(n % 28 + 1, 2)
        ).alias("filing_date"),
    ]


AUDIT_RETRIEVED = "array<struct<accession:string,company:string>>"


@dataclass(frozen=True)
class Tables:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def document_filings(self) -> DataFrame:
        """``meta..., text``: each document between headings, with contact details."""
        n, text = F.col("doc_id"), F.col("text")
        half = F.floor(F.length(text) / 2).cast("int")
        four = _digits(n % 10000, 4)
        body = F.concat(
            F.lit("Contents\nItem 1. Business overview\nItem 7. Results of operations\n"),
            F.lit("Item 9B. Other matters\nPART I\nItem 1. Business overview\n"),
            F.substring(text, F.lit(1), half),
            F.lit("\nPART II\nItem 7. Results of operations\n"),
            F.substring(text, half + 1, F.length(text) - half),
            F.lit("\nItem 8. Contact details\nHolder SSN "),
            _digits(n % 1000, 3), F.lit("-"), _digits(n % 100, 2), F.lit("-"), four,
            F.lit(", account no. "), _digits(n, 12),
            F.lit(", phone (425) 555-"), four,
            F.lit(", desk 425-555-"), four, F.lit("@mail.example, acct u@ma.io 9990"), _digits(n, 8),
            F.lit("."),
        )
        scan = spread(self.table("documents").select("doc_id", "text", "source"), "doc_id")
        return scan.select(*_meta("doc_id", F.col("source")), body.alias("text"))

    def page_filings(self) -> DataFrame:
        """``meta..., html``: each page with a heading before and after it."""
        scan = spread(self.table("pages"), "page_id")
        html = F.concat(
            F.lit("<p>PART I</p><p>Item 1. Business &amp; strategy</p>"),
            F.col("html"),
            F.lit("<div>Item 2. Properties&nbsp;held</div><p>Write to desk&#64;mail.example &#8217;now&#x2019;.</p>"),
        )
        site = F.regexp_extract("url", "^https?://([^/]+)", 1)
        return scan.select(*_meta("page_id", site), html.alias("html"))

    def queries(self) -> DataFrame:
        """``query_id, query, created_at`` from every benchmark text."""
        return self.table("benchmark").select(
            F.col("item_id").alias("query_id"),
            F.col("text").alias("query"),
            F.concat(F.lit("2026-06-12T12:00:00."), _digits(F.col("item_id") % 1000, 3), F.lit("Z")).alias(
                "created_at"
            ),
        )

    def audit_log(self) -> DataFrame:
        """One audit row per event, its retrieved filings as JSON text."""
        user = F.col("user_id")
        error = F.col("event_type") == "error"
        hit = lambda n: F.struct(
            _digits(n, 10).alias("accession"), F.concat(F.lit("Issuer "), n.cast("string")).alias("company")
        )
        return self.table("events").select(
            F.concat(F.lit("req-"), _digits(F.col("event_id"), 8)).alias("request_id"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
            F.concat("event_type", F.lit(" Rate 100%_net "), "props").alias("query"),
            F.when(error, F.lit("refused")).otherwise(F.lit("answered")).alias("verdict"),
            F.when(error, F.lit("no_claims")).alias("refusal_reason"),
            F.to_json(F.array(hit(user), hit(user + 1))).alias("retrieved_json"),
            (F.col("value") / 1000).alias("cost_usd"),
            F.from_json("props", "k long")["k"].alias("latency_ms"),
        )

    @cached_property
    def filings(self) -> DataFrame:
        """The documents as redacted filings, written once."""
        return materialise(redacted_texts(self.document_filings()), "filings")

    @cached_property
    def chunks(self) -> DataFrame:
        """Their chunks with vectors and terms, written once."""
        cut = chunk_filings(spread(self.filings, "accession"))
        # Sorted before features are added, which are several times the text.
        return materialise(with_features(cut.sortWithinPartitions("accession", "start_offset")), "chunks")

    @cached_property
    def index(self) -> Index:
        """The chunks with their term counts, counted once."""
        return Index.of(self.chunks)


@lru_cache(maxsize=8)
def _tables(spark: SparkSession, app: str, folder: str) -> Tables:
    return Tables(spark, folder)


def tables(spark: SparkSession, folder: str) -> Tables:
    """The tables of one folder; what they write is shared within a session."""
    return _tables(spark, spark.sparkContext.applicationId, folder)
