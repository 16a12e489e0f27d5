"""From raw filing HTML to canonical texts, chunks, vectors and postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewright.functions.chunk import ChunkOptions, chunk_rows
from citewright.functions.embed import Embedder, HashEmbedder, embed_column
from citewright.functions.html import extract_text
from citewright.functions.pii import redact_pii
from citewright.functions.sections import detect_sections
from citewright.functions.tokens import index_terms

META = ("cik", "accession", "company", "form", "filing_date")

# What the descriptive fields of a filing must look like.
META_RULES = {
    "cik": "^[0-9]{10}\\z",
    "accession": "^[0-9]{10}-[0-9]{2}-[0-9]{6}\\z",
    "company": "(?s)^.+\\z",
    "form": "^10-[KQ]\\z",
    "filing_date": "^[0-9]{4}-[0-9]{2}-[0-9]{2}\\z",
}


def invalid_fields(prefix: str = "") -> Column:
    """The names of the fields that break their rule, as an array."""
    checks = [
        F.when(F.coalesce(F.col(prefix + name).rlike(rule), F.lit(False)), F.lit(None)).otherwise(
            F.lit(name)
        )
        for name, rule in META_RULES.items()
    ]
    return F.array_compact(F.array(*checks))


def require_valid_meta(raw: DataFrame) -> DataFrame:
    """Fail the job on the first row whose fields break a rule."""
    bad = invalid_fields()
    message = F.concat(
        F.lit("invalid filing "), F.coalesce("accession", F.lit("?")), F.lit(": "),
        F.array_join(bad, ", "),
    )
    checked = F.when(F.size(bad) == 0, F.col("accession")).otherwise(F.raise_error(message))
    return raw.withColumn("accession", checked.cast("string"))


def parted_by_validity(raw: DataFrame, html: str = "html") -> tuple[DataFrame, DataFrame]:
    """The rows that keep all rules, and ``meta..., reasons`` of the others.

    A row without a page has nothing to ingest and counts as invalid.
    """
    page = F.when(F.col(html).isNull(), F.array(F.lit(html))).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(invalid_fields(), page)
    refused = raw.select(*META, reasons.alias("reasons")).filter(F.size("reasons") > 0)
    return raw.filter(F.size(reasons) == 0), refused


def canonical_filings(raw: DataFrame, html: str = "html") -> DataFrame:
    """``meta..., canonical_text, redactions`` with personal data already gone."""
    redacted = raw.select(*META, redact_pii(extract_text(F.col(html))).alias("r"))
    return redacted.select(
        *META, F.col("r.text").alias("canonical_text"), F.col("r.hits").alias("redactions")
    )


def redacted_texts(raw: DataFrame, text: str = "text") -> DataFrame:
    """The same for input that is plain text already."""
    redacted = raw.select(*META, redact_pii(F.col(text)).alias("r"))
    return redacted.select(
        *META, F.col("r.text").alias("canonical_text"), F.col("r.hits").alias("redactions")
    )


def chunk_filings(filings: DataFrame, options: ChunkOptions | None = None) -> DataFrame:
    """One row per chunk with its provenance. Filings without headings give none."""
    sectioned = filings.withColumn("sections", detect_sections(F.col("canonical_text")))
    return chunk_rows(sectioned, list(META), options).select(
        F.concat(F.col("accession"), F.lit(":"), F.col("start"), F.lit("-"), F.col("end")).alias(
            "chunk_id"
        ),
        *META,
        F.col("section.id").alias("section_id"),
        F.col("section.label").alias("section_label"),
        F.col("start").alias("start_offset"),
        F.col("end").alias("end_offset"),
        "text",
    )


def with_features(chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Add ``embedding``, ``terms`` and ``n_terms``, which are all that ranking reads."""
    return chunks.withColumns(
        {
            "embedding": embed_column(F.col("text"), embedder or HashEmbedder()),
            "terms": index_terms(F.col("text")),
        }
    ).withColumn("n_terms", F.size("terms"))


def ingest_summary(filings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per filing: sections, chunks, redactions and the length of its text."""
    counted = chunks.groupBy("accession").agg(F.count("*").alias("chunk_count"))
    return (
        filings.select(
            "accession",
            F.size(detect_sections(F.col("canonical_text"))).cast("long").alias("section_count"),
            F.size("redactions").cast("long").alias("redaction_count"),
            F.length("canonical_text").cast("long").alias("canonical_length"),
        )
        .join(counted, "accession", "left")
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("long")))
    )
