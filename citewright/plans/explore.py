"""What the explorer shows of recorded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewright.functions.highlight import CONTEXT_CHARS, highlight_span


def cited_spans(answers: DataFrame) -> DataFrame:
    """One row per citation that resolved, with where it stands in which filing."""
    claims = answers.select("request_id", F.posexplode("claims").alias("claim_no", "c"))
    cites = claims.select(
        "request_id", "claim_no", F.col("c.text").alias("claim"),
        F.posexplode("c.citations").alias("cite_no", "x"),
    )
    return cites.filter("x.span is not null").select(
        "request_id", "claim_no", "claim", "cite_no",
        "x.provenance.accession", "x.provenance.company", "x.provenance.section_label",
        "x.span.start_offset", "x.span.end_offset",
    )


def citation_contexts(
    answers: DataFrame, filings: DataFrame, context: int = CONTEXT_CHARS
) -> DataFrame:
    """Each cited span in its surroundings in the canonical text.

    The text is cut down right after the join, so no later step carries it.
    """
    text = F.col("canonical_text")
    joined = cited_spans(answers).join(filings.select("accession", "canonical_text"), "accession")
    shown = highlight_span(text, F.col("start_offset"), F.col("end_offset"), context)
    return joined.select(
        "request_id", "claim_no", "claim", "cite_no", "accession", "company", "section_label",
        "start_offset", "end_offset", shown.alias("shown"),
    )
