"""Ingesting filings as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from citewright.functions.embed import Embedder
from citewright.sources.store import Store

ARRIVAL_SCHEMA = """
    cik string, accession string, company string, form string, filing_date string, html string
"""


def ingest_stream(
    store: Store, arrivals: DataFrame, checkpoint: str, embedder: Embedder | None = None, reject: bool = False
) -> StreamingQuery:
    """Ingest each micro-batch of ``arrivals``, a stream with ``ARRIVAL_SCHEMA``.

    Ingesting replaces by accession, so a batch that is run again after a failure
    leaves the store as one run would. With ``reject`` an invalid filing is noted in
    the store's ``rejects`` and the stream goes on; else it ends the stream.
    """

    def take(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.ingest(batch, embedder, reject=reject)

    return (
        arrivals.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
