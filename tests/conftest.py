from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from citewright.session import local_session  # noqa: E402
from tests.filings import FILINGS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, **{"spark.driver.memory": "8g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    schema = "cik string, accession string, company string, form string, filing_date string, html string"
    return spark.createDataFrame(FILINGS, schema)


@pytest.fixture(scope="session")
def index(spark, raw):
    from citewright.operators.keyword import Index
    from citewright.plans.ingest import canonical_filings, chunk_filings, with_features
    from citewright.session import materialise

    filings = canonical_filings(raw)
    return Index.of(materialise(with_features(chunk_filings(filings)), "test-chunks"))
