"""Reading filings from files and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_SCHEMA = """
    note string,
    filings array<struct<file:string, meta:struct<
        cik:string, accession:string, company:string, form:string, filingDate:string>>>
"""

RECENT_SCHEMA = """
    filings struct<recent: struct<
        form:array<string>, accessionNumber:array<string>,
        filingDate:array<string>, primaryDocument:array<string>>>
"""

# The forms that are kept, and where documents and indexes live.
FORMS = ("10-K", "10-Q")
ARCHIVE = "https://www.sec.gov/Archives/edgar/data"
SUBMISSIONS = "https://data.sec.gov/submissions"


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """``file, html`` with one row per file, read whole."""
    return spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("html")
    )


def read_filings(spark: SparkSession, folder: str) -> DataFrame:
    """Filings described by ``index.json`` in ``folder``, with their HTML."""
    index = (
        spark.read.schema(INDEX_SCHEMA)
        .json(f"{folder}/index.json", multiLine=True)
        .select(F.inline("filings"))
        .select(
            "file", "meta.cik", "meta.accession", "meta.company", "meta.form",
            F.col("meta.filingDate").alias("filing_date"),
        )
    )
    return index.join(read_html(spark, f"{folder}/*.htm*"), "file")


def recent_filings(listing: Column) -> Column:
    """Entries of a company listing whose form is kept and that have a document.

    The listing holds parallel arrays; entries keep their order.
    """
    recent = F.from_json(listing, RECENT_SCHEMA)["filings"]["recent"]
    entries = F.arrays_zip(
        recent["form"].alias("form"),
        recent["accessionNumber"].alias("accession"),
        recent["filingDate"].alias("filing_date"),
        recent["primaryDocument"].alias("primary_document"),
    )
    return F.filter(
        entries, lambda e: e["form"].isin(*FORMS) & (F.length(e["primary_document"]) > 0)
    )


def listing_url(cik: Column) -> Column:
    padded = F.when(F.length(cik) < 10, F.lpad(cik, 10, "0")).otherwise(cik)
    return F.concat(F.lit(f"{SUBMISSIONS}/CIK"), padded, F.lit(".json"))


def document_url(cik: Column, accession: Column, document: Column) -> Column:
    folder = F.regexp_replace(accession, "-", "")
    return F.concat_ws("/", F.lit(ARCHIVE), cik.cast("long").cast("string"), folder, document)
