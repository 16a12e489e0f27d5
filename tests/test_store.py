from __future__ import annotations

import json
import threading

import pytest
from pyspark.sql import functions as F

from citewright.__main__ import main
from citewright.functions.embed import HashEmbedder
from citewright.operators.audit import audit_filter, audit_list, audit_totals, display_document
from citewright.plans.answer import answer_queries
from citewright.plans.ingest import invalid_fields
from citewright.sources.filings import document_url, listing_url, read_filings, recent_filings
from citewright.sources.remote import fetch_documents
from citewright.sources.snapshot import (
    build_snapshot,
    cited_accessions,
    read_document,
    read_snapshot,
    write_document,
    write_snapshot,
)
from citewright.sources.store import ConcurrentIngest, Store
from citewright.streaming.ingest import ARRIVAL_SCHEMA, ingest_stream
from tests.filings import FILINGS, HARBOR

QUERY = "query_id string, query string, created_at string"


@pytest.fixture(scope="module")
def store(spark, raw, tmp_path_factory):
    made = Store.create(spark, str(tmp_path_factory.mktemp("store") / "s"), 256, buckets=4)
    made.ingest(raw, ingested_at="2026-06-12T12:00:00.000Z")
    return made


def test_ingest_twice_is_ingest_once(spark, raw, store):
    before = sorted(map(tuple, store.chunks().collect()))
    counts = sorted(map(tuple, store.index().frequency.collect()))
    store.ingest(raw.limit(1))
    assert sorted(map(tuple, store.chunks().collect())) == before
    assert sorted(map(tuple, store.index().frequency.collect())) == counts
    assert store.filings().count() == 2


def test_changed_filing_is_replaced_everywhere(spark, raw, tmp_path):
    made = Store.create(spark, str(tmp_path / "s"), 256, buckets=2)
    made.ingest(raw)
    changed = raw.filter("cik = '0000000002'").withColumn("html", F.lit("<p>Item 8. Statements</p>kelp"))
    made.ingest(changed)
    texts = {r.accession: r.text for r in made.chunks().filter("cik = '0000000002'").collect()}
    assert list(texts.values()) == ["Item 8. Statements\nkelp"]
    assert made.index().frequency.filter("term = 'freight'").count() == 0
    made.ingest(changed.withColumn("html", F.lit("no headings")))
    assert made.chunks().filter("cik = '0000000002'").count() == 0
    assert made.filings().count() == 2
    assert made.chunks().filter("cik = '0000000001'").count() == 6


def test_filing_that_loses_its_headings_leaves_no_chunks(spark, raw, tmp_path):
    made = Store.create(spark, str(tmp_path / "s"), 256, buckets=64)
    made.ingest(raw)
    assert made.filings().select("bucket").distinct().count() == 2
    bare = raw.withColumn("html", F.lit("no headings"))
    made.ingest(bare.filter("cik = '0000000002'"))
    assert {r.cik for r in made.chunks().collect()} == {"0000000001"}
    assert made.filings("0000000002-26-000002").first().canonical_text == "no headings"
    assert made.chunks("0000000002-26-000002").count() == 0 and made.chunks("0000000001-26-000001").count() == 6
    assert made.index().frequency.filter("term = 'freight'").count() == 0
    assert made.index().totals.agg(F.sum("n")).first()[0] == 6
    versions = len(list((tmp_path / "s" / "filings").iterdir()))
    made.ingest(bare)
    assert made.chunks().count() == 0 and made.filings().count() == 2
    made.vacuum()
    assert versions == 2 and len(list((tmp_path / "s" / "filings").glob("version=*"))) == 1
    assert made.filings().count() == 2
    made.ingest(raw)
    assert made.chunks().count() == 8


def test_first_ingest_without_headings(spark, raw, tmp_path):
    made = Store.create(spark, str(tmp_path / "s"), 256, buckets=8)
    assert made.filings().count() == made.chunks().count() == 0
    made.ingest(raw.withColumn("html", F.lit("no headings")))
    assert made.filings().count() == 2 and made.chunks().count() == 0
    made.ingest(raw)
    assert made.chunks().count() == 8


def test_unpublished_versions_are_not_seen(spark, raw, tmp_path, monkeypatch):
    made = Store.create(spark, str(tmp_path / "s"), 256, buckets=8)
    made.ingest(raw.limit(1))
    monkeypatch.setattr(Store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        made.ingest(raw)
    assert made.filings().count() == 1


def test_two_writers_of_one_bucket_conflict(spark, raw, tmp_path, monkeypatch):
    made = Store.create(spark, str(tmp_path / "s"), 256, buckets=1)
    meet, publish = threading.Barrier(2), Store._publish

    def late(self, *args):
        # Both have read the same state before either publishes; then one after the other.
        if meet.wait(120):
            first_done.wait(120)
        try:
            publish(self, *args)
        finally:
            first_done.set()

    first_done = threading.Event()
    monkeypatch.setattr(Store, "_publish", late)
    ended = []

    def write(rows):
        try:
            made.ingest(rows)
            ended.append("published")
        except ConcurrentIngest:
            ended.append("conflict")

    writers = [threading.Thread(target=write, args=(raw.filter(F.col("cik") == cik),)) for cik in ("0000000001", "0000000002")]
    for writer in writers:
        writer.start()
    for writer in writers:
        writer.join()
    assert sorted(ended) == ["conflict", "published"]
    assert made.filings().count() == 1


def test_publishing_beside_others(spark, raw, tmp_path, monkeypatch):
    made = Store.create(spark, str(tmp_path / "s"), 256, buckets=8)
    made.ingest(raw)
    old = made._manifest()
    first, second = sorted(old[1])
    made.ingest(raw.filter("cik = '0000000001'"))
    number, now = made._manifest()
    changed = next(bucket for bucket in old[1] if now[bucket] != old[1][bucket])
    with pytest.raises(ConcurrentIngest):
        made._publish("rival", [changed], old)
    # Another bucket goes in beside it, also where its number was taken in between.
    other = second if changed == first else first
    stale, answers = made._manifest(), []
    monkeypatch.setattr(Store, "_manifest", lambda self: answers.pop() if answers else read(self))
    read = lambda self: (stale[0] + 1, stale[1] | {changed: "rival"})
    answers.append((stale[0] - 1, dict(stale[1])))
    made._publish("mine", [other], old)
    monkeypatch.undo()
    assert made._manifest() == (number + 2, {changed: "rival", other: "mine"})


def test_only_the_newest_manifest_is_read(spark, raw, tmp_path):
    made = Store.create(spark, str(tmp_path / "s"), 256, buckets=4)
    for _ in range(2):
        made.ingest(raw)
    kept = made._manifest()
    folder = tmp_path / "s" / "manifest"
    oldest = min(folder.glob("0*.json"))
    oldest.write_text("no manifest")
    assert made._manifest() == kept and made.filings().count() == 2
    made.vacuum()
    assert [path.name for path in folder.glob("*.json")] == [f"{kept[0]:012d}.json"]
    assert made.filings().count() == 2


def test_manifests_of_earlier_releases(spark, tmp_path):
    made = Store.create(spark, str(tmp_path / "s"), 256, buckets=4)
    for number, version in ((1, "a"), (2, "b")):
        rows = spark.createDataFrame([(number, 3, version)], "number long, bucket int, version string")
        rows.write.mode("append").json(f"{made.root}/manifest")
    assert made._manifest() == (2, {3: "b"})
    made._publish("c", [0], made._manifest())
    assert made._manifest() == (3, {0: "c", 3: "b"})


def test_rejects(spark, raw, tmp_path):
    made = Store.create(spark, str(tmp_path / "s"), 256, buckets=4)
    assert made.rejects().count() == 0
    bad = raw.limit(1).withColumns({"form": F.lit("8-K"), "cik": F.lit(None).cast("string"), "accession": F.lit("x")})
    empty = raw.limit(1).withColumns({"html": F.lit(None).cast("string"), "accession": F.lit("0000000009-26-000009")})
    made.ingest(raw.union(bad).union(empty), reject=True)
    assert made.filings().count() == 2
    noted = {row.accession: row.reasons for row in made.rejects().collect()}
    assert noted == {"x": ["cik", "accession", "form"], "0000000009-26-000009": ["html"]}
    with pytest.raises(Exception, match="invalid filing"):
        made.ingest(bad)


def test_stream_survives_a_bad_row(spark, tmp_path):
    made = Store.create(spark, str(tmp_path / "s"), 256, buckets=4)
    source = tmp_path / "in"
    source.mkdir()
    good, other = (dict(zip(ARRIVAL_SCHEMA.replace("string", "").replace(",", " ").split(), row)) for row in FILINGS[:2])
    for number, row in enumerate([good, good | {"form": "?", "accession": "bad"}, other]):
        (source / f"{number}.json").write_text(json.dumps(row))
        arrivals = spark.readStream.schema(ARRIVAL_SCHEMA).json(str(source))
        ingest_stream(made, arrivals, str(tmp_path / "ck"), reject=True).awaitTermination()
    assert made.filings().count() == 2
    assert [(row.accession, row.reasons) for row in made.rejects().collect()] == [("bad", ["accession", "form"])]


def test_chunks_of_another_embedder_are_refused(spark, store):
    class Other(HashEmbedder):
        id = "other"

    assert store.index(HashEmbedder(256)).chunks.count() == 8
    with pytest.raises(ValueError, match="not other"):
        store.index(Other(256))


def test_sizes_are_pinned(spark, raw, store):
    with pytest.raises(ValueError, match="256 dimensions"):
        Store.create(spark, store.root, 64)
    with pytest.raises(ValueError, match="embedder gives 64"):
        store.ingest(raw, HashEmbedder(64))
    assert Store.open(spark, store.root) == store
    with pytest.raises(FileNotFoundError):
        Store.open(spark, store.root + "-none")


def test_bad_fields_stop_an_ingest(spark, raw, store):
    with pytest.raises(Exception, match="invalid filing"):
        store.ingest(raw.withColumn("form", F.lit("8-K")))
    with pytest.raises(ValueError, match="given twice"):
        store.ingest(raw.union(raw))
    row = raw.limit(1).withColumn("cik", F.lit("1\n")).select(invalid_fields().alias("bad")).first()
    assert row.bad == ["cik"]


def test_audit_log(spark, store):
    queries = spark.createDataFrame(
        [("a", "orchard cider takings 100%_", "2026-06-10"), ("b", "xylophone", "2026-06-11"),
         ("c", "pruning robots frost", "2026-06-12")], QUERY
    )
    answers = answer_queries(queries, store.index())
    store.append_audit(answers)
    with pytest.raises(ValueError, match="already used"):
        store.append_audit(answers)
    log = store.records()
    ids = lambda df: [r.request_id for r in df.collect()]
    assert ids(audit_list(log)) == ["c", "b", "a"]
    assert ids(audit_list(log, limit=1, offset=1)) == ["b"]
    assert ids(audit_list(log, limit=0)) == []
    assert ids(audit_list(log, verdict="refused")) == ["b"]
    assert ids(audit_list(log, since="2026-06-11")) == ["c", "b"]
    assert ids(audit_list(log, until="2026-06-11")) == ["b", "a"]
    assert ids(audit_list(log, query_contains="0%_")) == ["a"]
    assert ids(audit_list(log, query_contains="ORCHARD")) == ["a"]
    assert ids(audit_list(log, query_contains="o%s")) == []
    assert len(ids(audit_filter(log, accession="0000000001-26-000001"))) == 3
    totals = audit_totals(log).first()
    assert (totals.total, totals.answered, totals.refused, totals.total_cost_usd) == (3, 2, 1, 0.0)
    first = log.filter("request_id = 'a'").first()
    assert first.claims[0].citations[0].span and first.verification.verdict == "supported"
    assert log.filter("request_id = 'b'").first().claims is None
    shown = log.select("request_id", display_document(F.col("verdict"), F.col("retrieved")).alias("d"))
    assert {r.request_id: r.d for r in shown.collect()} == {
        "a": "Orchard Systems Ltd.", "b": "—", "c": "Orchard Systems Ltd.",
    }


def test_snapshot(spark, store, tmp_path):
    queries = spark.createDataFrame([("s", "orchard cider takings", "2026-06-10")], QUERY)
    cited = cited_accessions(answer_queries(queries, store.index()))
    snapshot = build_snapshot(store.filings(), store.records(), cited)
    write_document(snapshot, str(tmp_path / "one"), "2026")
    row = read_document(spark, str(tmp_path / "one")).first()
    assert [f.company for f in row.filings] == ["Harbor Lines Co.", "Orchard Systems Ltd."]
    assert list(row.canonicalTexts) == ["0000000001-26-000001"] and row.generatedAt == "2026"
    assert [a.created_at for a in row.audit] == sorted((a.created_at for a in row.audit), reverse=True)
    write_snapshot(snapshot, str(tmp_path / "parts"), "2026")
    found = read_snapshot(spark, str(tmp_path / "parts"))
    assert found.generated_at == "2026" and found.filings.count() == 2
    assert [r.canonical_text for r in found.texts.collect()] == list(row.canonicalTexts.values())
    assert sorted(r.request_id for r in found.audit.collect()) == sorted(a.request_id for a in row.audit)
    assert found.audit.schema == spark.createDataFrame([], found.audit.schema).schema


def test_command_line(spark, tmp_path, capsys):
    page = tmp_path / "h.htm"
    page.write_text(HARBOR)
    root = str(tmp_path / "store")
    meta = ["--cik", "0000000002", "--accession", "0000000002-26-000002", "--company", "Harbor Lines Co.",
            "--form", "10-K", "--filing-date", "2026-02-20"]
    assert main(["ingest", str(page), "--store", root, "--fake-embeddings", *meta], spark) == 0
    assert "2 sections, 2 chunks, 0 PII redactions" in capsys.readouterr().out
    assert main(["query", "harbor freight volumes", "--store", root, "--fake-embeddings", "--scripted"], spark) == 0
    assert "verdict: " in capsys.readouterr().out
    assert main(["query", "xylophone", "--store", root, "--fake-embeddings", "--scripted"], spark) == 0
    assert "refused: low_retrieval_score" in capsys.readouterr().out
    assert main(["export", str(tmp_path / "out"), "--store", root], spark) == 0
    assert "1 filings, 2 audit records" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["nonsense"], spark)


def test_stream(spark, tmp_path):
    made = Store.create(spark, str(tmp_path / "s"), 256, buckets=2)
    source = tmp_path / "in"
    source.mkdir()
    names = ("cik", "accession", "company", "form", "filing_date", "html")
    for i, filing in enumerate(FILINGS):
        (source / f"{i}.json").write_text(json.dumps(dict(zip(names, filing))))
    arrivals = spark.readStream.schema(ARRIVAL_SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    ingest_stream(made, arrivals, str(tmp_path / "ck")).awaitTermination()
    assert made.filings().count() == 2 and made.chunks().count() == 8


def test_filing_folder(spark, tmp_path):
    (tmp_path / "h.htm").write_text(HARBOR)
    meta = dict(zip(("cik", "accession", "company", "form", "filingDate"), FILINGS[1][:5]))
    (tmp_path / "index.json").write_text(json.dumps({"note": "n", "filings": [{"file": "h.htm", "meta": meta}]}))
    row = read_filings(spark, str(tmp_path)).first()
    assert row.html == HARBOR and row.filing_date == "2026-02-20"


def test_listing_and_urls(spark):
    recent = {"form": ["10-K", "8-K", "10-Q", "10-Q"], "accessionNumber": ["a", "b", "c", "d"],
              "filingDate": ["1", "2", "3", "4"], "primaryDocument": ["x.htm", "y.htm", "", "z.htm"]}
    rows = spark.createDataFrame([(json.dumps({"filings": {"recent": recent}}),)], "j string")
    found = rows.select(F.inline(recent_filings(F.col("j")))).collect()
    assert [tuple(r) for r in found] == [("10-K", "a", "1", "x.htm"), ("10-Q", "d", "4", "z.htm")]
    urls = rows.select(
        document_url(F.lit("0000320193"), F.lit("0000320193-26-000013"), F.lit("m.htm")), listing_url(F.lit("320193"))
    ).first()
    assert urls[0] == "https://www.sec.gov/Archives/edgar/data/320193/000032019326000013/m.htm"
    assert urls[1] == "https://data.sec.gov/submissions/CIK0000320193.json"


def test_fetch(spark):
    urls = spark.createDataFrame([(1, "u/a"), (2, "u/b")], "id int, url string")
    rows = fetch_documents(urls, "me", fetch=lambda url: url.upper(), min_interval=0.01).collect()
    assert sorted((r.id, r.body) for r in rows) == [(1, "U/A"), (2, "U/B")]
    with pytest.raises(ValueError, match="user agent"):
        fetch_documents(urls, " ")
