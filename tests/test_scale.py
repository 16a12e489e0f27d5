"""What is shuffled and sorted follows the input, not the input times the questions."""

import re

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from citewright.operators.keyword import CHUNK_KEY, K1, B, Index, bm25_topk, query_term_counts, weighted_terms
from citewright.operators.postings import directory, postings_topk
from citewright.session import materialise
from citewright.sources import tables
from citewright.sources.store import Store
from citewright.workloads import registered

ROWS = [("a", 0, "frost dock"), ("a", 9, "dock lease lease"), ("b", 0, "frost frost elm"), ("c", 0, "elm lease dock frost")]


def chunks_of(spark, rows):
    made = spark.createDataFrame(rows, "accession string, start_offset int, text string").coalesce(1)
    return made.select("accession", "start_offset", F.split("text", " ").alias("terms")).withColumn("n_terms", F.size("terms"))


def asked_of(spark, index, *texts):
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    return weighted_terms(query_term_counts(queries), index)


def test_entries_name_their_chunk_by_its_place(spark, monkeypatch):
    monkeypatch.setattr("citewright.operators.postings.BLOCK", 3)
    index = Index.of(chunks_of(spark, ROWS))
    entries = index.postings.schema["entries"].dataType
    assert {f.name: f.dataType.simpleString() for f in entries} == {"row": "array<smallint>", "tf": "array<int>"}
    held = directory(index.postings).orderBy("block").collect()
    assert [[(k.accession, k.start_offset, k.n_terms) for k in row["keys"]] for row in held] == [
        [("a", 0, 2), ("a", 9, 3), ("b", 0, 3)], [("c", 0, 4)],
    ]
    assert index.frequency.filter("term IS NULL").count() == 0


def test_a_block_is_scored_against_all_questions_at_once(spark, capsys):
    """No row per question and entry: blocks give their best chunks per question."""
    index = Index.of(chunks_of(spark, ROWS))
    weighted = asked_of(spark, index, "frost", "frost dock", "elm")
    found = postings_topk(weighted, index.postings, directory(index.postings), CHUNK_KEY, 2, K1, B, prune=False)
    found.explain()
    plan = capsys.readouterr().out
    assert "FlatMapGroupsInArrow" in plan and "explode(entries" not in plan
    assert {r.query_id: r.n for r in found.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 2, 2: 2}


@pytest.mark.parametrize("block, prune, pairs", [(2, True, 100), (2, False, 1), (100, True, 100), (100, False, 2)])
def test_chunks_of_one_key_add_up_in_all_blocks(spark, monkeypatch, block, prune, pairs):
    monkeypatch.setattr("citewright.operators.postings.BLOCK", block)
    monkeypatch.setattr("citewright.operators.postings.FIRST", 1)
    monkeypatch.setattr("citewright.operators.postings.MAX_PAIRS", pairs)
    index = Index.of(chunks_of(spark, [*ROWS, *ROWS[:1], ("d", 0, "kelp")]))
    assert index.repeated.collect() == [("a", 0)]
    weighted = asked_of(spark, index, "frost", "dock lease", "kelp kelp")
    weights = {(r.query_id, r.term): (r.weight, r.mean_terms) for r in weighted.collect()}
    found = postings_topk(
        weighted, index.postings, directory(index.postings), CHUNK_KEY, 2, K1, B, prune=prune, repeated=index.repeated
    )
    sums = {}
    for accession, start, text in [*ROWS, *ROWS[:1], ("d", 0, "kelp")]:
        words = text.split()
        for (query, term), (weight, mean) in weights.items():
            if tf := words.count(term):
                gain = weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
                sums[query, accession, start] = sums.get((query, accession, start), 0) + gain
    best = []
    for query in range(3):
        mine = sorted((-round(s * 1e9), a, p) for (q, a, p), s in sums.items() if q == query)[:2]
        best += [(query, a, p, n) for n, (_, a, p) in enumerate(mine, 1)]
    assert sorted((r.query_id, r.accession, r.start_offset, r["rank"]) for r in found.collect()) == best


def test_an_index_of_nothing(spark):
    index = Index.of(chunks_of(spark, ROWS).limit(0))
    queries = spark.createDataFrame([(1, "frost")], "query_id long, query string")
    assert bm25_topk(queries, index, 2).count() == 0


def plan_of(capsys, frame):
    frame.explain()
    return capsys.readouterr().out


def test_chunks_are_sorted_before_they_have_features(spark, tmp_path, monkeypatch, capsys):
    words = "Frost came. The dock froze and the lease ran out. " * 40
    spark.createDataFrame([(n, words, "web") for n in range(4)], "doc_id long, text string, source string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    made = {}
    monkeypatch.setattr(tables, "materialise", lambda df, name: made.setdefault(name, df) and materialise(df, name))
    chunks = tables.Tables(spark, str(tmp_path)).chunks
    assert chunks.count() > 4 and chunks.filter("size(embedding) = 256 AND n_terms > 0").count() == chunks.count()
    plan = plan_of(capsys, made["chunks"])
    assert 0 < plan.index("ArrowEvalPython") < plan.index("Sort [")


def test_a_store_shuffles_chunks_without_features(spark, tmp_path, monkeypatch, capsys):
    shuffled = {}
    write = Store._write

    def kept(self, name, version, rows, *rest):
        shuffled.setdefault(name, []).append(rows)
        write(self, name, version, rows, *rest)

    monkeypatch.setattr(Store, "_write", kept)
    html = "<p>Item 1. Business</p><p>" + "The frost and the dock. " * 30 + "</p>"
    rows = [(f"{n:010d}", f"{n:010d}-24-000001", "Co", "10-K", "2024-01-05", html) for n in range(6)]
    raw = spark.createDataFrame(rows, "cik string, accession string, company string, form string, filing_date string, html string")
    store = Store.create(spark, str(tmp_path / "s"), 256, buckets=2)
    store.ingest(raw)
    assert "ArrowEvalPython" not in plan_of(capsys, shuffled["chunks"][0])
    # One shuffle of the index, by the writer, and counts from its rows.
    assert "Exchange" not in plan_of(capsys, shuffled["blocks"][0])
    assert "explode" not in plan_of(capsys, shuffled["frequency"][0])
    before = {r.chunk_id: list(r.embedding) for r in store.chunks().collect()}
    assert len(before) >= 6 and all(any(v) for v in before.values())
    counts = sorted(map(tuple, store.index().frequency.collect()))
    store.ingest(raw.limit(2))
    assert {r.chunk_id: list(r.embedding) for r in store.chunks().collect()} == before
    assert sorted(map(tuple, store.index().frequency.collect())) == counts
    queries = spark.createDataFrame([(1, "frost")], "query_id long, query string")
    by_index = bm25_topk(queries, store.index(), 3).collect()
    (tmp_path / "s" / "postings" / f"version={next(iter(store._manifest()[1].values()))}").mkdir(parents=True)
    assert store.index().postings is None and sorted(bm25_topk(queries, store.index(), 3).collect()) == sorted(by_index)


def shuffled_columns(capsys, frame):
    """The columns that go through a shuffle; those that are broadcast do not."""
    frame.explain("formatted")
    plan = capsys.readouterr().out
    return {name for found in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan) for name in re.findall(r"(\w+)#", found)}


def filings_of(spark, numbers, word):
    html = f"<p>Item 1. Business</p><p>{f'The {word} and the dock. ' * 60}</p>"
    rows = [(f"{n:010d}", f"{n:010d}-24-000001", "Co", "10-K", "2024-01-05", html) for n in numbers]
    return spark.createDataFrame(rows, "cik string, accession string, company string, form string, filing_date string, html string")


@pytest.mark.parametrize("most", [100_000, 0])
def test_kept_chunks_are_copied_where_they_are(spark, tmp_path, monkeypatch, capsys, most):
    monkeypatch.setattr("citewright.sources.store.MAX_BROADCAST_ROWS", most, raising=False)
    store = Store.create(spark, str(tmp_path / "s"), 256, buckets=2)
    store.ingest(filings_of(spark, range(6), "frost"))
    before = {row.chunk_id: row for row in store.chunks().collect()}
    written, parquet = [], DataFrameWriter.parquet

    def noted(self, path, *rest, **options):
        written.append((path, self._df))
        parquet(self, path, *rest, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    for _ in range(3):
        store.ingest(filings_of(spark, [1, 4], "kelp"))
    monkeypatch.undo()
    after = {row.chunk_id: row for row in store.chunks().collect()}
    changed = {key for key, row in after.items() if int(row.cik) in (1, 4)}
    assert changed and all("kelp" in after[key].text for key in changed)
    assert {key: row for key, row in after.items() if key not in changed} == {
        key: row for key, row in before.items() if int(row.cik) not in (1, 4)
    }
    assert store.filings().count() == 6 and len(changed) < len(after)
    terms = {row.term: row.n for row in store.index().frequency.groupBy("term").agg(F.sum("df").alias("n")).collect()}
    assert (terms["kelp"], terms["frost"], terms["dock"]) == (len(changed), len(after) - len(changed), len(after))
    shuffled = {name: set() for name in ("filings", "chunks", "blocks", "frequency")}
    for path, frame in written:
        for name in shuffled:
            if f"/s/{name}/" in path:
                shuffled[name] |= shuffled_columns(capsys, frame)
    if most:
        assert shuffled["chunks"] <= {"accession"} and not shuffled["blocks"]
        # Copies of several ingests do not pile up.
        now = store._manifest()[1]
        assert all(len(list((tmp_path / "s" / "chunks" / f"version={v}" / f"bucket={b}").glob("*.parquet"))) <= 3 for b, v in now.items())
    assert "canonical_text" in shuffled["filings"] and shuffled["frequency"] == {"bucket", "term", "df"}


def test_texts_of_a_store_are_not_shuffled_to_be_measured(spark, tmp_path, capsys):
    words = "Item 1. Business\n" + "Frost came. The dock froze and the lease ran out. " * 40
    spark.createDataFrame([(n, words, "web") for n in range(4)], "doc_id long, text string, source string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    found = registered()["store_reingest"](spark, str(tmp_path))
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        columns = shuffled_columns(capsys, found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert "length" in columns and "canonical_text" not in columns
