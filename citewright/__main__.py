"""Command line: ``ingest``, ``query`` and ``export`` over a store."""

from __future__ import annotations

import argparse
import os
import sys
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from citewright import __version__
from citewright.functions.citations import ModelVerifier, ScriptedVerifier
from citewright.functions.embed import Embedder, HashEmbedder, RemoteEmbedder
from citewright.functions.generation import ModelGenerator, sentence_generator
from citewright.plans.answer import answer_queries
from citewright.session import materialise
from citewright.sources.filings import read_html
from citewright.sources.remote import embedding_post, model_post
from citewright.sources.snapshot import build_snapshot, write_snapshot
from citewright.sources.store import Store


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def _key(name: str, instead: str) -> str:
    key = os.environ.get(name)
    if not key:
        raise SystemExit(f"{name} is not set (or pass {instead})")
    return key


def _embedder(args: argparse.Namespace) -> Embedder:
    if args.fake_embeddings:
        return HashEmbedder()
    return RemoteEmbedder(embedding_post(_key("VOYAGE_API_KEY", "--fake-embeddings")))


def ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    embedder = _embedder(args)
    store = Store.create(spark, args.store, embedder.dimensions)
    raw = read_html(spark, args.file).select(
        F.lit(args.cik).alias("cik"),
        F.lit(args.accession).alias("accession"),
        F.lit(args.company).alias("company"),
        F.lit(args.form).alias("form"),
        F.lit(args.filing_date).alias("filing_date"),
        "html",
    )
    filings = store.ingest(raw, embedder, ingested_at=_now())
    chunks = store.chunks().join(filings.select("accession"), "accession", "left_semi")
    sections = chunks.select("section_id").distinct().count()
    hits = filings.agg(F.sum(F.size("redactions"))).first()[0]
    print(
        f"ingested {args.company} {args.form} ({args.accession}): "
        f"{sections} sections, {chunks.count()} chunks, {hits} PII redactions"
    )
    return 0


def _show(answer: Row) -> None:
    print(f"request: {answer['request_id']}\nverdict: {answer['verdict']}")
    if answer["verdict"] == "refused":
        print(f"refused: {answer['refusal_reason']}\n{answer['message']}")
    else:
        print(f"\n{answer['message']}\n\nclaims:")
        for claim in answer["claims"]:
            print(f"  [{'+' if claim['supported'] else '-'}] {claim['text']}")
            for cite in claim["citations"]:
                if cite["span"] and cite["provenance"]:
                    where, span = cite["provenance"], cite["span"]
                    print(
                        f"      {where['company']} {where['section_label']} "
                        f"[{span['start_offset']}-{span['end_offset']}]"
                    )
    print(f"\ncost: ${answer['cost_usd']:.6f} | latency: {answer['latency_ms']}ms")


def query(spark: SparkSession, args: argparse.Namespace) -> int:
    embedder = _embedder(args)
    store = Store.create(spark, args.store, embedder.dimensions)
    asked = spark.createDataFrame(
        [(str(uuid.uuid4()), args.query, _now())], "query_id string, query string, created_at string"
    )
    if args.scripted:
        generator, verifier = sentence_generator(), ScriptedVerifier()
    else:
        post = model_post(_key("ANTHROPIC_API_KEY", "--scripted"))
        generator, verifier = ModelGenerator(post), ModelVerifier(post)
    answers: DataFrame = materialise(
        answer_queries(asked, store.index(embedder), generator, verifier, embedder), "answers"
    )
    store.append_audit(answers)
    _show(answers.first())
    return 0


def export(spark: SparkSession, args: argparse.Namespace) -> int:
    store = Store.open(spark, args.store)
    snapshot = build_snapshot(store.filings(), store.records())
    write_snapshot(snapshot, args.out, _now())
    print(
        f"wrote snapshot to {args.out}: "
        f"{snapshot.filings.count()} filings, {snapshot.audit.count()} audit records"
    )
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="citewright")
    top.add_argument("--version", "-v", action="version", version=f"citewright {__version__}")
    commands = top.add_subparsers(dest="command", required=True)
    for name, run, positional in (
        ("ingest", ingest, "file"), ("query", query, "query"), ("export", export, "out"),
    ):
        command = commands.add_parser(name)
        command.set_defaults(run=run)
        command.add_argument(positional)
        command.add_argument("--store", default="citewright-store")
        if name != "export":
            command.add_argument("--fake-embeddings", action="store_true")
        if name == "ingest":
            for flag in ("cik", "accession", "company", "form", "filing-date"):
                command.add_argument(f"--{flag}", required=True)
        if name == "query":
            command.add_argument("--scripted", action="store_true", help="answer without a model")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("citewright").getOrCreate()
    return args.run(session, args)


if __name__ == "__main__":
    sys.exit(main())
