"""The operators applied to the given tables, one query each.

Every query covers its whole tables. Numbers are widened to BIGINT or DOUBLE and
nested results are flattened so that any engine's rows compare with them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citewright.functions.citations import (
    ScriptedVerifier,
    constant_verifier,
    first_resolvable,
    judge_inputs,
    overlap_verdict,
    resolve_citations,
    verify_claims,
)
from citewright.functions.embed import HashEmbedder, embed_column, hash_buckets
from citewright.functions.generation import (
    ScriptedGenerator,
    build_prompt,
    check_generation,
    estimate_cost_usd,
    grounded_generator,
    sentence_generator,
)
from citewright.functions.highlight import highlight_span
from citewright.functions.html import extract_text
from citewright.functions.pii import detect_pii, redact_pii
from citewright.functions.sections import detect_sections
from citewright.functions.strings import let
from citewright.functions.tokens import fnv1a, match_expression, tokenize
from citewright.operators import audit as log_ops
from citewright.operators.fusion import fuse_two, rank_fusion
from citewright.operators.blocks import UNITS
from citewright.operators.keyword import CHUNK_KEY, K1, B, bm25_topk, postings_of, query_term_counts, weighted_terms
from citewright.operators.postings import directory, postings_topk
from citewright.operators.upsert import replace_by_key
from citewright.operators.vector import vector_topk
from citewright.plans.answer import (
    answer_gate,
    answer_queries,
    answer_retrieved,
    answer_trace,
    retrieval_gate,
    top_rrf,
)
from citewright.plans.explore import citation_contexts
from citewright.plans.ingest import (
    canonical_filings,
    chunk_filings,
    ingest_summary,
    invalid_fields,
    redacted_texts,
)
from citewright.plans.retrieve import embed_queries, hybrid_retrieve, retrieved_array
from citewright.session import materialise, scratch_dir, spread
from citewright.sources.filings import document_url, listing_url, recent_filings
from citewright.sources.snapshot import (
    build_snapshot,
    cited_accessions,
    list_filings,
    read_snapshot,
    write_snapshot,
)
from citewright.sources.store import Store
from citewright.sources.tables import AUDIT_RETRIEVED, Tables, tables

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def _register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    _QUERIES[build.__name__] = lambda spark, folder: build(tables(spark, folder))
    return build


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


def _long(*names: str) -> list[Column]:
    return [F.col(name).cast("long").alias(name.rsplit(".", 1)[-1]) for name in names]


# --- text -------------------------------------------------------------------


@_register
def extract_text_pages(t: Tables) -> DataFrame:
    pages = spread(t.table("pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", extract_text(F.col("html")).alias("canonical"))


@_register
def pii_detect_spans(t: Tables) -> DataFrame:
    spans = t.document_filings().select("accession", F.explode(detect_pii(F.col("text"))).alias("s"))
    return spans.select("accession", F.col("s.type").alias("type"), *_long("s.start", "s.end"))


@_register
def pii_redact(t: Tables) -> DataFrame:
    redacted = redacted_texts(t.document_filings())
    return redacted.select(
        "accession", "canonical_text", F.size("redactions").cast("long").alias("n_hits")
    )


@_register
def pii_redaction_hits(t: Tables) -> DataFrame:
    scan = spread(t.table("conversations"), "conv_id", "turn")
    hits = scan.select("conv_id", "turn", F.explode(redact_pii(F.col("text"))["hits"]).alias("h"))
    placed = t.document_filings().select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("accession").substr(1, 10).cast("long").alias("turn"),
        F.explode(redact_pii(F.col("text"))["hits"]).alias("h"),
    )
    return hits.unionByName(placed).select(
        "conv_id", "turn", F.col("h.type").alias("type"), *_long("h.start", "h.end")
    )


@_register
def section_detect(t: Tables) -> DataFrame:
    found = t.document_filings().select(
        "accession", F.inline(detect_sections(F.col("text")))
    )
    return found.select("accession", "id", "label", "part", "item", "title", *_long("start", "end"))


@_register
def chunk_windows(t: Tables) -> DataFrame:
    raw = t.document_filings().withColumnRenamed("text", "canonical_text")
    return chunk_filings(raw).select(
        "chunk_id", "accession", "section_id", *_long("start_offset", "end_offset"), "text"
    )


@_register
def ingest_pages(t: Tables) -> DataFrame:
    filings = materialise(canonical_filings(t.page_filings()), "page-filings")
    return ingest_summary(filings, chunk_filings(spread(filings, "accession")))


@_register
def meta_validate(t: Tables) -> DataFrame:
    odd = F.col("c_custkey") % 7
    rows = t.table("customer").select(
        "c_custkey",
        F.lpad(F.col("c_custkey").cast("string"), 10, "0").substr(
            F.lit(1), F.when(odd == 1, 9).otherwise(10)
        ).alias("cik"),
        F.concat(
            F.lpad(F.col("c_custkey").cast("string"), 10, "0"),
            F.when(odd == 2, F.lit("/")).otherwise(F.lit("-")),
            F.lit("24-000001"),
        ).alias("accession"),
        F.when(odd == 3, F.lit("")).otherwise(F.col("c_name")).alias("company"),
        F.when(odd == 4, F.lit("8-K")).otherwise(F.lit("10-K")).alias("form"),
        F.when(odd == 5, F.lit("2024-1-05")).otherwise(F.lit("2024-01-05")).alias("filing_date"),
    )
    return rows.select("c_custkey", F.array_join(invalid_fields(), ",").alias("invalid"))


# --- tokens and vectors -----------------------------------------------------


@_register
def tokenize_documents(t: Tables) -> DataFrame:
    docs = spread(t.table("documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", tokenize(F.col("text")).alias("tokens")).select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.array_join("tokens", " ").alias("tokens"),
    )


@_register
def fnv_hash(t: Tables) -> DataFrame:
    docs = spread(t.table("documents").select("doc_id", "text"), "doc_id")
    words = docs.select(F.explode(tokenize(F.col("text"))).alias("token")).distinct()
    return words.select("token", fnv1a(F.col("token")).alias("hash"))


@_register
def hash_embedding_sparse(t: Tables) -> DataFrame:
    talk = spread(t.table("conversations"), "conv_id", "turn")
    buckets = talk.select(
        "conv_id", "turn", F.explode(hash_buckets(tokenize(F.col("text")), 256)).alias("bucket")
    )
    return buckets.groupBy("conv_id", "turn", F.col("bucket").cast("long").alias("bucket")).agg(
        F.count("*").alias("n")
    )


@_register
def hash_embedding_norm(t: Tables) -> DataFrame:
    talk = spread(t.table("conversations"), "conv_id", "turn")
    dense = talk.select(
        "conv_id", "turn", F.posexplode(embed_column(F.col("text"), HashEmbedder())).alias("bucket", "w")
    )
    return dense.filter("w > 0").select(
        "conv_id", "turn", *_long("bucket"), F.round(F.col("w").cast("double"), 6).alias("weight")
    )


def _label_centres(t: Tables) -> DataFrame:
    """The mean vector of each label, as queries over the same table."""
    parts = t.table("embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    sized = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p"))
    return sized.select(
        F.col("label").cast("long").alias("query_id"),
        F.transform("p", lambda p: p["v"]).alias("embedding"),
    )


@_register
def vector_topk_centres(t: Tables) -> DataFrame:
    corpus = spread(t.table("embeddings").select("vec_id", "embedding"), "vec_id")
    found = vector_topk(_label_centres(t), corpus, 20, ["vec_id"])
    return found.select(
        "query_id", "vec_id", *_long("vector_rank"), F.round("vector_distance", 6).alias("distance")
    )


# --- retrieval --------------------------------------------------------------


def _vector(t: Tables) -> DataFrame:
    return vector_topk(embed_queries(t.queries()), t.chunks, 20, CHUNK_KEY)


def _keyword(t: Tables) -> DataFrame:
    return bm25_topk(t.queries(), t.index, 20)


def _retrieved(t: Tables) -> DataFrame:
    return hybrid_retrieve(t.queries(), t.index)


def _arrays(t: Tables) -> DataFrame:
    return retrieved_array(t.queries(), _retrieved(t))


@_register
def fts_query_terms(t: Tables) -> DataFrame:
    return t.queries().select("query_id", match_expression(F.col("query")).alias("expression"))


@_register
def postings_index(t: Tables) -> DataFrame:
    """The keyword index of the conversations, one posting list entry per row."""
    turns = spread(t.table("conversations"), "conv_id", "turn").select(
        F.col("conv_id").alias("accession"), F.col("turn").alias("start_offset"), "text"
    )
    return postings_of(turns).select(
        F.col("accession").alias("conv_id"), F.col("start_offset").alias("turn"),
        "term", *_long("tf", "n_terms"),
    )


@_register
def vector_topk_chunks(t: Tables) -> DataFrame:
    return _vector(t).select(
        "query_id", "accession", *_long("start_offset", "vector_rank"),
        F.round("vector_distance", 6).alias("distance"),
    )


@_register
def bm25_topk_chunks(t: Tables) -> DataFrame:
    return _keyword(t).select(
        "query_id", "accession", *_long("start_offset", "keyword_rank"),
        F.round("keyword_score", 6).alias("score"),
    )


@_register
def bm25_topk_postings(t: Tables) -> DataFrame:
    """The same ranking by the inverted index alone, blocks below the floor left out."""
    weighted = materialise(weighted_terms(query_term_counts(t.queries()), t.index), "weighted")
    postings = t.index.postings
    found = postings_topk(weighted, postings, directory(postings), CHUNK_KEY, 20, K1, B, repeated=t.index.repeated)
    return found.select(
        "query_id", "accession", *_long("start_offset"), F.col("rank").cast("long").alias("keyword_rank"),
        F.round(-F.col("key") / F.lit(UNITS), 6).alias("score"),
    )


@_register
def rrf_two_list(t: Tables) -> DataFrame:
    fused = fuse_two(_vector(t), _keyword(t), CHUNK_KEY, top=40)
    return fused.select(
        "query_id", "accession", *_long("start_offset", "fused_rank", "vector_rank", "keyword_rank"),
        F.round("rrf", 9).alias("rrf"),
    )


@_register
def rrf_n_list(t: Tables) -> DataFrame:
    """Each customer's orders ranked by price, by date and by key, then fused."""
    orders = t.table("orders")

    def ranked(list_no: int, *order: Column) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order))
        return orders.select(
            F.col("o_custkey").alias("query_id"), "o_orderkey", F.lit(list_no).alias("list_no"), rank.alias("rank")
        )

    lists = (
        ranked(0, F.desc("o_totalprice"), F.col("o_orderkey"))
        .union(ranked(1, F.desc("o_orderdate"), F.col("o_orderkey")))
        .union(ranked(2, F.desc("o_orderkey")))
    )
    fused = rank_fusion(lists, ["o_orderkey"], 3)
    return fused.select(
        "query_id", "o_orderkey", *_long("fused_rank"), F.round("rrf", 9).alias("rrf"),
        *[F.get("ranks", F.lit(i)).cast("long").alias(f"rank_{i}") for i in range(3)],
    )


@_register
def hybrid_retrieve_chunks(t: Tables) -> DataFrame:
    return _retrieved(t).select(
        "query_id", "chunk_id", *_long("fused_rank", "vector_rank", "keyword_rank"),
        F.round("vector_distance", 6).alias("distance"), F.round("rrf", 9).alias("rrf"),
    )


@_register
def hydrate_provenance(t: Tables) -> DataFrame:
    return _retrieved(t).select(
        "query_id", "chunk_id", "cik", "accession", "company", "form", "filing_date",
        "section_id", "section_label", *_long("start_offset", "end_offset"), "text",
    )


@_register
def retrieval_gate_reasons(t: Tables) -> DataFrame:
    r = F.col("retrieved")
    return _arrays(t).select(
        "query_id", F.size(r).cast("long").alias("n_retrieved"),
        F.round(top_rrf(r), 9).alias("top_rrf"), retrieval_gate(r).alias("reason"),
        retrieval_gate(r, 0.0325).alias("strict_reason"),
    )


@_register
def gate_intersection_fastpath(t: Tables) -> DataFrame:
    """With the default sizes a query passes iff some chunk is in both lists."""
    both = _vector(t).join(_keyword(t), ["query_id", *CHUNK_KEY]).select("query_id").distinct()
    passed = both.withColumn("sufficient", F.lit(True))
    return t.queries().select("query_id").join(passed, "query_id", "left").select(
        "query_id", F.coalesce("sufficient", F.lit(False)).alias("sufficient")
    )


# --- generation, citations, verdicts ----------------------------------------


@_register
def prompt_render(t: Tables) -> DataFrame:
    return _arrays(t).select(
        "query_id", build_prompt(F.col("query"), F.col("retrieved")).alias("prompt")
    )


@_register
def cost_estimate(t: Tables) -> DataFrame:
    models = ["claude-opus-4-8", "claude-sonnet-4-6", "claude-haiku-4-5", "other"]
    names = F.array(*[F.lit(m) for m in models])
    rows = t.table("lineitem").select(
        F.get(names, (F.col("l_linenumber") % 4).cast("int")).alias("model"),
        F.col("l_partkey").alias("tokens_in"), F.col("l_suppkey").alias("tokens_out"),
    )
    cost = estimate_cost_usd(F.col("model"), F.col("tokens_in"), F.col("tokens_out"))
    return rows.groupBy("model").agg(
        F.count("*").alias("calls"), F.round(F.sum(cost), 6).alias("cost_usd")
    )


@_register
def reply_validation(t: Tables) -> DataFrame:
    """A reply per conversation turn, most of them lacking something, and what each one lacks."""
    text, cited = F.col("text"), F.array(F.col("conv_id").cast("string"))
    quote = F.substring("text", 1, 30)

    def claims(said: Column, *quoted: Column) -> Column:
        return F.array(F.struct(said.alias("text"), cited.alias("chunk_ids"), *quoted)).alias("claims")

    answer, whole = text.alias("answer"), claims(F.col("role"), quote.alias("quote"))
    good = F.to_json(F.struct(answer, whole))
    kinds = [
        good,
        F.to_json(F.struct(whole)),
        F.to_json(F.struct(answer)),
        F.to_json(F.struct(answer, claims(F.col("role")))),
        F.to_json(F.struct(answer, claims(F.lit(""), quote.alias("quote")))),
        F.substring(good, F.lit(1), F.length(good) - 1),
        F.concat(F.lit("So: "), text),
    ]
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(kinds) + 1)).cast("int")
    # The eighth kind is no reply at all.
    reply = F.coalesce(*[F.when(kind == n, value) for n, value in enumerate(kinds)])
    checked = t.table("conversations").select("conv_id", "turn", check_generation(reply).alias("c"))
    return checked.select(
        *_long("conv_id", "turn"),
        F.col("c.problem").alias("problem"),
        F.col("c.generation.answer").alias("answer"),
        F.size("c.generation.claims").cast("long").alias("n_claims"),
        F.get("c.generation.claims", F.lit(0))["quote"].alias("quote"),
    ).withColumn("n_claims", F.when(F.col("n_claims") >= 0, F.col("n_claims")))


def _flat_generation(rows: DataFrame) -> DataFrame:
    g = F.col("g.generation")
    return rows.select("query_id", g["answer"].alias("answer"), F.explode(g["claims"]).alias("c")).select(
        "query_id", "answer", F.col("c.text").alias("claim"),
        F.array_join("c.chunk_ids", ",").alias("chunk_ids"), F.col("c.quote").alias("quote"),
    )


@_register
def grounded_generation(t: Tables) -> DataFrame:
    made = grounded_generator().generate(F.col("query"), F.col("retrieved"))
    return _flat_generation(_arrays(t).select("query_id", made.alias("g")))


@_register
def sentence_generation(t: Tables) -> DataFrame:
    made = sentence_generator().generate(F.col("query"), F.col("retrieved"))
    return _flat_generation(_arrays(t).select("query_id", made.alias("g")))


def mixed_generator() -> ScriptedGenerator:
    """Claims of every kind: sound, misquoted, uncited, fabricated, or none at all.

    The query length decides which, so that a batch of queries meets each reason.
    """

    def claim(text: Column, ids: Column, quote: Column) -> Column:
        return F.struct(text.alias("text"), ids.cast("array<string>").alias("chunk_ids"), quote.alias("quote"))

    def respond(query: Column, retrieved: Column) -> Column:
        def build(s: Column) -> Column:
            first, second, n = s["first"], s["second"], F.length(s["q"])
            quote = F.substring(first["text"], 11, 60)
            sound = claim(
                F.concat(F.lit("Stated: "), quote),
                F.array(second["chunk_id"], first["chunk_id"]),
                F.concat(F.lit("  "), quote, F.lit(" ")),
            )
            misquoted = claim(F.lit("Misquoted"), F.array(first["chunk_id"]), F.upper(quote))
            uncited = claim(F.lit("Uncited"), F.array(), quote)
            fabricated = claim(F.lit("Made up"), F.array(F.lit("missing:0-1"), first["chunk_id"]), quote)
            unrelated = claim(F.lit("zzzz"), F.array(first["chunk_id"]), quote)
            kind = n % 6
            claims = (
                F.when(kind == 0, F.array(sound))
                .when(kind == 1, F.array(sound, misquoted))
                .when(kind == 2, F.array(uncited))
                .when(kind == 3, F.array(sound, fabricated))
                .when(kind == 4, F.filter(F.array(sound), lambda _: F.lit(False)))
                .otherwise(F.array(sound, unrelated))
            )
            return F.struct(F.lit("Mixed.").alias("answer"), claims.alias("claims"))

        return let(
            F.struct(
                query.alias("q"),
                F.get(retrieved, F.lit(0)).alias("first"),
                F.get(retrieved, F.lit(1)).alias("second"),
            ),
            build,
        )

    return ScriptedGenerator(respond, "mixed-generator")


def _resolved(t: Tables) -> DataFrame:
    made = mixed_generator().generate(F.col("query"), F.col("retrieved"))
    return _arrays(t).withColumn("g", made).select(
        "query_id", resolve_citations(F.col("g.generation"), F.col("retrieved")).alias("resolved")
    )


@_register
def citation_resolve(t: Tables) -> DataFrame:
    claims = _resolved(t).select("query_id", F.posexplode("resolved.claims").alias("claim_no", "c"))
    cites = claims.select(
        "query_id", "claim_no", F.col("c.supported").alias("supported"),
        F.posexplode_outer("c.citations").alias("cite_no", "x"),
    )
    return cites.select(
        "query_id", *_long("claim_no", "cite_no"), "supported", "x.chunk_id", "x.chunk_found",
        "x.quote_found", *_long("x.span.start_offset", "x.span.end_offset"),
        F.col("x.provenance.section_id").alias("section_id"),
    )


@_register
def citation_precheck(t: Tables) -> DataFrame:
    return _resolved(t).select(
        "query_id", F.col("resolved.precheck_passed").alias("passed"),
        F.array_join("resolved.unknown_chunk_ids", ",").alias("unknown"),
        F.size("resolved.claims").cast("long").alias("n_claims"),
    )


@_register
def first_resolvable_citation(t: Tables) -> DataFrame:
    claims = _resolved(t).select("query_id", F.posexplode("resolved.claims").alias("claim_no", "c"))
    picked = claims.withColumn("x", first_resolvable(F.col("c.citations")))
    return picked.select(
        "query_id", *_long("claim_no"), F.col("x.chunk_id").alias("chunk_id"),
        *_long("x.span.start_offset"),
    )


@_register
def judge_overlap(t: Tables) -> DataFrame:
    """Each turn judged against the one after it."""
    turns = t.table("conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("quote"))
    judged = turns.join(after, ["conv_id", "turn"]).withColumn(
        "v", overlap_verdict(F.col("text"), F.col("quote"))
    )
    return judged.select("conv_id", "turn", "v.entailed", "v.confidence", "v.rationale")


@_register
def verify_claims_verdicts(t: Tables) -> DataFrame:
    judge = ScriptedVerifier()
    rows = _resolved(t).withColumn("inputs", judge_inputs(F.col("resolved.claims")))
    done = rows.withColumn(
        "v",
        verify_claims(F.col("resolved"), F.col("inputs"), judge.judge(F.col("inputs")), judge.id),
    )
    return done.select(
        "query_id", "v.verdict", "v.verifier_id", "v.cost_usd",
        F.aggregate(
            "v.claims", F.lit(0).cast("long"),
            lambda n, c: n + F.when(c["verified"], 1).otherwise(0).cast("long"),
        ).alias("n_verified"),
        F.aggregate(
            "v.claims", F.lit(0).cast("long"),
            lambda n, c: n + F.when(c["deterministic_ok"], 1).otherwise(0).cast("long"),
        ).alias("n_grounded"),
    )


@_register
def refusal_precedence(t: Tables) -> DataFrame:
    """Every mix of check outcomes the orders table can spell, most serious first."""
    claims = F.slice(F.array(*[F.lit(1)] * 7), F.lit(1), (F.col("o_custkey") % 3).cast("int"))
    resolved = F.struct(
        (F.col("o_orderstatus") != "P").alias("precheck_passed"), claims.alias("claims")
    )
    verdict = F.when(F.col("o_orderpriority") < "3", F.lit("supported")).otherwise(F.lit("unsupported"))
    rows = t.table("orders").select(
        answer_gate(resolved, F.struct(verdict.alias("verdict"))).alias("reason")
    )
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def _answers(t: Tables, skeptic: bool = False) -> DataFrame:
    judge = constant_verifier(False, 0.1, "not supported by the evidence") if skeptic else None
    return answer_retrieved(_arrays(t), mixed_generator(), judge)


@_register
def answer_or_refuse(t: Tables) -> DataFrame:
    """The whole flow: retrieve, gate, generate, resolve, verify, gate, record."""
    done = answer_queries(t.queries(), t.index, mixed_generator())
    return done.select(
        "request_id", "created_at", "query", "verdict", "refusal_reason", "answer", "message",
        F.array_join(F.transform("retrieved", lambda r: r["chunk_id"]), ",").alias("retrieved"),
        F.size("claims").cast("long").alias("n_claims"),
        F.col("verification.verdict").alias("verification"),
        "embedder_id", "generation_model", "verifier_id", "cost_usd", "latency_ms",
    )


@_register
def eval_summary(t: Tables) -> DataFrame:
    return answer_trace(_answers(t, skeptic=True))


# --- audit and export -------------------------------------------------------


@_register
def audit_list_page(t: Tables) -> DataFrame:
    page = log_ops.audit_list(
        t.audit_log(), limit=100, offset=25, verdict="answered",
        since="2024-01-02", until="2024-01-20", query_contains="RATE 100%_N",
    )
    return page.select("request_id", "created_at", "query", "verdict", "cost_usd", "latency_ms")


@_register
def audit_by_request(t: Tables) -> DataFrame:
    found = log_ops.audit_by_request(t.audit_log(), "req-00000042")
    return found.select("request_id", "created_at", "query", "verdict", "refusal_reason", "cost_usd")


@_register
def audit_filter_accession(t: Tables) -> DataFrame:
    log = t.audit_log().withColumn("retrieved", F.from_json("retrieved_json", AUDIT_RETRIEVED))
    kept = log_ops.audit_filter(log, accession="0000000008", query_contains="rate", until="2024-02-01")
    shown = log_ops.display_document(F.col("verdict"), F.col("retrieved"))
    return kept.select("request_id", "verdict", shown.alias("document"))


@_register
def audit_totals(t: Tables) -> DataFrame:
    totals = log_ops.audit_totals(t.audit_log())
    return totals.withColumn("total_cost_usd", F.round("total_cost_usd", 6))


@_register
def audit_duplicate_check(t: Tables) -> DataFrame:
    """Events as new requests against the log of orders with the same numbers."""
    incoming = t.table("events").select(
        F.concat(F.lit("req-"), F.when(F.col("event_id") % 11 == 0, 0).otherwise(F.col("event_id"))).alias(
            "request_id"
        )
    )
    log = t.table("orders").select(
        F.concat(F.lit("req-"), "o_orderkey").alias("request_id")
    )
    return log_ops.duplicate_requests(incoming, log)


@_register
def store_counts(t: Tables) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return (
        one(t.filings, "filings").union(one(t.chunks, "chunks")).union(one(t.audit_log(), "audit"))
    )


@_register
def filing_list(t: Tables) -> DataFrame:
    return list_filings(t.document_filings())


@_register
def chunks_by_filing(t: Tables) -> DataFrame:
    """Each filing's chunks with its text sliced back out of the canonical text."""
    chunks = t.chunks.select("accession", "start_offset", "end_offset", "chunk_id", "text")
    sliced = F.substring(
        F.col("canonical_text"), F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")
    )
    return (
        chunks.join(t.filings.select("accession", "company", "canonical_text"), "accession")
        .select(
            "accession", "company", *_long("start_offset", "end_offset"), "chunk_id",
            (sliced == F.col("text")).alias("exact"),
        )
        .orderBy("accession", "start_offset")
    )


@_register
def reingest_upsert(t: Tables) -> DataFrame:
    """Customers replaced by the suppliers that share their number."""
    stored = t.table("customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
    )
    incoming = t.table("supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return replace_by_key(stored, incoming, incoming, ["key"])


@_register
def snapshot_texts(t: Tables) -> DataFrame:
    cited = cited_accessions(_answers(t))
    return build_snapshot(t.filings, t.audit_log(), cited).texts


@_register
def snapshot_audit(t: Tables) -> DataFrame:
    page = build_snapshot(t.filings, t.audit_log()).audit
    return page.select("request_id", "created_at", "query", "verdict", "retrieved_json")


@_register
def snapshot_roundtrip(t: Tables) -> DataFrame:
    """The texts and the log of a snapshot that was written and read again."""
    log = t.audit_log().withColumn("retrieved", F.from_json("retrieved_json", AUDIT_RETRIEVED)).drop("retrieved_json")
    path = f"{scratch_dir(t.spark)}/snapshot-{uuid.uuid4().hex}"
    write_snapshot(build_snapshot(t.filings, log), path, "2026-06-12T12:00:00.000Z")
    found = read_snapshot(t.spark, path)
    stamp = F.lit(found.generated_at).alias("generated_at")
    texts = found.texts.select(stamp, F.lit("text").alias("part"), F.col("accession").alias("id"), F.col("canonical_text").alias("value"))
    audit = found.audit.select(stamp, F.lit("audit"), "request_id", F.get("retrieved", F.lit(0))["company"])
    return texts.union(audit)


@_register
def store_reingest(t: Tables) -> DataFrame:
    """Chunks and term counts per filing of a store into which every document was ingested, and
    every third one again: of those, the odd ones now without headings and so without chunks."""
    store = Store.create(t.spark, f"{scratch_dir(t.spark)}/store-{uuid.uuid4().hex}", 256, buckets=16)
    raw = t.document_filings().withColumn("html", F.concat(F.lit("<pre>"), _escaped("text"), F.lit("</pre>"))).drop("text")
    store.ingest(raw)
    number = F.col("accession").substr(1, 10).cast("long")
    again = raw.filter(number % 3 == 0)
    bare = F.when(number % 2 == 1, F.concat(F.lit("kelp "), F.col("cik"))).otherwise(F.lit("<p>Item 8. Kelp</p>kelp and more kelp"))
    store.ingest(again.withColumn("html", bare))
    kept = store.chunks().groupBy("accession").agg(F.count("*").alias("n_chunks"))
    # Measured before the join, which would shuffle the texts.
    length = F.when(number % 3 == 0, F.length("canonical_text").cast("long"))
    measured = store.filings().select("accession", length.alias("length"))
    found = measured.join(kept, "accession", "left").select(
        "accession", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"), "length"
    )
    kelp = store.index().frequency.filter("term = 'kelp'").agg(F.coalesce(F.sum("df"), F.lit(0).cast("long")).alias("n"))
    return found.unionByName(kelp.select(F.lit("kelp").alias("accession"), F.col("n").alias("n_chunks"), F.lit(None).cast("long").alias("length")))


def _escaped(text: str) -> Column:
    return F.replace(F.replace(F.col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


@_register
def highlight_spans(t: Tables) -> DataFrame:
    """Every redaction of every filing in its surroundings."""
    shown = F.transform(
        "redactions",
        lambda h: F.struct(
            h["start"].alias("start"), highlight_span(F.col("canonical_text"), h["start"], h["end"]).alias("s")
        ),
    )
    # Cut before the explode, so that no row but the filing's carries the text.
    hits = t.filings.select("accession", F.explode(shown).alias("h"))
    return hits.select("accession", *_long("h.start"), "h.s.*")


@_register
def citation_context(t: Tables) -> DataFrame:
    """Every resolved citation of every answer in its surroundings."""
    shown = citation_contexts(_answers(t), t.filings)
    return shown.select(
        "request_id", *_long("claim_no", "cite_no", "start_offset", "end_offset"),
        "accession", "company", "section_label", "shown.*",
    )


@_register
def recent_filings_filter(t: Tables) -> DataFrame:
    """A company listing per customer, as the parallel arrays such listings hold."""
    n = F.col("c_custkey")
    number = lambda i: F.concat(
        F.lpad(n.cast("string"), 10, "0"), F.lit(f"-24-00000{i}")
    )
    document = F.when(n % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("d"), n.cast("string"), F.lit(".htm")))
    recent = F.struct(
        F.array(F.lit("10-K"), F.lit("8-K"), F.lit("10-Q"), F.lit("10-K/A")).alias("form"),
        F.array(*[number(i) for i in range(4)]).alias("accessionNumber"),
        F.array(*[F.lit(f"2024-0{i + 1}-15") for i in range(4)]).alias("filingDate"),
        F.array(F.lit("a.htm"), F.lit("b.htm"), document, F.lit("c.htm")).alias("primaryDocument"),
    )
    listing = F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings")))
    entries = t.table("customer").select("c_custkey", F.inline(recent_filings(listing)))
    return entries.select("c_custkey", "form", "accession", "filing_date", "primary_document")


@_register
def document_urls(t: Tables) -> DataFrame:
    return t.document_filings().select(
        "accession",
        document_url(F.col("cik"), F.col("accession"), F.lit("main.htm")).alias("url"),
        listing_url(F.regexp_replace("cik", "^0+", "")).alias("listing"),
    )
