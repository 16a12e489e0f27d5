"""Answer or refuse: one row in per query, one audit row out per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from citewright.functions.citations import (
    ScriptedVerifier,
    Verifier,
    judge_inputs,
    resolve_citations,
    verify_claims,
)
from citewright.functions.embed import Embedder, HashEmbedder
from citewright.functions.generation import Generator, grounded_generator
from citewright.functions.pii import redact_pii
from citewright.operators.keyword import Index
from citewright.plans.retrieve import RetrieveOptions, hybrid_retrieve, retrieved_array
from citewright.session import materialise

# The least fused score to go on with, and what a refusal says.
MIN_TOP_RRF = 0.02
REFUSAL_MESSAGE = "This question is not supported by the available corpus."

SUMMARY = (
    "chunk_id", "company", "accession", "section_id", "section_label",
    "rrf", "vector_rank", "keyword_rank", "vector_distance",
)


def top_rrf(retrieved: Column) -> Column:
    best = F.array_max(F.transform(retrieved, lambda c: c["rrf"]))
    return F.coalesce(best, F.lit(0.0))


def retrieval_gate(retrieved: Column, min_top_rrf: float = MIN_TOP_RRF) -> Column:
    """Why retrieval is too weak to go on, or null."""
    return F.when(F.size(retrieved) == 0, F.lit("no_retrieval")).when(
        top_rrf(retrieved) < min_top_rrf, F.lit("low_retrieval_score")
    )


def answer_gate(resolved: Column, verification: Column) -> Column:
    """Why an answer is withheld, most serious reason first, or null."""
    return (
        F.when(~resolved["precheck_passed"], F.lit("citation_precheck_failed"))
        .when(F.size(resolved["claims"]) == 0, F.lit("no_claims"))
        .when(verification["verdict"] == "unsupported", F.lit("unverified_claims"))
    )


def answer_retrieved(
    rows: DataFrame,
    generator: Generator | None = None,
    verifier: Verifier | None = None,
    embedder_id: str | None = None,
    min_top_rrf: float = MIN_TOP_RRF,
) -> DataFrame:
    """Decide each query of ``query_id, query, created_at, retrieved``.

    The gates are columns: a query that the first one refuses hands a null to the
    generator, so it is neither generated nor judged and still keeps its row.
    Model replies are written once before anything reads them twice.
    """
    gen = generator or grounded_generator()
    ver = verifier or ScriptedVerifier()
    gated = rows.withColumn("gate", retrieval_gate(F.col("retrieved"), min_top_rrf))
    asked = F.when(F.col("gate").isNull(), F.col("query"))
    generated = gated.withColumn("generated", gen.generate(asked, F.col("retrieved")))
    if gen.remote:
        generated = materialise(generated, "generated")
    resolved = generated.withColumn(
        "resolved", resolve_citations(F.col("generated.generation"), F.col("retrieved"))
    ).withColumn("inputs", judge_inputs(F.col("resolved.claims")))
    judged = resolved.withColumn("verdicts", ver.judge(F.col("inputs")))
    if ver.remote:
        judged = materialise(judged, "judged")
    decided = judged.withColumn(
        "verification",
        verify_claims(F.col("resolved"), F.col("inputs"), F.col("verdicts"), ver.id),
    ).withColumn(
        "refusal_reason",
        F.coalesce("gate", answer_gate(F.col("resolved"), F.col("verification"))),
    )
    refused = F.col("refusal_reason").isNotNull()
    went_on = F.col("gate").isNull()
    answer = F.when(~refused, F.col("resolved.answer"))
    spent = F.col("generated.usage.cost_usd") + F.col("verification.cost_usd")
    return decided.select(
        F.col("query_id").cast("string").alias("request_id"),
        "created_at",
        redact_pii(F.col("query"))["text"].alias("query"),
        F.when(refused, F.lit("refused")).otherwise(F.lit("answered")).alias("verdict"),
        "refusal_reason",
        answer.alias("answer"),
        F.coalesce(answer, F.lit(REFUSAL_MESSAGE)).alias("message"),
        F.transform(
            "retrieved", lambda c: F.struct(*[c[name].alias(name) for name in SUMMARY])
        ).alias("retrieved"),
        F.col("resolved.claims").alias("claims"),
        "verification",
        F.lit(embedder_id or HashEmbedder().id).alias("embedder_id"),
        F.when(went_on, F.lit(gen.id)).alias("generation_model"),
        F.col("verification.verifier_id").alias("verifier_id"),
        F.coalesce(spent, F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.col("generated.usage.latency_ms"), F.lit(0).cast("long")).alias("latency_ms"),
    )


def answer_queries(
    queries: DataFrame,
    index: Index,
    generator: Generator | None = None,
    verifier: Verifier | None = None,
    embedder: Embedder | None = None,
    options: RetrieveOptions | None = None,
    min_top_rrf: float = MIN_TOP_RRF,
) -> DataFrame:
    """The whole flow for ``query_id, query, created_at``; see ``answer_retrieved``."""
    emb = embedder or HashEmbedder()
    retrieved = hybrid_retrieve(queries, index, emb, options)
    rows = retrieved_array(queries, retrieved)
    return answer_retrieved(rows, generator, verifier, emb.id, min_top_rrf)


def observed(answers: DataFrame, observation: Observation) -> DataFrame:
    """``answers`` with its counts and cost recorded while it is computed."""
    best = F.array_max(F.transform("retrieved", lambda r: r["rrf"]))
    return answers.observe(
        observation,
        F.count("*").alias("queries"),
        F.count_if(F.col("verdict") == "answered").alias("answered"),
        F.count_if(F.col("verdict") == "refused").alias("refused"),
        F.sum(F.size("retrieved")).alias("retrieved_count"),
        F.max(best).alias("top_rrf"),
        F.sum(F.coalesce(F.size("claims"), F.lit(0))).alias("claim_count"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def cassettes(answers: DataFrame, recorded_at: str) -> DataFrame:
    """``case_id, value``: each answer's summary, steps and cost as one JSON text.

    Latency is a constant, so that recording twice gives the same text.
    """
    flat = answer_trace(answers)
    output = F.struct(
        "verdict",
        F.col("refusal_reason").alias("refusalReason"),
        F.col("answer_present").alias("answerPresent"),
        F.col("claim_count").alias("claimCount"),
        F.col("all_claims_supported").alias("allClaimsSupported"),
        F.col("citations_resolved").alias("citationsResolved"),
        F.col("verification_verdict").alias("verificationVerdict"),
        "company",
    )
    steps = F.transform(
        F.split("trace", ","),
        lambda name: F.struct(F.lit("tool_call").alias("type"), F.struct(name.alias("name")).alias("call")),
    )
    metrics = F.struct(F.lit(1).alias("latencyMs"), F.col("cost_usd").alias("costUsd"), "steps")
    body = F.struct(
        F.lit(1).alias("version"),
        F.col("case_id").alias("caseId"),
        F.lit(recorded_at).alias("recordedAt"),
        F.struct(output.alias("output"), steps.alias("trace"), metrics.alias("metrics")).alias("result"),
    )
    text = F.to_json(body, {"ignoreNullFields": "false", "pretty": "true"})
    return flat.select("case_id", text.alias("value"))


def answer_trace(answers: DataFrame) -> DataFrame:
    """A flat summary of each answer and the steps that ran for it."""
    claims = F.coalesce("claims", F.array().cast(answers.schema["claims"].dataType))
    some = F.size(claims) > 0
    steps = F.when(
        F.coalesce(F.col("refusal_reason") == "low_retrieval_score", F.lit(False)),
        F.array(F.lit("retrieve")),
    ).otherwise(F.array(F.lit("retrieve"), F.lit("generate"), F.lit("verify")))
    return answers.select(
        F.col("request_id").alias("case_id"),
        "verdict",
        "refusal_reason",
        (F.col("verdict") == "answered").alias("answer_present"),
        F.size(claims).cast("long").alias("claim_count"),
        (some & F.forall(claims, lambda c: c["supported"])).alias("all_claims_supported"),
        (
            some
            & F.forall(
                claims,
                lambda c: F.exists(c["citations"], lambda x: x["chunk_found"] & x["quote_found"]),
            )
        ).alias("citations_resolved"),
        F.col("verification.verdict").alias("verification_verdict"),
        F.get("retrieved", F.lit(0))["company"].alias("company"),
        F.array_join(steps, ",").alias("trace"),
        F.size(steps).cast("long").alias("steps"),
        "cost_usd",
    )
