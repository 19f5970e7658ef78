"""Enrichment of findings from model responses: a table of recorded ones, or providers that are asked tier by tier."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherlake.functions.enrichment import nist_reference, response_fields, response_object, should_recommend_hybrid, user_prompt, valid_response, web_context
from cipherlake.functions.redaction import sanitize_text
from cipherlake.functions.text import strip
from cipherlake.operators.findings import RECOMMENDATION, complete, is_enriched
from cipherlake.shipping import ship_package
from cipherlake.sources.scratch import saved

#: Takes a prompt, gives a response's text or null; what it raises counts as no response.
Provider = Callable[[str], str | None]


def prompts(findings: DataFrame, live: Column | None = None) -> DataFrame:
    """Adds web_context and prompt; `live` is a page's excerpt, used if it is long enough. Snippets are sanitized before
    they go into a prompt."""
    out = findings.withColumn("web_context", web_context(F.col("algorithm_detected"), live))
    snippet = sanitize_text(F.col("code_snippet"))
    return out.withColumn("prompt", user_prompt(F.col("algorithm_detected"), F.col("language"), F.col("file_path"), F.col("line_number"), snippet, F.col("web_context")))


def ask(prompted: DataFrame, key: str, provider: Provider, tier: int, pool: int = 8) -> DataFrame:
    """(key, tier, raw) of (key, prompt): one call a row, at most `pool` at a time in each task."""

    def call(prompt: str | None) -> str | None:
        try:
            return None if prompt is None else provider(prompt)
        except Exception:  # a provider's failure is the next tier's turn
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(pool) as threads:
            for batch in batches:
                raw = list(threads.map(call, batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.string())], names=[key, "raw"])

    ship_package(prompted.sparkSession)
    answered = prompted.select(key, "prompt").mapInArrow(run, f"`{key}` {dict(prompted.dtypes)[key]}, raw string")
    return answered.select(key, F.lit(tier).alias("tier"), "raw")


def ask_tiers(prompted: DataFrame, key: str, providers: Sequence[Provider], pool: int = 8) -> DataFrame:
    """(key, tier, raw) of all calls that it took: a tier is asked only what no tier before it has answered validly.

    Each tier's answers are written before they are judged: no later step asks again, and a lost executor repeats the
    calls of its unfinished tasks only. Keys are unique.
    """
    todo, answers = prompted.select(key, "prompt"), None
    for tier, provider in enumerate(providers, 1):
        given = saved(ask(todo, key, provider, tier, pool), "answers")
        answers = given if answers is None else answers.unionByName(given)
        if tier < len(providers):
            todo = saved(todo.join(first_valid(given, key).select(key), key, "left_anti"), "unanswered")
            if todo.isEmpty():
                break
    if answers is None:
        raise ValueError("no providers")
    return answers


def enrich(findings: DataFrame, key: str, providers: Sequence[Provider], pool: int = 8) -> DataFrame:
    """Findings with what the first tier with a valid response says; blank snippets are sent to none."""
    asked = prompts(findings.where(strip(F.col("code_snippet")) != ""))
    return apply_responses(findings, ask_tiers(asked, key, providers, pool), key)


def first_valid(responses: DataFrame, key: str) -> DataFrame:
    """(key, tier, usage_context, pqc_replacement, migration_complexity, reasoning) of the first tier with a valid response."""
    # Invalid responses are passed over by their null order, not by a filter: a filter would be pushed below the
    # parsed columns and parse twice.
    text = responses.withColumn("text", response_object(F.col("raw"))).select(key, "tier", "text")
    parsed = text.select(key, "tier", response_fields(F.col("text")).alias("parsed"))
    best = parsed.groupBy(key).agg(F.min_by(F.struct("tier", "parsed"), F.when(valid_response(F.col("parsed")), F.col("tier"))).alias("best"))
    best = best.where("best IS NOT NULL")
    fields = [F.col(f"best.parsed.{k}").alias(k) for k in ("usage_context", "pqc_replacement", "reasoning")]
    return best.select(key, F.col("best.tier").alias("tier"), *fields, F.upper(strip(F.col("best.parsed.migration_complexity"))).alias("migration_complexity"))


def apply_responses(findings: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Findings with what their first valid response says; without one they stay as they are, blank snippets always."""
    best = first_valid(responses, key).select(key, *[F.col(c).alias(f"_{c}") for c in ("tier", "usage_context", "pqc_replacement", "migration_complexity", "reasoning")])
    joined = complete(findings).join(best, key, "left")
    hit = F.col("_tier").isNotNull() & (strip(F.col("code_snippet")) != "")
    recommendation = F.struct(
        F.col("_pqc_replacement").alias("primary_algorithm"),
        should_recommend_hybrid(F.col("_pqc_replacement"), F.col("_migration_complexity")).alias("hybrid_transition_recommended"),
        F.col("_reasoning").alias("migration_notes"),
        nist_reference(F.col("_pqc_replacement")).alias("nist_reference"),
    ).cast(RECOMMENDATION)
    new = {
        "usage_context": F.when(hit, F.col("_usage_context")).otherwise(F.col("usage_context")),
        "pqc_replacement": F.when(hit, F.col("_pqc_replacement")).otherwise(F.col("pqc_replacement")),
        "migration_complexity": F.when(hit, F.col("_migration_complexity")).otherwise(F.col("migration_complexity")),
        "pqc_recommendation": F.when(hit, recommendation).otherwise(F.col("pqc_recommendation")),
    }
    return joined.withColumns(new).drop("_tier", "_usage_context", "_pqc_replacement", "_migration_complexity", "_reasoning")


def enrichment_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """How an enrichment pass went: attempted, enriched, failed, and success_rate in percent (one decimal; 0 without findings)."""
    n, good = F.count(F.lit(1)), F.count_if(is_enriched())
    rate = F.when(n == 0, F.lit(0.0)).otherwise(F.bround(F.lit(100.0) * good / n, 1))
    return complete(findings).groupBy(*keys).agg(n.alias("attempted"), good.alias("enriched"), (n - good).alias("failed"), rate.alias("success_rate"))
