"""Latency-optimised answering: gates, cache, retrieval, evidence, one model call, guards.

Every exit is a value in the row: each stage only works on the rows still open, and the
closed ones are united at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.budgets import output_token_budget, prompt_token_budget, shrink_budgets
from quarry.functions.prompts import PLAIN_SYSTEM, plain_prompt
from quarry.functions.text import abstained, cache_key, normalize_query
from quarry.operators.answers import extractive_answer, normalize_reply
from quarry.operators.context import dedup_and_budget, focus_hits, prepare_context, render_compact, with_source_ids
from quarry.operators.gates import assess_evidence, dangling_reference, hit_lists, query_gates, retrieval_tie
from quarry.operators.guards import (
    allowed_ids, assess_grounding, format_issues, hard_format_issues, relevance_issues, resolve_sources,
)
from quarry.operators.indexing import Snapshot
from quarry.operators.model import Provider, estimate_tokens, with_reply
from quarry.operators.retrieval import search
from quarry.rules import russian as ru
from quarry.session import materialize
from quarry.settings import Settings

SOURCES = (
    "array<struct<source_id:string,doc_id:string,chunk_id:string,title:string,section:string,url:string,score:double>>"
)
RESULT = [
    "qid", "query", "answer", "sources", "status", "route_type", "retrieval_attempts", "generation_attempts",
    "rewritten_queries", "exit_stage", "diagnostics",
]


def strings(*values: Column) -> Column:
    return F.array_compact(F.array(*values)) if values else F.array().cast("array<string>")


def result(
    df: DataFrame, *, answer: Column, status: Column | str, stage: Column | str, retrievals: int, generations: Column | int,
    sources: Column | None = None, diagnostics: Column | None = None, route: Column | str = "naive",
    rewrites: Column | None = None,
) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select(
        "qid", "query", answer.alias("answer"),
        (sources if sources is not None else F.array()).cast(SOURCES).alias("sources"),
        lit(status).alias("status"), lit(route).alias("route_type"),
        lit(retrievals).cast("int").alias("retrieval_attempts"),
        lit(generations).cast("int").alias("generation_attempts"),
        (rewrites if rewrites is not None else F.array()).cast("array<string>").alias("rewritten_queries"),
        lit(stage).alias("exit_stage"),
        (diagnostics if diagnostics is not None else F.array()).cast("array<string>").alias("diagnostics"),
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- answer cache ----------------------------------------------------------------------


def cached_answers(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Hits of the cache table (keyed by normalised query, top_k and section)."""
    keyed = asked.withColumn("cache_key", cache_key(F.col("query")))
    return keyed.join(cache.drop("qid", "query", "used_at"), ["cache_key", "top_k", "section_id"])


def cache_rows(results: DataFrame, asked: DataFrame, s: Settings) -> DataFrame:
    """Successful model answers in cache shape; extractive fallbacks are never cached."""
    good = results.filter("status = 'success' AND exit_stage = 'answer'")
    keys = asked.select(
        "qid", cache_key(F.col("query")).alias("cache_key"), "top_k", "section_id", F.current_timestamp().alias("used_at")
    )
    return good.join(keys, "qid")


def evict(cache: DataFrame, s: Settings) -> DataFrame:
    """Keep the most recently used entries: a bounded top-k, not a sort of the table."""
    return cache.orderBy(F.desc("used_at"), "cache_key").limit(s.answer_cache_size)


# --- the plan ------------------------------------------------------------------------------


def _fit(ctx: DataFrame, s: Settings) -> DataFrame:
    """Up to three prompt-fitting steps: shrink the budgets of prompts that are too long."""
    tps, dps = F.lit(s.initial_prompt_tps), F.lit(s.initial_decode_tps)
    budget = F.lit(s.response_budget_seconds)
    target = prompt_token_budget(F.col("profile.tokens"), budget, tps, dps, s)
    df = ctx.withColumn("_target", target)
    for _ in range(3):
        used = estimate_tokens(F.concat(F.lit(PLAIN_SYSTEM), plain_prompt(F.col("query"), render_compact(F.col("context")))))
        df = df.withColumn("_used", used)
        long_ = df.filter("_used > _target")
        p = F.col("profile")
        fit = shrink_budgets(p["context"], p["passage"], p["chunks"], F.col("_target"), F.col("_used"))
        long_ = long_.withColumn("_fit", fit).withColumn(
            "profile",
            F.struct(
                p["name"].alias("name"), p["tokens"].alias("tokens"), F.col("_fit.passage").alias("passage"),
                F.col("_fit.context").alias("context"), F.col("_fit.chunks").alias("chunks"),
            ),
        )
        long_ = focus_hits(long_, s).withColumn(
            "context",
            with_source_ids(
                dedup_and_budget(F.col("passages"), F.col("profile.context"), F.col("profile.chunks"), s)
            ),
        ).drop("passages", "_fit")
        df = materialize(df.filter("_used <= _target").unionByName(long_), "fit")
    return df.withColumn(
        "token_limit", output_token_budget(F.col("profile.tokens"), budget, F.col("_used"), tps, dps, s)
    ).drop("_target", "_used")


def answer_queries(
    snap: Snapshot, queries: DataFrame, provider: Provider | None, cache: DataFrame | None = None
) -> DataFrame:
    """queries(qid, query, top_k, section_id) -> one result row per query."""
    s = snap.settings
    done: list[DataFrame] = []
    gated = materialize(query_gates(queries, s), "gated")
    q = F.col("query")
    done.append(
        result(gated.filter("gate_direct IS NOT NULL"), answer=F.col("gate_direct_answer"), status="success",
               stage="direct", retrievals=0, generations=0,
               diagnostics=strings(F.concat(F.lit("query_gate="), F.col("gate_direct")))))
    open_ = gated.filter("gate_direct IS NULL")
    done.append(
        result(open_.filter("gate_external IS NOT NULL"), answer=F.lit(ru.MSG_EXTERNAL), status="insufficient_context",
               stage="external", retrievals=0, generations=0,
               diagnostics=strings(F.concat(F.lit("query_gate="), F.col("gate_external")))))
    open_ = open_.filter("gate_external IS NULL")
    done.append(
        result(open_.filter("gate_clarify IS NOT NULL"), answer=F.col("gate_clarify"), status="insufficient_context",
               stage="underspecified", retrievals=0, generations=0,
               diagnostics=strings(F.lit("query_gate=underspecified"))))
    open_ = open_.filter("gate_clarify IS NULL").select("qid", "query", "top_k", "section_id")
    if cache is not None and s.answer_cache_size > 0:
        hit = materialize(
            cached_answers(open_, cache).withColumns(
                {"exit_stage": F.lit("cache"),
                 "diagnostics": F.array_append("diagnostics", F.lit("answer_cache_hit"))}
            ).select(*RESULT),
            "cache",
        )
        done.append(hit)
        open_ = open_.join(hit.select("qid"), "qid", "left_anti")

    asked = open_.withColumn("retrieval_query", normalize_query(q))
    k = max(s.naive_context_top_k, s.optimized_retrieval_top_k)
    hits = search(
        snap,
        asked.select("qid", F.col("retrieval_query").alias("query"),
                     F.greatest("top_k", F.lit(k)).alias("top_k"), "section_id"),
    )
    found = materialize(
        assess_evidence(asked.join(hit_lists(hits), "qid", "left"), s, "retrieval_query"), "found"
    )
    none = found.filter("hits IS NULL")
    done.append(result(none, answer=F.lit(ru.MSG_NOTHING_FOUND), status="insufficient_context", stage="no_hits",
                       retrievals=1, generations=0))
    found = found.filter("hits IS NOT NULL")
    e = F.col("evidence")
    notes = strings(
        F.concat(F.lit("evidence_gate="), e["level"]),
        F.format_string("evidence_score=%.3f", e["score"]),
        F.concat(F.lit("evidence_reason="), e["reason"]),
    )
    judged = found.withColumns(
        {
            "notes": notes if s.quality_gate_enabled else F.array().cast("array<string>"),
            "level": e["level"] if s.quality_gate_enabled else F.lit("strong"),
            "tie": retrieval_tie(F.col("retrieval_query"), F.col("hits")),
            "dangling": dangling_reference(q, F.col("hits")),
        }
    )
    n = F.col("notes")
    done.append(result(judged.filter("level = 'weak'"), answer=F.lit(ru.MSG_WEAK), status="insufficient_context",
                       stage="weak_evidence", retrievals=1, generations=0, diagnostics=n))
    judged = judged.filter("level <> 'weak'")
    done.append(result(judged.filter("tie"), answer=F.lit(ru.MSG_CLARIFY_TIE), status="insufficient_context",
                       stage="retrieval_ambiguity", retrievals=1, generations=0,
                       diagnostics=F.array_append(n, F.lit("query_gate=retrieval_ambiguity"))))
    done.append(result(judged.filter("NOT tie AND dangling"), answer=F.lit(ru.MSG_CLARIFY_REFERENCE),
                       status="insufficient_context", stage="ambiguous_reference", retrievals=1, generations=0,
                       diagnostics=F.array_append(n, F.lit("clarification_required_ambiguous_reference"))))
    ctx = materialize(prepare_context(judged.filter("NOT tie AND NOT dangling"), s), "context")

    if provider is None:
        fallback = ctx.withColumns({"fail": F.lit("llm_skipped_deadline_or_capability"), "attempts": F.lit(0)})
    else:
        answered, fallback = _generate(_fit(ctx, s), provider, s, done)
        done.append(answered)
    done.append(_extract(fallback, s))
    return union_all([d.select(*RESULT) for d in done])


def _generate(
    ctx: DataFrame, provider: Provider, s: Settings, done: list[DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(answered rows, rows that need the extractive fallback)."""
    prompt = plain_prompt(F.col("query"), render_compact(F.col("context")))
    asked = materialize(
        with_reply(ctx, "reply", provider, PLAIN_SYSTEM, prompt, F.col("token_limit"), s), "replies"
    )
    ok = asked.filter("reply.status = 'ok'")
    quit_ = abstained(F.col("reply.text"))
    done.append(result(ok.filter(quit_), answer=F.lit(ru.MSG_INSUFFICIENT), status="insufficient_context",
                       stage="abstained", retrievals=1, generations=1,
                       diagnostics=F.array_append("notes", F.lit("llm_explicit_abstention"))))
    strong = F.col("level") == "strong"
    g = ok.filter(~quit_).withColumn(
        "gen",
        normalize_reply(F.col("reply.text"), F.col("query"), F.col("context"), F.col("reply.truncated"), strong),
    ).withColumn("answer", F.col("gen.answer"))
    g = materialize(g, "generated")
    grounded = assess_grounding(g, s.grounding_min_claim_coverage)
    issues = format_issues(F.col("answer"), F.col("gen.used_source_ids"), F.col("gen.insufficient_context"),
                           allowed_ids(F.col("context")))
    g = g.join(grounded, "qid").withColumns(
        {"hard": hard_format_issues(issues), "off_topic": relevance_issues(F.col("query"), F.col("answer"))}
    )
    fail = F.when(F.size("gen.used_source_ids") == 0, "llm_answer_without_sources").when(
        F.size("hard") > 0, "format_guard_extractive_fallback"
    )
    if s.grounding_guard_enabled:
        fail = fail.when(~F.col("grounding.valid"), "grounding_guard_extractive_fallback")
    if s.relevance_guard_enabled:
        fail = fail.when(F.size("off_topic") > 0, "answer_relevance_extractive_fallback")
    g = materialize(g.withColumns({"fail": fail, "attempts": F.lit(1)}), "guarded")
    good = g.filter("fail IS NULL")
    answered = result(good, answer=F.col("answer"), status="success", stage="answer", retrievals=1, generations=1,
                      sources=resolve_sources(F.col("answer"), F.col("context")), diagnostics=F.col("notes"))
    broken = asked.filter("reply.status <> 'ok'").withColumns(
        {
            "fail": F.when(F.col("reply.status") == "timeout", "llm_timeout_extractive_fallback").otherwise(
                "llm_error_extractive_fallback"),
            "attempts": F.lit(1),
        }
    )
    keep = ["qid", "query", "context", "profile", "_qroots", "_acronyms", "_qnorm", "level", "notes", "fail", "attempts"]
    bad = g.filter("fail IS NOT NULL").select(*keep).unionByName(broken.select(*keep))
    if not s.extractive_fallback_enabled:
        done.append(result(bad, answer=F.lit(ru.MSG_INSUFFICIENT), status="insufficient_context", stage="guard",
                           retrievals=1, generations=1, diagnostics=F.array_append("notes", F.col("fail"))))
        bad = bad.limit(0)
    return answered, bad


def _extract(rows: DataFrame, s: Settings) -> DataFrame:
    """Deterministic fallback: accepted only on strong evidence, confidence and relevance."""
    limit = F.when(F.col("profile.name") == "fact", 1).otherwise(2)
    x = rows.join(extractive_answer(rows, limit), "qid")
    text = F.col("extractive.answer")
    strong = (F.col("level") == "strong") | F.lit(not s.quality_gate_enabled)
    good = strong & (text != "") & (F.col("extractive.confidence") >= s.extractive_min_score) & (
        F.size(relevance_issues(F.col("query"), text)) == 0
    )
    notes = F.concat(
        "notes", F.array("fail"),
        strings(F.when(good, F.format_string("extractive_confidence=%.3f", F.col("extractive.confidence")))),
    )
    return result(
        x, answer=F.when(good, text).otherwise(ru.MSG_INSUFFICIENT),
        status=F.when(good, "success").otherwise("insufficient_context"),
        stage=F.when(good, "extractive").otherwise("extractive_rejected"),
        retrievals=1, generations=F.col("attempts"),
        sources=F.when(good, resolve_sources(text, F.col("context")).cast(SOURCES)).otherwise(F.array().cast(SOURCES)),
        diagnostics=notes,
    )
