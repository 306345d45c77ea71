"""Corrective answering: at most two retrievals and two generations, unrolled into a static DAG.

Rows carry their own state (context, route, attempts, rewrites, diagnostics).  Each round
splits the open rows by the model's verdict; closed rows become results at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.prompts import (
    FAST_SYSTEM, GENERATOR_SYSTEM, GRADER_SYSTEM, VALIDATOR_SYSTEM, generator_prompt, source_prompt, validator_prompt,
)
from quarry.operators.answers import normalize_generated
from quarry.operators.context import render_compact, render_full, with_source_ids
from quarry.operators.contracts import ANSWER, EVALUATION, FAST, GRADE, check_answer, check_fast, check_grade, parse
from quarry.operators.gates import hit_lists
from quarry.operators.guards import allowed_ids, format_issues, resolve_sources, semantic_issues
from quarry.operators.indexing import Snapshot
from quarry.operators.model import Provider, with_reply
from quarry.operators.passages import select_passages
from quarry.operators.retrieval import search
from quarry.operators.rewrites import clean_rewrites, filter_rewrites
from quarry.plans.latency import RESULT, result, strings, union_all
from quarry.rules import russian as ru
from quarry.session import materialize
from quarry.settings import Settings

FAST_TOKENS_KEY = "naive_max_tokens"
GRADE_TOKENS, GENERATE_TOKENS, VALIDATE_TOKENS = 260, 350, 260
STATE = ["qid", "query", "top_k", "section_id", "full", "context", "route", "retrievals", "generations", "rewrites", "notes"]


def _close(df: DataFrame, answer: Column | str, status: Column | str, stage: str, notes: Column | None = None,
           sources: Column | None = None) -> DataFrame:
    return result(
        df, answer=answer if isinstance(answer, Column) else F.lit(answer), status=status, stage=stage,
        retrievals=F.col("retrievals"), generations=F.col("generations"), route=F.col("route"),
        rewrites=F.col("rewrites"), diagnostics=notes if notes is not None else F.col("notes"), sources=sources,
    ).select(*RESULT)


def _context(df: DataFrame, s: Settings, scorer=None) -> DataFrame:
    """`full`: S-numbered hits; `context`: the distinct non-blank ones handed to the model."""
    df = df.withColumn("full", with_source_ids(F.col("hits")))
    keys = F.transform("full", lambda c: F.struct(c["doc_id"], c["chunk_id"]))
    kept = F.filter(
        "full",
        lambda c, i: (F.array_position(keys, F.struct(c["doc_id"], c["chunk_id"])) == i + 1) & (F.trim(c["text"]) != ""),
    )
    df = df.withColumn("context", F.slice(kept, F.lit(1), F.least(F.lit(s.naive_context_top_k), F.col("top_k"))))
    if not s.passage_selection_enabled:
        return df
    if scorer is None:
        raise ValueError("passage selection is enabled but no scorer was given")
    rows = df.select("qid", "query", F.posexplode("context").alias("rank", "c")).select("qid", "query", "rank", "c.*")
    best = select_passages(rows, scorer, s.passage_window_chars, s.passage_overlap_chars)
    fields = ["source_id", "idx", "doc_id", "chunk_id", "title", "section", "url", "text", "score", "lexical_coverage"]
    packed = best.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("c")))).alias("p")
    ).select("qid", F.transform("p", lambda e: e["c"]).alias("context"))
    return df.drop("context").join(packed, "qid", "left").withColumn("context", F.coalesce("context", F.filter("full", lambda _: F.lit(False))))


def _ids(df_context: Column) -> Column:
    return allowed_ids(df_context)


def _fast(rows: DataFrame, provider: Provider, s: Settings, name: str) -> DataFrame:
    """Adds `verdict`: answer | corrective | invalid | unavailable, and the parsed reply `r`."""
    prompt = source_prompt(F.col("query"), render_compact(F.col("context")), _ids(F.col("context")))
    df = with_reply(rows, "reply", provider, FAST_SYSTEM, prompt, F.lit(s.naive_max_tokens), s)
    df = df.withColumn("r", parse(F.col("reply.text"), FAST))
    unknown = F.size(F.array_except("r.used_source_ids", _ids(F.col("context")))) > 0
    bad = F.col("r").isNull() | check_fast(F.col("r")).isNotNull() | unknown
    verdict = (
        F.when(F.col("reply.status").isin("timeout", "unavailable"), "unavailable")
        .when(bad, "invalid").otherwise(F.col("r.decision"))
    )
    return materialize(df.withColumn("verdict", verdict), name)


def _answered(df: DataFrame) -> DataFrame:
    """Rows whose fast reply answers: normalised answer over the cited passages."""
    gen = normalize_generated(F.trim("r.answer"), F.array_distinct("r.used_source_ids"), F.lit(False), F.col("context"))
    return df.filter("verdict = 'answer'").withColumns({"gen": gen, "generations": F.col("generations") + 1}).withColumn(
        "used", F.filter("context", lambda c: F.array_contains(F.col("gen.used_source_ids"), c["source_id"]))
    ).withColumn("by_fast", F.lit(True))


def _grade(rows: DataFrame, provider: Provider, s: Settings, name: str) -> DataFrame:
    """Adds `verdict`: sufficient | retry | invalid | unavailable and the graded reply `r`."""
    prompt = source_prompt(F.col("query"), render_full(F.col("full")), _ids(F.col("full")))
    df = with_reply(rows.drop("reply", "r", "verdict"), "reply", provider, GRADER_SYSTEM, prompt, F.lit(GRADE_TOKENS), s)
    df = df.withColumn("r", parse(F.col("reply.text"), GRADE))
    bad = F.col("r").isNull() | check_grade(F.col("r"), _ids(F.col("full"))).isNotNull()
    verdict = (
        F.when(F.col("reply.status").isin("timeout", "unavailable"), "unavailable")
        .when(bad, "invalid").when(F.col("r.decision") == "sufficient", "sufficient").otherwise("retry")
    )
    return materialize(df.withColumn("verdict", verdict), name)


def _generate(rows: DataFrame, provider: Provider, s: Settings, name: str, feedback: Column) -> DataFrame:
    """One generation over `used`; adds `gen` (null when invalid) and `reply`."""
    prompt = generator_prompt(F.col("query"), render_full(F.col("used")), _ids(F.col("used")), feedback)
    df = with_reply(rows.drop("reply", "r", "verdict"), "reply", provider, GENERATOR_SYSTEM, prompt, F.lit(GENERATE_TOKENS), s)
    r = parse(F.col("reply.text"), ANSWER)
    df = df.withColumn("r", r).withColumn("generations", F.col("generations") + 1)
    ok = F.col("r").isNotNull() & check_answer(F.col("r.answer"), F.array_distinct("r.used_source_ids"), F.col("r.insufficient_context")).isNull()
    gen = normalize_generated(F.col("r.answer"), F.array_distinct("r.used_source_ids"), F.col("r.insufficient_context"), F.col("used"))
    return materialize(df.withColumn("gen", F.when(ok, gen)).withColumn("by_fast", F.lit(False)), name)


def _errors(df: DataFrame, done: list[DataFrame]) -> None:
    """Close rows whose verdict is a model failure."""
    done.append(_close(df.filter("verdict = 'unavailable'"), ru.MSG_UNAVAILABLE, "service_unavailable", "unavailable"))
    done.append(
        _close(df.filter("verdict = 'invalid'"), ru.MSG_GENERATION_ERROR, "generation_error", "invalid_output",
               F.array_append("notes", F.lit("generation_error")))
    )


def _to_retry(df: DataFrame) -> DataFrame:
    raw = clean_rewrites(F.col("r.rewritten_queries"), 3)
    kept = filter_rewrites(F.col("query"), raw)
    return df.withColumns(
        {
            "route": F.lit("corrective"),
            "rewrites": kept,
            "notes": F.concat("notes", strings(F.when(kept != raw, F.lit("rewritten_queries_filtered")))),
        }
    ).select(*STATE)


def answer_queries(snap: Snapshot, queries: DataFrame, provider: Provider, passage_scorer=None) -> DataFrame:
    """queries(qid, query, top_k, section_id) -> one result row per query."""
    s = snap.settings
    done: list[DataFrame] = []
    generated: list[DataFrame] = []
    graded: list[DataFrame] = []
    none = F.array().cast("array<string>")
    start = queries.select("qid", F.trim("query").alias("query"), "top_k", "section_id").withColumns(
        {"route": F.lit("naive"), "retrievals": F.lit(1), "generations": F.lit(0), "rewrites": none, "notes": none}
    )
    found = materialize(
        _context(start.join(hit_lists(search(snap, start)), "qid", "left"), s, passage_scorer), "round1"
    )
    usable = F.coalesce(F.size("context") > 0, F.lit(False))
    done.append(_close(found.filter(~usable), ru.MSG_NOTHING_FOUND, "insufficient_context", "no_hits"))
    rows = found.filter(usable).select(*STATE)

    # round 1
    retry: list[DataFrame] = []
    if s.fast_naive_enabled:
        fast = _fast(rows, provider, s, "fast1")
        generated.append(_answered(fast))
        retry.append(_to_retry(fast.filter("verdict = 'corrective'")))
        invalid = fast.filter("verdict = 'invalid'")
        if s.legacy_fallback_enabled:
            _errors(fast.filter("verdict = 'unavailable'"), done)
            to_grade = invalid.withColumn("notes", F.array_append("notes", F.lit("fast_naive_legacy_fallback"))).select(*STATE)
        else:
            _errors(fast, done)
            to_grade = None
    else:
        to_grade = rows
    if to_grade is not None:
        g = _grade(to_grade, provider, s, "grade1")
        _errors(g, done)
        graded.append(g.filter("verdict = 'sufficient'"))
        retry.append(_to_retry(g.filter("verdict = 'retry'")))

    # round 2
    again = materialize(union_all(retry), "retry")
    if s.max_retrieval_attempts < 2:
        done.append(_close(again, ru.MSG_INSUFFICIENT, "insufficient_context", "attempts_exhausted"))
    else:
        again = again.withColumns(
            {"retrievals": F.col("retrievals") + 1, "rewrites": filter_rewrites(F.col("query"), F.col("rewrites"))}
        )
        hits = search(snap, again, again.select("qid", "rewrites"))
        second = materialize(
            _context(again.drop("full", "context").join(hit_lists(hits), "qid", "left"), s, passage_scorer), "round2"
        )
        done.append(_close(second.filter("hits IS NULL"), ru.MSG_SECOND_SEARCH_EMPTY, "insufficient_context", "second_empty"))
        second = second.filter("hits IS NOT NULL")
        done.append(_close(second.filter(~usable), ru.MSG_SECOND_SEARCH_NO_PASSAGE, "insufficient_context", "second_no_passage"))
        second = second.filter(usable).select(*STATE)
        if s.fast_naive_enabled:
            fast = _fast(second, provider, s, "fast2")
            generated.append(_answered(fast))
            done.append(
                _close(fast.filter("verdict = 'corrective'"), ru.MSG_INSUFFICIENT, "insufficient_context", "second_corrective",
                       F.concat("notes", strings(F.nullif(F.trim("r.reason"), F.lit("")))))
            )
            if s.legacy_fallback_enabled:
                _errors(fast.filter("verdict = 'unavailable'"), done)
                # the emergency grader works on the selected passages
                second = fast.filter("verdict = 'invalid'").withColumns(
                    {"notes": F.array_append("notes", F.lit("fast_corrective_legacy_fallback")), "full": F.col("context")}
                ).select(*STATE)
            else:
                _errors(fast, done)
                second = None
        if second is not None:
            g = _grade(second, provider, s, "grade2")
            _errors(g, done)
            done.append(_close(g.filter("verdict = 'retry'"), ru.MSG_INSUFFICIENT, "insufficient_context", "second_grade"))
            graded.append(g.filter("verdict = 'sufficient'"))

    # generation from graded sources
    keep = [*STATE, "used", "gen", "by_fast"]
    if graded:
        chosen = union_all(
            [
                g.withColumn(
                    "used", F.filter("full", lambda c: F.array_contains(F.col("r.relevant_source_ids"), c["source_id"]))
                ).select(*STATE, "used")
                for g in graded
            ]
        )
        made = _generate(chosen, provider, s, "generated", none)
        generated.append(_close_failures(made, done))
    ready = materialize(union_all([g.select(*keep) for g in generated]), "ready")
    empty = ready.filter(F.size("used") == 0)
    done.append(_close(empty, ru.MSG_GENERATION_ERROR, "generation_error", "no_source",
                       F.array_append("notes", F.lit("generation_error"))))
    ready = ready.filter(F.size("used") > 0)
    done.append(_close(ready.filter("gen.insufficient_context"), F.col("gen.answer"), "insufficient_context", "insufficient"))
    ready = ready.filter("NOT gen.insufficient_context")

    # validation, one regeneration with feedback, final validation
    first = _validate(ready, provider, s, "validated1", skip_fast=True)
    done.append(_success(first.filter("issues_n = 0")))
    failed = first.filter("issues_n > 0")
    over = failed.filter(F.col("generations") >= s.max_generation_attempts)
    done.append(_close(over, ru.MSG_VALIDATION, "validation_error", "validation", F.concat("notes", "issues")))
    redo = failed.filter(F.col("generations") < s.max_generation_attempts)
    made = _close_failures(_generate(redo, provider, s, "regenerated", F.col("issues")), done)
    done.append(_close(made.filter("gen.insufficient_context"), F.col("gen.answer"), "insufficient_context", "insufficient"))
    last = _validate(made.filter("NOT gen.insufficient_context").select(*keep), provider, s, "validated2", skip_fast=False)
    done.append(_success(last.filter("issues_n = 0")))
    done.append(_close(last.filter("issues_n > 0"), ru.MSG_VALIDATION, "validation_error", "validation", F.concat("notes", "issues")))
    return union_all(done)


def _close_failures(made: DataFrame, done: list[DataFrame]) -> DataFrame:
    down = F.col("reply.status").isin("timeout", "unavailable")
    done.append(_close(made.filter(down), ru.MSG_UNAVAILABLE, "service_unavailable", "unavailable"))
    done.append(_close(made.filter(~down & F.col("gen").isNull()), ru.MSG_GENERATION_ERROR, "generation_error", "invalid_output",
                       F.array_append("notes", F.lit("generation_error"))))
    return made.filter(~down & F.col("gen").isNotNull())


def _success(df: DataFrame) -> DataFrame:
    return _close(df, F.col("gen.answer"), "success", "answer", sources=resolve_sources(F.col("gen.answer"), F.col("used")))


def _validate(rows: DataFrame, provider: Provider, s: Settings, name: str, *, skip_fast: bool) -> DataFrame:
    issues = format_issues(F.col("gen.answer"), F.col("gen.used_source_ids"), F.col("gen.insufficient_context"), _ids(F.col("used")))
    df = rows.withColumn("issues", issues)
    if s.validation_mode in ("always", "corrective"):
        need = F.lit(True)
        if s.validation_mode == "corrective":
            need = F.col("route") == "corrective"
            if skip_fast:
                need = need & ~F.col("by_fast")
        prompt = validator_prompt(F.col("query"), render_full(F.col("used")), F.col("gen.answer"))
        ask = df.filter(need)
        asked = with_reply(ask, "reply", provider, VALIDATOR_SYSTEM, prompt, F.lit(VALIDATE_TOKENS), s)
        asked = asked.withColumn("ev", parse(F.col("reply.text"), EVALUATION)).withColumn(
            "issues",
            F.concat("issues", F.when(F.col("ev").isNotNull(), semantic_issues(F.col("ev"))).otherwise(
                F.array(F.lit(ru.SEMANTIC_NO_REASON)))),
        ).drop("ev", "reply")
        df = df.filter(~need).unionByName(asked) if s.validation_mode == "corrective" else asked
    return materialize(df.withColumn("issues_n", F.size("issues")), name)
