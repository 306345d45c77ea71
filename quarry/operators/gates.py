"""Query gates and the evidence gate: one row per query, pure expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.intents import direct_answer, direct_reason, external_reason
from quarry.functions.text import (
    content_roots, fold, gate_tokens, hard_anchors, let, matches, norm, rewrite_terms, specific_roots,
    tokens,
)
from quarry.rules import russian as ru
from quarry.settings import Settings


def underspecified(query: Column) -> Column:
    """Clarification message for queries without an object, else null."""
    q = norm(query)
    anchors = F.size(specific_roots(query))
    return (
        F.when(matches(q, ru.ANAPHORA_PATTERN) & (anchors == 0), F.lit(ru.MSG_CLARIFY_ANAPHORA))
        .when(
            (F.size(content_roots(query)) > 0) & (anchors == 0) & (F.size(tokens(query)) <= 7),
            F.lit(ru.MSG_CLARIFY_GENERIC),
        )
    )


def query_gates(queries: DataFrame, s: Settings) -> DataFrame:
    """Adds gate_direct, gate_direct_answer, gate_external, gate_clarify (nulls = passed)."""
    off = F.lit(None).cast("string")
    q = F.col("query")
    on = s.quality_gate_enabled
    return queries.withColumns(
        {
            "gate_direct": direct_reason(q) if on and s.gate_direct_enabled else off,
            "gate_direct_answer": direct_answer(q) if on and s.gate_direct_enabled else off,
            "gate_external": external_reason(q) if on and s.gate_external_enabled else off,
            "gate_clarify": underspecified(q) if on and s.gate_clarify_enabled else off,
        }
    )


def hit_lists(hits: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(qid, hits): the ranked hits of a query as one array, bounded by top_k <= 10 or so."""
    fields = [
        "rank", "idx", "doc_id", "chunk_id", "chunk_number", "title", "section", "url", "text", "score",
        "lexical_coverage", "title_coverage", "sparse_score", "dense_score", *extra,
    ]
    return hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("hits"))


# --- evidence -------------------------------------------------------------------------


def _best(top: Column, value) -> Column:
    return F.coalesce(F.array_max(F.transform(top, value)), F.lit(0.0))


def _share(top: Column, cond) -> Column:
    return F.size(F.filter(top, cond)) / F.greatest(F.lit(1), F.size(top))


def assess_evidence(lists: DataFrame, s: Settings, query_col: str = "query") -> DataFrame:
    """Adds `evidence`: level, score, sub-signals, reason.  `hits` may be null (no chunks)."""
    query = F.col(query_col)
    inputs = F.struct(
        F.slice("hits", 1, 3).alias("top"),
        F.greatest(F.lit(0.0), F.get("hits", F.lit(0))["score"]).alias("top_score"),
        gate_tokens(query).alias("terms"),
        hard_anchors(query).alias("anchors"),
        fold(
            F.array_join(
                F.transform(F.slice("hits", 1, 5), lambda h: F.concat(h["title"], F.lit(" "), h["text"])),
                " ",
            )
        ).alias("source"),
    )
    return lists.withColumn("evidence", let(inputs, lambda b: let(_signals(b), lambda g: _verdict(b, g, s))))


def _signals(b: Column) -> Column:
    top, terms = b["top"], b["terms"]

    def exact(h: Column) -> Column:
        source = gate_tokens(F.concat(h["title"], F.lit(" "), h["text"]))
        return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, source)) / F.size(terms)).otherwise(0.0)

    doc_share = F.array_max(F.transform(top, lambda h: _share(top, lambda o: o["doc_id"] == h["doc_id"])))
    return F.struct(
        _best(top, exact).alias("exact_coverage"),
        _best(top, lambda h: h["lexical_coverage"]).alias("stem_coverage"),
        _best(top, lambda h: h["sparse_score"]).alias("sparse_score"),
        _best(top, lambda h: h["dense_score"]).alias("dense_score"),
        _best(top, lambda h: h["title_coverage"]).alias("title_coverage"),
        b["top_score"].alias("top_score"),
        _share(top, lambda h: h["title_coverage"] > 0).alias("title_support"),
        _share(top, lambda h: h["lexical_coverage"] >= 0.5).alias("lexical_support"),
        F.coalesce(doc_share, F.lit(0.0)).alias("document_coherence"),
        F.exists(b["anchors"], lambda a: ~F.contains(b["source"], a)).alias("hard_anchor_missing"),
    )


def _verdict(b: Column, g: Column, s: Settings) -> Column:
    one = F.lit(1.0)
    raw = (
        0.22 * F.least(one, g["exact_coverage"])
        + 0.14 * F.least(one, g["stem_coverage"])
        + 0.14 * F.least(one, g["sparse_score"] / 0.12)
        + 0.08 * F.least(one, g["dense_score"] / 0.35)
        + 0.12 * F.least(one, g["title_coverage"])
        + 0.08 * F.least(one, g["top_score"] / 0.75)
        + 0.10 * g["title_support"] + 0.08 * g["lexical_support"] + 0.04 * g["document_coherence"]
    )
    collision = (
        (g["exact_coverage"] < 0.50) & (g["title_coverage"] < 0.10)
        & (g["lexical_support"] == 0.0) & (g["top_score"] < 0.40)
    )
    missing = g["hard_anchor_missing"]
    score = F.round(
        F.when(collision | missing, F.least(raw, F.lit(s.weak_threshold - 0.01))).otherwise(raw), 9
    )
    found = F.coalesce(F.size(b["top"]) > 0, F.lit(False))
    fields = [
        "exact_coverage", "stem_coverage", "sparse_score", "dense_score", "title_coverage", "top_score",
        "title_support", "lexical_support", "document_coherence",
    ]
    return let(
        score,
        lambda v: F.struct(
            F.when(~found | (v < s.weak_threshold), "weak")
            .when(v < s.strong_threshold, "borderline").otherwise("strong").alias("level"),
            F.when(found, F.greatest(F.lit(0.0), F.least(one, v))).otherwise(0.0).alias("score"),
            *[F.when(found, g[f]).otherwise(0.0).alias(f) for f in fields],
            F.coalesce(found & missing, F.lit(False)).alias("hard_anchor_missing"),
            F.when(found, F.array_sort(b["terms"])).otherwise(F.array().cast("array<string>")).alias("query_terms"),
            F.when(~found, "no_chunks").when(collision, "collision_like")
            .when(missing, "missing_hard_anchor").otherwise("score").alias("reason"),
        ),
    )


# --- post-retrieval clarification ------------------------------------------------------


def retrieval_tie(query: Column, hits: Column) -> Column:
    """Two different documents nearly tied and no title names the object."""
    first, second = F.element_at(hits, 1), F.element_at(hits, 2)
    titles = F.array_max(F.transform(F.slice(hits, 1, 3), lambda h: h["title_coverage"]))
    return F.when(
        F.size(hits) >= 2,
        (F.size(specific_roots(query)) > 0)
        & (first["doc_id"] != second["doc_id"])
        & (first["score"] > 0)
        & (F.try_divide(second["score"], first["score"]) >= 0.94)
        & (titles < 0.15),
    ).otherwise(False)


def dangling_reference(query: Column, hits: Column) -> Column:
    """Short anaphoric question whose hits fan out over several documents."""
    q = norm(query)
    anchors = F.array_except(
        rewrite_terms(q), F.array(*[F.lit(r) for r in ru.GENERIC_REWRITE_ROOTS])
    )
    docs = F.size(F.array_distinct(F.transform(F.slice(hits, 1, 4), lambda h: h["doc_id"])))
    first = F.element_at(hits, 1)["score"]
    close = F.when(first > 0, F.element_at(hits, 2)["score"] >= first * 0.72).otherwise(True)
    return F.when(
        F.size(hits) >= 2,
        matches(q, ru.ANAPHORA_SHORT_PATTERN)
        & (F.size(anchors) == 0)
        & ~matches(query, ru.CONCRETE_ENTITY_PATTERN)
        & (docs >= 2)
        & close,
    ).otherwise(False)
