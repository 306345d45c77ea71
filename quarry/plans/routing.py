"""Model-free routing of a table of questions: direct / reject / clarify / answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.functions.text import normalize_query
from quarry.operators.gates import assess_evidence, hit_lists, query_gates, retrieval_tie
from quarry.operators.indexing import Snapshot
from quarry.operators.retrieval import search


def route_queries(snap: Snapshot, queries: DataFrame) -> DataFrame:
    """One row per query; retrieval only runs for queries that pass the cheap gates."""
    s = snap.settings
    gated = query_gates(queries, s)
    open_ = gated.filter(
        F.col("gate_direct").isNull() & F.col("gate_external").isNull() & F.col("gate_clarify").isNull()
    )
    k = max(5, s.optimized_retrieval_top_k)
    asked = open_.select(
        "qid", normalize_query(F.col("query")).alias("query"), F.lit(k).alias("top_k"),
        F.lit(0).alias("section_id"),
    )
    lists = hit_lists(search(snap, asked))
    judged = assess_evidence(
        gated.select(
            "qid", "query", "gate_direct", "gate_external", "gate_clarify",
            normalize_query(F.col("query")).alias("retrieval_query"),
        ).join(lists, "qid", "left"),
        s, "retrieval_query",
    )
    passed = F.col("gate_direct").isNull() & F.col("gate_external").isNull() & F.col("gate_clarify").isNull()
    tie = retrieval_tie(F.col("retrieval_query"), F.coalesce(F.col("hits"), F.array()))
    route = (
        F.when(F.col("gate_direct").isNotNull(), "direct")
        .when(F.col("gate_external").isNotNull(), "reject")
        .when(F.col("gate_clarify").isNotNull(), "clarify")
        .when(F.col("evidence.level") == "weak", "reject")
        .when(tie, "clarify")
        .otherwise("answer")
    )
    reason = F.coalesce(
        "gate_direct", "gate_external", F.when(F.col("gate_clarify").isNotNull(), "underspecified"),
    )

    def only(c, digits: int | None = None):
        return F.when(passed, F.round(c, digits) if digits is not None else c)

    e = lambda n: F.col(f"evidence.{n}")
    top = F.element_at("hits", 1)
    return judged.select(
        "qid", "query", route.alias("route"), reason.alias("reason"),
        only(F.col("retrieval_query")).alias("retrieval_query"),
        only(e("level")).alias("evidence_level"),
        only(e("score"), 3).alias("evidence_score"),
        only(e("reason")).alias("evidence_reason"),
        only(e("exact_coverage"), 3).alias("exact_coverage"),
        only(e("stem_coverage"), 3).alias("stem_coverage"),
        only(e("title_coverage"), 3).alias("title_coverage"),
        only(e("title_support"), 3).alias("title_support"),
        only(e("lexical_support"), 3).alias("lexical_support"),
        only(top["title"]).alias("top_document"),
        only(top["score"], 3).alias("top_score"),
    )
