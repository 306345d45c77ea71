"""Hybrid retrieval for a whole table of queries in one job.

variants(qid, vid, query): vid 0 is the primary query of qid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.intents import (
    answerability, business_adjustment, business_text, preferred_sections, text_head,
)
from quarry.functions.budgets import sigmoid
from quarry.functions.text import fold, is_number, let, norm, root_list, strip
from quarry.operators.indexing import Snapshot
from quarry.operators.scoring import coverage_topk, score_topk
from quarry.session import materialize, small_side
from quarry.settings import Settings

RRF_OFFSET = 60
SIGNALS = [
    "rrf_score", "dense_score", "sparse_score", "lexical_coverage", "title_coverage",
    "term_proximity", "document_affinity", "title_match", "section_match", "intent_boost",
    "intent_penalty", "answerability_bonus", "boilerplate_penalty", "base_score",
]


# --- query relations ------------------------------------------------------------


def query_variants(queries: DataFrame, rewrites: DataFrame | None = None) -> DataFrame:
    """(qkey, qid, vid, query): the primary query plus distinct non-blank rewrites in order."""
    primary = queries.select("qid", F.array(strip(F.col("query"))).alias("all"))
    if rewrites is not None:
        primary = (
            primary.join(rewrites.select("qid", "rewrites"), "qid", "left")
            .select(
                "qid",
                F.concat(
                    "all",
                    F.coalesce(
                        F.transform("rewrites", strip), F.array().cast("array<string>")
                    ),
                ).alias("all"),
            )
        )
    clean = primary.select("qid", F.array_distinct(F.filter("all", lambda q: q != "")).alias("all"))
    return clean.select("qid", F.posexplode("all").alias("vid", "query")).select(
        F.xxhash64("qid", "vid").alias("qkey"), "qid", "vid", "query"
    )


def with_variant(scored: DataFrame, variants: DataFrame, n_variants: int, s: Settings) -> DataFrame:
    """(qid, vid, kind, idx, score, rank): the scorer's key put back to its question and variant."""
    names = small_side(variants.select("qkey", "qid", "vid"), n_variants, s.broadcast_rows)
    return scored.join(names, "qkey").select("qid", "vid", "kind", "idx", "score", "rank")


def variant_roots(variants: DataFrame) -> DataFrame:
    """(qkey, qid, vid, qroots, qn, n_numeric) with distinct roots in query order."""
    roots = F.array_distinct(root_list(F.col("query")))
    return variants.select("qkey", "qid", "vid", roots.alias("qroots")).select(
        "qkey", "qid", "vid", "qroots",
        F.size("qroots").alias("qn"),
        F.size(F.filter("qroots", is_number)).alias("n_numeric"),
    )


# --- lexical candidates ------------------------------------------------------------


def coverage_value(matched: Column, matched_numeric: Column, qn: Column, n_numeric: Column) -> Column:
    cov = matched / qn
    boosted = F.least(F.lit(1.15), cov + 0.12)
    return F.when((n_numeric > 0) & (matched_numeric == n_numeric), boosted).otherwise(cov)


def lexical_topk(postings: DataFrame, roots: DataFrame, n_roots: int, k: int, s: Settings) -> DataFrame:
    """(qid, idx, coverage, lex_rank): best root coverage per query, from the inverted index."""
    n_variants = roots.count()
    names = small_side(roots.select("qkey", "qid"), n_variants, s.broadcast_rows)
    per_query = coverage_topk(postings, roots, n_variants, n_roots, k, s).join(names, "qkey").select("qid", "idx", "coverage", "qkey")
    # a slice keeps its own top k: those of all slices are cut to k a variant
    each = Window.partitionBy("qkey").orderBy(F.desc("coverage"), "idx")
    per_query = per_query.withColumn("n", F.row_number().over(each)).filter(F.col("n") <= k)
    # several variants of one query: keep the best value per chunk
    best = per_query.groupBy("qid", "idx").agg(F.max("coverage").alias("coverage"))
    order = Window.partitionBy("qid").orderBy(F.desc("coverage"), "idx")
    return best.withColumn("lex_rank", F.row_number().over(order)).filter(F.col("lex_rank") <= k)


# --- fusion and candidate pool -------------------------------------------------------


def fuse(ranked: DataFrame) -> DataFrame:
    """(qid, idx, rrf_score, dense_score, sparse_score, seen): reciprocal-rank fusion.

    `seen` reproduces first-appearance order (variant, dense before sparse, rank).
    """
    seen = F.struct("vid", (F.col("kind") == "sparse").alias("sparse"), "rank")
    best = lambda kind: F.greatest(
        F.lit(0.0), F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    )
    return ranked.groupBy("qid", "idx").agg(
        F.round(F.sum(1.0 / (RRF_OFFSET + F.col("rank"))), 12).alias("rrf_score"),
        best("dense").alias("dense_score"),
        best("sparse").alias("sparse_score"),
        F.min(seen).alias("seen"),
    )


#: Order of the pool: fused ranks, then lexical ranks, then neighbours by anchor. The steps are wider
#: than any rank, whatever the settings.
LEXICAL_POS, NEIGHBOR_POS, ANCHOR_STEP = 1 << 40, 1 << 60, 1 << 30


def candidate_pool(fused: DataFrame, lexical: DataFrame | None, s: Settings) -> DataFrame:
    """(qid, idx, pos, rrf_score, dense_score, sparse_score); pos = candidate order."""
    order = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), "seen")
    top = (
        fused.withColumn("pos", F.row_number().over(order))
        .filter(F.col("pos") <= s.rerank_candidate_k)
        .select("qid", "idx", F.col("pos").cast("long").alias("pos"))
    )
    pool = top
    if lexical is not None:
        pool = pool.unionByName(
            lexical.select("qid", "idx", (F.col("lex_rank") + F.lit(LEXICAL_POS)).cast("long").alias("pos"))
        )
    if s.neighbor_expansion_enabled and s.neighbor_distance:
        # the ordered union starts with the fused list, so its head holds the anchors;
        # with an empty fused list the lexical list provides them
        place = Window.partitionBy("qid").orderBy("pos")
        anchors = pool if lexical is None else pool.groupBy("qid", "idx").agg(F.min("pos").alias("pos"))
        anchors = anchors.withColumn("anchor", F.row_number().over(place)).filter(
            F.col("anchor") <= s.neighbor_anchor_k
        )
        deltas = [d for i in range(1, s.neighbor_distance + 1) for d in (-i, i)]
        near = anchors.select(
            "qid", "idx", "anchor", F.posexplode(F.array(*[F.lit(d) for d in deltas])).alias("j", "delta")
        ).select(
            "qid", (F.col("idx") + F.col("delta")).alias("idx"),
            (F.lit(NEIGHBOR_POS) + F.col("anchor").cast("long") * F.lit(ANCHOR_STEP) + F.col("j")).cast("long").alias("pos"),
        )
        pool = pool.unionByName(near)
    pool = pool.groupBy("qid", "idx").agg(F.min("pos").alias("pos"))
    pool = pool.join(fused.drop("seen"), ["qid", "idx"], "left").na.fill(
        0.0, ["rrf_score", "dense_score", "sparse_score"]
    )
    top_rrf = F.max("rrf_score").over(Window.partitionBy("qid"))
    return pool.withColumn("max_rrf", F.when(top_rrf > 0, top_rrf).otherwise(1.0))


# --- features -------------------------------------------------------------------------


def min_span(seq: Column, required: Column) -> Column:
    """Shortest token window holding every required root (null when one is missing)."""
    marked = F.filter(
        F.transform(
            seq,
            lambda x, i: F.struct(
                i.cast("int").alias("at"), F.array_position(required, x).cast("int").alias("slot")
            ),
        ),
        lambda e: e["slot"] > 0,
    )
    start = F.struct(
        F.transform(required, lambda _: F.lit(-1)).alias("last"), F.lit(None).cast("int").alias("best")
    )

    def step(acc: Column, e: Column) -> Column:
        last = F.transform(acc["last"], lambda v, j: F.when(j == e["slot"] - 1, e["at"]).otherwise(v))
        span = let(F.array_min(last), lambda low: F.when(low >= 0, e["at"] - low + 1))
        return F.struct(last.alias("last"), F.least(acc["best"], span).alias("best"))

    # `least` skips nulls, so `best` stays null until every required root was seen
    return F.aggregate(marked, start, step, lambda acc: acc["best"])


def proximity(seq: Column, matched: Column) -> Column:
    def of(required: Column) -> Column:
        n = F.size(required)
        return F.when(
            n >= 2, let(min_span(seq, required), lambda span: n / F.greatest(n, span))
        )

    return F.coalesce(let(F.slice(matched, 1, 5), of), F.lit(0.0))


def lexical_features(variants: Column, roots: Column, title_roots: Column) -> dict[str, Column]:
    """Best value over the query's variants (an array of roots structs, at most 16)."""

    def best(value) -> Column:
        def one(v: Column) -> Column:
            return let(
                F.array_intersect(v["qroots"], roots),
                lambda m: F.when(F.size(m) > 0, value(v, m)).otherwise(0.0),
            )

        return F.coalesce(F.array_max(F.transform(variants, one)), F.lit(0.0))

    return {
        "lexical_coverage": F.round(
            best(
                lambda v, m: coverage_value(
                    F.size(m), F.size(F.filter(m, is_number)), v["qn"], v["n_numeric"]
                )
            ),
            12,
        ),
        "title_coverage": best(
            lambda v, m: F.size(F.array_intersect(v["qroots"], title_roots)) / v["qn"]
        ),
        "term_proximity": best(lambda v, m: proximity(roots, m)),
    }


def document_affinity(
    pairs: DataFrame, primary: DataFrame, doc_roots: DataFrame, n_pairs: int, n_roots: int, s: Settings
) -> DataFrame:
    """(qid, doc_id, document_affinity) from document-level root counts.

    Only the roots of the documents in `pairs` are dealt: of these there are at most `n_pairs`, whatever the corpus.
    """
    asked = pairs.select("qid", "doc_id").distinct()
    of_pairs = small_side(asked.select("doc_id").distinct(), n_pairs, s.broadcast_rows)
    doc_roots = doc_roots.join(of_pairs, "doc_id", "left_semi")
    wanted = (
        asked
        .join(small_side(primary.select("qid", "qroots", "qn"), n_roots, s.broadcast_rows), "qid")
        .select("qid", "doc_id", "qn", F.explode("qroots").alias("root"))
    )
    hit = doc_roots.join(small_side(wanted, n_pairs * max(1, n_roots), s.broadcast_rows), ["doc_id", "root"])
    per_root = F.least(F.lit(1.0), F.log1p(F.col("n").cast("double")) / F.log1p(F.lit(7.0)))
    g = hit.groupBy("qid", "doc_id").agg(
        F.count("*").alias("m"), F.sum(per_root).alias("f"), F.first("qn").alias("qn")
    )
    return g.select(
        "qid", "doc_id",
        F.round(
            F.col("m") / F.col("qn") * (0.55 + 0.45 * F.col("f") / F.col("qn")), 12
        ).alias("document_affinity"),
    )


def base_score(s: Settings) -> Column:
    c = F.col
    rrf_norm = c("rrf_score") / c("max_rrf")
    if s.lexical_rerank_enabled:
        score = (
            0.22 * rrf_norm + 0.10 * c("dense_score") + 0.18 * c("sparse_score")
            + s.lexical_coverage_weight * c("lexical_coverage")
            + s.lexical_title_weight * c("title_coverage")
            + s.lexical_proximity_weight * c("term_proximity")
            + s.lexical_document_weight * c("document_affinity")
            + 0.18 * c("title_match") + 0.08 * c("section_match")
            + c("intent_boost") - c("intent_penalty")
        )
    else:
        score = 0.50 * rrf_norm + 0.30 * c("dense_score") + 0.20 * c("sparse_score")
    return F.round(
        F.greatest(F.lit(0.0), score + c("answerability_bonus") - c("boilerplate_penalty")), s.score_digits
    )


def rerank(
    pool: DataFrame, snap: Snapshot, variants: DataFrame, n_variants: int, n_roots: int
) -> DataFrame:
    """All signals and the final score of every candidate that exists in the corpus."""
    s = snap.settings
    bound = n_variants * (
        s.rerank_candidate_k + s.lexical_candidate_k + 2 * s.neighbor_distance * s.neighbor_anchor_k
    )
    roots = variant_roots(variants)
    asked = variants.filter("vid = 0").select("qid", "query").join(
        roots.groupBy("qid").agg(
            F.collect_list(F.struct("qroots", "qn", "n_numeric")).alias("variants"),
            F.max(F.when(F.col("vid") == 0, F.col("qroots"))).alias("qroots"),
        ),
        "qid",
    ).select(
        "qid", "query", "variants", "qroots", F.size("qroots").alias("qn"),
        norm(F.col("query")).alias("qnorm"), fold(F.col("query")).alias("qfold"),
        preferred_sections(F.col("query")).alias("prefs"),
    )
    chunks = snap.table("chunks").select("idx", "doc_id", "chunk_number", "chunk_id", "text", "roots")
    docs = snap.table("docs").select(
        "doc_id", "title", "section", "section_id", "url", "version", "updated_at", "title_roots",
        "section_roots",
    )
    # features are per-row work: give every core a slice (a query owns at most ~170 rows)
    slices = max(snap.spark.sparkContext.defaultParallelism, -(-bound // 20_000))
    pairs = materialize(
        chunks.join(small_side(pool, bound, s.broadcast_rows), "idx").join(docs, "doc_id")
        .repartition(slices, "qid", "idx"),
        "pairs",
    )
    affinity = document_affinity(
        pairs, asked, snap.table("doc_roots"), bound, n_roots, s
    )
    boost, penalty = business_adjustment(F.col("qfold"), F.col("dtext"))
    bonus, boiler = answerability(F.col("qnorm"), F.col("whole"), F.col("head"))
    prefs = F.col("prefs")
    in_pref = F.array_contains(prefs, F.coalesce(F.col("section_id").try_cast("int"), F.lit(0)))
    nq = F.greatest(F.lit(1), F.col("qn"))
    feats = (
        pairs.join(small_side(asked, n_variants, s.broadcast_rows), "qid")
        .withColumns(
            {
                "whole": norm(F.col("text")), "head": text_head(F.col("text")),
                "dtext": business_text(F.col("section"), F.col("title")),
                **lexical_features(F.col("variants"), F.col("roots"), F.col("title_roots")),
                "title_match": F.size(F.array_intersect("qroots", "title_roots")) / nq,
                "section_match": F.size(F.array_intersect("qroots", "section_roots")) / nq,
            }
        )
        .withColumns(
            {
                "intent_boost": boost + F.when((F.size(prefs) > 0) & in_pref, 0.30).otherwise(0.0),
                "intent_penalty": penalty + F.when((F.size(prefs) > 0) & ~in_pref, 0.10).otherwise(0.0),
                "answerability_bonus": bonus,
                "boilerplate_penalty": boiler,
            }
        )
        .join(affinity, ["qid", "doc_id"], "left")
        .na.fill(0.0, ["document_affinity"])
    )
    return feats.withColumn("base_score", base_score(s)).withColumn("score", F.col("base_score"))


def cross_encode(candidates: DataFrame, scorer: Column) -> DataFrame:
    """Blend an injected (query, text) -> double scorer with the base score."""
    raw = F.when(F.isnan(scorer) | scorer.isNull() | (F.abs(scorer) == float("inf")),
                 F.raise_error(F.lit("scorer returned a non-finite value"))).otherwise(scorer)
    return candidates.withColumn("rerank_raw_score", raw).withColumn(
        "score",
        0.72 * sigmoid(F.col("rerank_raw_score")) + 0.28 * F.least(F.lit(1.0), F.col("base_score")),
    )


def select_hits(candidates: DataFrame, queries: DataFrame, n_queries: int, s: Settings) -> DataFrame:
    """Score/section filter, per-document cap, then top_k (a column) per query."""
    wanted = small_side(queries.select("qid", "top_k", "section_id"), n_queries, s.broadcast_rows)
    c = candidates.withColumnRenamed("section_id", "doc_section_id").join(wanted, "qid")
    c = c.filter(F.col("score") >= s.retrieval_min_score).filter(
        (F.col("section_id") == 0)
        | (F.coalesce("doc_section_id", F.lit("")) == F.col("section_id").cast("string"))
    )
    order = [F.desc("score"), F.col("pos")]
    per_doc = Window.partitionBy("qid", "doc_id").orderBy(*order)
    per_query = Window.partitionBy("qid").orderBy(*order)
    capped = c.withColumn("in_doc", F.row_number().over(per_doc)).filter(
        F.col("in_doc") <= s.max_chunks_per_document
    )
    return (
        capped.withColumn("rank", F.row_number().over(per_query))
        .filter(F.col("rank") <= F.col("top_k"))
        .drop("in_doc")
    )


def search(
    snap: Snapshot, queries: DataFrame, rewrites: DataFrame | None = None, scorer=None
) -> DataFrame:
    """hits(qid, rank, idx, doc_id, ..., score, 14 signals) for every non-blank query.

    The variants table is small metadata (one row per question); it is counted to decide
    which sides may be broadcast.
    """
    s = snap.settings
    # written once: the questions are read by every step, and rewrites may come from a costly plan
    variants = materialize(query_variants(queries, rewrites), "variants")
    roots = variant_roots(variants)
    n_variants, n_roots = roots.agg(F.count("*"), F.coalesce(F.sum("qn"), F.lit(0))).first()
    scored = with_variant(
        score_topk(snap, variants, n_variants, {"dense": s.dense_top_k, "sparse": s.sparse_top_k}), variants, n_variants, s
    )
    fused = materialize(fuse(scored), "fused")
    lexical = None
    if s.lexical_rerank_enabled:
        lexical = materialize(
            lexical_topk(snap.table("postings"), roots, n_roots, s.lexical_candidate_k, s),
            "lexical",
        )
    pool = materialize(candidate_pool(fused, lexical, s), "pool")
    candidates = rerank(pool, snap, variants, n_variants, n_roots)
    if scorer is not None:
        candidates = cross_encode(candidates, scorer(F.col("query"), F.col("text")))
    return select_hits(candidates, queries, n_variants, s).select(
        "qid", "rank", "idx", "doc_id", "chunk_id", "chunk_number", "title", "section",
        F.col("doc_section_id").alias("section_id"), "text", "url", "version", "updated_at", "score",
        *SIGNALS, *(["rerank_raw_score"] if scorer is not None else []),
    )
