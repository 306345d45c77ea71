"""Retrieval, fusion, reranking and routing queries with their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from catalog.common import SETTINGS as S, hits, question_lists, snapshot
from catalog.sql import block, fold, isnum, keep, norm, ordered_distinct, q, root_list, sql, tokens, unicode_word, words
from catalog.text_queries import L, TURNS, filled, s_anchors
from quarry.operators import retrieval as R
from quarry.operators.gates import assess_evidence, dangling_reference, retrieval_tie
from quarry.operators.rewrites import fallback_rewrites, filter_rewrites
from quarry.operators.scoring import score_topk, vector_topk
from quarry.plans.routing import route_queries
from quarry.rules import russian as ru
from quarry.session import materialize
from quarry.sources.tables import queries_from_benchmark, queries_from_conversations, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            SQL[name] = oracle
        return fn

    return add


def _variants(spark, d):
    return R.query_variants(queries_from_benchmark(spark, d))


def _ranked(spark, d, kinds):
    v = _variants(spark, d)
    n = v.count()
    return R.with_variant(score_topk(snapshot(spark, d), v, n, kinds), v, n, S)


@query("dense_topk", sql("SELECT qid, idx, score, rank FROM dense_ranked", "dense_ranked"))
def _(spark, d):
    return _ranked(spark, d, {"dense": S.dense_top_k}).select("qid", "idx", "score", L(F.col("rank")).alias("rank"))


@query("sparse_topk", sql("SELECT qid, idx, score, rank FROM sparse_ranked", "sparse_ranked"))
def _(spark, d):
    return _ranked(spark, d, {"sparse": S.sparse_top_k}).select("qid", "idx", "score", L(F.col("rank")).alias("rank"))


def _lexical(spark, d):
    roots = R.variant_roots(_variants(spark, d))
    n = roots.agg(F.sum("qn")).first()[0]
    return R.lexical_topk(snapshot(spark, d).table("postings"), roots, n, S.lexical_candidate_k, S)


@query("lexical_topk", sql("SELECT qid, idx, coverage, lex_rank FROM lexical", "lexical"))
def _(spark, d):
    return _lexical(spark, d).select("qid", "idx", "coverage", L(F.col("lex_rank")).alias("lex_rank"))


@query("root_postings", sql("""
SELECT root, count(*)::BIGINT AS chunks, min(idx) AS low, max(idx) AS high, sum(idx)::BIGINT AS total FROM
  (SELECT DISTINCT idx, unnest(roots) AS root FROM croots) GROUP BY 1""", "croots"))
def _(spark, d):
    """The inverted index, its blocks put together by root."""
    blocks = snapshot(spark, d).table("postings")
    total = F.aggregate("idxs", F.lit(0).cast("long"), lambda a, x: a + x)
    return blocks.groupBy("root").agg(L(F.sum("n")).alias("chunks"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum(total).alias("total"))


@query("index_delta", sql("""
SELECT name, rows::BIGINT AS rows, true AS equal_to_full FROM (
  SELECT 'chunks' AS name, count(*) AS rows FROM chunks UNION ALL SELECT 'profiles', count(*) FROM chunks UNION ALL SELECT 'norms', count(*) FROM chunks
  UNION ALL SELECT 'docs', count(*) FROM docs_in UNION ALL SELECT 'vocab', count(*) FROM vocab
  UNION ALL SELECT 'doc_roots', count(*) FROM doc_roots UNION ALL SELECT 'postings', count(*) FROM (SELECT DISTINCT idx, unnest(roots) FROM croots)
  UNION ALL SELECT 'terms', (SELECT count(DISTINCT term) FROM wtf) + (SELECT count(DISTINCT term) FROM ctf))""",
    "chunks", "docs_in", "vocab", "doc_roots", "croots", "wtf", "ctf"))
def _(spark, d):
    """The index of an earlier state (one source not there yet, one with other texts, archived documents still live),
    refreshed by a delta to the present, next to an index built at once."""
    from quarry.operators.refresh import refresh_index, table_digests
    from quarry.session import work_dir
    from quarry.sources.tables import documents_from_tables

    now = documents_from_tables(spark, d)
    text = F.when(F.col("section") == "src3", F.concat("content", F.lit("\nEarlier draft."))).otherwise(F.col("content"))
    before = now.where("section <> 'src7'").withColumn("content", text).withColumn("is_actual", F.lit(True))
    root = f"{work_dir(spark)}/quarry-delta/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
    refresh_index(spark, before, f"tables:{d}", root, S)
    delta = table_digests(refresh_index(spark, now, f"tables:{d}", root, S))
    full = table_digests(snapshot(spark, d)).select("name", F.col("digest").alias("full"))
    return delta.join(full, "name").select("name", L(F.col("rows")).alias("rows"), (F.col("digest") == F.col("full")).alias("equal_to_full"))


@query("rrf_fusion", sql("SELECT qid, idx, round(rrf_score,9) AS rrf_score, dense_score, sparse_score FROM fused", "fused"))
def _(spark, d):
    return R.fuse(_ranked(spark, d, {"dense": S.dense_top_k, "sparse": S.sparse_top_k})).select(
        "qid", "idx", F.round("rrf_score", 9).alias("rrf_score"), "dense_score", "sparse_score")


@query("candidate_pool", sql("SELECT qid, idx, pos FROM pool", "pool"))
def _(spark, d):
    fused = materialize(R.fuse(_ranked(spark, d, {"dense": S.dense_top_k, "sparse": S.sparse_top_k})), "fused")
    return R.candidate_pool(fused, materialize(_lexical(spark, d), "lexical"), S).select("qid", "idx", "pos")


@query("neighbor_expansion", sql("""
SELECT h.qid, c.idx FROM (SELECT qid, idx, rank FROM hits5 WHERE rank<=3) h, (SELECT unnest([-1,1]) AS dx), chunks c
WHERE c.idx=h.idx+dx GROUP BY 1,2""", "hits5", "chunks"))
def _(spark, d):
    near = hits(spark, d, 5).filter("rank <= 3").select(
        "qid", F.explode(F.array(F.col("idx") - 1, F.col("idx") + 1)).alias("idx"))
    return snapshot(spark, d).table("chunks").select("idx").join(near, "idx").select("qid", "idx").distinct()


@query("document_affinity", sql("""
SELECT DISTINCT h.qid, h.doc_id, round(a.document_affinity,6) AS affinity FROM hits5 h JOIN affinity a ON a.qid=h.qid AND a.doc_id=h.doc_id""",
    "hits5", "affinity"))
def _(spark, d):
    roots = R.variant_roots(_variants(spark, d))
    h = hits(spark, d, 5)
    n, m = h.count(), roots.agg(F.sum("qn")).first()[0]
    return R.document_affinity(h, roots, snapshot(spark, d).table("doc_roots"), n, m, S).select(
        "qid", "doc_id", F.round("document_affinity", 6).alias("affinity"))


_sig = ", ".join(f"round({c},6) AS {c}" for c in R.SIGNALS[:-1])


@query("rerank_signals", sql(f"SELECT qid, idx, rank, score, {_sig} FROM hits10", "hits10"))
def _(spark, d):
    return hits(spark, d, 10).select(
        "qid", "idx", L(F.col("rank")).alias("rank"), "score", *[F.round(c, 6).alias(c) for c in R.SIGNALS[:-1]])


@query("search_hits", sql("SELECT qid, rank, idx, doc_id, chunk_id, title, section, md5(text) AS text_md5, score FROM hits5", "hits5"))
def _(spark, d):
    return R.search(snapshot(spark, d), queries_from_benchmark(spark, d)).select(
        "qid", L(F.col("rank")).alias("rank"), "idx", "doc_id", "chunk_id", "title", "section",
        F.md5("text").alias("text_md5"), "score")


_in_section = "section_id=(qid%20+1)::VARCHAR"


@query("search_in_section", sql(f"""
SELECT qid, rank, idx, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid,doc_id ORDER BY score DESC, pos) AS in_doc FROM scored WHERE {_in_section})
    WHERE in_doc<=3) WHERE rank<=5""", "scored"))
def _(spark, d):
    asked = queries_from_benchmark(spark, d).withColumn("section_id", (F.col("qid") % 20 + 1).cast("int"))
    return R.search(snapshot(spark, d), asked).select("qid", L(F.col("rank")).alias("rank"), "idx", "score")


@query("search_variants", sql("SELECT qid, rank, idx, score FROM v_hits5", "v_hits5"))
def _(spark, d):
    asked = queries_from_benchmark(spark, d)
    rewrites = asked.select("qid", fallback_rewrites(F.col("query")).alias("rewrites"))
    return R.search(snapshot(spark, d), asked, rewrites).select("qid", L(F.col("rank")).alias("rank"), "idx", "score")


@query("embedding_topk", """
SELECT qid, idx, score, rank, same_label FROM (
  SELECT a.vec_id AS qid, b.vec_id AS idx, round(list_dot_product(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),6) AS score, a.label=b.label AS same_label,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.embedding::DOUBLE[],b.embedding::DOUBLE[]),6) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b) WHERE rank<=10""")
def _(spark, d):
    e = read(spark, d, "embeddings")
    corpus = e.select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))
    top = vector_topk(corpus, e.select(F.col("vec_id").alias("qkey"), F.col("embedding").alias("vector")), e.count(), 10, S)
    a = e.select(F.col("vec_id").alias("qkey"), F.col("label").alias("la"))
    b = e.select(F.col("vec_id").alias("idx"), F.col("label").alias("lb"))
    return top.join(a, "qkey").join(b, "idx").select(
        F.col("qkey").alias("qid"), "idx", "score", L(F.col("rank")).alias("rank"), (F.col("la") == F.col("lb")).alias("same_label"))


@query("recall_at_k", sql("""
SELECT t.item_id AS qid, count(t.doc_id)::BIGINT AS planted, count(DISTINCT h.doc_id)::BIGINT AS found,
       round(coalesce(max(1.0::DOUBLE/h.rank),0.0),6) AS reciprocal_rank
FROM (SELECT b.item_id, k.doc_id FROM benchmark b LEFT JOIN docs_in k ON contains(k.content,b.text)) t
LEFT JOIN (SELECT qid, doc_id, min(rank) AS rank FROM hits10 GROUP BY 1,2) h ON h.qid=t.item_id AND h.doc_id=t.doc_id
GROUP BY 1""", "docs_in", "hits10"))
def _(spark, d):
    from quarry.operators.quality import planted_pairs, retrieval_quality
    from quarry.sources.tables import actual_documents, documents_from_tables

    docs = actual_documents(documents_from_tables(spark, d))
    asked = queries_from_benchmark(spark, d)
    return retrieval_quality(planted_pairs(docs, asked), hits(spark, d, 10), asked)


# --- gates ----------------------------------------------------------------------------------

_terms = f"list_distinct({keep('query', ru.GATE_STOP)})"
_src = f"list_distinct({keep(chr(116) + 'itle||' + q(' ') + '||text', ru.GATE_STOP)})"

block("top10", ("hits10",), """
  SELECT qid, query, list({'rank':rank,'doc_id':doc_id,'title':title,'text':text,'score':score,'cov':lexical_coverage,
    'tc':title_coverage,'sp':sparse_score,'de':dense_score} ORDER BY rank) AS h FROM hits10 GROUP BY 1,2""")
block("exact", ("hits10",), f"""
  SELECT qid, max(CASE WHEN len(t)>0 THEN len(list_intersect(t,s))::DOUBLE/len(t) ELSE 0.0 END) AS exact FROM (
    SELECT qid, {_terms} AS t, {_src} AS s FROM hits10 WHERE rank<=3) GROUP BY 1""")
block("agg3", ("hits10",), """
  SELECT qid, max(lexical_coverage) AS stem, max(sparse_score) AS sparse, max(dense_score) AS dense, max(title_coverage) AS title,
         max(score) FILTER (rank=1) AS top, avg((title_coverage>0)::INT) AS tsup, avg((lexical_coverage>=0.5)::INT) AS lsup
  FROM hits10 WHERE rank<=3 GROUP BY 1""")
block("coherence", ("hits10",), """
  SELECT qid, max(n)::DOUBLE/sum(n) AS coh FROM (SELECT qid, doc_id, count(*) AS n FROM hits10 WHERE rank<=3 GROUP BY 1,2) GROUP BY 1""")
block("anchors", ("hits10",), f"""
  SELECT qid, len(list_filter(a, lambda x: NOT contains(src,x)))>0 AS missing FROM (
    SELECT qid, {s_anchors('query')} AS a, src FROM (
      SELECT qid, query, {fold("string_agg(title||' '||text,' ' ORDER BY rank)")} AS src FROM hits10 WHERE rank<=5 GROUP BY 1,2))""")
block("evidence", ("exact", "agg3", "coherence", "anchors"), """
  SELECT *, CASE WHEN v<0.42 THEN 'weak' WHEN v<0.62 THEN 'borderline' ELSE 'strong' END AS level,
         CASE WHEN coll THEN 'collision_like' WHEN missing THEN 'missing_hard_anchor' ELSE 'score' END AS reason FROM (
    SELECT *, round(CASE WHEN coll OR missing THEN least(raw,0.42-0.01) ELSE raw END,9) AS v FROM (
      SELECT *, exact<0.5 AND title<0.1 AND lsup=0 AND top<0.4 AS coll,
        0.22*least(1.0,exact)+0.14*least(1.0,stem)+0.14*least(1.0,sparse/0.12)+0.08*least(1.0,dense/0.35)+0.12*least(1.0,title)
        +0.08*least(1.0,top/0.75)+0.10*tsup+0.08*lsup+0.04*coh AS raw
      FROM exact JOIN agg3 USING (qid) JOIN coherence USING (qid) JOIN anchors USING (qid)))""")
block("gated", (), f"""
  SELECT qid, query, c, list_filter(c, lambda t: NOT list_contains({words(ru.GENERIC_ROOTS)},t)) AS sp,
    CASE WHEN regexp_matches(query,'[0-9]\\s*[+*/=]\\s*[0-9]') THEN 'external_arithmetic' END AS ext, len({tokens('query')}) AS nt
  FROM (SELECT qid, query, {ordered_distinct('r')} AS c FROM
    (SELECT item_id AS qid, text AS query, {root_list('text', ru.PLANNER_STOP)} AS r FROM benchmark))""")
block("tie", ("top10", "gated"), """
  SELECT t.qid, coalesce(len(h)>=2 AND len(sp)>0 AND h[1].doc_id<>h[2].doc_id AND h[1].score>0 AND h[2].score/h[1].score>=0.94
    AND greatest(h[1].tc,h[2].tc,coalesce(h[3].tc,0.0))<0.15, false) AS tie FROM top10 t JOIN gated g ON g.qid=t.qid""")


@query("evidence", sql("""
SELECT qid, level, round(v,6) AS score, reason, round(exact,6) AS exact_coverage, round(stem,6) AS stem_coverage, round(sparse,6) AS sparse_score,
  round(dense,6) AS dense_score, round(title,6) AS title_coverage, round(tsup,6) AS title_support, round(lsup,6) AS lexical_support,
  round(coh,6) AS document_coherence, missing AS hard_anchor_missing FROM evidence""", "evidence"))
def _(spark, d):
    e = assess_evidence(question_lists(spark, d), S)
    num = ["score", "exact_coverage", "stem_coverage", "sparse_score", "dense_score", "title_coverage", "title_support",
           "lexical_support", "document_coherence"]
    return e.select("qid", "evidence.level", "evidence.reason", "evidence.hard_anchor_missing",
                    *[F.round(F.col(f"evidence.{c}"), 6).alias(c) for c in num])


_rt = f"list_distinct(list_transform(list_filter(regexp_extract_all(lower(X),'[0-9a-zа-яё]+'), lambda t: length(t)>=4 AND NOT list_contains({words(ru.REWRITE_STOP)},t)), lambda t: left(t,5)))"
#: Follow-up questions without an object of their own, over the hits of the question they follow.
_after, _after_col = filled(("{q}", "Как это оформить?", "Какие эти {q}", "Можно ли делать такое 5 дней?"), "qid%4", "query")


@query("retrieval_clarification", sql(rf"""
SELECT qid, tie, len(h)>=2 AND {unicode_word('n', ru.ANAPHORA_SHORT_PATTERN[len(chr(92) + 'b(?:'):-len(')' + chr(92) + 'b')])}
  AND len(list_filter({_rt.replace('X', 'n')}, lambda t: NOT list_contains({words(ru.GENERIC_REWRITE_ROOTS)},t)))=0
  AND NOT ({unicode_word('x', '[А-ЯA-Z]{2,}')} OR regexp_matches(x,'[0-9]|[а-яa-z]+-[а-яa-z]+'))
  AND len(list_distinct(list_transform(h[1:4], lambda y: y.doc_id)))>=2 AND (h[1].score<=0 OR h[2].score>=h[1].score*0.72) AS dangling
FROM (SELECT *, {norm('x')} AS n FROM (SELECT qid, h, tie, {_after} AS x FROM top10 JOIN tie USING (qid)))""", "top10", "tie"))
def _(spark, d):
    return question_lists(spark, d).select(
        "qid", retrieval_tie(F.col("query"), F.col("hits")).alias("tie"),
        dangling_reference(_after_col(), F.col("hits")).alias("dangling"))


@query("route", sql("""
SELECT g.qid, g.query,
  CASE WHEN g.ext IS NOT NULL THEN 'reject' WHEN len(c)>0 AND len(sp)=0 AND nt<=7 THEN 'clarify' WHEN level='weak' THEN 'reject'
       WHEN tie THEN 'clarify' ELSE 'answer' END AS route,
  coalesce(g.ext, CASE WHEN len(c)>0 AND len(sp)=0 AND nt<=7 THEN 'underspecified' END) AS reason,
  level AS evidence_level, round(v,3) AS evidence_score, e.reason AS evidence_reason,
  round(exact,3) AS exact_coverage, round(stem,3) AS stem_coverage, round(title,3) AS title_coverage, round(tsup,3) AS title_support,
  round(lsup,3) AS lexical_support, h[1].title AS top_document, round(h[1].score,3) AS top_score
FROM gated g LEFT JOIN evidence e ON e.qid=g.qid LEFT JOIN tie t ON t.qid=g.qid LEFT JOIN top10 p ON p.qid=g.qid""",
    "gated", "evidence", "tie", "top10"))
def _(spark, d):
    return route_queries(snapshot(spark, d), queries_from_benchmark(spark, d)).drop("retrieval_query")


@query("rewrite_filter", f"""
SELECT qid, CASE WHEN len(v)>0 THEN v[1] ELSE o END AS first, CASE WHEN len(v)>0 THEN v[2] WHEN len(p)>=2 THEN p[2] END AS second FROM (
  SELECT qid, trim(query,' '||chr(9)||chr(10)||chr(13)) AS o, p,
    CASE WHEN len(t0)>0 THEN list_filter(p, lambda x: len(list_intersect(t0,{_rt.replace('X', 'x')}))>0) ELSE []::VARCHAR[] END AS v FROM (
    SELECT qid, query, {_rt.replace('X', 'query')} AS t0,
      list_distinct([]::VARCHAR[]) AS z,
      list_filter(s, lambda x, i: list_position(list_transform(s, lambda y: replace(lower(y),'ß','ss')), replace(lower(x),'ß','ss'))=i) AS p FROM (
      SELECT qid, query, list_filter(list_transform(string_split(query,'.'), lambda x: trim(x,' '||chr(9)||chr(10)||chr(13))), lambda x: x<>'') AS s FROM {TURNS})))""")
def _(spark, d):
    c = F.col("query")
    r = filter_rewrites(c, F.split(c, r"\."))
    return queries_from_conversations(spark, d).select("qid", r.alias("r")).select(
        "qid", F.get("r", F.lit(0)).alias("first"), F.get("r", F.lit(1)).alias("second"))
