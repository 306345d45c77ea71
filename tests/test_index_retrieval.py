import math
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.operators.chunking import chunk_text
from quarry.operators.indexing import build_index, check_compatible, ensure_index, load_index, stale_fields
from quarry.operators.profiles import profile
from quarry.operators.scoring import score_topk
from quarry.session import work_dir
from quarry.settings import Settings

S = Settings(chunk_size_chars=400, chunk_overlap_chars=40)
TEXTS = {
    1: "Отпуск\nЕжегодный отпуск работника составляет 28 календарных дней. Заявление подается за две недели. " + "Отпуск оплачивается в срок. " * 20,
    2: "Пожарная безопасность\nПри обнаружении пожара необходимо сообщить дежурному и вызвать пожарную охрану по телефону 101.",
    3: "Hot word\n" + "alpha beta gamma. " * 60,
    4: "Hot word\n" + "alpha beta delta 2024. " * 60,
    5: "Hot word\n" + "alpha epsilon zeta. " * 10,
}


def documents(spark):
    rows = [(i, str(i), "1", t.split("\n")[0], "src7", "7" if i < 3 else "8", t, f"kb://{i}", True) for i, t in TEXTS.items()]
    return spark.createDataFrame(
        rows, "doc_seq long, doc_id string, version string, title string, section string, section_id string, content string, url string, is_actual boolean"
    ).withColumn("updated_at", F.lit("1970-01-01").cast("timestamp"))


@pytest.fixture(scope="module")
def snap(spark):
    root = f"{work_dir(spark)}/test-index-{spark.sparkContext.applicationId}"
    return build_index(spark, documents(spark), "test", root, S)


def questions(spark, *texts, section=0):
    return spark.createDataFrame([(i, t, 5, section) for i, t in enumerate(texts)], "qid long, query string, top_k int, section_id int")


def brute_sparse(query):
    """Independent TF-IDF scoring of every chunk."""
    chunks = {(d << 20) + n: c for d, t in TEXTS.items() for n, c in enumerate(chunk_text(t, 400, 40), 1)}
    prof = {i: profile(c, 384) for i, c in chunks.items()}
    out = {}
    for fam, weight in (("word", 1.0), ("char", 0.45)):
        df = Counter(t for p in prof.values() for t in p[fam + "_ids"].tolist())
        idf = {t: math.log((1 + len(prof)) / (1 + n)) + 1 for t, n in df.items()}

        def vec(p):
            v = {t: (1 + math.log(n)) * idf[t] for t, n in zip(p[fam + "_ids"].tolist(), p[fam + "_tfs"].tolist()) if t in idf}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
            return {t: x / norm * weight for t, x in v.items()}

        q = vec(profile(query, 384))
        for i, p in prof.items():
            out[i] = out.get(i, 0.0) + sum(x * q.get(t, 0.0) for t, x in vec(p).items())
    return {i: round(x / math.sqrt(1 + 0.45**2), 6) for i, x in out.items()}


def test_sparse_matches_brute_force(spark, snap):
    v = R.query_variants(questions(spark, "ежегодный отпуск 28 дней", "alpha delta"))
    got = R.with_variant(score_topk(snap, v, 2, {"sparse": 80}), v, 2, snap.settings).collect()
    for qid, text in enumerate(("ежегодный отпуск 28 дней", "alpha delta")):
        want = brute_sparse(text)
        mine = {r.idx: r.score for r in got if r.qid == qid}
        assert mine.keys() == want.keys()
        assert all(mine[i] == pytest.approx(want[i], abs=2e-6) for i in want)


def test_blocks_equal_broadcast(spark, snap):
    qs = questions(spark, "отпуск", "пожар 101", "alpha beta", "zeta", "delta 2024")
    v = R.query_variants(qs)
    kinds = {"dense": 4, "sparse": 3}
    key = lambda df: sorted(map(tuple, df.select("qkey", "kind", "idx", "score", "rank").collect()))
    small = snap.__class__(spark, snap.path, snap.manifest, S.with_(query_block=2), snap.names)
    assert key(score_topk(snap, v, 5, kinds)) == key(score_topk(small, v, 5, kinds))


def brute_coverage(snap, asked, k):
    """Best coverage of every question over all chunks, straight from the roots of the chunks."""
    chunks = {r.idx: set(r.roots) for r in snap.table("chunks").select("idx", "roots").collect()}
    out = []
    for q in asked:
        wanted, numbers = set(q.qroots), {r for r in q.qroots if r.isdecimal()}
        scored = []
        for i, have in chunks.items():
            m = wanted & have
            if m:
                c = len(m) / len(wanted)
                scored.append((round(min(1.15, c + 0.12) if numbers and numbers <= have else c, 6), i))
        scored.sort(key=lambda x: (-x[0], x[1]))
        out += [(q.qid, i, c, r) for r, (c, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [2, 80])
def test_coverage_from_postings(spark, snap, k):
    """One block, several blocks of one and two variants, and no bound on roots: all equal brute force over the chunks."""
    roots = R.variant_roots(R.query_variants(questions(spark, "alpha beta gamma", "отпуск 2024", "qqq", "delta 2024 alpha", "пожарная охрана 101")))
    want = brute_coverage(snap, roots.collect(), k)
    for s in (S, S.with_(query_block=2), S.with_(query_block=1), S.with_(broadcast_rows=0), S.with_(query_block=1, broadcast_rows=0)):
        got = R.lexical_topk(snap.table("postings"), roots, 11, k, s)
        assert sorted(map(tuple, got.collect())) == want


def test_postings_hold_every_root_of_every_chunk(spark, snap):
    from quarry.operators.indexing import root_postings

    chunks = snap.table("chunks")
    want = sorted({(r.idx, x) for r in chunks.select("idx", "roots").collect() for x in r.roots})
    for slices in (1, 3, 50):
        blocks = root_postings(chunks, slices).collect()
        assert sorted((i, b.root) for b in blocks for i in b.idxs) == want
        assert all(b.n == len(b.idxs) and list(b.idxs) == sorted(b.idxs) and (b.low, b.high) == (b.idxs[0], b.idxs[-1]) for b in blocks)


def test_many_questions_leave_the_corpus_where_it_is(spark, snap):
    """Above one block, scores and vectors are read in place: the corpus side of the plan has no exchange."""
    from quarry.operators import scoring

    small = snap.__class__(spark, snap.path, snap.manifest, S.with_(query_block=2), snap.names)
    v = R.query_variants(questions(spark, "отпуск", "пожар 101", "alpha beta", "zeta", "delta 2024"))
    profiles = scoring.query_profiles(v, S)
    plan = scoring._score_blocks(small, scoring.profiles_with_norms(small), profiles, 3, 5, {"dense": 4})._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_search_finds_the_document_and_caps_per_doc(spark, snap):
    hits = R.search(snap, questions(spark, "Сколько дней отпуск работника", "alpha beta")).collect()
    assert [h.doc_id for h in sorted(hits, key=lambda h: h.rank) if h.qid == 0][0] == "1"
    per_doc = Counter((h.qid, h.doc_id) for h in hits)
    assert max(per_doc.values()) <= S.max_chunks_per_document
    assert all(h.score >= 0 for h in hits)


def test_section_filter_applies_after_ranking(spark, snap):
    hits = R.search(snap, questions(spark, "отпуск alpha", section=8)).collect()
    assert hits and {h.doc_id for h in hits} <= {"3", "4", "5"}


def test_variants_share_one_result(spark, snap):
    qs = questions(spark, "отпуск")
    rewrites = spark.createDataFrame([(0, ["пожарная охрана", "отпуск", " "])], "qid long, rewrites array<string>")
    docs = {h.doc_id for h in R.search(snap, qs, rewrites).collect()}
    assert {"1", "2"} <= docs


def test_cross_encoder_blend(spark, snap):
    hits = R.search(snap, questions(spark, "отпуск"), scorer=lambda q, t: F.lit(0.0)).collect()
    assert all(h.score == pytest.approx(0.36 + 0.28 * min(1, h.base_score)) for h in hits)


def test_min_span(spark):
    df = spark.createDataFrame([(["a", "x", "b", "a", "b"], ["a", "b"]), (["a", "x"], ["a", "b"])], "s array<string>, r array<string>")
    assert [r.x for r in df.select(R.min_span(F.col("s"), F.col("r")).alias("x")).collect()] == [2, None]


def test_snapshot_reuse_and_staleness(spark, snap):
    root = snap.path.rsplit("/", 1)[0]
    again = ensure_index(spark, documents(spark), "test", root, S)
    assert again.manifest["version"] == snap.manifest["version"]
    assert load_index(spark, root, S, verify=True).manifest["chunk_count"] == snap.table("chunks").count()
    assert stale_fields(snap.manifest, "other", S) == ["source_key"]
    assert stale_fields(snap.manifest, "test", S.with_(chunk_size_chars=500)) == ["chunk_size_chars"]
    with pytest.raises(ValueError):
        check_compatible(snap.manifest, S.with_(embedding_dimension=512))
    with pytest.raises(ValueError):
        build_index(spark, documents(spark).filter("false"), "none", root + "-empty", S)


def test_plans(spark, snap):
    from quarry.operators.model import FirstSourceClient, ModelTimeout
    from quarry.plans import agentic, latency
    from quarry.plans.routing import route_queries
    from quarry.plans.service import answer_stream

    qs = questions(spark, "Привет!", "Какая погода завтра?", "Как оформить?", "Сколько календарных дней составляет ежегодный отпуск работника?", "qqq www eee")
    routes = {r.qid: r for r in route_queries(snap, qs).collect()}
    assert [routes[i].route for i in range(5)] == ["direct", "reject", "clarify", "answer", "reject"]
    out = {r.qid: r for r in latency.answer_queries(snap, qs, FirstSourceClient).collect()}
    assert [out[i].exit_stage for i in range(3)] == ["direct", "external", "underspecified"]
    assert out[3].status == "success" and out[3].sources and out[4].exit_stage == "weak_evidence"

    class Slow:
        truncated = False

        def complete(self, *a):
            raise ModelTimeout("late")

    slow = {r.qid: r for r in latency.answer_queries(snap, qs, Slow).collect()}
    assert "llm_timeout_extractive_fallback" in slow[3].diagnostics
    cached = latency.cache_rows(latency.answer_queries(snap, qs, FirstSourceClient), qs, S)
    hit = {r.qid: r for r in latency.answer_queries(snap, qs, None, cached).collect()}
    assert hit[3].exit_stage == "cache" and hit[3].answer == out[3].answer
    stream = answer_stream(latency.answer_queries(snap, qs, None), S).filter("qid = 0").orderBy("seq").collect()
    assert stream[0].kind == "route_info" and stream[-1].kind == "final"
    assert "".join(r.payload for r in stream if r.kind == "token") == out[0].answer


def test_corrective_plan(spark, snap):
    from quarry.operators.model import FirstSourceClient, ModelUnavailable
    from quarry.plans import agentic

    class Corrective:
        """First asks for a rewrite, then answers."""

        truncated = False

        def complete(self, system, user, max_tokens, timeout):
            import json

            if "SECOND" in user or "28" in user.split("<SOURCES>")[0]:
                return "not json"
            if "relevant_source_ids" in system:
                return json.dumps({"decision": "partial", "relevant_source_ids": [], "missing_information": [], "rewritten_queries": ["отпуск дни"], "reason": ""})
            return json.dumps({"decision": "corrective", "answer": "", "used_source_ids": [], "rewritten_queries": ["ежегодный отпуск"], "reason": "need"})

    qs = questions(spark, "Сколько дней отпуск работника?", "отпуск 28 дней")
    ok = {r.qid: r for r in agentic.answer_queries(snap, qs, FirstSourceClient).collect()}
    assert ok[0].status == "success" and ok[0].generation_attempts == 1 and ok[0].sources[0].source_id == "S1"
    out = {r.qid: r for r in agentic.answer_queries(snap, qs, Corrective).collect()}
    assert out[0].route_type == "corrective" and out[0].retrieval_attempts == 2 and out[0].exit_stage == "second_corrective"
    assert out[0].rewritten_queries == ["ежегодный отпуск"]
    assert out[1].status == "generation_error"

    class Down:
        def complete(self, *a):
            raise ModelUnavailable("no")

    assert {r.status for r in agentic.answer_queries(snap, qs, Down).collect()} == {"service_unavailable"}


def test_streaming_equals_batch(spark, snap):
    from quarry.streaming.intake import answer_batch, question_stream, run_answers

    base = f"{work_dir(spark)}/stream-{tempfile.mktemp(dir='')[1:]}"
    asked = questions(spark, "Сколько календарных дней составляет ежегодный отпуск работника?", "Привет", "  ").withColumn("trace_id", F.lit("t"))
    asked.write.json(base + "/in")
    q = run_answers(question_stream(spark, base + "/in"), lambda: snap, base + "/out", base + "/cp")
    q.awaitTermination(180)
    key = lambda df: sorted((r.qid, r.status, r.answer) for r in df.collect())
    got = key(spark.read.parquet(base + "/out"))
    assert got == key(answer_batch(snap, asked, None)) and (2, "invalid_argument", "query must not be empty") in got


def test_sync_jobs(spark, snap):
    from quarry.plans.service import KnowledgeBase

    kb = KnowledgeBase(spark, snap.path.rsplit("/", 1)[0] + "-sync", "test", S)
    assert kb.health(True, "connected")["healthy"] is False
    job = kb.start_sync()
    assert kb.start_sync() is job
    assert kb.run_sync(job.job_id, documents(spark).filter("false")).status == "failed"
    job = kb.start_sync()
    assert kb.run_sync(job.job_id, documents(spark)).status == "completed" and kb.health(True, "connected")["healthy"]
    with pytest.raises(KeyError):
        kb.sync_status("nope")


def test_rest_source(spark):
    import fake_kb
    from quarry.sources.rest import Api, ArticleReader, TransportError, readable_articles, SCHEMA, source_key

    opts = {"base_url": "https://kb.local", "email": "e", "password": "p", "transport": "fake_kb:transport"}
    reader = ArticleReader(opts)
    parts = reader.partitions()
    assert [(p.section, p.first, p.last) for p in parts] == [(7, 1, 1), (7, 2, None), (9, 1, None)]
    rows = [r for p in parts for r in reader.read(p)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert df.filter("error is not null").count() == 1
    assert sorted(r.id for r in readable_articles(df).collect()) == [1, 2, 3, 4]
    calls = []

    def flaky(*a):
        calls.append(a)
        if len(calls) < 3:
            raise TransportError("t")
        return fake_kb.transport(*a)

    pauses = []
    api = Api(opts, lambda *a: fake_kb.transport(*a) if a[0] == "POST" else flaky(*a), pauses.append)
    assert api.sections() == [7, 9] and pauses == [2, 4]
    with pytest.raises(RuntimeError):
        Api({**opts, "password": "x"}, fake_kb.transport).login()
    assert source_key("https://kb.local/", 0) == "kb:https://kb.local:section:all"


def test_many_variants_and_large_ids_keep_their_question(spark):
    big = 1 << 60
    queries = spark.createDataFrame([(big, "main one"), (big + 1, "main two")], "qid long, query string")
    rewrites = spark.createDataFrame([(big, [f"rewrite {i}" for i in range(20)])], "qid long, rewrites array<string>")
    v = R.query_variants(queries, rewrites)
    scored = v.select("qkey", F.lit("dense").alias("kind"), F.lit(1).cast("long").alias("idx"), F.lit(0.5).alias("score"), F.lit(1).alias("rank"))
    got = R.with_variant(scored, v, 22, Settings()).groupBy("qid").count().collect()
    assert {r.qid: r["count"] for r in got} == {big: 21, big + 1: 1} and v.select("qkey").distinct().count() == 22


def test_pool_order_beyond_a_thousand(spark):
    fused = spark.createDataFrame([(1, i, 1.0 / i, 0.1, 0.1, i) for i in range(1, 1501)], "qid long, idx long, rrf_score double, dense_score double, sparse_score double, seen int")
    lexical = spark.createDataFrame([(1, 5000 + i, i) for i in range(1, 1501)], "qid long, idx long, lex_rank int")
    s = Settings(rerank_candidate_k=1500, neighbor_expansion_enabled=False)
    order = [r.idx for r in R.candidate_pool(fused, lexical, s).orderBy("pos").collect()]
    assert order == list(range(1, 1501)) + list(range(5001, 6501))


def test_short_questions_are_found(spark):
    from quarry.operators.quality import planted_pairs, retrieval_quality

    docs = spark.createDataFrame([(1, "so the five word question here stands"), (2, "nothing like it"), (3, "a-b, c")], "doc_id long, content string")
    asked = [(1, "five word question here stands"), (2, "like it"), (3, ","), (4, "absent words"), (5, " "), (6, "the five word question here stands")]
    queries = spark.createDataFrame(asked, "qid long, query string")
    pairs = planted_pairs(docs, queries)
    assert sorted(map(tuple, pairs.collect())) == [(1, 1), (2, 2), (3, 3), (6, 1)]
    hits = spark.createDataFrame([(1, 1, 2)], "qid long, doc_id long, rank int")
    got = {r.qid: (r.planted, r.found) for r in retrieval_quality(pairs, hits, queries).collect()}
    assert got[1] == (1, 1) and got[4] == (0, 0) and len(got) == 6


def test_ema_over_more_samples_than_any_window(spark):
    from quarry.operators.telemetry import ema_throughput

    tps = [1.0 + i % 7 for i in range(3000)]
    df = spark.createDataFrame([("m", float(i // 3), i, x) for i, x in enumerate(tps)], "model string, ts double, seq long, tps double")
    for alpha in (0.0005, 0.35, 1.0):
        s = Settings(perf_ema_alpha=alpha)
        want = s.initial_decode_tps
        for x in tps:
            want = alpha * x + (1 - alpha) * want
        got = ema_throughput(df, s).first()
        assert got.samples == 3000 and abs(got.tps - want) < 1e-9


def test_throughput_of_crowds_and_outliers(spark):
    """All samples of one model at one instant, and another with one sample ten years early, are spread over the parts."""
    from quarry.operators.telemetry import ema_throughput, exact_medians, in_ranges

    rows = [("crowd", 5.0, i, 1.0 + i % 11) for i in range(2000)] + [("late", 1e9 + i, i, 2.0 + i % 5) for i in range(1999)] + [("late", -3e8, 0, 900.0)]
    rows += [("same", 1.0, 1, 4.0)] * 500 + [("one", 1.0, 1, 7.0), ("one", 2.0, 2, 0.0)]
    df = spark.createDataFrame(rows, "model string, ts double, seq long, tps double")
    sizes = [r["count"] for r in in_ranges(df.where("model = 'crowd'"), "ts", "seq").groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 800
    for alpha in (0.002, 0.35):
        s = Settings(perf_ema_alpha=alpha)
        got = {r.model: (r.samples, r.tps) for r in ema_throughput(df, s).collect()}
        for model in ("crowd", "late", "same", "one"):
            mine = [x for m, _, _, x in sorted(r for r in rows if r[0] == model) if x > 0]
            want = s.initial_decode_tps
            for x in mine:
                want = alpha * x + (1 - alpha) * want
            assert got[model][0] == len(mine) and got[model][1] == pytest.approx(want, rel=1e-9)
    medians = {r.model: (r.samples, r.median) for r in exact_medians(df).collect()}
    for model in ("crowd", "late", "same", "one"):
        mine = [x for m, _, _, x in rows if m == model]
        assert medians[model] == (len(mine), float(np.median(mine)))


def test_chunk_index_out_of_range_fails(spark):
    from quarry.operators.chunking import chunk_index

    df = spark.createDataFrame([(1, 1 << 20)], "d long, n long")
    with pytest.raises(Exception, match="out of range"):
        df.select(chunk_index(F.col("d"), F.col("n"))).collect()


def test_vector_blocks_equal_broadcast_and_brute_force(spark):
    from quarry.operators.scoring import vector_topk
    rng = np.random.default_rng(7)
    vectors = np.round(rng.normal(size=(60, 4)), 1)
    vectors[20:40] = vectors[0]                                   # ties: the smaller idx goes first
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    corpus = spark.createDataFrame(rows, "idx long, vector array<float>").repartition(5)
    asked = spark.createDataFrame(rows, "qkey long, vector array<float>")
    got = lambda s: sorted(map(tuple, vector_topk(corpus, asked, 60, 5, s).select("qkey", "rank", "idx", "score").collect()))
    scores = np.round(vectors.astype(np.float32).astype(float) @ vectors.astype(np.float32).astype(float).T, S.score_digits)
    want = []
    for q, line in enumerate(scores):
        best = sorted(range(60), key=lambda i: (-line[i], i))[:5]
        want += [(q, r, i, line[i]) for r, i in enumerate(best, 1)]
    assert got(S) == got(S.with_(query_block=16))
    assert [x[:3] for x in got(S)] == [x[:3] for x in sorted(want)]


def test_running_top_k():
    from quarry.operators.scoring import TopK
    rng = np.random.default_rng(3)
    for k in (1, 3, 50):
        top, rows = TopK(k, 2), []
        for _ in range(6):
            idx = rng.permutation(1000)[:20] + 1000 * len(rows)
            scores = rng.integers(0, 3, size=(20, 2)).astype(float)
            top.add(idx, scores)
            rows += list(zip(idx, scores))
        for q in range(2):
            want = sorted(((-s[q], i) for i, s in rows))[:k]
            assert [(-v, i) for v, i, qq in zip(top.score, top.idx, top.q) if qq == q] == want


def test_index_profiles_take_the_layout_of_the_chunks(spark, snap):
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    assert spark.conf.get(auto) == "true"
    joined = snap.table("profiles").join(snap.table("chunks").select("idx").hint("merge"), "idx")
    assert joined.count() == snap.manifest["chunk_count"]
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
