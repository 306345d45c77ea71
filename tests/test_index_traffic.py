"""What the index build and the search move and leave on disk."""

import math
import os
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.operators import indexing, profiles, retrieval, scoring
from quarry.session import SHUFFLE_CLEANUP, materialize, stage_root
from quarry.settings import Settings

S = Settings(chunk_size_chars=80, chunk_overlap_chars=10)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(spark) -> int:
    return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def docs(spark, n=6):
    rows = [(i, str(i), "1", f"title {i}", "kb", "1", f"alpha beta word{i}. " * 9, f"kb://{i}", True) for i in range(n)]
    d = spark.createDataFrame(rows, "doc_seq long, doc_id string, version string, title string, section string, section_id string, content string, url string, is_actual boolean")
    return d.withColumn("updated_at", F.lit("1970-01-01 00:00:00").cast("timestamp"))


def test_a_written_stage_leaves_no_shuffle(spark):
    before, setting = shuffles(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    out = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "k"), "swept")
    assert out.agg(F.sum("count")).first()[0] == 1000
    assert shuffles(spark) <= before + 1  # the sum just read
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting


def test_build_deletes_the_staged_documents(spark, tmp_path):
    had = {x for x in os.listdir(stage_root(spark))} if os.path.isdir(stage_root(spark)) else set()
    snap = indexing.build_index(spark, docs(spark), "t", str(tmp_path), S)
    assert snap.table("docs").count() == 6
    left = set(os.listdir(stage_root(spark))) - had if os.path.isdir(stage_root(spark)) else set()
    assert not [x for x in left if x.startswith("index-docs")]


def test_roots_of_a_document_are_dealt_as_lists(spark):
    chunks = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["y"]), ("b", [])], "doc_id string, roots array<string>")
    d = spark.createDataFrame([("a", 2, ["x"]), ("b", 1, []), ("c", 0, ["z"])], "doc_id string, n_chunks long, title_roots array<string>")
    out = indexing.document_roots(chunks, d)
    assert "hashpartitioning(doc_id" in plan_of(out) and "root#" not in "".join(x for x in plan_of(out).splitlines() if "hashpartitioning" in x)
    assert {(r.doc_id, r.root): r.n for r in out.collect()} == {("a", "x"): 4, ("a", "y"): 1, ("b", "y"): 1}


def test_postings_are_dealt_once(spark):
    rows = [(i, [f"r{i % 3}", "all", "all"] if i % 5 else []) for i in range(40)]
    chunks = spark.createDataFrame(rows, "idx long, roots array<string>").repartition(4)
    out = indexing.root_postings(chunks.localCheckpoint(), 3, 2)
    assert sum("Exchange" in x for x in plan_of(out).splitlines()) == 1
    got = out.collect()
    assert len({(r.root, r.slice) for r in got}) == len(got) and all(r.idxs == sorted(r.idxs) and r.n == len(r.idxs) for r in got)
    pairs = [(r.root, i) for r in got for i in r.idxs]
    assert sorted(pairs) == sorted({(x, i) for i, roots in rows for x in roots})


def test_blocks_of_a_pack(spark):
    b = pa.RecordBatch.from_pydict({
        "idx": pa.array([9, 4, 7], pa.int64()), "slice": pa.array([1, 0, 1], pa.int32()), "roots": pa.array([["a", "b", "a"], ["b"], ["a"]])})
    got = {(r["root"], r["slice"]): r["idxs"] for r in indexing._partial_blocks([b, b.slice(1, 1).slice(0, 0)]).to_pylist()}
    assert got == {("a", 1): [7, 9], ("b", 1): [9], ("b", 0): [4]}


def test_counts_of_one_segment_are_not_added_up(spark):
    terms = spark.createDataFrame([("word", 1, 2, 3), ("char", 1, 0, 0)], "family string, term_id long, df long, total long")
    alone = indexing.added_up(terms, 1)
    assert "Exchange" not in plan_of(alone) and alone.collect() == indexing.added_up(terms).collect()


def test_shared_and_lone_terms_of_a_block(spark):
    rng = np.random.default_rng(1)
    m = np.where(rng.random((50, 9)) < np.linspace(0, 1, 50)[:, None], rng.random((50, 9)), 0.0)
    q = scoring.QueryBlock(np.arange(9), np.zeros((9, 2)), {}, {}, {"word": m})
    column, shared, first, query, weight = q.split["word"]
    assert (np.count_nonzero(m, axis=1)[column >= 0] >= scoring.SHARED_TERM).all() and len(shared) < 50
    rows, terms, values = np.repeat(np.arange(4), 50), np.tile(np.arange(50), 4), rng.random(200)
    alone = column[terms] < 0
    got = scoring._cell_sums(rows[alone], terms[alone], values[alone], 4, 9, first, query, weight)
    for r, t, v in zip(rows[~alone], terms[~alone], values[~alone]):
        got[r] += v * shared[column[t]]
    assert np.allclose(got, values.reshape(4, 50) @ m, rtol=1e-12)


def test_affinity_deals_the_roots_of_its_documents_only(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "qid long, doc_id string")
    asked = spark.createDataFrame([(1, ["x", "y"], 2), (2, ["z"], 1)], "qid long, qroots array<string>, qn int")
    roots = spark.createDataFrame([("a", "x", 7), ("b", "x", 1), ("c", "x", 9), ("c", "z", 1)], "doc_id string, root string, n long")
    out = retrieval.document_affinity(pairs, asked, roots, 3, 1_000_000, Settings())
    assert [(r.qid, r.doc_id) for r in out.collect()] == [(1, "a")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "strategy=broadcast" in plan.split("LeftSemi")[1].splitlines()[0]


def test_word_ids_by_columns():
    words = ["a", "straße", "日本語", "x" * 51, "y" * 53, "z" * 54, "q" * 70, "ю" * 26, "ab1_"]
    left, right = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    terms = words + [f"{words[a]} {words[b]}" for a, b in zip(left, right)]
    assert {len(t.encode()) for t in terms} >= {52, 53, 54, 55}
    assert profiles._term_ids(words, left, right).tolist() == [profiles.term_id("w:" + t) for t in terms]
    assert profiles.profiles(["", " "], 4).to_pylist() == [{**{f"{f}_{x}": [] for f in ("word", "char") for x in ("ids", "tfs")}, "buckets": [0] * 8}] * 2


def test_rare_words_meet_their_vocabulary_in_packets(spark):
    rng = np.random.default_rng(3)
    n, ids = 400, rng.integers(0, 1 << 60, 3000)
    rows = [(i << 20, sorted(rng.choice(ids, 20, replace=False).tolist()), rng.integers(1, 5, 20).tolist(), [], []) for i in range(n)]
    prof = spark.createDataFrame(rows, "idx long, word_ids array<long>, word_tfs array<int>, char_ids array<long>, char_tfs array<int>")
    df = Counter(t for r in rows for t in r[1])
    idf = {t: 1.0 + math.log((1 + n) / (1 + k)) for t, k in df.items() if t % 7}
    vocab = spark.createDataFrame([("word", t, df[t], df[t], x) for t, x in idf.items()], "family string, term_id long, df long, total long, idf double")
    monkey, indexing.HOT_TERM_LIMIT = indexing.HOT_TERM_LIMIT, 1500
    try:
        out = indexing.chunk_norms(prof, vocab)
    finally:
        indexing.HOT_TERM_LIMIT = monkey
    assert "Join" not in plan_of(out)
    got = {r.idx: r.word_norm for r in out.collect()}
    assert len(got) == n
    for i, terms, tfs, _, _ in rows:
        assert math.isclose(got[i], math.sqrt(sum(((1 + math.log(k)) * idf.get(t, 0.0)) ** 2 for t, k in zip(terms, tfs))), rel_tol=1e-12)


def test_packets_return_what_they_hold():
    ids, tfs = np.array([5, 3, 1 << 59, 8], np.int64), np.array([1, 2, 3, 4], np.int32)
    got = {}
    for r in indexing._packets(indexing.OCCURRENCES, 2, [(ids[:1], tfs[:1]), (ids[1:], tfs[1:])]).to_pylist():
        assert r["kind"] == indexing.OCCURRENCES
        delta, n = indexing._unpacked(r["body"], np.int64, np.int32)
        got[r["part"]] = list(zip(np.cumsum(delta).tolist(), n.tolist()))
    assert got == {0: [(8, 4), (1 << 59, 3)], 1: [(3, 2), (5, 1)]}
