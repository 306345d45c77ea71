"""Leaks of items with unusual keys and repeated shingles."""

import numpy as np

from quarry.llm import decontaminate


def test_items_without_an_id_leak_too(spark):
    texts = [" ".join(f"{p}{i}" for i in range(30)) for p in "abc"]
    docs = spark.createDataFrame([(i, f"before {t} after") for i, t in enumerate(texts)] + [(9, "clean text of no item at all")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (7, texts[2]), (8, texts[2])], "item_id long, text string")
    got = {(r.doc_id, r.leak.item_id, r.leak.similarity) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(0, None, 1.0), (1, None, 1.0), (2, 7, 1.0), (2, 8, 1.0)}
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()] == [9]


def test_a_replaced_run_of_one_word_is_found(spark):
    """Item and window differ in a run of one word, at either side: their fingerprints are often more than 23 bits apart."""
    rng = np.random.default_rng(6)
    docs, bench = [], []
    for i in range(24):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 164)]
        run, other = ["-"] * 20, [f"n{x}" for x in rng.integers(0, 10**9, 20)]
        docs.append((i, " ".join(words + (other if i % 2 else run))))
        bench.append((i, " ".join(words + (run if i % 2 else other))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.leaks(df, spark.createDataFrame(bench, "item_id long, text string")).select("doc_id", "leak.*").collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(24)]
    assert all(r.similarity == 0.8 for r in got) and max(r.hamming for r in got) > 23
