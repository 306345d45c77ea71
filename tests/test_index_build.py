"""Work of the index build: what is hashed, exploded and sorted."""

import math
from collections import Counter

import pytest

from quarry.operators import indexing, profiles


def test_grams_are_hashed_once_a_batch(monkeypatch):
    words = [a + b + c for a in ("inter", "over", "under") for b in ("work", "stand", "line") for c in ("ing", "ed", "er", "s")]
    asked = Counter()
    real = profiles.term_id
    monkeypatch.setattr(profiles, "_gram_id", lambda t: asked.update([t]) or real(t))
    lows = [" ".join(words[i::2]) for i in range(2)]
    n, ids, tfs = profiles._char_terms(lows)
    grams = [Counter(f" {w} "[i:i + k] for w in t.split() for k in (3, 4, 5) for i in range(len(w) + 3 - k)) for t in lows]
    assert set(asked) == {"c:" + g for c in grams for g in c} and max(asked.values()) == 1
    assert dict(zip(ids[:n[0]].tolist(), tfs[:n[0]].tolist())) == {real("c:" + g): k for g, k in grams[0].items()}


@pytest.mark.parametrize("cells", [1, 40, 1 << 22])
def test_profiles_of_odd_texts(cells, monkeypatch):
    monkeypatch.setattr(profiles._char_terms, "__defaults__", (cells,))
    wide = "".join(chr(c) + (" " if c % 7 == 0 else "") for c in range(0x4E00, 0x7000))
    texts = ["", " ", "aaaa aaaa Straße ſ İ a", "日本 語語語語語", wide, "x", "\x1c a\x85b c 😀😀😀", "aaaa"]
    for text, got in zip(texts, profiles.profiles(texts, 8).to_pylist()):
        one = profiles.profile(text, 8)
        for f in ("word", "char"):
            assert dict(zip(got[f + "_ids"], got[f + "_tfs"])) == dict(zip(one[f + "_ids"].tolist(), one[f + "_tfs"].tolist()))
        assert got["buckets"] == one["buckets"].tolist()


def test_norms_explode_rare_words_only(spark):
    rows = [(1, [10, 11, 12], [1, 2, 3], [20, 21], [4, 1]), (2, [10], [5], [21], [2]), (3, [], [], [99], [1]), (4, [], [], [], []), (5, [13], [1], [], [])]
    prof = spark.createDataFrame(rows, "idx long, word_ids array<long>, word_tfs array<int>, char_ids array<long>, char_tfs array<int>")
    words = {10: (2, 1.5), 11: (1, 2.0), 12: (1, 2.25), 13: (1, 3.0)}
    chars = {20: (1, 1.25), 21: (2, 1.75)}
    known = [(f, t, df, df, w) for f, terms in (("word", words), ("char", chars)) for t, (df, w) in terms.items()]
    vocab = spark.createDataFrame(known, "family string, term_id long, df long, total long, idf double")
    out = indexing.chunk_norms(prof, vocab)
    weigh = lambda terms, ids, tfs: math.sqrt(sum(((1 + math.log(n)) * terms[t][1]) ** 2 for t, n in zip(ids, tfs) if t in terms))
    expected = {i: (weigh(words, w, n), weigh(chars, c, m)) for i, w, n, c, m in rows if any(t in words for t in w) or any(t in chars for t in c)}
    got = {r.idx: (r.word_norm, r.char_norm) for r in out.collect()}
    assert got.keys() == expected.keys() == {1, 2, 5}
    assert all(got[i] == pytest.approx(expected[i], rel=1e-12) for i in got)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    assert indexing.chunk_norms(prof.limit(0), vocab.limit(0)).collect() == []


def test_document_roots_are_grouped_once(spark):
    chunks = spark.createDataFrame([("a", ["x", "x", "y"]), ("a", ["x"]), ("b", [])], "doc_id string, roots array<string>")
    docs = spark.createDataFrame([("a", 2, ["x", "z", "z"]), ("b", 1, ["q"]), ("c", 0, ["r"])], "doc_id string, n_chunks long, title_roots array<string>")
    out = indexing.document_roots(chunks, docs)
    assert {(r.doc_id, r.root): r.n for r in out.collect()} == {("a", "x"): 5, ("a", "y"): 1, ("a", "z"): 4, ("b", "q"): 1}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_profiles_are_written_without_a_sort():
    assert indexing.BUCKETED["profiles"] == ("idx", [])
