"""Centroid clusters, source divergence and the Jaccard join against brute force, with nulls, ties, repeats and clashing names."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import centroid_clusters, jaccard_join, source_divergence
from quarry.llm.centroid_clusters import ClusterSettings
from quarry.llm.jaccard_join import JoinSettings
from quarry.llm.source_divergence import AuditSettings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- centroid clusters ------------------------------------------------------------


def naive_clusters(rows, s):
    kept = [(i, [math.floor(s.scale * float(np.float32(x))) for x in e]) for i, e in rows
            if e is not None and len(e) == s.dimensions and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{s.seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[: s.clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(s.rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k])] if k in groups else c for k, c in enumerate(centroids)]
    out = [(i, nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, (d, k) in out:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for i, (d, k) in out)


def vectors(n=300, dims=5, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=dims) + 3 * rng.integers(0, 3, dims))]) for i in rng.permutation(n)]
    return rows + [rows[0], rows[1], (7, rows[2][1]), (None, rows[3][1]), (None, [0.0] * dims), (901, None), (902, []), (903, [1.0] * (dims + 1)),
                   (904, [float("nan")] + [1.0] * (dims - 1)), (905, [float("inf")] * dims), (906, [None] * dims), (907, [-0.0001] * dims)]


@pytest.mark.parametrize("clusters", [1, 3, 8])
def test_clusters_against_brute_force(spark, clusters):
    s = ClusterSettings(clusters=clusters, dimensions=5, rounds=4)
    rows = vectors()
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<float>, cluster int, v string").repartition(3)
    got = centroid_clusters.clustered(df, s)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == naive_clusters(rows, s)


def test_threshold_walk_keeps_ties_and_the_smaller_number():
    rng = np.random.default_rng(1)
    for _ in range(50):
        k, d = int(rng.integers(1, 9)), int(rng.integers(1, 7))
        c, x = rng.integers(-3, 4, (k, d)), rng.integers(-4, 5, (60, d))
        exact = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        best, distance = centroid_clusters.nearest(x.astype(np.int64), c.astype(np.int64))
        assert (best == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_clusters_of_few_huge_and_no_vectors(spark):
    s = ClusterSettings(dimensions=2)
    df = spark.createDataFrame([(1, [1e30, 0.0]), (2, [1e30, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.distance) for r in centroid_clusters.clustered(df, s).orderBy("vec_id").collect()] == [(1, 0), (2, 0)]
    assert centroid_clusters.clustered(df.limit(0), s).collect() == []


# --- source divergence -----------------------------------------------------------


def naive_audit(rows, s):
    docs = [((t or ""), (la or ""), (so or "")) for t, la, so in rows]
    held, count = defaultdict(Counter), defaultdict(Counter)
    for t, la, so in docs:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
        held[la].update(set(terms))
        count[la, so].update(terms)
    out = Counter()
    for la in {la for la, _ in count}:
        kept = sorted((t for t, n in held[la].items() if n >= s.min_docs), key=str.encode)
        sources = {so: c for (x, so), c in count.items() if x == la}

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**s.digits * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        whole = shares(sum(sources.values(), Counter()))
        p = {so: shares(c) for so, c in sources.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for so, c in sources.items():
            pair = sorted(((-sum(f(p[so][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != so))
            term = sorted((-f(p[so][t], whole[t]), t.encode(), t) for t in kept if c[t] and p[so][t] > whole[t])[: s.top]
            for part, ranked in (("pair", pair), ("term", term)):
                out.update((la, so, part, x, -v, k) for k, (v, _, x) in enumerate(ranked, 1))
    return out


def audited():
    rng = np.random.default_rng(2)
    vocabulary = ["Alpha", "beta", "gÄmma", "delta", "ε", "x1y", "zeta", "eta", "theta", "iota", "né", "𝔘", "kappa", "lam-bda"]
    rows = []
    for k in range(400):
        so = ["s0", "s0", "s1", "S2", None, "é"][int(rng.integers(6))]
        shift = hash_of(so) % 5
        rows.append((" ".join(vocabulary[int(x) % len(vocabulary)] for x in rng.geometric(0.2, 12) + shift), ["en", "de", None][k % 3], so))
    return rows + [(None, "en", "bare"), ("", "fr", "s0"), ("12 34", "fr", "s1"), ("alone", "xx", "one"), ("alone", "", "s0")] + rows[:3]


def hash_of(x):
    return int(hashlib.md5(str(x).encode()).hexdigest(), 16)


@pytest.mark.parametrize("s", [AuditSettings(min_docs=4, top=3), AuditSettings(min_docs=10, held_terms=3, block_terms=4)])
def test_audit_against_brute_force(spark, s):
    rows = audited()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n int, term string").repartition(4)
    assert Counter(map(tuple, source_divergence.audit(df, s).collect())) == naive_audit(rows, s)


def test_skyband_holds_what_fewer_than_k_dominate():
    rng = np.random.default_rng(5)
    for k in (1, 2, 5):
        rows = [(int(a), int(b), f"t{i}".encode()) for i, (a, b) in enumerate(rng.integers(0, 9, (120, 2)))]
        better = lambda x, y: x[0] >= y[0] and x[1] <= y[1] and x[2] < y[2]
        assert set(source_divergence._in_skyband(list(rows), k)) == {r for r in rows if sum(better(o, r) for o in rows) < k}


def test_audit_of_an_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert source_divergence.audit(df).collect() == []


def test_a_long_text_is_counted_whole(spark):
    rows = [("word " * 400_000 + "tail", "en", "a"), ("tail word", "en", "b")]
    s = AuditSettings(min_docs=1)
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert Counter(map(tuple, source_divergence.audit(df, s).collect())) == naive_audit(rows, s)


# --- Jaccard join ------------------------------------------------------------------


def shingle_set(text, k=3):
    ws = WORDS.findall(lowered(text))
    return frozenset(tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))) if ws else frozenset()


def naive_components(rows, percent=90, k=3):
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(x & sets[j])
            if x and 100 * shared >= percent * (len(x) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def near_texts():
    rng = np.random.default_rng(6)
    rows = [(None, "no id here at all"), (1, None), (2, " \n"), (3, "One two"), (4, "one  two\n"), (5, "one"), (6, "é É ß"), (7, "É é ß"), (7, "one two three")]
    passage = " ".join(f"p{i}" for i in range(40))
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, 90)]
        for m in range(14):
            words = list(base)
            for at in rng.choice(len(words), m % 6, replace=False):
                words[at] = f"new{rng.integers(1 << 30)}"
            rows.append((100 * g + 10 + m, " ".join(words)))
        rows += [(100 * g + 50, passage + " " + " ".join(base[:30])), (100 * g + 51, passage + " " + " ".join(base[30:60])), rows[-1]]
    return rows


@pytest.mark.parametrize("s", [JoinSettings(), JoinSettings(group_nodes=3, counted_tokens=50, sent_tokens=20, frequent_tokens=10)])
def test_jaccard_join_against_all_pairs(spark, s):
    rows = near_texts()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, node string").repartition(4)
    assert Counter(map(tuple, jaccard_join.jaccard_components(df, s).collect())) == naive_components(rows)


def test_jaccard_join_at_the_limit(spark):
    """Sets of 19 and 19 shingles that share 18 have similarity 18/20."""
    words = [f"w{i}" for i in range(21)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join([*words[:-2], "other", "words"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_jaccard_join_of_empty_tables_and_long_texts(spark):
    df = spark.createDataFrame([(1, "a b " * 200_000), (2, "b a " * 200_000), (3, "q r s")], "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()} == {(1, 2, 1), (2, 2, 1), (3, 1, 3)}
    assert jaccard_join.jaccard_components(df.limit(0)).collect() == []
