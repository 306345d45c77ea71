import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import suffix_dedup as S


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int)))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges.tolist()))
    return out


def texts_with_repeats(seed, length):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passages = [word(n) for n in (length // 2, length - 2, length - 1, length, length + 1, length + 3, 2 * length, 5 * length)]
    out = [word(rnd.randint(0, 4 * length)) for _ in range(30)]
    for _ in range(60):
        parts = [word(rnd.randint(0, length))]
        for _ in range(rnd.randint(1, 3)):
            p = rnd.choice(passages)
            cut = rnd.randint(0, 3)
            parts += [p[cut:], word(rnd.randint(0, length))]
        out.append("".join(parts))
    out += [out[40], out[40], None, "", "", "a" * (3 * length), "ab" * length, word(20 * length)]
    return out


@pytest.mark.parametrize("length", [20, 45])
def test_matches_brute_force(spark, length):
    texts = texts_with_repeats(length, length)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(5)
    got = S.suffix_dedup(df, S.RepeatSettings(length=length, sift_bytes=500, sort_bytes=300)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts, length)


def test_covers_are_perfect():
    for v, members in S.COVERS.items():
        assert {(a - b) % v for a in members for b in members} == set(range(v))


def test_names_do_not_depend_on_segments(monkeypatch):
    data = np.frombuffer(random.Random(3).randbytes(5000), np.uint8)
    at = np.arange(0, 4900)
    want = S.Namer(1, 100).names(data, at, 100)
    monkeypatch.setattr(S, "SEGMENT", 512)
    assert (S.Namer(1, 100).names(data, at, 100) == want).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.suffix_dedup(df).collect() == []
