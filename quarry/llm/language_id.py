"""Language identification by hierarchical discrimination.

A linear model predicts the language family; within the family, one-versus-one linear support
vector machines vote for the language. Features are the hashed 1- to 3-byte runs of the whole
lower-cased text, square-rooted and normalised. The machines are trained on at most
`sample_per_language` different labelled rows of each language (and `sample_total` in all): the ones with
the smallest hash of id and text. Only those vectors come to the driver; texts never do.

Cases: `und` with score 0 for a null text, a text without a letter, or when nothing was learned;
one learned language is always predicted; rows without lang are predicted but not learned from; a
null doc_id counts as an empty string; repeated rows are predicted alike; extra columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import prepare, scratch

#: Families of common languages; any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en is nl no sv",
    "romance": "ca es fr gl it pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
}
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageSettings:
    dimensions: int = 2048
    sample_per_language: int = 1000
    sample_total: int = 8000
    folds: int = 5
    epochs: int = 40
    regularisation: float = 1e-4


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang in members.split()), lang)


def features(text: str, dimensions: int, chunk: int = 1 << 20) -> np.ndarray:
    data = text.lower().encode()
    counts = np.zeros(dimensions, np.int64)
    for at in range(0, len(data), chunk):
        b = np.frombuffer(data[max(at - 2, 0) : at + chunk], np.uint8).astype(np.uint32)
        for width in (1, 2, 3):
            lead = min(at, 2) - (width - 1)  # runs that end in this chunk
            h = np.zeros(max(len(b) - width + 1, 0), np.uint32)
            for i in range(width):
                h = h * np.uint32(0x01000193) ^ b[i : len(b) - width + 1 + i]
            h = h[max(lead, 0) :] * np.uint32(0x9E3779B1)
            counts += np.bincount((h >> np.uint32(16)) % dimensions, minlength=dimensions)
    v = np.sqrt(counts).astype(np.float32)
    return v / max(float(np.linalg.norm(v)), 1e-9)


def hinge_machine(x: np.ndarray, y: np.ndarray, s: LanguageSettings) -> tuple[np.ndarray, float]:
    """Linear support vector machine by averaged mini-batch subgradient steps; y is +1 or -1."""
    rng = np.random.default_rng(7)
    w, b = np.zeros(x.shape[1], np.float64), 0.0
    mean_w, mean_b, step = np.zeros_like(w), 0.0, 0
    cost = np.where(y > 0, len(y) / (2 * max((y > 0).sum(), 1)), len(y) / (2 * max((y < 0).sum(), 1)))
    for epoch in range(s.epochs):
        order = rng.permutation(len(y))
        rate = 2.0 / (1 + 0.2 * epoch)
        for at in range(0, len(y), 64):
            i = order[at : at + 64]
            bad = y[i] * (x[i] @ w + b) < 1
            pull = (y[i] * cost[i] * bad) / len(i)
            w += rate * (pull @ x[i] - s.regularisation * w)
            b += rate * 0.1 * pull.sum()
            if epoch >= s.epochs // 2:
                step += 1
                mean_w += (w - mean_w) / step
                mean_b += (b - mean_b) / step
    return mean_w, mean_b


@dataclass
class LanguageModel:
    langs: list[str]
    families: list[str]
    weights: np.ndarray
    biases: np.ndarray
    family_pairs: list[tuple[str, str]]
    lang_pairs: dict[str, list[tuple[str, str]]]
    rows: dict[tuple[str, str], int]

    def _vote(self, margins: np.ndarray, names: list[str], pairs: list[tuple[str, str]], tag: str) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        votes, least = dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for a, b in pairs:
            p = 1 / (1 + np.exp(-3 * margins[self.rows[(f"{tag}{a}", f"{tag}{b}")]]))
            votes[a] += (p > 0.5) + 1e-3 * p
            votes[b] += (p <= 0.5) + 1e-3 * (1 - p)
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        best = max(names, key=lambda n: (votes[n], n))
        return best, float(least[best])

    def predict(self, text: str | None, s: LanguageSettings) -> tuple[str, float]:
        if text is None or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0
        margins = self.weights @ features(text, s.dimensions) + self.biases if len(self.weights) else self.biases
        family, p = self._vote(margins, self.families, self.family_pairs, "family:")
        members = [x for x in self.langs if family_of(x) == family]
        lang, q = self._vote(margins, members, self.lang_pairs[family], "")
        return lang, min(1.0, max(0.0, p * q))


def fit(vectors: np.ndarray, labels: list[str], s: LanguageSettings) -> LanguageModel:
    langs = sorted(set(labels))
    families = sorted({family_of(x) for x in langs})
    y = np.array(labels)
    fam = np.array([family_of(x) for x in labels])
    weights, biases, rows = [], [], {}

    def machine(name: tuple[str, str], a: np.ndarray, b: np.ndarray) -> None:
        i = np.flatnonzero(a | b)
        w, c = hinge_machine(vectors[i].astype(np.float64), np.where(a[i], 1.0, -1.0), s)
        rows[name] = len(weights)
        weights.append(w)
        biases.append(c)

    family_pairs = list(combinations(families, 2))
    for a, b in family_pairs:
        machine((f"family:{a}", f"family:{b}"), fam == a, fam == b)
    lang_pairs = {f: list(combinations([x for x in langs if family_of(x) == f], 2)) for f in families}
    for pairs in lang_pairs.values():
        for a, b in pairs:
            machine((a, b), y == a, y == b)
    w = np.array(weights, np.float32).reshape(len(weights), vectors.shape[1])
    return LanguageModel(langs, families, w, np.array(biases, np.float32), family_pairs, lang_pairs, rows)


def held_out(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def train(docs: DataFrame, s: LanguageSettings, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LanguageModel:
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l"), F.col(f"`{doc_id}`").cast("string").alias("i"))
    rows = rows.where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("i"), s.folds))
    place = F.shiftrightunsigned(F.xxhash64("t"), 1).alias("place")
    # different texts of each language, by sketches: copies of a text share its hash, whatever their ids
    sizes = {r.l: r.n for r in rows.select("l", place).groupBy("l").agg(F.approx_count_distinct("place", 0.02).alias("n")).collect()}
    if not sizes:
        return fit(np.zeros((0, s.dimensions), np.float32), [], s)
    cap = max(1, min(s.sample_per_language, s.sample_total // len(sizes)))
    # hash thresholds that leave about cap rows of each language; the smallest hashes are taken
    whole = (1 << 63) - 1
    shares = F.create_map(*[F.lit(x) for l, n in sorted(sizes.items()) for x in (l, int(whole * min(1.0, (1.2 * cap + 20) / n)) if n > 1.2 * cap + 20 else whole)])
    dims = s.dimensions

    @F.arrow_udf("binary")
    def vector(col: pa.Array) -> pa.Array:
        return pa.array([features(x, dims).tobytes() if LETTER.search(x) else None for x in col.to_pylist()], pa.binary())

    chosen = rows.select("l", "t", place).where(F.col("place") <= shares[F.col("l")])
    # one of the copies of a text is learned from, so a hot group cannot fill the sample
    got = chosen.dropDuplicates(["l", "place"]).select("l", "place", vector("t").alias("v")).collect()
    taken: dict[str, list] = {}
    for r in sorted((r for r in got if r.v is not None), key=lambda r: (r.l, r.place, r.v)):
        if len(kept := taken.setdefault(r.l, [])) < cap:
            kept.append(np.frombuffer(r.v, np.float32))
    labels = [l for l, vs in taken.items() for _ in vs]
    return fit(np.array([v for vs in taken.values() for v in vs], np.float32).reshape(len(labels), dims), labels, s)


def identify(docs: DataFrame, model: LanguageModel, s: LanguageSettings, text: str = "text") -> DataFrame:
    """`docs` plus one struct column (first free name of `language`): lang_pred, score."""
    prepare(docs.sparkSession)
    (col,) = scratch(docs, "language")

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        got = [model.predict(t, s) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang_pred", "score"])

    return docs.withColumn(col, predict(F.col(f"`{text}`").cast("string")))
