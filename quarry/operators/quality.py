"""Retrieval quality against passages planted in the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.text import let

PROBE_WORDS = 4
PROBE_CHARS = 3


def _runs(text: Column, unit: str, n: Column | int) -> Column:
    """Distinct hashes of all n-unit runs of `text`; units are the matches of `unit`."""
    n = F.lit(n) if isinstance(n, int) else n

    def runs(w: Column) -> Column:
        starts = F.when((F.size(w) >= n) & (n > 0), F.sequence(F.lit(1), F.size(w) - n + 1))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), "\x1f"), n))

    return F.array_distinct(let(F.regexp_extract_all(text, F.lit(unit), F.lit(0)), runs))


def planted_pairs(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, doc_id) of documents whose text contains the whole question text.

    The containment test is only run on pairs sharing the question's rarest run, found by an
    equi-join, never on all pairs. A run is PROBE_WORDS words strictly inside the question, as those
    are whole words of the document too; a question with fewer inner words is probed by its
    characters, three at a time (all of them if it is shorter). A blank question has no pair.
    """
    word, char = r"[^\s]+", r"(?s)."
    inner = F.regexp_replace("query", r"^\S*\s+|\s+\S*$", "")
    long_enough = F.size(F.regexp_extract_all(inner, F.lit(word), F.lit(0))) >= PROBE_WORDS
    asked = queries.filter(F.trim("query") != "").select("qid", "query", F.when(long_enough, 0).otherwise(
        F.least(F.length("query"), F.lit(PROBE_CHARS))).alias("n"), inner.alias("inner"))
    probes = asked.select("qid", "query", "n", F.explode(
        F.when(F.col("n") == 0, _runs(F.col("inner"), word, PROBE_WORDS)).otherwise(_runs(F.col("query"), char, F.col("n")))
    ).alias("g"))
    used = sorted(r.n for r in probes.select("n").distinct().collect())  # at most four
    if not used:
        return documents.select(F.lit(0).cast("long").alias("qid"), "doc_id").limit(0)
    own = [_runs(F.col("content"), char, n) if n else _runs(F.col("content"), word, PROBE_WORDS) for n in used]
    grams = documents.select("doc_id", F.explode(F.concat(*[F.coalesce(x, F.array().cast("array<bigint>")) for x in own])).alias("g"))
    grams = grams.join(probes.select("g").distinct(), "g")
    shared = grams.groupBy("g").agg(F.count("*").alias("df"))
    rarest = probes.join(shared, "g").groupBy("qid", "query").agg(F.min(F.struct("df", "g")).alias("m")).select(
        "qid", "query", F.col("m.g").alias("g")
    )
    pairs = grams.join(rarest, "g").select("qid", "query", "doc_id").distinct()
    return (
        documents.select("doc_id", "content").join(pairs, "doc_id")
        .filter(F.contains("content", F.col("query"))).select("qid", "doc_id").distinct()
    )


def retrieval_quality(pairs: DataFrame, hits: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(qid, planted, found, reciprocal_rank); with `queries`, also the questions planted nowhere."""
    best = hits.groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"))
    if queries is not None:
        pairs = queries.select("qid").join(pairs, "qid", "left")
    return pairs.join(best, ["qid", "doc_id"], "left").groupBy("qid").agg(
        F.count("doc_id").cast("long").alias("planted"),
        F.count("rank").cast("long").alias("found"),
        F.round(F.coalesce(F.max(1.0 / F.col("rank")), F.lit(0.0)), 6).alias("reciprocal_rank"),
    )
