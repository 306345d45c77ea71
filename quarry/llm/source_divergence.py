"""How the sources of a language differ: divergence of term shares between sources, and the terms that mark a source.

Every text is read once. A task counts its terms and the documents that hold them by (lang, source) and sends them
pre-aggregated; the terms then meet once, dealt by (lang, term). A kept term is one row with its count in every source.

`pair`: a kept term adds f for every two sources of its language, also where it is absent. The terms are dealt into
(lang, block) tasks; a task holds the shares of a batch of terms as a matrix of terms by sources, and emits one sum a pair.

`term`: f grows with the count in the group and falls with the count in the language, so a term dominated by k others
(no lower group count, no higher language count, earlier UTF-8) cannot be among the first k. Each partition keeps its
skyband, the terms dominated by fewer than k; a term dominated by k terms is dominated by k terms of the skyband. The
skybands of all partitions are merged by group, and only what is left is ranked by exact values.

Cases: null text, lang or source counts as ''; a group without kept terms still has its pairs (value 0 if its language
keeps none); ties are broken by UTF-8; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.common import partitions, prepare, stage

#: Terms: letters A-Z in either case and everything outside ASCII; all other bytes part them.
_PARTING = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class AuditSettings:
    min_docs: int = 10
    top: int = 10
    #: Shares are whole parts of ten to this power.
    digits: int = 9
    #: Terms of one pair task, and distinct terms that a counting task holds before it sends them.
    block_terms: int = 65_536
    held_terms: int = 400_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_PARTING).split()


def term_counts(docs: DataFrame, s: AuditSettings, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): partial counts, and a row with a null term for every group a task has seen."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for (g_lang, g_source), (n, d) in held.items():
            keys = list(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([g_lang] * (len(keys) + 1), pa.string()), pa.array([g_source] * (len(keys) + 1), pa.string()),
                pa.array([None, *keys], pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(d[k] for k in keys)], pa.int64()),
            ], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for b in batches:
            for g_lang, g_source, t in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"]):
                n, d = held.setdefault((g_lang, g_source), (Counter(), Counter()))
                size -= len(n)
                found = terms_of(t.as_buffer().to_pybytes())
                n.update(found)
                d.update(set(found))
                size += len(n)
                if size > s.held_terms:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    read = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return docs.select(read(lang).alias("lang"), read(source).alias("source"), read(text).alias("text")).mapInArrow(
        count, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, kept: Column, digits: int) -> Column:
    """p = 1 + floor(10 ** digits * (count + 2) / (total + 2 * kept)), exact."""
    wide = (count + 2).cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, (total + 2 * kept).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _in_skyband(block: list[tuple[int, int, bytes]], k: int, step: int = 256) -> list[tuple[int, int, bytes]]:
    """The (count, lang count, term) rows that fewer than k of the others dominate."""
    block.sort(key=lambda r: (-r[0], r[1], r[2]))
    # earlier rows have no lower count: a row is dominated by those of them that are no worse in the other two
    place = {t: i for i, t in enumerate(sorted({r[2] for r in block}))}
    lows = np.fromiter((r[1] for r in block), np.int64, len(block))
    places = np.fromiter((place[r[2]] for r in block), np.int64, len(block))
    low, at = np.empty_like(lows), np.empty_like(places)
    kept, size = [], 0
    for lo in range(0, len(block), step):
        # what was kept before the step drops most of its rows at once; the others are compared with those of the step
        own_low, own_at = lows[lo:lo + step], places[lo:lo + step]
        before = ((low[:size] <= own_low[:, None]) & (at[:size] < own_at[:, None])).sum(axis=1)
        first = size
        for j in np.flatnonzero(before < k).tolist():
            if before[j] + int(((low[first:size] <= own_low[j]) & (at[first:size] < own_at[j])).sum()) < k:
                kept.append(block[lo + j])
                low[size], at[size] = own_low[j], own_at[j]
                size += 1
    return kept


def skyband(terms: DataFrame, k: int, hold: int = 4096) -> DataFrame:
    """(lang, source, term, n, lang_n) -> the rows of each partition that fewer than k terms of their group dominate."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("lang_n", pa.int64())])

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, limit = {}, {}
        for b in batches:
            columns = (b[c].to_pylist() for c in ("lang", "source", "term", "n", "lang_n"))
            for g_lang, g_source, term, n, lang_n in zip(*columns):
                g = (g_lang, g_source)
                rows = held.setdefault(g, [])
                rows.append((n, lang_n, term.encode()))
                # filtered again only after it has grown by half, so the work stays in proportion
                if len(rows) >= limit.get(g, hold):
                    held[g] = _in_skyband(rows, k)
                    limit[g] = max(hold, len(held[g]) * 3 // 2)
        for (g_lang, g_source), rows in held.items():
            rows = _in_skyband(rows, k)
            yield pa.RecordBatch.from_arrays([
                pa.array([g_lang] * len(rows), pa.string()), pa.array([g_source] * len(rows), pa.string()),
                pa.array([r[2] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
            ], schema=schema)

    return terms.select(schema.names).mapInArrow(filtered, "lang string, source string, term string, n long, lang_n long")


def kept_terms(counts: DataFrame, s: AuditSettings) -> DataFrame:
    """(lang, term, lang_n, by array<struct<source, n>>) of the terms that enough documents of their language hold."""
    per_group = counts.where("term is not null").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    per_term = per_group.groupBy("lang", "term").agg(
        F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by"))
    return per_term.where(F.col("docs") >= s.min_docs).select("lang", "term", "lang_n", "by")


def group_totals(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, group_n, lang_n, kept_terms) of every occurring group."""
    groups = counts.where("term is null").select("lang", "source").distinct()
    sums = kept.select("lang", F.explode("by").alias("b")).groupBy("lang", F.col("b.source").alias("source")).agg(F.sum("b.n").alias("group_n"))
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_n"), F.count("*").alias("kept_terms"))
    known = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    return known.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("group_n", "lang_n", "kept_terms")])


def pair_divergence(kept: DataFrame, totals: DataFrame, s: AuditSettings) -> DataFrame:
    """(lang, source, item, value): for every two sources of a language the sum of f over all kept terms.

    The result has a row for every ordered pair of sources, so the sources of one language are taken to fit one row.
    """
    spark = kept.sparkSession
    langs = totals.groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("source", "group_n"))).alias("sources"), F.first("kept_terms").alias("v"))
    langs = stage(langs, "audit-langs")
    blocks = max(1, -(-(langs.agg(F.max("v")).first()[0] or 0) // s.block_terms))
    dealt = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), "by").join(langs, "lang")
    dealt = dealt.repartition(min(blocks * 16, max(partitions(spark), blocks)), "lang", "block").sortWithinPartitions("lang", "block")
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def shares(n: np.ndarray, low: np.ndarray) -> np.ndarray:
        """1 + floor(10 ** digits * n / low) digit by digit, so that nothing leaves 64 bits; n <= low."""
        p, rest = n // low, n % low
        for _ in range(s.digits):
            p, rest = p * 10 + rest * 10 // low, rest * 10 % low
        return 1 + p

    def rows(name: str, sources: list[str], total: np.ndarray) -> pa.RecordBatch:
        a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
        own = pa.array(sources, pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(a), pa.string()), own.take(pa.array(a)), own.take(pa.array(b)), pa.array(total[a, b], pa.int64())], schema=schema)

    def none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, sources in zip(b["lang"].to_pylist(), b["sources"].to_pylist()):
                yield rows(name, [x["source"] for x in sources], np.zeros((len(sources),) * 2, np.int64))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sources, place, low, total = None, [], {}, None, None
        for b in batches:
            keys = list(zip(b["lang"].to_pylist(), b["block"].to_pylist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if keys[i] != at:
                    if at is not None:
                        yield rows(at[0], sources, total)
                    at = keys[i]
                    own = b["sources"][i].as_py()
                    sources, place = [x["source"] for x in own], {x["source"]: k for k, x in enumerate(own)}
                    low = np.array([x["group_n"] + 2 * b["v"][i].as_py() for x in own], np.int64)
                    total = np.zeros((len(own),) * 2, np.int64)
                counts = np.zeros((j - i, len(sources)), np.int64)
                for k, by in enumerate(b["by"].slice(i, j - i).to_pylist()):
                    for x in by:
                        counts[k, place[x["source"]]] = x["n"]
                p = shares(counts + 2, low)
                for k in range(len(sources)):
                    q = p[:, k : k + 1]
                    total[k] += ((p - q) ** 2 // (p + q)).sum(axis=0)
        if at is not None:
            yield rows(at[0], sources, total)

    columns = "lang string, source string, item string, value long"
    found = langs.mapInArrow(none, columns).unionByName(dealt.mapInArrow(summed, columns))
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def marking_terms(kept: DataFrame, totals: DataFrame, s: AuditSettings) -> DataFrame:
    """(lang, source, item, value): the skyband of every group, with the exact values of its terms above the language's share."""
    spark = kept.sparkSession
    rows = kept.select("lang", "term", "lang_n", F.explode("by").alias("b")).select("lang", "b.source", "term", "b.n", "lang_n")
    merged = skyband(rows, s.top).repartition(partitions(spark), "lang", "source").sortWithinPartitions("lang", "source")
    last = skyband(merged, s.top)
    n = totals.select("lang", "source", "group_n", F.col("lang_n").alias("all_n"), "kept_terms")
    v = F.col("kept_terms")
    valued = last.join(n, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        share(F.col("n"), F.col("group_n"), v, s.digits).alias("p"), share(F.col("lang_n"), F.col("all_n"), v, s.digits).alias("q"))
    return valued.where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, s: AuditSettings = AuditSettings(), text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank)."""
    prepare(docs.sparkSession)
    counts = stage(term_counts(docs, s, text, lang, source), "audit-counts")
    kept = stage(kept_terms(counts, s), "audit-terms")
    totals = stage(group_totals(counts, kept), "audit-totals")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    parts = pair_divergence(kept, totals, s).withColumn("part", F.lit("pair")).unionByName(
        marking_terms(kept, totals, s).withColumn("part", F.lit("term")))
    out = parts.withColumn("rank", F.row_number().over(ranked)).where((F.col("part") == "pair") | (F.col("rank") <= s.top))
    return out.select("lang", "source", "part", "item", "value", "rank")
