"""Benchmark decontamination in native expressions: SimHash of item-sized windows, then exact similarity.

1. Word shingles of all texts meet the benchmark's shingles; a window reaching the similarity needs
   at least `threshold` of an item's shingle weight, so (text, item) pairs with fewer hits are gone.
2. The remaining pairs' item-sized windows that start at a hit (a best window can always be moved
   there) get a 64-bit SimHash. The fingerprints are cut into radius + 1 blocks; a window is a
   candidate of its item if a block agrees, which no pair within the radius can miss.
3. Candidates within the radius are verified by weighted (multiset) shingle similarity. Where the item or the
   window holds a shingle twice the radius does not count: a repeated shingle moves many bits at once.

Of distinct shingles the radius of 23 bits lies far beyond the distances of windows at 0.8 (mean about 10 bits).

Cases: null and blank texts or items match nothing; an item of fewer than five words is compared by
one shingle of its length; a text shorter than an item is one window; repeated rows return their
matches each; equal items match alike, whatever their item_ids, and a null item_id is
reported like any other; empty tables give an empty result; in `decontaminate` the
columns of the documents pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import WORD, scratch, stage, text_of
from quarry.session import small_side

SHINGLE = 5
BITS = 64
#: A side is broadcast only below this many rows (each of bounded width).
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class LeakSettings:
    threshold: float = 0.8
    radius: int = 23


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def shingles(w: Column, k: int) -> Column:
    """Hashes of all k-word runs of the array column `w` (empty if it is shorter)."""
    at = lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(1, k + 1)])
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), at)).otherwise(
        F.array().cast("array<bigint>")
    )


def simhash(hashes: Column) -> Column:
    """Bit b is set if more than half of the hashes have it."""
    one = lambda b: F.aggregate(
        hashes, F.lit(0), lambda acc, h: acc + F.call_function("getbit", h, b)
    )
    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.when(one(b) * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def blocks(fp: Column, radius: int) -> Column:
    """radius + 1 block keys: block number and the block's bits, so two within the radius share one."""
    n, out, low = radius + 1, [], 0
    for i in range(n):
        wide = BITS // n + (1 if i < BITS % n else 0)
        out.append(F.shiftrightunsigned(fp, low).bitwiseAND((1 << wide) - 1) + F.lit(i << 32))
        low += wide
    return F.array(*out)


def benchmark_items(benchmark: DataFrame, radius: int, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item, item_id, k, n_words, item_hashes, item_fp, item_blocks): staged, one row per item that has a word.

    `item` is the digest of the item's words: unlike item_id it is never null, and equal items share it."""
    df = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), words(text_of(text)).alias("w")).where(F.size("w") > 0)
    df = df.withColumn("k", F.least(F.size("w"), F.lit(SHINGLE)))
    hashes = F.coalesce(*[F.when(F.col("k") == k, shingles(F.col("w"), k)) for k in range(1, SHINGLE + 1)])
    df = df.select(F.md5(F.array_join("w", " ")).alias("item"), "item_id", "k", F.size("w").alias("n_words"), hashes.alias("item_hashes"))
    df = df.withColumn("item_fp", simhash(F.col("item_hashes")))
    return stage(df.withColumn("item_blocks", blocks(F.col("item_fp"), radius)), "items")


def candidate_pairs(docs: DataFrame, items: DataFrame, s: LeakSettings, text: str = "text") -> DataFrame:
    """(key, item_id, starts, item columns): texts (by digest) with enough hits of an item; staged."""
    sizes = [r.k for r in items.select("k").distinct().orderBy("k").collect()]  # at most five
    distinct_hashes = items.dropDuplicates(["item"]).select("item", "k", "n_words", F.size("item_hashes").alias("weight"), F.explode(F.array_distinct("item_hashes")).alias("h"))
    n_hashes = distinct_hashes.count()
    t = text_of(text)
    base = docs.select(F.md5(t).alias("key"), words(t).alias("w"))
    hits = None
    for k in sizes:
        own = distinct_hashes.where(F.col("k") == k).select("h", "item", "n_words", "weight")
        found = (
            base.select("key", F.size("w").alias("m"), F.posexplode(shingles(F.col("w"), k)).alias("pos", "h"))
            .join(small_side(own, n_hashes, BROADCAST_ROWS), "h")
            .select("key", "item", "n_words", "weight", "m", "pos")
        )
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = base.select("key", *[F.lit(0).alias(c) for c in ("item", "n_words", "weight", "m", "pos")]).limit(0)
    start = F.greatest(F.least(F.col("pos"), F.col("m") - F.col("n_words")), F.lit(0))
    per = hits.distinct().groupBy("key", "item", "weight", "n_words").agg(
        F.array_sort(F.collect_set("pos")).alias("hits"), F.array_sort(F.collect_set(start)).alias("starts")
    )
    # c shared of a window's and an item's weights: c / (|W| + |I| - c) >= t needs c >= t * |I|
    need = F.ceil(F.col("weight") * s.threshold - 1e-9)
    enough = F.filter("starts", lambda b: F.size(F.filter("hits", lambda p: (p >= b) & (p < b + F.col("weight")))) >= need)
    per = per.where(F.size("hits") >= need).select("key", "item", enough.alias("starts")).where(F.size("starts") > 0)
    return stage(per.join(items, "item"), "pairs")


def _verified(own: DataFrame, sizes: list[int], s: LeakSettings) -> DataFrame:
    """`own` (w, starts, k, item_hashes, item_fp, item_blocks) plus `best`, the best verified window or null.

    Every step is a column of its own, so that no fingerprint is computed twice."""
    own = own.withColumn("h", F.coalesce(*[F.when(F.col("k") == k, shingles(F.col("w"), k)) for k in sizes]))
    own = own.withColumn("windows", F.transform("starts", lambda b: F.slice("h", b + 1, F.size("item_hashes"))))
    own = own.withColumn("fps", F.transform("windows", simhash))
    count = lambda xs, h: F.size(F.filter(xs, lambda x: x == h))
    shared = lambda window: F.aggregate(
        F.array_distinct("item_hashes"), F.lit(0), lambda acc, h: acc + F.least(count(F.col("item_hashes"), h), count(window, h))
    )
    repeats = lambda xs: F.size(F.array_distinct(xs)) < F.size(xs)
    own = own.withColumn(
        "near",
        F.filter(
            F.arrays_zip("starts", "windows", "fps"),
            lambda z: repeats(F.col("item_hashes")) | repeats(z.windows)
            | (F.arrays_overlap(blocks(z.fps, s.radius), F.col("item_blocks")) & (F.bit_count(z.fps.bitwiseXOR(F.col("item_fp"))) <= s.radius)),
        ),
    )
    own = own.withColumn("common", F.transform("near", lambda z: shared(z.windows)))
    scored = F.transform(
        F.arrays_zip("near", "common"),
        lambda z: F.struct(
            (z.common / (F.size(z.near.windows) + F.size("item_hashes") - z.common)).alias("similarity"),
            (-z.near.starts).alias("before"),
            F.bit_count(z.near.fps.bitwiseXOR(F.col("item_fp"))).alias("hamming"),
        ),
    )
    return own.withColumn("best", F.array_max(F.filter(scored, lambda x: x.similarity >= s.threshold)))


def verified_pairs(docs: DataFrame, benchmark: DataFrame, s: LeakSettings, text: str = "text") -> DataFrame:
    """(key, item_id, start_word, n_words, hamming, similarity), one row for every leaked item of a text digest; staged.

    The verdicts are written before they are filtered: a filter above would be pushed below the
    steps, and compute each of them anew inside the next."""
    items = benchmark_items(benchmark, s.radius)
    sizes = [r.k for r in items.select("k").distinct().orderBy("k").collect()] or [SHINGLE]  # at most five
    pairs = candidate_pairs(docs, items, s, text)
    side = small_side(pairs, pairs.count(), BROADCAST_ROWS)
    t = text_of(text)
    own = docs.select(F.md5(t).alias("key"), t.alias("body")).join(side, "key").withColumn("w", words(F.col("body")))
    judged = stage(_verified(own, sizes, s).select("key", "item_id", "n_words", F.size("w").alias("m"), "best"), "judged")
    return judged.where(F.col("best").isNotNull()).select(
        "key", "item_id", (-F.col("best.before")).alias("start_word"), F.least("n_words", "m").alias("n_words"),
        F.col("best.hamming").alias("hamming"), F.col("best.similarity").alias("similarity"),
    ).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, s: LeakSettings = LeakSettings(), text: str = "text") -> DataFrame:
    """Rows of `docs` times their leaked items: the document's columns and one struct column `leak`
    (item_id, start_word, n_words, hamming, similarity) for the best window of each item."""
    found = stage(verified_pairs(docs, benchmark, s, text), "leaks")
    (leak,) = scratch(docs, "leak")
    side = small_side(found.select(F.struct("*").alias(leak)), found.count(), BROADCAST_ROWS)
    joined = docs.join(side, F.md5(text_of(text)) == F.col(f"{leak}.key"))
    return joined.withColumn(leak, F.col(leak).dropFields("key"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, s: LeakSettings = LeakSettings(), text: str = "text") -> DataFrame:
    """The rows of `docs` whose text holds no leaked item."""
    (leaked,) = scratch(docs, "leaked")
    bad = stage(verified_pairs(docs, benchmark, s, text).select(F.col("key").alias(leaked)).distinct(), "leaked")
    side = small_side(bad, bad.count(), BROADCAST_ROWS)
    return docs.join(side, F.md5(text_of(text)) == F.col(f"`{leaked}`"), "left_anti")
