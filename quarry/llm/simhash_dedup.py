"""SimHash near-duplicates linked through Burkhard-Keller trees.

Fingerprints are reduced to the distinct ones first, so a hot group of copies is one row. Two
fingerprints within three bits agree on one of four 16-bit blocks; a shard holds the fingerprints
that share a block value, and gets its own tree, whose children are keyed by their integer distance
to the parent. A search follows only edges within the radius. A shard above `shard_limit` is dealt
again by four 12-bit parts of its other 48 bits. Within a shard every fingerprint is linked to the
root of its local group (as many links as fingerprints, never all pairs); groups meet in a
distributed components run. The trees lie with their shard instead of being broadcast: the
fingerprints grow with the corpus, and no broadcast of them has a bound.

Cases: a null, empty or blank text has fingerprint zero and links like any other; null doc_ids are
ignored when the smallest is taken (a component of only null ids has a null id); repeated rows
each return a row; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import components, partitions, prepare, scratch, stage, text_of

SEED = 42
SHINGLE = 3
RADIUS = 3
BLOCKS = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, chunk: int = 1 << 16) -> int:
    """Bit b is set if more than half of all word shingles have it in their XXH64 (bytes.lower() lowers A-Z only)."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(words, words[1:], words[2:])]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for i in range(0, len(shingles), chunk):
        h = np.array([digest(s, SEED) for s in shingles[i : i + chunk]], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    set_bits = total * 2 > len(shingles)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def wide_fingerprint(hashes: np.ndarray, bits: int, chunk: int = 1 << 14) -> bytes:
    """The same rule for the 64-bit hashes of a set and any multiple of 64 bits: further words are the hashes mixed again."""
    words = [hashes]
    while 64 * len(words) < bits:
        words.append((words[-1] ^ (words[-1] >> np.uint64(31))) * _MIX)
    wide = np.stack(words, axis=1)
    total = np.zeros(bits, np.int64)
    for i in range(0, len(wide), chunk):
        total += np.unpackbits(wide[i : i + chunk].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(total * 2 > len(hashes), bitorder="little").tobytes()


def fingerprints(text: Column) -> Column:
    @F.arrow_udf("bigint")
    def simhash(col: pa.Array) -> pa.Array:
        got = np.fromiter((fingerprint(x.encode()) for x in col.to_pylist()), np.uint64, len(col))
        return pa.array(got.view(np.int64))

    return simhash(text)


class BKTree:
    """Burkhard-Keller tree over 64-bit integers under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while at != new:
            at = self.children[at].setdefault((value ^ self.values[at]).bit_count(), new)

    def within(self, value: int, radius: int) -> list[int]:
        """Indexes of the stored values at most `radius` bits away."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            todo += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]
        return found


    def nearest(self, value: int, radius: int) -> tuple[int, int] | None:
        """Index and distance of the first of the nearest stored values found within `radius` bits."""
        best, todo = None, [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius and (best is None or d < best[1]):
                best, radius = (at, d), d
            todo += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]
        return best


def local_roots(values: list[int], radius: int) -> list[int]:
    """For each value, the index of the first member of its group (links within `radius`, inside this shard)."""
    tree, parent = BKTree(), list(range(len(values)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            a, b = find(i), find(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.insert(v)
    return [find(i) for i in range(len(values))]


def _link_shards(batches):
    """Batches of (shard, fp) sorted by shard -> links (a, b) of fingerprint to local root."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    current, held = None, []

    def links():
        if len(held) < 2:
            return None
        values = sorted(set(held))
        roots = local_roots([v & 0xFFFFFFFFFFFFFFFF for v in values], RADIUS)
        pairs = [(values[i], values[r]) for i, r in enumerate(roots) if i != r]
        if not pairs:
            return None
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], schema=schema)

    for batch in batches:
        for shard, fp in zip(batch["shard"].to_pylist(), batch["fp"].to_pylist()):
            if shard != current:
                if (out := links()) is not None:
                    yield out
                current, held = shard, []
            held.append(fp)
    if (out := links()) is not None:
        yield out


def fingerprint_links(distinct_fps: DataFrame, shard_limit: int = 2048) -> DataFrame:
    """Links (a, b) that connect every two of the distinct `fp` within the radius, directly or through others."""
    spark = distinct_fps.sparkSession
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)
    blocks = distinct_fps.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), block(i).alias("v")) for i in range(BLOCKS)])).alias("s")
    ).select("fp", (F.col("s.i") * F.lit(1 << 16) + F.col("s.v")).alias("block"))
    large = blocks.groupBy("block").count().where(F.col("count") > shard_limit).select("block", F.lit(True).alias("large"))
    dealt = blocks.join(large, "block", "left")
    # the other 48 bits, moved together: what lies above the block, then what lies below it
    below = F.expr("fp & (shiftleft(1L, cast((block >> 16) * 16 as int)) - 1)")
    above = F.expr("case when (block >> 16) = 3 then 0L else shiftrightunsigned(fp, cast((block >> 16) * 16 + 16 as int)) end")
    rest = F.expr("shiftleft({}, cast((block >> 16) * 16 as int))".format("rest_above")).bitwiseOR(F.col("rest_below"))
    parts = dealt.withColumn("rest_below", below).withColumn("rest_above", above).withColumn("rest", rest)
    sub = lambda j: F.shiftrightunsigned("rest", 12 * j).bitwiseAND(0xFFF)
    shard = F.when(
        F.col("large"),
        F.array(*[F.col("block") + F.lit((j + 1) << 18) + F.shiftleft(sub(j).cast("long"), 24) for j in range(4)]),
    ).otherwise(F.array(F.col("block").cast("long")))
    shards = parts.select("fp", F.explode(shard).alias("shard"))
    return (
        shards.repartition(partitions(spark), "shard")
        .sortWithinPartitions("shard", "fp")
        .mapInArrow(_link_shards, "a bigint, b bigint")
    )


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """(fp, doc_id) rows -> (fp, root, component_id): the component of every distinct fingerprint."""
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = components(fingerprint_links(nodes.select("fp")))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id."""
    prepare(docs.sparkSession)
    fps = stage(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprints(text_of(text)).alias("fp")), "docfps")
    found = stage(fingerprint_components(fps), "components")
    return fps.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of every near-duplicate group: its smallest doc_id (null last), then the smallest fingerprint; of
    rows alike in both, one. Only the columns of `docs` return."""
    prepare(docs.sparkSession)
    fp, key, want, kid = scratch(docs, "fp", "key", "want", "kid")
    keyed = docs.withColumn(fp, fingerprints(text_of(text))).withColumn(kid, F.col(f"`{doc_id}`"))
    fps = stage(keyed.select(F.col(f"`{kid}`").alias("doc_id"), F.col(f"`{fp}`").alias("fp")), "docfps")
    found = fingerprint_components(fps.distinct())
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("fp").alias("f"))
    chosen = fps.distinct().join(found, "fp").groupBy("root").agg(F.min(order).alias("o"))
    chosen = stage(chosen.select(F.col("o.f").alias(want), F.col("o.id").alias(key)), "kept")
    joined = keyed.join(
        chosen, (F.col(f"`{fp}`") == F.col(f"`{want}`")) & F.col(f"`{kid}`").eqNullSafe(F.col(f"`{key}`"))
    )
    return joined.dropDuplicates([fp, kid]).select(*[F.col(f"`{c}`") for c in docs.columns])
