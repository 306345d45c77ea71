"""Index snapshot: versioned tables, published by one pointer switch.

A version is a list of segments and two tables over all of them. A segment holds the rows of its own documents:

    chunks    idx, doc_seq, doc_id, chunk_number, chunk_id, text, roots   bucketed by idx
    profiles  idx, word/char term ids and counts, hashed bucket counts    bucketed by idx
    docs      doc_id, doc_hash, title, section, url, ..., title_roots, n_chunks
    doc_roots doc_id, root, n
    postings  root, slice, n, low, high, idxs                              bucketed by root
    terms     family, term_id, df, total: what the segment adds to (and its tombstones take from) the counts
    dead      doc_id, doc_seq: tombstones of documents in earlier segments

and over all segments, since inverse document frequencies depend on every document:

    vocab     family, term_id, df, total, idf
    norms     idx, word_norm, char_norm                                   bucketed by idx

A posting block holds the chunks of one slice of the corpus that have the root, ordered by idx, with
their number and range; a root in many chunks is as many blocks as there are slices, never one row.

The three per-chunk tables share one bucketing, so joins and group-bys on `idx`
need no exchange.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.functions.text import root_list
from quarry.operators.chunking import CHUNK_BITS, CHUNKING_VERSION, chunk_documents
from quarry.operators.profiles import profile_of
from quarry.session import drop_stage, materialize, ship_package, shuffles_dropped
from quarry.settings import Settings
from quarry.sources.tables import actual_documents

FORMAT_VERSION = 2
SPARSE_LIBRARY = "spark-tfidf-v1"
HOT_TERM_LIMIT = 500_000
SEGMENT_TABLES = ("chunks", "profiles", "docs", "doc_roots", "postings", "terms", "dead")
GLOBAL_TABLES = ("vocab", "norms")
#: Bucketed tables and the columns that bucket and sort them; profiles keep the order of the chunks they are read from.
BUCKETED = {"chunks": ("idx", ["idx"]), "profiles": ("idx", []), "norms": ("idx", ["idx"]), "postings": ("root", ["root", "slice"])}
BY_CHUNK = ("chunks", "profiles", "norms")
#: Term ids are hashes, which only a dictionary makes short: the n-grams of a bucket are some hundred thousand ids.
WRITE_OPTIONS = {"profiles": {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}}
#: Chunks whose profiles a Python worker holds at once, about 25 KB each.
PROFILE_BATCH = 512


def table_name(version: str, table: str) -> str:
    return f"quarry_{version.replace('-', '_')}_{table}"


@dataclass(frozen=True)
class Snapshot:
    """An immutable index version; queries planned on it keep reading it."""

    spark: SparkSession
    path: str
    manifest: dict
    settings: Settings
    names: dict[str, str] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        """The live rows of a table: every segment's, without those that a later segment has a tombstone for."""
        if name in GLOBAL_TABLES:
            return self.spark.table(self.names[name])
        segments = self.manifest["segments"]
        parts = [self._alive(name, seg, [x for x in segments[i + 1:] if x["dead"]]) for i, seg in enumerate(segments)]
        return reduce(DataFrame.unionByName, parts)

    def _alive(self, name: str, segment: dict, later: list[dict]) -> DataFrame:
        rows = self.spark.table(table_name(segment["version"], name))
        if not later or name in ("terms", "dead"):
            return rows
        dead = reduce(DataFrame.unionByName, [self.spark.table(table_name(x["version"], "dead")) for x in later])
        if name == "profiles":
            return rows.join(dead.select("doc_seq"), F.shiftright("idx", CHUNK_BITS) == F.col("doc_seq"), "left_anti")
        if name != "postings":
            return rows.join(dead.select("doc_id"), "doc_id", "left_anti")
        # a slice has a bounded number of chunks, and so of dead ones
        chunks = self.spark.table(table_name(segment["version"], "chunks")).join(dead.select("doc_id").distinct(), "doc_id", "left_semi")
        gone = chunks.groupBy(posting_slice(segment["slices"]).alias("slice")).agg(F.collect_list("idx").alias("gone"))
        left = rows.join(gone, "slice", "left").withColumn(
            "idxs", F.when(F.col("gone").isNull(), F.col("idxs")).otherwise(F.array_except("idxs", "gone")))
        return left.where(F.size("idxs") > 0).select("root", "slice", *_block_statistics(), "idxs")


class IndexNotReady(FileNotFoundError):
    pass


# --- hadoop-filesystem pointer (works on any shared storage Spark can reach) ---


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _publish_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target, then replace it in one rename."""
    fs, p, jvm = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    array[0] = options
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        p.toUri(), spark._jsc.hadoopConfiguration()
    )
    context.rename(context.makeQualified(tmp), context.makeQualified(p), array)


# --- fingerprints and staleness ---------------------------------------------------


def hash_sums(chunks: DataFrame) -> DataFrame:
    """(rows, h0 .. h3): order-free sums of row hashes; they add up over segments and are taken off for dead rows."""
    row = F.sha2(F.concat_ws("\x1f", "chunk_id", "text"), 256)
    part = [
        F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"h{i}") for i in range(4)
    ]
    return chunks.agg(F.count("*").alias("rows"), *part)


def corpus_hash(chunks: DataFrame) -> DataFrame:
    """Order-free fingerprint: row hashes are summed, nothing is collected."""
    parts = [F.col(f"h{i}").cast("string") for i in range(4)]
    return hash_sums(chunks).select("rows", F.sha2(F.concat_ws(":", *parts), 256).alias("corpus_hash"))


def expected_manifest(source_key: str, s: Settings) -> dict:
    return {
        "format_version": FORMAT_VERSION,
        "source_key": source_key,
        "chunking_version": CHUNKING_VERSION,
        "chunk_size_chars": s.chunk_size_chars,
        "chunk_overlap_chars": s.chunk_overlap_chars,
        "embedding_backend": s.embedding_backend,
        "embedding_model": s.embedding_model,
        "embedding_dimension": s.embedding_dimension,
        "char_vocabulary_size": s.char_vocabulary_size,
        "sparse_library": SPARSE_LIBRARY,
    }


def stale_fields(manifest: dict, source_key: str, s: Settings) -> list[str]:
    return [k for k, v in expected_manifest(source_key, s).items() if manifest.get(k) != v]


# --- relational pieces, usable on their own -----------------------------------------


def term_rows(profiles: DataFrame, family: str) -> DataFrame:
    """(idx, term_id, tf) of one family."""
    zipped = F.arrays_zip(F.col(f"{family}_ids").alias("t"), F.col(f"{family}_tfs").alias("n"))
    return profiles.select("idx", F.explode(zipped).alias("z")).select(
        "idx", F.col("z.t").alias("term_id"), F.col("z.n").alias("tf")
    )


def idf(n_chunks: int):
    return F.log((1.0 + n_chunks) / (1.0 + F.col("df"))) + 1.0


def term_stats(profiles: DataFrame) -> DataFrame:
    """(family, term_id, df, total) of all terms."""

    def stats(family: str) -> DataFrame:
        counted = term_rows(profiles, family).groupBy("term_id").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("total"))
        return counted.select(F.lit(family).alias("family"), "term_id", "df", "total")

    return stats("word").unionByName(stats("char"))


def added_up(terms: DataFrame, segments: int = 2) -> DataFrame:
    """Signed term statistics of several segments as one, without the terms that no live chunk has; one segment's are sums already."""
    if segments == 1:
        return terms.select("family", "term_id", "df", "total").where("df > 0")
    return terms.groupBy("family", "term_id").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where("df > 0")


def vocabulary(terms: DataFrame, n_chunks: int, s: Settings) -> DataFrame:
    """Document frequency, total count and smoothed idf; char terms keep the top-N by count."""
    known = terms.select("family", "term_id", "df", "total", idf(n_chunks).alias("idf"))
    char = known.where("family = 'char'").orderBy(F.desc("total"), "term_id").limit(s.char_vocabulary_size)
    return known.where("family = 'word'").unionByName(char)


def sublinear(tf):
    return 1.0 + F.log(tf.cast("double"))


#: Occurrences of rare words that meet their vocabulary at once, and those that a task packs at once (20 bytes each).
JOINED_OCCURRENCES, PACKED_OCCURRENCES = 1 << 20, 1 << 21
#: Parts of the rare words that a task joins one after another.
PARTS_OF_TASK = 4
#: Kinds of packets: vocabulary (first of its part), occurrences, and sums that only pass through.
VOCABULARY, OCCURRENCES, SUMS = 0, 1, 2
PACKET = "part int, kind int, body binary"


def _looked_up(flat: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Place of every id among the known (sorted ids, idf), and whether it is there."""
    if not len(known[0]):
        return np.zeros(len(flat), np.int64), np.zeros(len(flat), bool)
    at = np.minimum(np.searchsorted(known[0], flat), len(known[0]) - 1)
    return at, known[0][at] == flat


def _squares(tfs: np.ndarray, idfs: np.ndarray) -> np.ndarray:
    return ((1.0 + np.log(tfs)) * idfs) ** 2


def _packet(*columns: np.ndarray) -> bytes:
    """Columns of one length; the first bytes of all values, then the second ones and so on, since near values compress."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns]
    return len(columns[0]).to_bytes(8, "little") + b"".join(planes)


def _unpacked(body: bytes, *kinds: type) -> list[np.ndarray]:
    n, at, out = int.from_bytes(body[:8], "little"), 8, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _packets(kind: int, parts: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """(part, kind, body) of rows dealt by their first column, ids, modulo `parts`; in a body the ids ascend and are their differences."""
    ids, *columns = map(np.concatenate, zip(*held))
    part = ids % parts
    order = np.lexsort((ids, part))
    part, ids, columns = part[order], ids[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    bodies = [_packet(np.diff(ids[i:j], prepend=0), *[c[i:j] for c in columns]) for i, j in zip(cuts, cuts[1:])]
    return _rows_of(part[cuts[:-1]], kind, bodies)


def _rows_of(part: np.ndarray, kind: int, bodies: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(part, pa.int32()), pa.array([kind] * len(bodies), pa.int32()), pa.array(bodies, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "kind", "body"])


def _word_packets(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term_id, idf) -> packets."""
    held, n = [], 0
    for b in batches:
        held.append((b["term_id"].to_numpy(), b["idf"].to_numpy()))
        n += b.num_rows
        if n >= PACKED_OCCURRENCES:
            yield _packets(VOCABULARY, parts, held)
            held, n = [], 0
    if n:
        yield _packets(VOCABULARY, parts, held)


def _norm_packets(
    hot: tuple[np.ndarray, np.ndarray], char: tuple[np.ndarray, np.ndarray], parts: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Profiles -> sums of squares over the known terms, and the occurrences of all other words by part."""

    def known_sums(x: pa.RecordBatch, family: str, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        ids = x[f"{family}_ids"]
        row, flat, tfs = ids.value_parent_indices().to_numpy(), ids.flatten().to_numpy(), x[f"{family}_tfs"].flatten().to_numpy()
        at, hit = _looked_up(flat, known)
        sums = np.zeros(x.num_rows)
        if hit.any():
            sums += np.bincount(row[hit], _squares(tfs[hit], known[1][at[hit]]), x.num_rows)
        return sums, (flat[~hit], row[~hit], tfs[~hit])

    held, n = [], 0
    for x in batches:
        idx = x["idx"].to_numpy()
        w, (ids, row, tfs) = known_sums(x, "word", hot)
        c, _ = known_sums(x, "char", char)
        held.append((ids, idx[row], tfs))
        n += len(ids)
        # a chunk without a known term has no norms
        seen = (w > 0) | (c > 0)
        if seen.any():
            yield _rows_of(idx[:1] % parts, SUMS, [_packet(idx[seen], w[seen], c[seen])])
        if n >= PACKED_OCCURRENCES:
            yield _packets(OCCURRENCES, parts, held)
            held, n = [], 0
    if n:
        yield _packets(OCCURRENCES, parts, held)


def _norm_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packets sorted by part and kind -> lists of sums of squares (idx, w, c), of the occurrences that are in the vocabulary."""
    part, words, known = None, [], (np.empty(0, np.int64), np.empty(0))
    found, n = [], 0

    def out() -> pa.RecordBatch:
        idx, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([f[k] for f in found]), len(idx)) for k in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.from_numpy_dtype(x.dtype))) for x in (idx, *sums)], ["idx", "w", "c"])

    for b in batches:
        for at, kind, body in zip(b["part"].to_pylist(), b["kind"].to_pylist(), b["body"].to_pylist()):
            if at != part:
                part, words, known = at, [], (np.empty(0, np.int64), np.empty(0))
            if kind == VOCABULARY:
                ids, idfs = _unpacked(body, np.int64, np.float64)
                words.append((np.cumsum(ids), idfs))
                continue
            if kind == SUMS:
                found.append(tuple(_unpacked(body, np.int64, np.float64, np.float64)))
            else:
                if words:
                    ids, idfs = map(np.concatenate, zip(*words))
                    order = np.argsort(ids, kind="stable")
                    known, words = (ids[order], idfs[order]), []
                ids, idx, tfs = _unpacked(body, np.int64, np.int64, np.int32)
                place, hit = _looked_up(np.cumsum(ids), known)
                found.append((idx[hit], _squares(tfs[hit], known[1][place[hit]]), np.zeros(int(hit.sum()))))
            n += len(found[-1][0])
            if n >= PACKED_OCCURRENCES:
                yield out()
                found, n = [], 0
    if n:
        yield out()


def chunk_norms(profiles: DataFrame, vocab: DataFrame) -> DataFrame:
    """L2 norms per family.

    Word terms: at most HOT_TERM_LIMIT terms can have df >= occurrences/LIMIT (their
    dfs would add up to more than all occurrences otherwise), so the hot part is
    broadcast with a proven bound and only rare terms are shuffled by term.  A term
    present in a third of all chunks therefore never lands in one task.  The broadcast
    terms, nearly all occurrences, are added up row by row in Arrow batches; the rare
    ones and their vocabulary are packed by part of the ids and meet there, a part of
    about JOINED_OCCURRENCES at a time, so that they are neither exploded nor sorted as rows.
    """
    spark = profiles.sparkSession
    ship_package(spark)
    word_vocab = vocab.filter("family = 'word'").select("term_id", "idf", "df")
    occurrences = word_vocab.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    hot_df = max(2, math.ceil(occurrences / HOT_TERM_LIMIT))
    hot = word_vocab.filter(F.col("df") >= hot_df).select("term_id", "idf")
    cold = word_vocab.filter(F.col("df") < hot_df).select("term_id", "idf")
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(occurrences / (PARTS_OF_TASK * JOINED_OCCURRENCES)))
    parts = tasks * PARTS_OF_TASK

    def in_order(terms: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = terms.toArrow()
        ids, weights = got["term_id"].to_numpy(), got["idf"].to_numpy()
        order = np.argsort(ids)
        return ids[order], weights[order]

    char = in_order(vocab.filter("family = 'char'").select("term_id", "idf"))
    known = spark.sparkContext.broadcast((in_order(hot), char))

    def pack_profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _norm_packets(*known.value, parts, batches)

    def pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _word_packets(parts, batches)

    lists = profiles.select("idx", "word_ids", "word_tfs", "char_ids", "char_tfs")
    packets = cold.mapInArrow(pack_words, PACKET).unionByName(lists.mapInArrow(pack_profiles, PACKET))
    met = packets.repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part", "kind")
    sums = met.mapInArrow(_norm_sums, "idx array<long>, w array<double>, c array<double>")
    rows = sums.select(F.explode(F.arrays_zip("idx", "w", "c")).alias("z")).select("z.*")
    return rows.groupBy("idx").agg(
        F.sqrt(F.sum("w")).alias("word_norm"), F.sqrt(F.sum("c")).alias("char_norm")
    )


def _root_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, lists of (roots in one string, times)), a row a document -> (doc_id, root, n)."""
    for b in batches:
        lists = b["lists"]
        if not len(lists.flatten()):
            continue
        strings, times = lists.flatten().flatten()
        split = pc.split_pattern(strings, ROOT_MARK)
        of, root = split.value_parent_indices().to_numpy(), split.flatten().dictionary_encode()
        size = len(root.dictionary)
        cell, at = np.unique(lists.value_parent_indices().to_numpy()[of] * size + root.indices.to_numpy(), return_inverse=True)
        n = np.bincount(at, times.to_numpy()[of], len(cell)).astype(np.int64)
        row, code = np.divmod(cell, size)
        yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(row)), root.dictionary.take(pa.array(code)), pa.array(n)], ["doc_id", "root", "n"])


#: Stands between the roots of a list; roots are words.
ROOT_MARK = "\x1f"


def document_roots(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, root, n): text roots of every chunk plus the title roots once per chunk.

    The lists of a document meet in one row, each as one string, and are counted there: no table of all documents' roots is held.
    """
    text = chunks.select("doc_id", "roots", F.lit(1).cast("long").alias("n"))
    title = docs.where("n_chunks > 0").select("doc_id", F.col("title_roots").alias("roots"), F.col("n_chunks").alias("n"))
    lists = text.unionByName(title).where(F.size("roots") > 0)
    entry = F.struct(F.array_join("roots", ROOT_MARK).alias("roots"), "n")
    kind = chunks.schema["doc_id"].dataType.simpleString()
    return lists.groupBy("doc_id").agg(F.collect_list(entry).alias("lists")).mapInArrow(_root_counts, f"doc_id {kind}, root string, n long")


def document_hash() -> Column:
    """Digest of everything that a document's rows are made of."""
    fields_of = ("version", "title", "section", "section_id", "content", "url", "updated_at")
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in fields_of]), {"ignoreNullFields": "false"}), 256)


def document_dimension(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return documents.join(counts, "doc_id", "left").select(
        "doc_id", "doc_seq", "version", "title", "section", "section_id", "url", "updated_at",
        "is_actual", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"),
        root_list(F.col("title")).alias("title_roots"),
        F.array_distinct(root_list(F.coalesce("section", F.lit("")))).alias("section_roots"),
        "doc_hash",
    )


def posting_slice(slices: int) -> Column:
    return F.pmod(F.xxhash64("idx"), F.lit(slices)).cast("int")


def _block_statistics() -> list[Column]:
    return [F.size("idxs").alias("n"), F.array_min("idxs").alias("low"), F.array_max("idxs").alias("high")]


#: Postings that a task packs into blocks at once, about 100 MB while they are sorted.
PACKED_POSTINGS = 1 << 20


def _partial_blocks(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(idx, slice, roots) -> (root, slice, idxs): the blocks of these chunks alone."""
    rows = pa.Table.from_batches(batches)
    roots = rows["roots"].combine_chunks()
    flat = roots.flatten().dictionary_encode()
    owner, code = roots.value_parent_indices().to_numpy(), flat.indices.to_numpy().astype(np.int64)
    # a chunk counts once however often it has the root
    code, owner = np.divmod(np.unique(code * len(rows) + owner), max(1, len(rows)))
    part, idx = rows["slice"].to_numpy()[owner], rows["idx"].to_numpy()[owner]
    order = np.lexsort((idx, part, code))
    code, part, idx = code[order], part[order], idx[order]
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (part[1:] != part[:-1])]) if len(idx) else np.empty(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(idx)), pa.int32()), pa.array(idx, pa.int64()))
    return pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(code[first])), pa.array(part[first], pa.int32()), lists], ["root", "slice", "idxs"])


def root_postings(chunks: DataFrame, slices: int, buckets: int | None = None) -> DataFrame:
    """(root, slice, n, low, high, idxs): the inverted index of the distinct roots of every chunk, in blocks.

    A task packs the postings it reads into blocks of its own; those are dealt once, by root into `buckets` partitions where
    given, and joined where they arrive.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b["roots"].flatten())
            if n >= PACKED_POSTINGS:
                yield _partial_blocks(held)
                held, n = [], 0
        if held:
            yield _partial_blocks(held)

    rows = chunks.select("idx", posting_slice(slices).alias("slice"), "roots").where(F.size("roots") > 0)
    blocks = rows.mapInArrow(pack, "root string, slice int, idxs array<long>")
    dealt = blocks.repartition(buckets, "root") if buckets else blocks
    lists = dealt.groupBy("root", "slice").agg(F.sort_array(F.flatten(F.collect_list("idxs"))).alias("idxs"))
    return lists.select("root", "slice", *_block_statistics(), "idxs")


def numbered(documents: DataFrame, first: int = 0) -> DataFrame:
    """`documents` with dense doc_seq numbers from `first` on, in the order of the old ones.

    Only where these leave no room for chunk numbers (hashed 64-bit ids): the rows are sorted by range and written, and
    a partition's numbers start after the rows of those before it, of which one count a partition is gathered.
    """
    spark = documents.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents.repartitionByRange(wide, "doc_seq", "doc_id").sortWithinPartitions("doc_seq", "doc_id")
    place = F.monotonically_increasing_id()
    rows = materialize(ordered.withColumn("_part", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND((1 << 33) - 1)), "numbered")
    starts, at = [], first
    for r in sorted(rows.groupBy("_part").count().collect(), key=lambda r: r["_part"]):
        starts.append((r["_part"], at))
        at += r["count"]
    offsets = spark.createDataFrame(starts, "_part long, _start long")
    return rows.join(F.broadcast(offsets), "_part").withColumn("doc_seq", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


# --- build, load, reuse ---------------------------------------------------------------


def new_version() -> str:
    return f"v{int(time.time() * 1000)}-{uuid.uuid4().hex[:6]}"


def save_table(spark: SparkSession, root: str, version: str, name: str, df: DataFrame, buckets: int, placed: bool = False) -> DataFrame:
    """Write one table of a version. `placed`: every partition of `df` holds whole buckets already."""
    table, path = table_name(version, name), f"{root}/{version}/{name}"
    out = df
    if name in BUCKETED:
        by, order = BUCKETED[name]
        out = (df if placed else df.repartition(buckets, by)).write.mode("overwrite").format("parquet").bucketBy(buckets, by)
        out = out.sortBy(order) if order else out
    else:
        out = df.write.mode("overwrite").format("parquet")
    with shuffles_dropped(df.sparkSession):
        out.options(**WRITE_OPTIONS.get(name, {})).option("path", path).saveAsTable(table)
    return spark.table(table)


def prepared(documents: DataFrame) -> DataFrame:
    """The documents to index, written once: a source that answers differently the second time cannot mix two states."""
    return materialize(actual_documents(documents).withColumn("doc_hash", document_hash()), "index-docs")


def bucket_count(n_chars: int, cores: int, s: Settings) -> int:
    """Buckets of at most `bucket_target_chars` in whole rounds of the cores, so that no round leaves most of them idle."""
    return cores * max(1, math.ceil(n_chars / (s.bucket_target_chars * cores)))


def write_segment(spark: SparkSession, root: str, version: str, docs_in: DataFrame, s: Settings, dead: DataFrame, off: DataFrame | None = None) -> dict:
    """Write the segment of `docs_in` with its tombstones; `off` are the live profiles of the dead documents."""
    n_docs, n_chars = docs_in.agg(F.count("*"), F.coalesce(F.sum(F.length("content")), F.lit(0))).first()
    buckets = s.index_buckets or bucket_count(n_chars, spark.sparkContext.defaultParallelism, s)
    save = lambda name, df, placed=False: save_table(spark, root, version, name, df, buckets, placed)
    # the roots follow from the text, so they are made after the exchange
    chunks = save("chunks", chunk_documents(docs_in, s).repartition(buckets, "idx").withColumn("roots", root_list(F.col("text"))), placed=True)
    sums = hash_sums(chunks).first()
    # one task a bucket: the profiles keep the layout of the chunks without an exchange; the setting is this session's own
    alone = spark.newSession()
    alone.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    alone.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PROFILE_BATCH))
    # rows that need no order go straight to the file of their bucket: a sort would hold all profiles of a task, 25 KB a row
    alone.conf.set("spark.sql.maxConcurrentOutputFileWriters", "2")
    prof = profile_of(F.col("text"), s.embedding_dimension)
    save("profiles", alone.table(table_name(version, "chunks")).select("idx", prof.alias("p")).select("idx", "p.*"), placed=True)
    terms = term_stats(spark.table(table_name(version, "profiles")))
    if off is not None:
        less = term_stats(off).withColumns({"df": -F.col("df"), "total": -F.col("total")})
        terms = terms.unionByName(less).groupBy("family", "term_id").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    save("terms", terms)
    save("docs", document_dimension(docs_in, chunks))
    save("doc_roots", document_roots(chunks, spark.table(table_name(version, "docs"))))
    slices = max(buckets, -(-sums["rows"] // s.posting_slice_chunks))
    save("postings", root_postings(chunks, slices, buckets), placed=True)
    return {
        "version": version, "buckets": buckets, "slices": slices, "documents": n_docs, "dead": save("dead", dead).count(),
        "rows": sums["rows"], "hash_sums": [str(int(sums[f"h{i}"] or 0)) for i in range(4)],
        "schemas": {x: spark.table(table_name(version, x)).schema.toDDL() for x in SEGMENT_TABLES},
    }


def publish(
    spark: SparkSession, root: str, version: str, source_key: str, s: Settings, segments: list[dict], counts: tuple[int, int, list[int]], more: dict
) -> Snapshot:
    """Write the tables over all segments and the manifest of a version, then move CURRENT to it.

    counts: live documents, live chunks and the sums behind the corpus hash.
    """
    n_docs, n_chunks, sums = counts
    if not n_chunks:
        raise ValueError("no chunks left after chunking")
    names = {x: table_name(version, x) for x in GLOBAL_TABLES}
    manifest = {
        **expected_manifest(source_key, s), **more,
        "created_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()),
        "document_count": n_docs,
        "chunk_count": n_chunks,
        "hash_sums": [str(x) for x in sums],
        "corpus_hash": sha256(":".join(map(str, sums)).encode()).hexdigest(),
        "version": version,
        "buckets": max(x["buckets"] for x in segments),
        "segments": segments,
    }
    snap = Snapshot(spark, f"{root}/{version}", manifest, s, names)
    buckets = manifest["buckets"]
    vocab = save_table(spark, root, version, "vocab", vocabulary(added_up(snap.table("terms"), len(segments)), n_chunks, s), buckets)
    save_table(spark, root, version, "norms", chunk_norms(snap.table("profiles"), vocab), buckets)
    manifest["schemas"] = {x: spark.table(names[x]).schema.toDDL() for x in GLOBAL_TABLES}
    _publish_text(spark, f"{root}/{version}/manifest.json", json.dumps(manifest))
    _publish_text(spark, f"{root}/CURRENT", version)
    return snap


def tombstones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id string, doc_seq long")


def build_index(
    spark: SparkSession, documents: DataFrame, source_key: str, root: str, s: Settings, *,
    force: bool = False,
) -> Snapshot:
    """Build a new version beside the live one and switch CURRENT when it is complete."""
    if not force:
        try:
            return load_index(spark, root, s)
        except IndexNotReady:
            pass
    version = new_version()
    docs_in = prepared(documents)
    low, high = docs_in.agg(F.min("doc_seq"), F.max("doc_seq")).first()
    dense = low is not None and not (0 <= low and high < 1 << (63 - CHUNK_BITS))
    if dense:
        docs_in = materialize(numbered(docs_in), "index-docs")
    segment = write_segment(spark, root, version, docs_in, s, tombstones(spark))
    drop_stage(docs_in)
    counts = segment["documents"], segment["rows"], [int(x) for x in segment["hash_sums"]]
    return publish(spark, root, version, source_key, s, [segment], counts, {"numbered": dense})


def load_manifest(spark: SparkSession, root: str) -> dict:
    version = _read_text(spark, f"{root}/CURRENT")
    raw = version and _read_text(spark, f"{root}/{version.strip()}/manifest.json")
    if not raw:
        raise IndexNotReady(f"index not ready: no manifest under {root}")
    return json.loads(raw)


def load_index(spark: SparkSession, root: str, s: Settings, *, verify: bool = False) -> Snapshot:
    """Register the live version's tables; `verify` checks row alignment with the manifest."""
    manifest = load_manifest(spark, root)
    check_compatible(manifest, s)

    def register(version: str, buckets: int, schemas: dict[str, str]) -> None:
        for x, columns in schemas.items():
            name = table_name(version, x)
            if not spark.catalog.tableExists(name):
                cluster = f"CLUSTERED BY ({BUCKETED[x][0]}) INTO {buckets} BUCKETS" if x in BUCKETED else ""
                spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {cluster} LOCATION '{root}/{version}/{x}'")

    version = manifest["version"]
    register(version, manifest["buckets"], manifest["schemas"])
    for x in manifest["segments"]:
        register(x["version"], x["buckets"], x["schemas"])
    snap = Snapshot(spark, f"{root}/{version}", manifest, s, {x: table_name(version, x) for x in GLOBAL_TABLES})
    if verify:
        for x in BY_CHUNK:
            rows = snap.table(x).count()
            if rows != manifest["chunk_count"]:
                raise ValueError(f"{x}: {rows} rows, manifest says {manifest['chunk_count']}")
    return snap


def check_compatible(manifest: dict, s: Settings) -> None:
    if manifest["embedding_backend"] != s.embedding_backend:
        raise ValueError("index was built with another embedding backend; rebuild it")
    if manifest["embedding_dimension"] != s.embedding_dimension:
        raise ValueError("embedding dimension does not match the index")


def ensure_index(
    spark: SparkSession, documents: DataFrame, source_key: str, root: str, s: Settings, *,
    force: bool = False,
) -> Snapshot:
    """Reuse the live version unless a manifest field differs."""
    if not force:
        try:
            if not stale_fields(load_manifest(spark, root), source_key, s):
                return load_index(spark, root, s)
        except IndexNotReady:
            if not s.auto_build_index:
                raise
    return build_index(spark, documents, source_key, root, s, force=True)
