"""Top-k scoring of every chunk against every query, without emitting the pairs.

The exact result needs each query compared with each chunk.  Instead of joining the
two sides, each Arrow batch of chunk profiles is multiplied with a block of query
vectors inside the task, and only the running top-k per query leaves the task:
`queries * k` rows per task, whatever the corpus size.

* queries <= settings.query_block: the block (a counted, bounded number of rows) is
  broadcast and the corpus is scanned once, with no shuffle of the corpus;
* more queries: they are packed into block rows in shared storage, and every corpus task reads
  the blocks in turn (`in_blocks`). The corpus stays where it is, no block passes through the
  driver, and a task holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarry.operators.indexing import Snapshot, sublinear, term_rows
from quarry.operators.profiles import profile_of
from quarry.session import materialize, ship_package
from quarry.settings import Settings
from quarry.sources.tables import spread

PROFILE_COLUMNS = [
    "idx", "word_ids", "word_tfs", "char_ids", "char_tfs", "buckets", "word_norm", "char_norm",
]
HIT_SCHEMA = "qkey long, kind string, idx long, score double"
#: Queries of a term from which on it is a column of a matrix; the fewer cells of any other term are added up one by one.
SHARED_TERM = 4
#: Corpus rows of one packed row.
PACKED_ROWS = 1_024


# --- query side ----------------------------------------------------------------


def query_profiles(variants: DataFrame, s: Settings) -> DataFrame:
    """(qkey, profile columns); qkey identifies one (qid, vid) variant."""
    return variants.select("qkey", profile_of(F.col("query"), s.embedding_dimension).alias("p")).select(
        "qkey", "p.*"
    )


def query_weights(profiles: DataFrame, vocab: DataFrame, s: Settings, bounded: bool) -> DataFrame:
    """(qkey, family, term_id, idf, weight): per-family L2, family weight, never re-normalised."""

    def family(name: str, weight: float) -> DataFrame:
        terms = term_rows(profiles.withColumnRenamed("qkey", "idx"), name).withColumnRenamed("idx", "qkey")
        known = vocab.filter(F.col("family") == name).select("term_id", "idf")
        hit = known.join(F.broadcast(terms) if bounded else terms, "term_id")
        raw = hit.select("qkey", "term_id", "idf", (sublinear(F.col("tf")) * F.col("idf")).alias("w"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("qkey")))
        return raw.select(
            "qkey", F.lit(name).alias("family"), "term_id", "idf",
            (F.col("w") / norm * weight).alias("weight"),
        )

    return family("word", s.word_family_weight).unionByName(family("char", s.char_family_weight))


@dataclass
class QueryBlock:
    keys: np.ndarray                     # qkey per column
    dense: np.ndarray                    # (queries, dimension), unit rows
    terms: dict[str, np.ndarray]         # family -> sorted term ids
    idf: dict[str, np.ndarray]
    weights: dict[str, np.ndarray]       # family -> (terms, queries)

    @cached_property
    def split(self) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """family -> (column of every shared term or -1, their weights; the other terms' first cell, and query and weight of the cells)."""
        out = {}
        for family, m in self.weights.items():
            much = np.count_nonzero(m, axis=1)
            shared = much >= SHARED_TERM
            column = np.where(shared, np.cumsum(shared) - 1, -1)
            term, query = np.nonzero(np.where(shared[:, None], 0.0, m))
            first = np.concatenate([[0], np.cumsum(np.where(shared, 0, much))])
            out[family] = column, m[shared], first, query, m[term, query]
        return out


def make_block(profiles: pd.DataFrame, weights: pd.DataFrame, half: int) -> QueryBlock:
    profiles = profiles.sort_values("qkey")
    keys = profiles["qkey"].to_numpy()
    dense = _unit_halves(np.stack(profiles["buckets"].to_numpy()).astype(float), half)
    terms, idf, mats = {}, {}, {}
    for family in ("word", "char"):
        part = weights[weights["family"] == family]
        ids, first = np.unique(part["term_id"].to_numpy(dtype=np.int64), return_index=True)
        m = np.zeros((len(ids), len(keys)))
        m[np.searchsorted(ids, part["term_id"]), np.searchsorted(keys, part["qkey"])] = part["weight"]
        terms[family], idf[family], mats[family] = ids, part["idf"].to_numpy(float)[first], m
    return QueryBlock(keys, dense, terms, idf, mats)


# --- kernel --------------------------------------------------------------------------


def _unit_halves(counts: np.ndarray, half: int) -> np.ndarray:
    out = np.zeros_like(counts)
    present = np.zeros(len(counts))
    for part in (slice(0, half), slice(half, 2 * half)):
        n = np.sqrt((counts[:, part] ** 2).sum(axis=1))
        ok = n > 0
        out[ok, part] = counts[ok, part] / n[ok, None]
        present += ok
    return out / np.sqrt(np.maximum(present, 1.0))[:, None]


def _cell_sums(
    rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int, nq: int, first: np.ndarray, query: np.ndarray, weight: np.ndarray
) -> np.ndarray:
    """(n, nq): every value times the weights of its term's cells, from first[term] to first[term + 1]."""
    much = first[terms + 1] - first[terms]
    place = np.repeat(first[terms] - np.cumsum(much) + much, much) + np.arange(much.sum())
    cell = np.repeat(rows * nq, much) + query[place]
    return np.bincount(cell, np.repeat(values, much) * weight[place], n * nq).reshape(n, nq)


def _sparse_scores(batch: pa.RecordBatch, q: QueryBlock, s: Settings) -> np.ndarray:
    n = batch.num_rows
    families = (("word", s.word_family_weight), ("char", s.char_family_weight))
    norms = {f: batch.column(f + "_norm").to_numpy(zero_copy_only=False) for f, _ in families}
    whole = np.sqrt(sum(np.where(norms[f] > 0, w * w, 0.0) for f, w in families))
    scale = {
        f: np.where(norms[f] > 0, w / np.maximum(norms[f], 1e-300), 0.0) / np.maximum(whole, 1e-300)
        for f, w in families
    }
    scores = np.zeros((n, len(q.keys)))
    for f, _ in families:
        vocab = q.terms[f]
        if not len(vocab):
            continue
        col = batch.column(f + "_ids")
        ends = col.offsets.to_numpy()
        ids = col.flatten().to_numpy()
        tfs = batch.column(f + "_tfs").flatten().to_numpy()
        at = np.minimum(np.searchsorted(vocab, ids), len(vocab) - 1)
        known = vocab[at] == ids
        rows = np.repeat(np.arange(n), np.diff(ends))[known]
        at = at[known]
        values = (1.0 + np.log(tfs[known])) * q.idf[f][at] * scale[f][rows]
        column, matrix, first, query, weight = q.split[f]
        alone = column[at] < 0
        scores += _cell_sums(rows[alone], at[alone], values[alone], n, len(q.keys), first, query, weight)
        rows, at, values = rows[~alone], column[at[~alone]], values[~alone]
        step = max(1, 4_000_000 // max(1, len(matrix)))
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            a, b = np.searchsorted(rows, (lo, hi))
            dense = np.zeros((hi - lo, len(matrix)))
            dense[rows[a:b] - lo, at[a:b]] = values[a:b]
            scores[lo:hi] += dense @ matrix
    return scores


class TopK:
    """Running exact top-k per query; order = score desc, idx asc. A row that cannot enter is never sorted."""

    def __init__(self, k: int, n_queries: int) -> None:
        self.k, self.nq = k, n_queries
        self.q = np.empty(0, np.int64)
        self.idx = np.empty(0, np.int64)
        self.score = np.empty(0)
        self.last_score = np.full(n_queries, -np.inf)    # the k-th of each query, once it has k
        self.last_idx = np.full(n_queries, np.iinfo(np.int64).max)

    def add(self, idx: np.ndarray, scores: np.ndarray) -> None:
        enter = scores > self.last_score
        level = scores == self.last_score
        if level.any():
            enter |= level & (idx[:, None] < self.last_idx)
        # a query that more rows enter than it may keep is cut to its first k before anything is sorted
        for c in np.nonzero(enter.sum(axis=0) > self.k)[0]:
            rows = np.nonzero(enter[:, c])[0]
            own = scores[rows, c]
            limit = np.partition(own, len(own) - self.k)[len(own) - self.k]
            above, tied = own > limit, rows[own == limit]
            room = self.k - int(above.sum())
            enter[:, c] = False
            enter[rows[above], c] = True
            enter[tied[np.argsort(idx[tied])[:room]], c] = True
        rows, cols = np.nonzero(enter)
        if not len(rows):
            return
        q = np.concatenate([self.q, cols])
        i = np.concatenate([self.idx, idx[rows]])
        v = np.concatenate([self.score, scores[rows, cols]])
        order = np.lexsort((i, -v, q))
        q, i, v = q[order], i[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        full = rank == self.k - 1
        self.last_score[q[full]], self.last_idx[q[full]] = v[full], i[full]
        self.q, self.idx, self.score = q[keep], i[keep], v[keep]

    def add_raw(self, idx: np.ndarray, scores: np.ndarray, digits: int) -> None:
        """`add` of the rounded scores; rows that stay below every k-th even when rounded up are not rounded at all."""
        near = (scores >= self.last_score - 10.0 ** -digits).any(axis=1)
        if near.any():
            self.add(idx[near], np.round(scores[near], digits))


def score_batches(
    batches: Iterator[pa.RecordBatch], q: QueryBlock, kinds: dict[str, int], s: Settings
) -> Iterator[pa.RecordBatch]:
    half = s.embedding_dimension // 2
    tops = {kind: TopK(k, len(q.keys)) for kind, k in kinds.items()}
    for batch in batches:
        if not batch.num_rows:
            continue
        idx = batch.column("idx").to_numpy()
        if "dense" in tops:
            counts = batch.column("buckets").flatten().to_numpy().reshape(batch.num_rows, 2 * half)
            dense = _unit_halves(counts.astype(float), half) @ q.dense.T
            tops["dense"].add_raw(idx, dense, s.score_digits)
        if "sparse" in tops:
            tops["sparse"].add_raw(idx, _sparse_scores(batch, q, s), s.score_digits)
    for kind, top in tops.items():
        if len(top.q):
            yield pa.RecordBatch.from_pydict(
                {
                    "qkey": pa.array(q.keys[top.q], pa.int64()),
                    "kind": pa.array([kind] * len(top.q), pa.string()),
                    "idx": pa.array(top.idx, pa.int64()),
                    "score": pa.array(top.score, pa.float64()),
                }
            )


# --- Spark operators --------------------------------------------------------------------


def profiles_with_norms(snap: Snapshot) -> DataFrame:
    """Co-bucketed join on idx: no exchange, and norms is the small build side."""
    return (
        snap.table("profiles")
        .join(snap.table("norms").hint("shuffle_hash"), "idx", "left")
        .select(
            *PROFILE_COLUMNS[:6],
            F.coalesce("word_norm", F.lit(0.0)).alias("word_norm"),
            F.coalesce("char_norm", F.lit(0.0)).alias("char_norm"),
        )
    )


def score_topk(
    snap: Snapshot, variants: DataFrame, n_variants: int, kinds: dict[str, int]
) -> DataFrame:
    """(qkey, kind, idx, score, rank) for kinds such as {'dense': 60, 'sparse': 80}."""
    s = snap.settings
    ship_package(snap.spark)
    if n_variants == 0:
        local = snap.spark.createDataFrame([], HIT_SCHEMA)
    else:
        corpus = profiles_with_norms(snap)
        profiles = materialize(query_profiles(variants, s), "query-profiles")
        n_terms = profiles.agg(F.sum(F.size("word_ids") + F.size("char_ids"))).first()[0] or 0
        if n_variants <= s.query_block and n_terms <= s.broadcast_rows:
            local = _score_broadcast(snap.spark, corpus, profiles, snap.table("vocab"), kinds, s)
        else:
            n_blocks = max(-(-n_variants // s.query_block), -(-n_terms // s.broadcast_rows))
            local = _score_blocks(snap, corpus, profiles, n_blocks, n_variants, kinds)
    order = Window.partitionBy("qkey", "kind").orderBy(F.desc("score"), "idx")
    limit = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in kinds.items()])
    ranked = local.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= max(kinds.values())).filter(F.col("rank") <= limit)


def _score_broadcast(
    spark: SparkSession, corpus: DataFrame, profiles: DataFrame, vocab: DataFrame,
    kinds: dict[str, int], s: Settings,
) -> DataFrame:
    """The caller has counted the questions and their terms; both are within bounds."""
    weights = query_weights(profiles, vocab, s, bounded=True)
    block = make_block(
        profiles.select("qkey", "buckets").toPandas(), weights.toPandas(), s.embedding_dimension // 2
    )
    shared = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from score_batches(batches, shared.value, kinds, s)

    return corpus.mapInArrow(run, HIT_SCHEMA)


def packed_rows(df: DataFrame, column: str) -> DataFrame:
    """One binary row per Arrow batch; nothing is shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PACKED_ROWS):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(lo, PACKED_ROWS))
                yield pa.RecordBatch.from_pydict({column: pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return df.mapInArrow(pack, f"{column} binary")


def unpacked(value: pa.Scalar) -> list[pa.RecordBatch]:
    return list(pa.ipc.open_stream(value.as_buffer()))


def question_blocks(questions: DataFrame, n_questions: int, size: int) -> DataFrame:
    """(block, questions): binary rows of about `size` questions each, a bounded number of them in a partition."""
    n_blocks = -(-n_questions // size)

    def pack(block: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        rows = block.drop_columns("block")
        with pa.ipc.new_stream(sink, rows.schema) as out:
            out.write_table(rows)
        return pa.table({"block": block["block"][:1], "questions": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    dealt = questions.withColumn("block", F.pmod(F.xxhash64("qkey"), F.lit(n_blocks)).cast("int"))
    return materialize(dealt.groupBy("block").applyInArrow(pack, "block int, questions binary"), "question-blocks")


def in_blocks(
    corpus: DataFrame, blocks: DataFrame, score: Callable[[pa.Table, Iterator[list[pa.RecordBatch]]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """`score(questions, batches of the corpus partition)` for every block and every partition of the corpus.

    `corpus` may already be packed, one binary `cell` a row. A stated set of questions against all rows, in blocks: each task reads its own corpus partition and the question blocks
    one after another. The corpus is not shuffled, and only what `score` keeps leaves the task.
    """
    cells = corpus if corpus.columns == ["cell"] else packed_rows(corpus, "cell")
    pairs = blocks.hint("shuffle_replicate_nl").crossJoin(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b["block"][i].as_py(), b["questions"][i], b["cell"][i]) for b in batches for i in range(b.num_rows))
        for _, same in groupby(rows, key=lambda r: r[0]):
            _, questions, cell = next(same)
            yield from score(pa.Table.from_batches(unpacked(questions)), chain([unpacked(cell)], (unpacked(r[2]) for r in same)))

    return pairs.mapInArrow(run, schema)


def _score_blocks(
    snap: Snapshot, corpus: DataFrame, profiles: DataFrame, n_blocks: int, n_variants: int, kinds: dict[str, int]
) -> DataFrame:
    s = snap.settings
    weights = query_weights(profiles, snap.table("vocab"), s, bounded=False)
    per_query = weights.groupBy("qkey").agg(
        F.collect_list(F.struct("family", "term_id", "idf", "weight")).alias("terms")
    )
    asked = profiles.select("qkey", "buckets").join(per_query, "qkey", "left")
    half = s.embedding_dimension // 2

    def score(questions: pa.Table, cells: Iterator[list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        pdf = questions.to_pandas()
        rows = [
            (k, t["family"], t["term_id"], t["idf"], t["weight"])
            for k, ts in zip(pdf["qkey"], pdf["terms"]) if ts is not None for t in ts
        ]
        w = pd.DataFrame(rows, columns=["qkey", "family", "term_id", "idf", "weight"])
        return score_batches(chain.from_iterable(cells), make_block(pdf, w, half), kinds, s)

    return in_blocks(corpus.select(PROFILE_COLUMNS), question_blocks(asked, n_variants, -(-n_variants // n_blocks)), score, HIT_SCHEMA)


def vector_topk(
    corpus: DataFrame, queries: DataFrame, n_queries: int, k: int, s: Settings
) -> DataFrame:
    """Dense top-k over precomputed vectors: corpus(idx, vector), queries(qkey, vector).

    Up to `query_block` counted queries are broadcast; more are read in blocks by every corpus task in
    turn. The corpus is scanned in place either way, and a task emits its top k only.
    """
    spark = corpus.sparkSession
    ship_package(spark)
    columns = "qkey long, idx long, score double"

    def matrix(vectors: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
        return vectors.flatten().to_numpy().astype(float).reshape(n, -1)

    def found(keys: np.ndarray, top: TopK) -> pa.Table:
        return pa.table({
            "qkey": pa.array(keys[top.q], pa.int64()), "idx": pa.array(top.idx, pa.int64()),
            "score": pa.array(top.score, pa.float64()),
        })

    def against(keys: np.ndarray, m: np.ndarray, batches: Iterator[pa.RecordBatch]) -> pa.Table:
        top = TopK(k, len(keys))
        for b in batches:
            if b.num_rows and len(keys):
                v = matrix(b.column("vector"), b.num_rows)
                top.add_raw(b.column("idx").to_numpy(), v @ m.T, s.score_digits)
        return found(keys, top)

    if n_queries <= s.query_block:
        pdf = queries.limit(s.query_block).toPandas()
        mat = np.stack(pdf["vector"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast((pdf["qkey"].to_numpy(np.int64), mat))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from against(*shared.value, batches).to_batches()

        scored = corpus.mapInArrow(scan, columns)
    else:
        def score(questions: pa.Table, cells: Iterator[list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
            keys = questions["qkey"].to_numpy()
            m = matrix(questions["vector"].combine_chunks(), len(keys))
            yield from against(keys, m, chain.from_iterable(cells)).to_batches()

        blocks = question_blocks(queries.select("qkey", "vector"), n_queries, s.query_block)
        # every task of a block reads its cells again: they are packed once, in pieces for all cores
        cells = materialize(packed_rows(spread(corpus.select("idx", "vector")), "cell"), "vector-cells")
        scored = in_blocks(cells, blocks, score, columns)
    order = Window.partitionBy("qkey").orderBy(F.desc("score"), "idx")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@dataclass
class RootBlock:
    """Questions by the roots they ask for."""

    keys: np.ndarray
    names: pa.Array                      # distinct roots
    digits: np.ndarray                   # whether a root is a number
    variants: np.ndarray                 # variants by root, from first[root] to first[root + 1]
    first: np.ndarray
    size: np.ndarray
    n_numeric: np.ndarray


def make_root_block(asked: pa.Table) -> RootBlock:
    names = pc.unique(asked["qroots"].combine_chunks().flatten())
    at = pc.index_in(asked["qroots"].combine_chunks().flatten(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = pc.list_parent_indices(asked["qroots"].combine_chunks()).to_numpy()
    order = np.argsort(at, kind="stable")
    digits = np.array([r.isdecimal() and r.isascii() for r in names.to_pylist()], dtype=bool)
    return RootBlock(
        asked["qkey"].to_numpy(), names, digits, owner[order], np.searchsorted(at[order], np.arange(len(names) + 1)),
        asked["qn"].to_numpy().astype(float), asked["n_numeric"].to_numpy().astype(float),
    )


def slice_coverage(postings: pa.Table, q: RootBlock, top: TopK, s: Settings, step: int = 2048) -> None:
    """Add the best coverage of every variant over the chunks of one slice, from its postings(root, idxs)."""
    term = pc.index_in(postings["root"].combine_chunks(), value_set=q.names)
    known = term.is_valid().to_numpy(zero_copy_only=False)
    if not known.any():
        return
    lists = postings["idxs"].combine_chunks().filter(pa.array(known))
    term = np.repeat(pc.drop_null(term).to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy())
    chunks, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    order = np.argsort(at, kind="stable")
    at, term = at[order], term[order]
    nq = len(q.keys)
    for lo in range(0, len(chunks), step):
        a, b = np.searchsorted(at, (lo, lo + step))
        n = min(step, len(chunks) - lo)
        t = term[a:b]
        much = q.first[t + 1] - q.first[t]
        place = np.repeat(q.first[t] - np.concatenate([[0], np.cumsum(much)[:-1]]).astype(np.int64), much) + np.arange(much.sum())
        cell = np.repeat(at[a:b] - lo, much) * nq + q.variants[place]
        matched = np.bincount(cell, minlength=n * nq).reshape(n, nq)
        numeric = np.bincount(cell, np.repeat(q.digits[t], much), minlength=n * nq).reshape(n, nq)
        plain = matched / np.maximum(q.size, 1.0)
        cover = np.where((q.n_numeric > 0) & (numeric == q.n_numeric), np.minimum(1.15, plain + 0.12), plain)
        top.add(chunks[lo : lo + n], np.where(matched > 0, np.round(cover, s.score_digits), -1.0))


def coverage_topk(postings: DataFrame, roots: DataFrame, n_variants: int, n_roots: int, k: int, s: Settings) -> DataFrame:
    """(qkey, idx, coverage): the chunks that cover each variant's roots best, from postings(root, slice, idxs).

    Only the lists of the asked roots are read and dealt by slice; a slice holds every list of its chunks, so counts are
    added up inside one task and no (variant, chunk) pair leaves it, only a running top k. Up to `query_block` counted
    variants are broadcast; more are read by every slice in blocks.
    """
    spark = postings.sparkSession
    ship_package(spark)
    asked = roots.select("qkey", "qroots", "qn", "n_numeric")
    schema = "qkey long, idx long, coverage double"
    if n_roots <= s.broadcast_rows:
        names = asked.select(F.explode("qroots").alias("root")).distinct()
        postings = postings.join(F.broadcast(names), "root", "left_semi")
    rows = postings.select("slice", "root", "idxs")

    def found(q: RootBlock, top: TopK) -> pa.Table:
        keep = top.score > 0
        return pa.table({
            "qkey": pa.array(q.keys[top.q[keep]], pa.int64()), "idx": pa.array(top.idx[keep], pa.int64()),
            "coverage": pa.array(top.score[keep], pa.float64()),
        })

    if n_variants <= s.query_block and n_roots <= s.broadcast_rows:
        shared = spark.sparkContext.broadcast(make_root_block(asked.limit(s.query_block).toArrow()))

        def one(lists: pa.Table) -> pa.Table:
            top = TopK(k, len(shared.value.keys))
            slice_coverage(lists, shared.value, top, s)
            return found(shared.value, top)

        return rows.groupBy("slice").applyInArrow(one, schema)

    def pack(lists: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, lists.schema) as out:
            out.write_table(lists)
        return pa.table({"cell": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def score(questions: pa.Table, cells: Iterator[list[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        q = make_root_block(questions)
        top = TopK(k, len(q.keys))
        for cell in cells:
            slice_coverage(pa.Table.from_batches(cell), q, top, s)
        yield from found(q, top).to_batches()

    packed = materialize(rows.groupBy("slice").applyInArrow(pack, "cell binary"), "posting-cells")
    return in_blocks(packed, question_blocks(asked, n_variants, s.query_block), score, schema)
