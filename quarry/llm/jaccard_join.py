"""Exact n-gram Jaccard join through a token-group matrix.

1. A document is the set of its distinct word shingles (three words unless set otherwise), each a 64-bit hash of its words'
   hashes; documents with the same set are one node, named by 128 bits of the set.
2. Tokens have one global order: first those not known to be frequent, by hash, then the frequent ones, rarest first. What is
   frequent is counted by all tasks with bounded tables; the order may be any, so a wrong count costs time and no link.
   Of a node of n tokens only the first n - ceil(0.9 n) + 1 need be looked up: two linked nodes share one of these.
3. Nodes that share such a token with another are dealt into groups of similar nodes, at most `group_nodes` each: sorted by
   their first shared tokens, neighbours stand together.
4. The token-group matrix has a row per looked-up token and group. A node meets the groups before its own in which it
   finds a token: at first only the first group of each token, then, by components, those where the token belongs to a
   member of another component. Parity sketches (a differing token flips one bit) drop groups where no member can be near
   enough, and members that can be near nobody.
5. For the groups and nodes that remain, whole sets are made again from their texts. A group stores the union of its near
   members' tokens, each with the members that have it; a node that has less than 0.9 of its tokens in the union does not open
   the group, the others are compared with its members exactly. One link per local component of a group is enough;
   components join the rest.

No step emits pairs of nodes before the last, and the last only links. Sets are compared by 64-bit hashes: that a token differs
but counts as shared has a chance near 10^-14 for two sets of 500 tokens.

Cases: null texts and texts without words have an empty set and link with nothing; fewer words than a shingle are one; a
null doc_id gives way to any other when the smallest is taken; repeated rows each return a row; an empty table an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.common import components, discard, partitions, prepare, stage, text_of
from quarry.llm.simhash_dedup import wide_fingerprint

#: An odd multiplier; its powers weigh the words of a shingle.
MIX = np.uint64(0x9E3779B97F4A7C15)

#: The gap of two sets that cannot be near.
FAR = 1 << 40


@dataclass(frozen=True)
class JoinSettings:
    #: Least similarity in hundredths, and words of a shingle.
    percent: int = 90
    shingle: int = 3
    group_nodes: int = 128
    #: Bits of the smallest sketch (a power of two), and bits for a hundred tokens.
    sketch_bits: int = 256
    sketch_share: int = 60
    #: Bits of the table that tells which texts may be wanted again; a full table only lets more texts through.
    wanted_bits: int = 1 << 27
    #: Bounds of the tables of frequent tokens: of one task, sent by one task, and of all.
    counted_tokens: int = 200_000
    sent_tokens: int = 20_000
    frequent_tokens: int = 200_000
    #: Bits of a SimHash fingerprint of the set (a multiple of 64; 0: none).
    fingerprint_bits: int = 0


_SPAN = 1 << 18
_LONG = 1 << 16
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(base: int) -> np.ndarray:
    out = np.full(_SPAN, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSES = _powers(int(MIX)), _powers(pow(int(MIX), -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of every word (run of anything but blanks) of a text, A-Z lowered.

    Polynomials over the bytes, all at once: sums up to a word's end less those up to its start, moved to its start.
    Words over 65,536 bytes are hashed one by one.
    """
    text = text.lower()
    b = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    np.logical_not(_BLANK[b], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _SPAN, "right")))
        stop = min(ends[j - 1], base + _SPAN)
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum((b[base:stop].astype(np.uint64) + np.uint64(1)) * _POWERS[: stop - base], out=sums[1:])
        first, last = starts[i:j] - base, np.minimum(ends[i:j], stop) - base
        out[i:j] = (sums[last] - sums[first]) * _INVERSES[first]
        i = j
    for i in np.flatnonzero(ends - starts > _LONG):
        out[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]], 13)
    return _mixed(out)


def token_set(text: bytes, shingle: int = 3) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    of = word_hashes(text)
    if not len(of):
        return of
    # fewer words than a shingle are one; the number of words keeps them apart from longer ones
    size = min(shingle, len(of))
    n = len(of) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h *= MIX
        h += of[i : i + n]
    h = _mixed(h)
    h.sort()
    fresh = np.ones(n, bool)
    np.not_equal(h[1:], h[:-1], out=fresh[1:])
    return h[fresh]


def sketch_of(tokens: np.ndarray, s: JoinSettings) -> bytes:
    """Parities of the tokens over a power of two of bits."""
    bits = s.sketch_bits
    while 100 * bits < s.sketch_share * len(tokens):
        bits *= 2
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Differing parities of every two sketches, a lower bound of their sets' differing tokens; the longer sketch is folded."""
    out = np.zeros((len(a), len(b)), np.int64)

    def by_length(sketches: list[bytes]) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for i, x in enumerate(sketches):
            found.setdefault(len(x), []).append(i)
        return found

    def folded(sketches: list[bytes], length: int) -> np.ndarray:
        x = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
        while x.shape[1] * 8 > length:
            half = x.shape[1] // 2
            x = x[:, :half] ^ x[:, half:]
        return x

    for n, i in by_length(a).items():
        for m, j in by_length(b).items():
            x, y = folded([a[k] for k in i], min(n, m)), folded([b[k] for k in j], min(n, m))
            for row, one in zip(i, x):
                out[row, j] = np.bitwise_count(one ^ y).sum(axis=1, dtype=np.int64)
    return out


def looked_up(n: int, s: JoinSettings) -> int:
    return n - (s.percent * n + 99) // 100 + 1


class _Counts:
    """Counts of the more frequent tokens of a task, in a bounded table."""

    def __init__(self, limit: int) -> None:
        self.limit, self.tokens, self.counts = limit, np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, tokens: np.ndarray) -> None:
        self.waiting.append(tokens)
        self.n += len(tokens)
        if self.n > 2_000_000:
            self.settle()

    def settle(self) -> None:
        fresh, n = np.unique(np.concatenate([*self.waiting, np.empty(0, np.uint64)]), return_counts=True)
        both = np.concatenate([self.tokens, fresh])
        self.tokens, at = np.unique(both, return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, n]), len(self.tokens)).astype(np.int64)
        if len(self.tokens) > self.limit:
            top = np.sort(np.argpartition(self.counts, -self.limit)[-self.limit :])
            self.tokens, self.counts = self.tokens[top], self.counts[top]
        self.waiting, self.n = [], 0


def document_nodes(docs: DataFrame, s: JoinSettings, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, node, n, text_md5) of every document, and rows (token, seen) of each task's frequent tokens."""
    kind = docs.select(F.col(f"`{doc_id}`")).schema[0].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ids = _Counts(s.counted_tokens), None
        for b in batches:
            nodes, sizes, ids = [], [], b["doc_id"].type
            for t in b["text"]:
                x = token_set(t.as_buffer().to_pybytes(), s.shingle)
                counts.add(x)
                sizes.append(len(x))
                nodes.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), b["text_md5"], none, none],
                ["doc_id", "node", "n", "text_md5", "token", "seen"])
        if ids is not None:
            counts.settle()
            top = np.argsort(-counts.counts, kind="stable")[: s.sent_tokens]
            top = top[counts.counts[top] > 1]
            m = len(top)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, ids), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()),
                 pa.array(counts.tokens[top].view(np.int64)), pa.array(counts.counts[top])],
                ["doc_id", "node", "n", "text_md5", "token", "seen"])

    t = text_of(text)
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("text"), F.unhex(F.md5(t)).alias("text_md5")).mapInArrow(
        read, f"doc_id {kind}, node binary, n long, text_md5 binary, token long, seen long")


def frequent(rows: DataFrame, s: JoinSettings) -> tuple[np.ndarray, np.ndarray]:
    """At most `frequent_tokens` sorted tokens and their counts."""
    counted = rows.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen"))
    got = counted.orderBy(F.desc("seen"), "token").limit(s.frequent_tokens).toArrow()
    tokens = got["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], got["seen"].to_numpy()[order]


def lookups(docs: DataFrame, known: tuple[np.ndarray, np.ndarray], s: JoinSettings, text: str = "text") -> DataFrame:
    """(node, nid, n, sketch, tokens[, fp]): one row per node with the tokens that must be looked up and, where the settings want
    one, the fingerprint of its set; nid is a number of the row, good once the rows are written."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value
        for b in batches:
            nodes, sizes, sketches, first, fps = [], [], [], [], []
            for t in b["text"]:
                x = token_set(t.as_buffer().to_pybytes(), s.shingle)
                if not len(x):
                    continue
                rank = np.zeros(len(x), np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
                    rank = np.where(tokens[at] == x, counts[at], 0)
                nodes.append(xxhash.xxh3_128_digest(x.tobytes()))
                sizes.append(len(x))
                sketches.append(sketch_of(x, s))
                first.append(x[np.lexsort((x, rank))][: looked_up(len(x), s)].view(np.int64))
                fps.append(wide_fingerprint(x, s.fingerprint_bits) if s.fingerprint_bits else b"")
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(first, pa.list_(pa.int64())),
                 pa.array(fps, pa.binary())],
                ["node", "n", "sketch", "tokens", "fp"])

    found = docs.select(text_of(text).alias("text")).mapInArrow(read, "node binary, n long, sketch binary, tokens array<long>, fp binary")
    kept = ["n", "sketch", "tokens", *(["fp"] if s.fingerprint_bits else [])]
    once = found.groupBy("node").agg(*[F.first(c).alias(c) for c in kept])
    return once.withColumn("nid", F.monotonically_increasing_id())


MEMBER = "struct<nid:bigint,n:bigint,sketch:binary,tokens:array<bigint>,places:array<int>>"


def similar_groups(nodes: DataFrame, s: JoinSettings, clustered: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(grp, members), staged: nodes that share a looked-up token, similar ones together; a group has the number of its first node.

    A member keeps its shared tokens and their places in the global order of its set. `clustered` may name nodes that belong together:
    (nid, root) of some of the given nodes, which then are grouped by root.
    """
    # tokens are dealt once: those of one node only go where they meet no other
    p, whole, of = s.percent, 100 + s.percent, Window.partitionBy("token")
    dealt = nodes.select("nid", "n", F.posexplode("tokens").alias("place", "token")).withColumns({
        "met": F.count(F.lit(1)).over(of), "least": F.min("n").over(of), "sizes": F.sum("n").over(of), "all_places": F.sum("place").over(of)})
    # as in `later_visits`, what follows the first shared token in either set bounds what they share; most tokens that meet have two
    # nodes by chance, so the other's size and place are the sums without one's own
    n, place, other = F.col("n"), F.col("place").cast("long"), F.col("sizes") - F.col("n")
    alike = (100 * other >= p * n) & (100 * n >= p * other)
    pair = alike & (100 * n - whole * place >= p * other) & (100 * other - whole * (F.col("all_places") - place) >= p * n)
    dealt = dealt.where((F.col("met") > 1) & F.when(F.col("met") == 2, pair).otherwise(100 * n - whole * place >= p * F.col("least")))
    shared = dealt.groupBy("nid").agg(F.array_sort(F.collect_list(F.struct("token", "place"))).alias("shared"))
    given = [c for c in ("nid", "n", "sketch", "fp") if c in nodes.columns]
    kept = shared.join(nodes.select(*given), "nid").select(
        *given, F.col("shared.token").alias("tokens"), F.col("shared.place").alias("places"))
    # similar nodes have the same smallest hashes among their shared tokens
    spread = stage(kept.withColumns({"t0": F.col("tokens")[0], "t1": F.get("tokens", F.lit(1))}), "join-nodes")
    ordering = spread.drop("fp")
    if clustered:
        ordering = ordering.join(clustered(spread), "nid", "left").withColumns(
            {"t0": F.coalesce("root", "t0"), "t1": F.when(F.col("root").isNull(), F.col("t1")).otherwise(F.col("t0"))}).drop("root")
    member = pa.struct([("nid", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("tokens", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups(found: list[list[dict]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([g[0]["nid"] for g in found], pa.int64()), pa.array(found, pa.list_(member))], ["grp", "members"])

        held, last = [], None
        for b in batches:
            done = []
            for row in b.to_pylist():
                t0 = row.pop("t0")
                row.pop("t1")
                if held and (t0 != last or len(held) >= s.group_nodes):
                    done.append(held)
                    held = []
                held.append(row)
                last = t0
            if done:
                yield groups(done)
        if held:
            yield groups([held])

    ordered = ordering.repartitionByRange(partitions(nodes.sparkSession), "t0", "t1", "nid").sortWithinPartitions("t0", "t1", "nid")
    out = stage(ordered.mapInArrow(form, f"grp bigint, members array<{MEMBER}>"), "join-groups")
    discard(spread)
    return out


def first_visits(groups: DataFrame, s: JoinSettings) -> DataFrame:
    """(grp, nid): every node with the first group of each of its tokens, where that is an earlier one and of fitting size.

    A token has one first group, so the visits grow with the nodes however many share a token.
    """
    p = s.percent
    rows = groups.select("grp", F.array_min("members.n").alias("low"), F.array_max("members.n").alias("high"),
                         F.explode(F.array_distinct(F.flatten("members.tokens"))).alias("token"))
    first = rows.groupBy("token").agg(F.min(F.struct("grp", "low", "high")).alias("f"))
    fits = (F.col("grp") > F.col("f.grp")) & (100 * F.col("f.high") >= p * F.col("n")) & (100 * F.col("n") >= p * F.col("f.low"))
    members = groups.select("grp", F.explode("members").alias("m"))
    placed = members.select("grp", "m.nid", "m.n", F.explode("m.tokens").alias("token"))
    return placed.join(first, "token").where(fits).select(F.col("f.grp").alias("grp"), "nid").distinct()


def later_visits(groups: DataFrame, roots: DataFrame, s: JoinSettings) -> DataFrame:
    """(grp, nid): nodes that find a token of theirs in an earlier group, at a member of fitting size in another component.

    A token whose nodes all are in one component is dropped, with it the visits among the members of a linked cluster. Of the
    first token that two sets share, in the global order, all tokens before it are in one set only: what follows it in either set
    (its size less the place) bounds what they share. `room` is that bound as the largest set that the node may be linked with,
    times the percentage; visits that leave either side without room are ruled out, and with them those among copies that have too
    many words of their own. A group is asked by component, so its members of the node's own component let nothing through.

    Groups meet, not nodes: a row is a token and two groups that have it, so a token in many similar nodes makes a row for two
    groups of up to `group_nodes` of them, and the nodes of these rows are looked through in place.
    """
    p, whole = s.percent, 100 + s.percent
    # the root joins a node before its tokens become rows, and a token's rows are dealt once for all that is grouped by it
    members = groups.select("grp", F.explode("members").alias("m")).select("grp", "m.nid", "m.n", "m.tokens", "m.places")
    rooted = members.join(roots, "nid", "left").withColumn("root", F.coalesce("root", "nid"))
    placed = rooted.select("grp", "nid", "n", "root", "places", F.posexplode("tokens").alias("i", "token")).select(
        "token", "grp", "nid", "n", "root", (100 * F.col("n") - whole * F.get("places", F.col("i")).cast("long")).alias("room"))
    of = Window.partitionBy("token")
    open_ = placed.withColumns({"a": F.min("root").over(of), "b": F.max("root").over(of)}).where("a <> b").drop("a", "b")
    of_root = open_.groupBy("token", "grp", "root").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("room").alias("most"), F.collect_list(F.struct("nid", "n", "room")).alias("nodes"))
    matrix = stage(of_root.groupBy("token", "grp").agg(F.collect_list(F.struct("root", "low", "high", "most", "nodes")).alias("parts")), "join-open")

    def fits(node: Column, part: Column) -> Column:
        alike = (100 * part["high"] >= p * node["n"]) & (100 * node["n"] >= p * part["low"])
        return alike & (node["room"] >= p * part["low"]) & (part["most"] >= p * node["n"])

    def let_in(part: Column) -> Column:
        others = F.filter("asked", lambda o: o["root"] != part["root"])
        return F.transform(F.filter(part["nodes"], lambda v: F.exists(others, lambda o: fits(v, o))), lambda v: v["nid"])

    asked = matrix.select("token", F.col("grp").alias("at"), F.col("parts").alias("asked"))
    met = matrix.join(asked, "token").where(F.col("at") < F.col("grp"))
    met = met.select("at", "grp", F.flatten(F.transform("parts", let_in)).alias("nids")).where(F.size("nids") > 0)
    # two groups meet in many tokens: their visits are made one before they become rows
    pairs = met.groupBy("at", "grp").agg(F.array_distinct(F.flatten(F.collect_list("nids"))).alias("nids"))
    return pairs.select(F.col("at").alias("grp"), F.explode("nids").alias("nid"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, pa.RecordBatch]]:
    """Rows sorted by group, members (with a place `at`) first -> (group, members, visitors) of each run in a batch."""
    for b in batches:
        keys = b["grp"].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for i, j in zip(cuts, cuts[1:]):
            if i < j:
                run = b.slice(i, j - i)
                m = run.num_rows - run["at"].null_count
                yield int(keys[i]), run.slice(0, m), run.slice(m)


def _together(rows: DataFrame) -> DataFrame:
    """Members (with a place `at`) and visitors (without) in one partition by group, the members first and in order."""
    return rows.repartition(partitions(rows.sparkSession), "grp").sortWithinPartitions(F.col("grp"), F.col("at").asc_nulls_last())


def promising(groups: DataFrame, found: DataFrame, s: JoinSettings, roots: DataFrame | None = None) -> DataFrame:
    """(grp, at, nid, gap): visits `found` (at is null) and members (with their place) that the sketches leave near enough to one
    another; gap is that of a visitor's nearest member in millionths.

    Without roots(nid, root) members are held against one another too; with it only visits count, and only those of another
    component's members.
    """
    slack, whole, alone = 100 - s.percent, 100 + s.percent, roots is None

    def gaps(a: pa.RecordBatch, sketches: list[bytes], n: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Gap of every row of `a` to every member, large where it is too far or needs no look."""
        differ = differing(a["sketch"].to_pylist(), sketches)
        both = a["n"].to_numpy()[:, None] + n[None, :]
        # similarity p needs at most (na + nb) * (1 - p) / (1 + p) differing tokens, each of which flips one bit
        open_ = (whole * differ <= slack * both) & (a["root"].to_numpy()[:, None] != root[None, :])
        return np.where(open_, 1_000_000 * differ // np.maximum(both, 1), FAR)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("grp", pa.int64()), ("at", pa.int32()), ("nid", pa.int64()), ("gap", pa.int64())]
        columns: list[list] = [[], [], [], []]

        def add(*values: list) -> None:
            for column, v in zip(columns, values):
                column.extend(v)

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], [name for name, _ in kinds])
            for c in columns:
                c.clear()
            return batch

        def close() -> None:
            hit = np.flatnonzero(near).tolist()
            add([group] * len(hit), hit, [names[i] for i in hit], [0] * len(hit))

        def fresh() -> tuple:
            return [], [], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

        group = None
        names, sketches, n, root, near = fresh()
        for g, members, visitors in _runs(batches):
            if g != group:
                close()
                group = g
                names, sketches, n, root, near = fresh()
            if members.num_rows:
                names, sketches = names + members["nid"].to_pylist(), sketches + members["sketch"].to_pylist()
                n, root = np.concatenate([n, members["n"].to_numpy()]), np.concatenate([root, members["root"].to_numpy()])
                near = np.concatenate([near, np.zeros(members.num_rows, bool)])
                if alone:
                    close_by = gaps(members, sketches, n, root) < FAR
                    near |= close_by.any(axis=0)
                    near[len(near) - members.num_rows :] |= close_by.any(axis=1)
            if visitors.num_rows:
                gap = gaps(visitors, sketches, n, root)
                near |= (gap < FAR).any(axis=0)
                nearest = gap.min(axis=1)
                ok = np.flatnonzero(nearest < FAR)
                add([g] * len(ok), [None] * len(ok), visitors["nid"].to_numpy()[ok].tolist(), nearest[ok].tolist())
            if len(columns[0]) > 4096:
                yield out()
        close()
        yield out()

    own = groups.select("grp", F.posexplode("members").alias("at", "m")).select("grp", "at", "m.nid", "m.n", "m.sketch")
    if roots is None:
        own = own.withColumn("root", F.col("nid"))
    else:
        own = own.join(roots, "nid", "left").withColumn("root", F.coalesce("root", "nid")).select("grp", "at", "nid", "n", "sketch", "root")
    visiting = found.join(own.select("nid", "n", "sketch", "root"), "nid").withColumn("at", F.lit(None).cast("int"))
    if roots is not None:
        # groups without a visitor have nothing to say
        own = own.join(found.select("grp").distinct(), "grp", "left_semi")
    return _together(own.unionByName(visiting.select(own.columns))).mapInArrow(sift, "grp bigint, at int, nid bigint, gap bigint")


def _marked(digests: DataFrame, bits: int) -> np.ndarray:
    """A table of `bits` bits with one set for every (16-byte) digest; tasks send the places, a bounded table is gathered."""
    piece = 1 << 16

    def places(digest: pa.Array) -> np.ndarray:
        return (np.frombuffer(b"".join(digest.to_pylist()), "<u8").reshape(-1, 2)[:, 0] % np.uint64(bits)).astype(np.int64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(places(b["text_md5"]))
            yield pa.RecordBatch.from_arrays([pa.array(at // piece), pa.array(at % piece)], ["piece", "at"])

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        out = np.zeros(piece // 8, np.uint8)
        at = np.unique(rows["at"].to_numpy())
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([out.tobytes()], pa.binary())})

    marked = digests.mapInArrow(mark, "piece bigint, at bigint").distinct().groupBy("piece").applyInArrow(gather, "piece bigint, bits binary")
    table = np.zeros(bits // 8, np.uint8)
    for r in marked.collect():
        table[r.piece * piece // 8 : (r.piece + 1) * piece // 8] = np.frombuffer(r.bits, np.uint8)
    return table


def with_texts(docs: DataFrame, rows: DataFrame, names: DataFrame, visits: DataFrame, s: JoinSettings, text: str = "text") -> DataFrame:
    """Rows of `visits` (grp, at, nid) with a compressed text of the node.

    A table of bits lets through the texts that may be wanted, so that the others are not shuffled; the join is exact. A text is
    moved once to meet its copies and once for every visit; texts travel instead of token sets, which are larger and do not
    compress.
    """
    one = rows.where("node is not null").groupBy("node").agg(F.min("text_md5").alias("text_md5"))
    wanted = one.join(names.join(visits.select("nid").distinct(), "nid"), "node").select("nid", "text_md5")
    wanted = stage(visits.join(wanted, "nid").select("text_md5", "grp", "at", "nid"), "join-wanted")
    bits = s.wanted_bits
    table = docs.sparkSession.sparkContext.broadcast(_marked(wanted.select("text_md5"), bits))

    def may_be_wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor()
        for b in batches:
            at = (np.frombuffer(b"".join(b["text_md5"].to_pylist()), "<u8").reshape(-1, 2)[:, 0] % np.uint64(bits)).astype(np.int64)
            b = b.filter(pa.array((table.value[at >> 3] >> (at & 7) & 1).astype(bool)))
            packed = [packer.compress(x.as_buffer()) for x in b["text"]]
            yield pa.RecordBatch.from_arrays([b["text_md5"], pa.array(packed, pa.binary())], ["text_md5", "text"])

    t = text_of(text)
    texts = docs.select(F.unhex(F.md5(t)).alias("text_md5"), t.alias("text")).mapInArrow(may_be_wanted, "text_md5 binary, text binary")
    return texts.groupBy("text_md5").agg(F.first("text").alias("text")).join(wanted, "text_md5").select("grp", "at", "nid", "text")


class _Members:
    """The token sets of a group: its token union, each token with the members that have it, and the local components."""

    def __init__(self, names: list[int], sets: list[np.ndarray], percent: int) -> None:
        self.names, self.percent = names, percent
        self.sizes = np.array([len(x) for x in sets], np.int64)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.union, first = np.unique(tokens[order], return_index=True)
        self.first = np.append(first, len(tokens))
        self.links: list[tuple[int, int]] = []
        self.local = np.arange(len(sets))
        for i, x in enumerate(sets[:-1]):
            for j in self.similar(x):
                if j > i and self.local[i] != self.local[j]:
                    self.links.append((names[i], names[j]))
                    self.local[self.local == self.local[j]] = self.local[i]

    def similar(self, x: np.ndarray) -> np.ndarray:
        """Members with the least similarity to the set `x`."""
        at = np.minimum(np.searchsorted(self.union, x), len(self.union) - 1)
        at = at[self.union[at] == x]
        # the bound: no member shares more tokens than the union does
        if 100 * len(at) < self.percent * len(x):
            return np.empty(0, np.int64)
        much = self.first[at + 1] - self.first[at]
        place = np.repeat(self.first[at] - np.cumsum(much) + much, much) + np.arange(much.sum())
        shared = np.bincount(self.owner[place], minlength=len(self.names))
        return np.flatnonzero(100 * shared >= self.percent * (len(x) + self.sizes - shared))


def group_links(rows: DataFrame, s: JoinSettings) -> DataFrame:
    """(grp, at, nid, text), members with their place `at` and visitors without, texts compressed -> exact links (a, b) of
    node numbers."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        def close() -> None:
            nonlocal group
            if group is None and sets:
                group = _Members(names, sets, s.percent)
                found.extend(group.links)

        def tokens_of(column: pa.Array) -> list[np.ndarray]:
            return [token_set(unpacker.decompress(x.as_buffer()), s.shingle) for x in column]

        unpacker = zstandard.ZstdDecompressor()
        found: list[tuple[int, int]] = []
        at, names, sets, group = None, [], [], None
        for g, own, visiting in _runs(batches):
            if g != at:
                close()
                at, names, sets, group = g, [], [], None
            names = names + own["nid"].to_pylist()
            sets = sets + tokens_of(own["text"])
            if visiting.num_rows:
                close()
                for nid, tokens in zip(visiting["nid"].to_pylist(), tokens_of(visiting["text"])):
                    near = group.similar(tokens)
                    # one link to each local component
                    found.extend((nid, names[j]) for j in near[np.unique(group.local[near], return_index=True)[1]])
            if len(found) > 4096:
                yield out()
                found = []
        close()
        yield out()

    return _together(rows).mapInArrow(links, "a bigint, b bigint")


def similar_links(docs: DataFrame, rows: DataFrame, s: JoinSettings, text: str = "text",
                  clustered: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links (a, b) of nodes that connect every two with the least similarity, directly or through others; staged.

    First the members of each group are held against one another and every node visits the nearest of its tokens' first groups,
    which joins most of a cluster of near copies. Then nodes visit the groups in which a token of theirs leads to another component.
    """
    nodes = stage(lookups(docs, frequent(rows, s), s, text), "join-lookups")
    names = stage(nodes.select("node", "nid"), "join-names")
    groups = similar_groups(nodes, s, clustered)
    discard(nodes)

    def opened(visits: DataFrame) -> DataFrame:
        """Exact links of the near visits and members (grp, at, nid)."""
        return stage(group_links(with_texts(docs, rows, names, visits, s, text), s), "join-links")

    found = stage(promising(groups, first_visits(groups, s), s), "join-visits")
    nearest = found.where("at is null").groupBy("nid").agg(F.min(F.struct("gap", "grp")).alias("v")).select("v.grp", "nid")
    members = found.where("at is not null").select("grp", "at", "nid")
    visitors = lambda of: of.select("grp", F.lit(None).cast("int").alias("at"), "nid")
    links = opened(members.unionByName(visitors(nearest)))
    roots = stage(components(links).withColumnRenamed("node", "nid"), "join-roots")
    others = stage(later_visits(groups, roots, s).join(nearest, ["grp", "nid"], "left_anti"), "join-others")
    rest = stage(promising(groups, others, s, roots), "join-visits")
    both = links.unionByName(opened(rest.select("grp", "at", "nid")))
    named = lambda c: names.select(F.col("nid").alias(c), F.col("node").alias(f"node_{c}"))
    out = stage(both.join(named("a"), "a").join(named("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "join-links")
    discard(groups, names, found, others, rest, roots)
    return out


def jaccard_components(docs: DataFrame, s: JoinSettings = JoinSettings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    prepare(docs.sparkSession, rows=256)
    rows = stage(document_nodes(docs, s, text, doc_id), "join-rows")
    roots = components(similar_links(docs, rows, s, text))
    documents = rows.where("token is null").select("doc_id", "node", "n")
    least = documents.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(rooted.join(smallest, "root").select("node", "component_id"), "join-components")
    alone = documents.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return documents.join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
