"""Suffix-array dedup with a difference cover, one suffix bucket at a time.

Wanted is every byte covered by a `length`-byte string that starts at another place too. The
suffixes at cover positions (position modulo v in a perfect difference set) are the sample: for any
two places there is a shift below v that makes both of them sample positions, so a repeated string
holds a repeated sample string of length - v + 1 bytes. Three rounds follow, each of the same form:
name strings by hash, deal the names to buckets, sort one bucket at a time, report the repeated ones.

1. Sample strings: where none is repeated near, no repeated string starts (most of the input ends here).
2. Long ties: repeated samples are named again by length + v - 1 bytes. If such a name repeats, the v
   suffixes from there on are settled at once, without sorting them; one member of each class of
   equal names stands for the others in the last round.
3. The suffixes that are left, and those of the standing members, are sorted by their first `length` bytes.

Names are 64-bit polynomial hashes (48 bits besides the bucket in round 1, which only sifts; in
rounds 2 and 3 bucket and name come from independent hashes). A name is dealt once per Arrow batch,
so a passage in a third of all texts costs an entry a batch. Texts are told apart by MD5; a text
with an exact copy is removed whole if it has `length` bytes.

Cases: null and empty texts have nothing to remove; shorter texts keep all; repeated rows are copies of
each other; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import partitions, prepare, stage, text_of
from quarry.session import small_side

#: Perfect difference sets; every residue is a difference of two members.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}
SEGMENT = 1 << 20
BROADCAST_KEYS = 200_000
PACKED = "bucket int, batch bigint, keys binary, sizes binary, places binary, names binary, marks binary"
FOUND = "key binary, places binary, marks binary"


@dataclass(frozen=True)
class RepeatSettings:
    length: int = 400
    #: Buckets for each shuffle partition: a task holds one of them at a time.
    buckets_per_partition: int = 4
    #: Bytes of text named at once where the sample is named, and where all suffixes may be.
    sift_bytes: int = 8 << 20
    sort_bytes: int = 2 << 20

    @property
    def cover(self) -> int:
        fitting = [v for v in COVERS if v <= max(7, self.length // 3)]
        if self.length < 14:
            raise ValueError("length must be 14 or more")
        return max(fitting)

    @property
    def sample_length(self) -> int:
        return self.length - self.cover + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Namer:
    """64-bit names of all strings of one length, by prefix sums of a polynomial over random byte values."""

    def __init__(self, seed: int, longest: int) -> None:
        base = (0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64 | 1
        self.values = _mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1000))
        n = SEGMENT + longest + 1
        self.up = self._powers(base, n)
        self.down = self._powers(pow(base, -1, 2**64), n)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, np.uint64(base))
        out[0] = 1
        return np.multiply.accumulate(out)

    def names(self, data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """Names of data[p : p + length] for the ascending places `at`, a bounded segment at a time."""
        out = np.empty(len(at), np.uint64)
        cuts = np.searchsorted(at, np.arange(0, len(data) + SEGMENT, SEGMENT))
        for k in range(len(cuts) - 1):
            if cuts[k] == cuts[k + 1]:
                continue
            s = k * SEGMENT
            piece = self.values[data[s : s + SEGMENT + length]]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(piece * self.up[: len(piece)], out=sums[1:])
            p = at[cuts[k] : cuts[k + 1]] - s
            out[cuts[k] : cuts[k + 1]] = (sums[p + length] - sums[p]) * self.down[p]
        return _mix(out)


def pack_places(places: np.ndarray) -> bytes:
    """Ascending runs of places as byte planes of differences, compressed."""
    steps = np.diff(places, prepend=0).astype("<i8")
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack_places(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel())


def _concatenated(keys: list[bytes], texts: list[str]):
    """Distinct texts of a batch: keys, whether each has a copy here, joined bytes, starts, sizes."""
    seen: dict[bytes, int] = {}
    copies: list[bool] = []
    parts: list[bytes] = []
    rows: list[int] = []
    for i, (k, t) in enumerate(zip(keys, texts)):
        if (j := seen.get(k)) is not None:
            copies[j] = True
            continue
        seen[k] = len(parts)
        copies.append(False)
        parts.append(t.encode())
        rows.append(i)
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    return list(seen), np.array(copies, bool), data, np.cumsum(sizes) - sizes, sizes, rows


def _rows(batch: int, buckets: np.ndarray, at: np.ndarray, names, marks: np.ndarray):
    """Entries, by ascending place in the batch, as one packed row per bucket."""
    order = np.argsort(buckets, kind="stable")
    buckets, at, marks = buckets[order], at[order], marks[order]
    names = None if names is None else names[order]
    edges = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1], True]) if len(buckets) else np.zeros(1, int)
    return [
        (int(buckets[a]), batch, None, None, pack_places(at[a:b]), b"" if names is None else names[a:b].tobytes(), np.packbits(marks[a:b]).tobytes())
        for a, b in zip(edges[:-1], edges[1:])
    ]


def _pieces(batch: pa.RecordBatch, limit: int):
    """The batch in slices of about `limit` bytes of text (one text may be more)."""
    size = np.cumsum(pa.compute.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(size // limit, prepend=-1)).tolist() + [len(batch)] if len(batch) else []
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), *[(c, pa.binary()) for c in ("keys", "sizes", "places", "names", "marks")]])
FOUND_ARROW = pa.schema([("key", pa.binary()), ("places", pa.binary()), ("marks", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _deal(length: int, n_buckets: int, name_bytes: int, select, limit: int):
    """Mapper of a round: `select(batch, rows, starts, sizes)` gives the places (in the joined bytes) to be named."""

    def run(batches):
        first, second = Namer(1, length), Namer(2, length) if name_bytes == 8 else None
        part, nth = TaskContext.get().partitionId(), 0
        for batch in (piece for whole in batches for piece in _pieces(whole, limit)):
            keys, copies, data, starts, sizes, rows = _concatenated(batch["key"].to_pylist(), batch["text"].to_pylist())
            at = select(batch, rows, starts, sizes)
            owner = np.searchsorted(starts, at, side="right") - 1
            fits = at + length <= (starts + sizes)[owner] if len(at) else np.zeros(0, bool)
            at, owner = at[fits], owner[fits]
            if not len(at):
                continue
            nth += 1
            number = part << 32 | nth
            dealt = first.names(data, at, length)
            names = second.names(data, at, length) if second else dealt & np.uint64((1 << 48) - 1)
            buckets = ((_mix(dealt ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(24)) % np.uint64(n_buckets)).astype(np.int32)
            # once a batch: the first of equal names is dealt, the others are known to be repeated
            order = np.lexsort((names, dealt)) if second else np.argsort(dealt, kind="stable")
            new = np.ones(len(at), bool)
            new[1:] = (dealt[order[1:]] != dealt[order[:-1]]) | (names[order[1:]] != names[order[:-1]])
            group = np.cumsum(new) - 1
            leader = np.zeros(len(at), bool)
            leader[order[new]] = True
            many = np.zeros(len(at), bool)
            many[order] = (np.bincount(group)[group] > 1)
            many |= copies[owner]
            stored = np.ascontiguousarray(names.astype("<u8").view(np.uint8).reshape(-1, 8)[leader, :name_bytes])
            # the texts of the batch once, then the entries, whose places are in the joined texts
            out = [(number % n_buckets, number, b"".join(keys), sizes.astype("<u8").tobytes(), b"", b"", b"")]
            out += _rows(number, buckets[leader], at[leader], stored, many[leader])
            rest = ~leader
            if rest.any():
                alone = np.full(int(rest.sum()), number % n_buckets, np.int32)
                out += _rows(number, alone, at[rest], None, np.zeros(len(alone), bool))
            yield _table(out, PACKED_ARROW)

    return run


def _sort_buckets(name_bytes: int):
    """Reducer of a round: the repeated entries of each bucket, one bucket in memory at a time.

    Marks of the result tell the one member that stands for each class of equal names."""

    def solve(rows: list[tuple]):
        sizes = [len(r[5]) // name_bytes for r in rows]
        raw = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(-1, name_bytes)
        names = np.zeros((len(raw), 8), np.uint8)
        names[:, :name_bytes] = raw
        names = names.view("<u8").ravel()
        many = np.concatenate([np.unpackbits(np.frombuffer(r[6], np.uint8), count=n).astype(bool) for r, n in zip(rows, sizes)] or [np.zeros(0, bool)])
        order = np.argsort(names, kind="stable")
        new = np.ones(len(names), bool)
        new[1:] = names[order[1:]] != names[order[:-1]]
        group = np.cumsum(new) - 1
        size = np.bincount(group, weights=1 + many[order]) if len(names) else np.zeros(0)
        repeated, stands = np.zeros(len(names), bool), np.zeros(len(names), bool)
        repeated[order] = size[group] > 1
        stands[order[new]] = True
        at, out = 0, []
        for r, n in zip(rows, sizes):
            hit, mark = repeated[at : at + n], stands[at : at + n]
            at += n
            if not hit.any():
                continue
            out.append((r[0], r[1], None, None, pack_places(unpack_places(r[4])[hit]), b"", np.packbits(mark[hit]).tobytes()))
        return out

    def run(batches):
        bucket, held = None, []
        for batch in batches:
            for row in zip(*[batch[c].to_pylist() for c in PACKED_ARROW.names]):
                if row[0] != bucket:
                    if held:
                        yield _table(solve(held), PACKED_ARROW)
                    bucket, held = row[0], []
                if row[5]:
                    held.append(row)
                else:
                    yield _table([row], PACKED_ARROW)
        if held:
            yield _table(solve(held), PACKED_ARROW)

    return run


def _by_text(batches):
    """Found entries sorted by mapper batch -> one row per text of that batch: all its places, ascending, and marks."""
    number, keys, sizes, held = None, b"", b"", []

    def flush():
        if not held:
            return _table([], FOUND_ARROW)
        at = np.concatenate([p for p, _ in held])
        marks = np.concatenate([m for _, m in held])
        order = np.argsort(at, kind="stable")
        at, marks = at[order], marks[order]
        ends = np.cumsum(np.frombuffer(sizes, "<u8").astype(np.int64))
        cuts = np.r_[0, np.searchsorted(at, ends)]
        out = []
        for j in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[j], cuts[j + 1])
            begin = ends[j - 1] if j else 0
            out.append((keys[16 * j : 16 * j + 16], pack_places(at[part] - begin), np.packbits(marks[part]).tobytes()))
        return _table(out, FOUND_ARROW)

    for batch in batches:
        for row in zip(*[batch[c].to_pylist() for c in PACKED_ARROW.names]):
            if row[1] != number:
                yield flush()
                number, held = row[1], []
            if row[2] is not None:
                keys, sizes = row[2], row[3]
                continue
            places = unpack_places(row[4])
            held.append((places, np.unpackbits(np.frombuffer(row[6], np.uint8), count=len(places)).astype(bool)))
    yield flush()


def _round(texts: DataFrame, length: int, name_bytes: int, select, s: RepeatSettings, name: str, limit: int) -> DataFrame:
    """(key, places, marks) of the texts with repeated names, one row per text; staged."""
    n = partitions(texts.sparkSession)
    n_buckets = n * s.buckets_per_partition
    dealt = texts.mapInArrow(_deal(length, n_buckets, name_bytes, select, limit), PACKED)
    solved = dealt.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket").mapInArrow(_sort_buckets(name_bytes), PACKED)
    found = solved.repartition(n, "batch").sortWithinPartitions("batch").mapInArrow(_by_text, FOUND)
    # copies of a text in different batches found the same places; marks differ only by who stands
    return stage(found.groupBy("key").agg(F.first("places").alias("places"), F.first("marks").alias("marks")), name)


def _ranges(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Mask of [0, n) covered by the ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(starts, 0, n), 1)
    np.add.at(edge, np.clip(stops, 0, n), -1)
    return np.cumsum(edge[:n]) > 0


def _marks(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _open_starts(size: int, samples: np.ndarray, settled: np.ndarray, standing: np.ndarray, s: RepeatSettings) -> np.ndarray:
    """Suffixes of one text that round 3 has to sort."""
    n, v = max(size - s.length + 1, 0), s.cover
    near = _ranges(samples - v + 1, samples + 1, n)
    done = _ranges(settled, settled + v, n)
    return np.flatnonzero((near & ~done) | _ranges(standing, standing + v, n))


def repeated_spans(texts: DataFrame, s: RepeatSettings) -> DataFrame:
    """(key, text) rows -> staged (key, text, settled, starts): texts with repeated samples, the places from which v
    suffixes are repeated, and single repeated suffixes."""
    v, cover = s.cover, np.array(COVERS[s.cover])

    def samples(batch, rows, starts, sizes):
        # the residues of every text's places are counted from its own start
        blocks = (sizes + v - 1) // v
        begin = np.repeat(starts - v * (np.cumsum(blocks) - blocks), blocks) + v * np.arange(int(blocks.sum()))
        places = begin[:, None] + cover
        return places[places < np.repeat(starts + sizes, blocks)[:, None]]

    first = _round(texts, s.sample_length, 6, samples, s, "samples", s.sift_bytes)
    keys = small_side(first.select("key"), first.count(), BROADCAST_KEYS)
    near = texts.join(keys, "key", "left_semi").dropDuplicates(["key"])
    near = stage(near.join(first.select("key", F.col("places").alias("samples")), "key"), "near")

    def long_ties(batch, rows, starts, sizes):
        return np.concatenate([starts[j] + unpack_places(batch["samples"][i].as_py()) for j, i in enumerate(rows)] or [np.zeros(0, np.int64)])

    second = _round(near, s.length + v - 1, 8, long_ties, s, "ties", s.sort_bytes)
    left = near.join(second.select("key", F.col("places").alias("settled"), F.col("marks").alias("standing")), "key", "left")
    left = stage(left, "left")

    def open_places(batch, rows, starts, sizes):
        out = [np.zeros(0, np.int64)]
        for j, i in enumerate(rows):
            settled = standing = np.zeros(0, np.int64)
            if (data := batch["settled"][i].as_py()) is not None:
                settled = unpack_places(data)
                standing = settled[_marks(batch["standing"][i].as_py(), len(settled))]
            out.append(starts[j] + _open_starts(int(sizes[j]), unpack_places(batch["samples"][i].as_py()), settled, standing, s))
        return np.concatenate(out)

    third = _round(left, s.length, 8, open_places, s, "suffixes", s.sort_bytes)
    return left.join(third.select("key", F.col("places").alias("starts")), "key", "left").select("key", "text", "settled", "starts")


def removed_mask(size: int, settled: np.ndarray, starts: np.ndarray, s: RepeatSettings) -> np.ndarray:
    whole = _ranges(settled, settled + s.cover - 1 + s.length, size)
    return whole | _ranges(starts, starts + s.length, size)


def _cut(s: RepeatSettings):
    schema = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            out = []
            for key, text, settled, starts in zip(*[batch[c].to_pylist() for c in ("key", "text", "settled", "starts")]):
                data = np.frombuffer(text.encode(), np.uint8)
                none = np.zeros(0, np.int64)
                gone = removed_mask(len(data), unpack_places(settled) if settled else none, unpack_places(starts) if starts else none, s)
                edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                out.append((key, int(gone.sum()), len(edges) // 2, hashlib.sha256(data[~gone].tobytes()).hexdigest(), edges.tolist()))
            yield _table(out, schema)

    return run


CUT = "key binary, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>"


def suffix_dedup(docs: DataFrame, s: RepeatSettings = RepeatSettings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (starts and ends of the removed
    byte runs, in turn)."""
    prepare(docs.sparkSession, 2048)
    t = text_of(text)
    key = F.unhex(F.md5(t))
    texts = docs.select(key.alias("key"), t.alias("text")).where(F.octet_length("text") >= s.length)
    cuts = stage(repeated_spans(texts, s).mapInArrow(_cut(s), CUT), "cuts")
    size = F.octet_length(t).cast("long")
    rows = stage(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), key.alias("key"), size.alias("n_bytes"), F.sha2(t, 256).alias("sha")), "digests")
    copied = rows.where(F.col("n_bytes") >= s.length).groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("copied"))
    facts = copied.join(cuts, "key", "full")
    joined = rows.join(facts, "key", "left")
    whole = F.coalesce("copied", F.lit(False))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(whole, empty).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(F.coalesce("spans", F.array().cast("array<bigint>"))).alias("spans"),
    )
