"""Training-order materialisation: token ids in fixed-stride shards under a keyed permutation.

Texts become token ids once (staged), sequences are numbered by scan partition and position, and a
keyed Feistel network over the smallest even-bit domain, walked until it lands below N, gives every
sequence its slot. Slots are dealt by range: shard k holds slots [k * shard_size, (k + 1) * shard_size)
in order, each `stride` bytes, so a reader that stopped at slot t opens one shard and seeks.

Only the sequence counts of the scan partitions (16 bytes a partition) come to the driver.

Cases: a null or empty text is one sequence holding the end token; repeated rows are sequences of
their own; null ids pass through; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import os
import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import prepare, stage, text_of

MASK = (1 << 64) - 1
_BESIDE = re.compile(r"\s | \s")
_CUT = re.compile(r"(?<=\S) (?=\S)")
SCHEMA = "part int, nth bigint, doc_id bigint, seq_no int, n_tokens int, tokens binary"


@dataclass(frozen=True)
class OrderSettings:
    tokenizer: str = "byte_bpe_50k.tiktoken"
    sequence_length: int = 512
    shard_size: int = 16_384
    key: int = 20_240_607
    end_token: int = 50_256
    #: Most tasks of the last shuffle; a task then orders and writes several neighbouring shards, one after the other.
    tasks: int = 20_000

    @property
    def stride(self) -> int:
        return 2 * self.sequence_length


def tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Byte-level token ids as little-endian uint16 bytes, with a bounded cache of space-led pieces.

    The vocabulary's pattern always starts a piece at a space between two characters that are no white space, so a text
    may be cut there and nowhere else: a space beside any other white space stays inside its piece.
    """

    def __init__(self, name: str, cache_size: int = 400_000) -> None:
        import public_tokenizers
        import tiktoken

        with open(tokenizer_path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = _CUT.split(text) if _BESIDE.search(text) else text.split(" ")
        cache = self.cache
        if len(cache) > self.cache_size:
            cache.clear()
        out = [np.array(self.encode(first), "<u2").tobytes()] if first else []
        for word in rest:
            got = cache.get(word)
            if got is None:
                got = np.array(self.encode(" " + word), "<u2").tobytes()
                if len(word) < 64:
                    cache[word] = got
            out.append(got)
        return b"".join(out)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel_slots(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The keyed permutation of [0, n) at `index`, by cycle-walking a balanced Feistel network."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [_mix64(np.array([(key + (r + 1) * 0x9E3779B97F4A7C15) & MASK], np.uint64))[0] for r in range(rounds)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & low
        for k in keys:
            left, right = right, left ^ (_mix64(right ^ k) & low)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def tokenized(docs: DataFrame, s: OrderSettings, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Sequences of every text, numbered within their scan partition (staged, so a number never moves)."""
    length, end, name = s.sequence_length, s.end_token, s.tokenizer

    def encode(batches):
        encoder, part, nth = Encoder(name), TaskContext.get().partitionId(), 0
        stop, schema = np.array([end], "<u2").tobytes(), pa.schema(
            [("part", pa.int32()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("seq_no", pa.int32()), ("n_tokens", pa.int32()), ("tokens", pa.binary())]
        )
        for batch in batches:
            ids, numbers, counts, cut = [], [], [], []
            for doc, body in zip(batch["doc_id"].to_pylist(), batch["body"].to_pylist()):
                data = encoder.ids(body) + stop
                for k, at in enumerate(range(0, len(data), 2 * length)):
                    piece = data[at : at + 2 * length]
                    ids.append(doc)
                    numbers.append(k)
                    counts.append(len(piece) // 2)
                    cut.append(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(np.arange(nth, nth + len(ids))), pa.array(ids, pa.int64()),
                 pa.array(numbers, pa.int32()), pa.array(counts, pa.int32()), pa.array(cut, pa.binary())], schema=schema
            )
            nth += len(ids)

    sequences = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(text).alias("body")).mapInArrow(encode, SCHEMA)
    # the whole corpus lies here beside its shuffle: zstd takes three quarters of the disk of the default
    return stage(sequences, "tokens", compression="zstd")


def training_order(docs: DataFrame, s: OrderSettings = OrderSettings(), **columns: str) -> DataFrame:
    """One row per sequence in training order: slot, shard, byte_offset, doc_id, seq_no, n_tokens, tokens (one stride)."""
    spark = docs.sparkSession
    prepare(spark)
    sequences = tokenized(docs, s, **columns)
    sizes = {r.part: r.n for r in sequences.groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts = np.array(sorted(sizes), np.int64)
    ends = np.cumsum([sizes[p] for p in parts]) if sizes else np.zeros(0, np.int64)
    total = int(ends[-1]) if sizes else 0
    begins, key = (ends - [sizes[p] for p in parts]) if sizes else ends, s.key

    @F.arrow_udf("bigint")
    def slot_of(part: pa.Array, nth: pa.Array) -> pa.Array:
        at = begins[np.searchsorted(parts, part.to_numpy(zero_copy_only=False))] + nth.to_numpy(zero_copy_only=False)
        return pa.array(feistel_slots(at, total, key))

    slotted = sequences.withColumn("slot", slot_of("part", "nth"))
    slotted = slotted.withColumn("shard", F.floor(F.col("slot") / s.shard_size).cast("int"))
    shards = max(1, -(-total // s.shard_size))
    tasks = min(shards, s.tasks)
    return (
        slotted.repartitionById(tasks, F.expr(f"cast(cast(shard as bigint) * {tasks} div {shards} as int)"))
        .sortWithinPartitions("slot")
        .select(
            "slot", "shard", ((F.col("slot") % s.shard_size) * s.stride).cast("long").alias("byte_offset"), "doc_id", "seq_no", "n_tokens",
            F.rpad("tokens", s.stride, b"\x00").alias("tokens"),
        )
    )


def write_shards(ordered: DataFrame, folder: str, s: OrderSettings = OrderSettings()) -> DataFrame:
    """Write every shard as one flat file of strides in a folder that all executors mount; returns (shard, path, sequences).

    A task writes under a name of its own and renames at the end, so a repeated attempt replaces a
    whole file by the same whole file.
    """
    local = folder.removeprefix("file://") if folder.startswith("file:///") else folder
    if "://" in local:
        raise ValueError("flat shards need a mounted folder; write the frame itself with a Spark format elsewhere")

    def write(batches):
        os.makedirs(local, exist_ok=True)
        open_shard, file, rows = None, None, 0
        done: list[tuple[int, str, int]] = []

        def close():
            if file is not None:
                file.close()
                final = f"{local}/shard-{open_shard:06d}.bin"
                os.replace(file.name, final)
                done.append((open_shard, final, rows))

        for batch in batches:
            for shard, tokens in zip(batch["shard"].to_pylist(), batch["tokens"].to_pylist()):
                if shard != open_shard:
                    close()
                    open_shard, rows = shard, 0
                    file = open(f"{local}/.{shard:06d}-{uuid.uuid4().hex}", "wb")
                file.write(tokens)
                rows += 1
        close()
        yield pa.RecordBatch.from_pylist(
            [{"shard": a, "path": b, "sequences": c} for a, b, c in done],
            schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("sequences", pa.int64())]),
        )

    return stage(ordered.select("shard", "tokens").mapInArrow(write, "shard int, path string, sequences bigint"), "shards")


def read_from(folder: str, slot: int, s: OrderSettings = OrderSettings()):
    """Token-id arrays from `slot` on, in training order, shard after shard."""
    shard, at = divmod(slot, s.shard_size)
    while os.path.exists(path := f"{folder}/shard-{shard:06d}.bin"):
        with open(path, "rb") as f:
            f.seek(at * s.stride)
            while data := f.read(s.stride):
                yield np.frombuffer(data, "<u2")
        shard, at = shard + 1, 0
