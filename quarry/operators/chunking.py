"""Documents -> overlapping chunks that respect line and sentence boundaries.

The whole document is one row, so chunking is a narrow transformation: a small
Arrow UDF returns the chunk texts of each row and Spark explodes them.  Packing
works on cumulative lengths (binary search for the furthest piece that fits).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quarry.settings import Settings

CHUNKING_VERSION = "line-sentence-v1"
CHUNK_BITS = 20
MAX_CHUNKS_PER_DOC = 1 << CHUNK_BITS      # idx = doc_seq * 2^20 + chunk_number

_SPACES = re.compile(r"[ \t\r\f\v]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _packs(pieces: list[str], limit: int) -> Iterator[list[str]]:
    """Greedy groups whose one-space join stays within `limit` (a lone piece may exceed it)."""
    ends = [0, *accumulate(len(p) + 1 for p in pieces)]
    at = 0
    while at < len(pieces):
        to = max(at + 1, bisect_right(ends, ends[at] + limit + 1) - 1)
        yield pieces[at:to]
        at = to


def _slices(text: str, limit: int) -> Iterator[str]:
    """Cut an oversized run at the last space of its final third, else hard."""
    cut = re.compile(r"(.{%d,%d}) |.{%d}" % (max(1, int(limit * 0.65)), limit, limit), re.S)
    rest = text.strip()
    while len(rest) > limit:
        m = cut.match(rest)
        yield (m.group(1) or m.group(0)).strip()
        rest = rest[m.end():].strip()
    if rest:
        yield rest


def _units(text: str, limit: int) -> Iterator[str]:
    for line in text.split("\n"):
        block = _SPACES.sub(" ", line).strip()
        if len(block) <= limit:
            if block:
                yield block
            continue
        parts = [p for p in map(str.strip, _SENTENCE.split(block)) if p]
        if len(parts) <= 1:
            yield from _slices(block, limit)
            continue
        for oversized, run in groupby(parts, key=lambda p: len(p) > limit):
            if oversized:
                for p in run:
                    yield from _slices(p, limit)
            else:
                yield from (" ".join(g) for g in _packs(list(run), limit))


def _tail(units: list[str], overlap: int) -> list[str]:
    """Trailing whole units within `overlap`; a lone last unit may be twice that."""
    if overlap <= 0:
        return []
    sizes = list(accumulate((len(u) + 1 for u in reversed(units)), initial=-1))[1:]
    take = sum(1 for s in sizes if s <= overlap)
    if not take and sizes[0] <= 2 * overlap:
        take = 1
    return units[len(units) - take:] if take else []


def chunk_text(text: str, limit: int, overlap: int) -> list[str]:
    out: list[str] = []
    tail: list[str] = []
    for group in _packs(list(_units(text, limit)), limit):
        out.append(" ".join(tail + group).strip())
        tail = _tail(group, overlap)
    return out


def chunk_texts(content: Column, s: Settings) -> Column:
    limit, overlap = s.chunk_size_chars, s.chunk_overlap_chars

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t, limit, overlap) if t else [])

    return run(content)


def chunk_index(doc_seq: Column, number: Column) -> Column:
    """doc_seq * 2^20 + number; a document or number that would run into the next one's ids is an error."""
    fits = (number < MAX_CHUNKS_PER_DOC) & (doc_seq < (1 << 63) // MAX_CHUNKS_PER_DOC)
    index = doc_seq * MAX_CHUNKS_PER_DOC + number
    return F.when(fits, index).otherwise(F.raise_error(F.lit("chunk index out of range")).cast("long"))


def chunk_documents(documents: DataFrame, s: Settings) -> DataFrame:
    """chunks(idx, doc_seq, doc_id, chunk_number, chunk_id, text); order = idx."""
    return (
        documents.select(
            "doc_seq", "doc_id", "version",
            F.posexplode(chunk_texts(F.col("content"), s)).alias("pos", "text"),
        )
        .select(
            chunk_index(F.col("doc_seq"), F.col("pos") + 1).alias("idx"),
            "doc_seq",
            "doc_id",
            (F.col("pos") + 1).cast("int").alias("chunk_number"),
            F.format_string("%s:v%s:chunk-%d", F.col("doc_id"), F.col("version"), F.col("pos") + 1).alias("chunk_id"),
            "text",
        )
    )


def simple_chunks(documents: DataFrame, limit: int) -> DataFrame:
    """JVM-only variant: non-empty lines, greedily packed with an `aggregate` fold."""
    lines = F.filter(
        F.transform(
            F.split("content", "\n"),
            lambda x: F.trim(F.regexp_replace(x, "[ \t\r\f\x0b]+", " ")),
        ),
        lambda x: x != "",
    )
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, line: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + 1 + F.length(line) > limit)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["cur"] == ""), line)
            .otherwise(F.concat(acc["cur"], F.lit(" "), line)).alias("cur"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"]))

    packed = F.aggregate(lines, start, step, finish)
    return documents.select("doc_seq", "doc_id", F.posexplode(packed).alias("pos", "text")).select(
        "doc_seq", "doc_id", (F.col("pos") + 1).cast("int").alias("chunk_number"), "text"
    )
