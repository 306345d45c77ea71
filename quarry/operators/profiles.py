"""Term profiles: word 1-2-grams and in-word character 3-5-grams of a text.

One Arrow UDF yields, per row, the distinct term ids of both families with their
counts, plus the hashed bucket counts of the dense embedding.  Everything of one
text is produced in one row, so term counting never shuffles.  A term id is the
first 60 bits of the MD5 of the term (`w:`/`c:` prefix), so SQL can recompute it.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.text import let

PROFILE_TYPE = (
    "struct<word_ids:array<bigint>,word_tfs:array<int>,char_ids:array<bigint>,"
    "char_tfs:array<int>,buckets:array<int>>"
)
_WORD = re.compile(r"\w\w+")


def term_id(term: str) -> int:
    return int.from_bytes(md5(term.encode()).digest()[:8]) >> 4


def _word_id(term: str) -> int:
    return term_id("w:" + term)


#: Bounded, as every worker of an executor has its own.
_gram_id = lru_cache(maxsize=1 << 17)(term_id)


@lru_cache(maxsize=1 << 15)
def word_grams(word: str) -> np.ndarray:
    """Ids of the 3..5-grams inside one space-padded word."""
    w = f" {word} "
    return np.array([_gram_id("c:" + w[i:i + n]) for n in (3, 4, 5) for i in range(len(w) - n + 1)], np.int64)


def profile(text: str, half: int) -> dict[str, np.ndarray]:
    low = text.lower()
    words = _WORD.findall(low)
    pairs = map(" ".join, zip(words, words[1:]))
    word = Counter(map(_word_id, chain(words, pairs)))
    char = Counter(chain.from_iterable(word_grams(w).tolist() for w in low.split()))
    out, buckets = {}, []
    for family, counts in (("word", word), ("char", char)):
        ids = np.fromiter(counts.keys(), np.int64, len(counts))
        tfs = np.fromiter(counts.values(), np.int32, len(counts))
        out[family + "_ids"], out[family + "_tfs"] = ids, tfs
        buckets.append(np.bincount(ids % half, weights=tfs, minlength=half).astype(np.int32))
    out["buckets"] = np.concatenate(buckets)
    return out


#: MD5 by columns: the constants and shifts of its 64 steps, and how many messages are hashed at once.
_MD5_ADD = (np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32).astype(np.uint32)
_MD5_TURN = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().tolist()
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_ROWS = 1 << 13
#: Bytes of a message that is one block.
_MD5_ONE = 55


def _md5_ids(blocks: np.ndarray) -> np.ndarray:
    """The first 60 bits of the MD5 of padded messages of one block each, (n, 64) bytes."""
    out = np.empty(len(blocks), np.uint64)
    for lo in range(0, len(blocks), _MD5_ROWS):
        m = np.ascontiguousarray(blocks[lo:lo + _MD5_ROWS].view("<u4").T).astype(np.uint32, copy=False)
        a, b, c, d = (np.full(m.shape[1], x, np.uint32) for x in _MD5_START)
        f, t = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            if i < 16:
                g = i
                np.bitwise_xor(c, d, out=f); f &= b; f ^= d
            elif i < 32:
                g = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f); f &= d; f ^= c
            elif i < 48:
                g = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f); f ^= d
            else:
                g = 7 * i % 16
                np.invert(d, out=f); f |= b; f ^= c
            a += f; a += m[g]; a += _MD5_ADD[i]
            np.right_shift(a, 32 - _MD5_TURN[i], out=t)
            a <<= _MD5_TURN[i]
            a |= t
            a += b
            a, b, c, d = d, a, b, c
        high, low = (a + np.uint32(_MD5_START[0])).byteswap(), (b + np.uint32(_MD5_START[1])).byteswap()
        out[lo:lo + _MD5_ROWS] = (high.astype(np.uint64) << np.uint64(32) | low) >> np.uint64(4)
    return out.astype(np.int64)


def _term_ids(words: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """`term_id` of every word and of the pairs of words at `left` and `right`."""
    texts = [w.encode() for w in words]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first, second = np.concatenate([np.arange(len(words)), left]), np.concatenate([np.full(len(words), -1), right])
    single = second < 0
    total = 2 + size[first] + np.where(single, 0, 1 + size[second])
    ids = np.empty(len(first), np.int64)
    short = total <= _MD5_ONE
    for i in np.flatnonzero(~short).tolist():
        ids[i] = _word_id(words[first[i]] if single[i] else f"{words[first[i]]} {words[second[i]]}")
    rows = np.flatnonzero(short)
    # rows of one length of the first word lie together, so that the second words of each length are one copy
    rows = rows[np.argsort(size[first[rows]], kind="stable")]
    first, second, single, total = first[rows], second[rows], single[rows], total[rows]
    wide = min(_MD5_ONE - 2, int(size.max(initial=0)))
    padded = np.zeros((len(words), wide), np.uint8)
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    fits = place < wide
    padded[owner[fits], place[fits]] = np.frombuffer(b"".join(texts), np.uint8)[fits]
    blocks = np.zeros((len(rows), 64), np.uint8)
    blocks[:, :2] = np.frombuffer(b"w:", np.uint8)
    blocks[:, 2:2 + wide] = padded[first]
    lengths, cuts = np.unique(size[first], return_index=True)
    for n, lo, hi in zip(lengths.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(rows)]):
        at = lo + np.flatnonzero(~single[lo:hi])
        room = min(wide, _MD5_ONE - 3 - n)
        if len(at):
            blocks[at, 2 + n] = 32
            if room > 0:
                blocks[at, 3 + n:3 + n + room] = padded[second[at], :room]
    blocks[np.arange(len(rows)), total] = 0x80
    blocks[:, 56:].view("<u8")[:, 0] = total * 8
    ids[rows] = _md5_ids(blocks)
    return ids


def _placed(terms: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct terms and the place of every term among them."""
    place: dict[str, int] = {}
    at = np.fromiter((place.setdefault(t, len(place)) for t in terms), np.int64, len(terms))
    return list(place), at


def _counted(rows: np.ndarray, at: np.ndarray, ids: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms per row, ids, counts) of (row, place) pairs, ordered by row and id."""
    known, rank = np.unique(ids, return_inverse=True)
    cells, n = np.unique(rows * len(known) + rank[at], return_counts=True)
    row, col = np.divmod(cells, max(1, len(known)))
    return np.bincount(row, minlength=n_rows), known[col], n


def _word_terms(lows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and pairs of words that stand next to each other in a text."""
    found = [_WORD.findall(t) for t in lows]
    rows = np.repeat(np.arange(len(lows)), [len(w) for w in found])
    words, at = _placed(list(chain.from_iterable(found)))
    near = rows[1:] == rows[:-1]
    pairs, pair_at = np.unique(at[:-1][near] * len(words) + at[1:][near], return_inverse=True)
    left, right = np.divmod(pairs, max(1, len(words)))
    ids = _term_ids(words, left, right)
    return _counted(np.concatenate([rows, rows[1:][near]]), np.concatenate([at, pair_at + len(words)]), ids, len(lows))


def _word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams per word, ids, places): the 3..5-grams of all words at once, as places in the sorted ids, word by word.

    A gram is a number in the base of the batch's alphabet, so that only the distinct ones are cut out and hashed.
    """
    text = "".join(f" {w} " for w in words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    alphabet, code = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(end, size) - np.arange(len(text))
    key, bound, ids, owners, places = code.astype(np.int64), len(alphabet), [], [], []
    for n in range(2, 6):
        if bound * len(alphabet) >= 1 << 63:
            known, key = np.unique(key, return_inverse=True)
            bound = len(known)
        key, bound = key[:-1] * len(alphabet) + code[n - 1:], bound * len(alphabet)
        if n < 3:
            continue
        at = np.flatnonzero(left >= n)
        distinct, place = np.unique(key[at], return_inverse=True)
        # any place of a gram will do to cut it out
        first = np.empty(len(distinct), np.int64)
        first[place] = np.arange(len(at))
        owners.append(owner[at])
        places.append(place + sum(map(len, ids)))
        ids.append([_gram_id("c:" + text[i:i + n]) for i in at[first].tolist()])
    known, rank = np.unique(np.array(list(chain.from_iterable(ids)), np.int64), return_inverse=True)
    owner = np.concatenate(owners)
    return np.bincount(owner, minlength=len(words)), known, rank[np.concatenate(places)[np.argsort(owner, kind="stable")]]


def _char_terms(lows: list[str], cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """3..5-grams inside the words: the grams of a word are found once, counts are added in slices of at most `cells` grams."""
    found = [t.split() for t in lows]
    words, at = _placed(list(chain.from_iterable(found)))
    if not words:
        return np.zeros(len(lows), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    size, known, rank = _word_grams(words)
    start = np.cumsum(size) - size
    first = np.concatenate([[0], np.cumsum([len(w) for w in found])])
    total = np.concatenate([[0], np.cumsum(size[at])])[first]
    parts, lo = [], 0
    while lo < len(lows):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + cells, "right")) - 1)
        own = at[first[lo]:first[hi]]
        row = np.repeat(np.arange(hi - lo), np.diff(first[lo:hi + 1]))
        much = size[own]
        gram = rank[np.repeat(start[own] - np.cumsum(much) + much, much) + np.arange(much.sum())]
        cell, counts = np.unique(np.repeat(row, much) * len(known) + gram, return_counts=True)
        at_row, col = np.divmod(cell, len(known))
        parts.append((np.bincount(at_row, minlength=hi - lo), known[col], counts))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*parts))


def profiles(texts: list[str], half: int) -> pa.StructArray:
    """`profile` of many texts at once; the ids of a text are ascending."""
    lows = [t.lower() for t in texts]
    out, buckets = [], []
    for n, ids, tfs in (_word_terms(lows), _char_terms(lows)):
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        out += [pa.ListArray.from_arrays(ends, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))]
        cell = np.repeat(np.arange(len(lows)) * half, n) + ids % half
        buckets.append(np.bincount(cell, tfs, minlength=len(lows) * half).reshape(len(lows), half))
    counts = pa.array(np.concatenate(buckets, axis=1).astype(np.int32).ravel(), pa.int32())
    out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(lows) + 1) * 2 * half, pa.int32()), counts))
    return pa.StructArray.from_arrays(out, ["word_ids", "word_tfs", "char_ids", "char_tfs", "buckets"])


def profile_of(text: Column, dimension: int) -> Column:
    half = dimension // 2

    @F.arrow_udf(PROFILE_TYPE)
    def run(texts: pa.Array) -> pa.Array:
        return profiles([t or "" for t in texts.to_pylist()], half)

    return run(text)


def dense_vector(buckets: Column, dimension: int) -> Column:
    """Bucket counts -> unit vector: each half L2-normalised, then the whole."""
    half = dimension // 2

    def norm(part: Column) -> Column:
        return F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, x: a + x * x))

    def scaled(part: Column, n: Column, total: Column) -> Column:
        return F.transform(part, lambda x: F.when(n > 0, x / n / total).otherwise(0.0))

    def build(v: Column) -> Column:
        halves = F.when(v["wn"] > 0, 1.0).otherwise(0.0) + F.when(v["cn"] > 0, 1.0).otherwise(0.0)
        return let(
            F.sqrt(F.greatest(halves, F.lit(1.0))),
            lambda total: F.concat(scaled(v["w"], v["wn"], total), scaled(v["c"], v["cn"], total)),
        )

    w, c = F.slice(buckets, 1, half), F.slice(buckets, half + 1, half)
    return let(F.struct(w.alias("w"), c.alias("c"), norm(w).alias("wn"), norm(c).alias("cn")), build)


def dense_entries(profiles: DataFrame, dimension: int) -> DataFrame:
    """(idx, bucket, weight) of the non-zero entries: norms in the row, then one explode."""
    half = dimension // 2

    def square(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x)

    rows = profiles.select(
        "idx",
        F.sqrt(square(F.slice("buckets", 1, half))).alias("wn"),
        F.sqrt(square(F.slice("buckets", half + 1, half))).alias("cn"),
        "buckets",
    ).select("idx", "wn", "cn", F.posexplode("buckets").alias("bucket", "n")).filter("n > 0")
    halves = (F.col("wn") > 0).cast("int") + (F.col("cn") > 0).cast("int")
    norm = F.when(F.col("bucket") < half, F.col("wn")).otherwise(F.col("cn"))
    return rows.select("idx", "bucket", (F.col("n") / norm / F.sqrt(halves)).alias("weight"))
