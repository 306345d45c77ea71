"""Token counts by rank-synchronous merging of ragged arrays.

The piece model merges, again and again, the adjacent pair whose piece has the best score, the
leftmost of equal ones. No piece holds a space mark after another character, so a text falls into
pre-tokens (space marks, then other characters) that never merge with each other. The distinct
unknown pre-tokens of a batch lie in flat arrays with offsets; one round finds every sequence's
lowest-ranked pair with one segmented minimum and merges them all, one per sequence (merging more
at once could skip a better pair that a merge creates). The symbols left are the tokens; a
character without a piece counts one token a byte. Pre-tokens too long for rounds over the whole
batch are merged with a heap, by the same rule.

Cases: null and empty texts have no tokens; strings of control pieces are plain characters; repeated
rows are counted each; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import prepare, scratch, text_of
from quarry.llm.training_order import tokenizer_path

MARK = "▁"
PRETOKEN = re.compile(f"{MARK}+[^{MARK}]*")
NEVER = np.int64(1 << 62)
LIMIT = 4096


class PieceMerger:
    """Pair table of a byte-fallback piece model and the merging of batches of pre-tokens."""

    def __init__(self, model: str, cache_size: int = 300_000, longest: int = 256) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(tokenizer_path(model), "rb") as f:
            proto.ParseFromString(f.read())
        pieces = {p.piece: p.score for p in proto.pieces if p.type == 1}
        symbols = dict.fromkeys(pieces)
        for p in pieces:
            symbols.update(dict.fromkeys(p))
        self.ids = {s: i for i, s in enumerate(symbols)}
        order = {s: i for i, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        pairs = {}
        for p, score in pieces.items():
            for cut in range(1, len(p)):
                left, right = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if left is not None and right is not None:
                    pairs[(left, right)] = (order[score], self.ids[p])
        self.pairs = pairs
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self.keys = keys[by]
        self.ranks = np.array([r for r, _ in pairs.values()], np.int64)[by]
        self.merged = np.array([m for _, m in pairs.values()], np.int64)[by]
        # tokens a left-over symbol counts: one for a piece, else one a byte
        self.cost = np.array([1 if s in pieces else len(s.encode()) for s in self.ids], np.int64)
        self.cache: dict[str, int] = {}
        self.cache_size, self.longest = cache_size, longest

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NEVER), self.merged[at]

    def merge_batch(self, pretokens: list[str]) -> np.ndarray:
        """Token counts of pre-tokens, all merged in step."""
        get, cost = self.ids.get, self.cost
        sizes = np.array([len(p) for p in pretokens], np.int64)
        flat = "".join(pretokens)
        sym = np.fromiter((get(c, -1) for c in flat), np.int64, len(flat))
        unknown = np.fromiter((len(c.encode()) for c in flat), np.int64, len(flat)) if (sym < 0).any() else None
        counts = np.zeros(len(pretokens), np.int64)
        seq = np.arange(len(pretokens))
        starts = np.cumsum(sizes) - sizes
        value = np.where(sym >= 0, cost[sym], 0 if unknown is None else unknown)
        n = len(sym)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        last = np.zeros(n, bool)
        last[starts + sizes - 1] = True
        first = np.zeros(n, bool)
        first[starts] = True
        after[last], before[first] = -1, -1
        rank = np.full(n, NEVER)
        inner = np.flatnonzero(~last)
        rank[inner], _ = self._lookup(sym[inner], sym[inner + 1])
        while True:
            # rank and position in one number: the segmented minimum is the leftmost lowest pair
            key = np.where(rank < NEVER, rank << 32 | np.arange(n), NEVER)
            low = np.minimum.reduceat(key, starts)
            live = low < NEVER
            if not live.all():
                done = np.flatnonzero(~live)
                counts[seq[done]] = np.add.reduceat(value, starts)[done]
                if not live.any():
                    return counts
                keep = np.repeat(live, sizes)
                shift = np.cumsum(~keep)
                sym, value, rank = sym[keep], value[keep], rank[keep]
                moved = lambda x: np.where(x >= 0, x - shift[np.maximum(x, 0)], -1)
                after, before = moved(after)[keep], moved(before)[keep]
                at = (low[live] & 0xFFFFFFFF) - shift[low[live] & 0xFFFFFFFF]
                seq, sizes = seq[live], sizes[live]
                starts = np.cumsum(sizes) - sizes
                n = len(sym)
            else:
                at = low & 0xFFFFFFFF
            gone = after[at]
            _, sym[at] = self._lookup(sym[at], sym[gone])
            value[at] = cost[sym[at]]
            value[gone], rank[gone] = 0, NEVER
            nxt, prv = after[gone], before[at]
            after[at] = nxt
            has = nxt >= 0
            before[nxt[has]] = at[has]
            rank[at] = NEVER
            rank[at[has]], _ = self._lookup(sym[at[has]], sym[nxt[has]])
            has = prv >= 0
            rank[prv[has]], _ = self._lookup(sym[prv[has]], sym[at[has]])

    def merge_long(self, text: str) -> int:
        """Token count of one long pre-token, by a heap of (rank, position)."""
        sym = [self.ids.get(c, -1) for c in text]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.pairs[p], i, *p) for i, p in enumerate(zip(sym, sym[1:])) if p in self.pairs]
        heap = [(rank, i, m, a, b) for rank, m, i, a, b in heap]
        heapq.heapify(heap)
        dead = bytearray(n)
        while heap:
            _, i, m, a, b = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], dead[j] = m, 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (p := self.pairs.get((m, sym[k]))) is not None:
                    heapq.heappush(heap, (p[0], i, p[1], m, sym[k]))
            if (h := before[i]) >= 0 and (p := self.pairs.get((sym[h], m))) is not None:
                heapq.heappush(heap, (p[0], h, p[1], sym[h], m))
        return sum(int(self.cost[s]) if s >= 0 else len(c.encode()) for s, c, d in zip(sym, text, dead) if not d)

    def count(self, texts: list[str], batch_chars: int = 1 << 20) -> list[int]:
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        cache, split = self.cache, []
        for t in texts:
            if not t:
                split.append([])
            elif MARK not in t and "  " not in t and t[0] != " ":
                # plain words: the cache is keyed by the word without its mark
                split.append(t.split(" "))
            else:
                split.append([p[1:] for p in PRETOKEN.findall(MARK + t.replace(" ", MARK))])
        fresh = list({w for ws in split for w in ws if w not in cache})
        found: dict[str, int] = {}
        some, held = [], 0
        for w in fresh:
            if len(w) > self.longest:
                found[w] = self.merge_long(MARK + w)
                continue
            some.append(w)
            held += len(w) + 1
            if held > batch_chars:
                found.update(zip(some, self.merge_batch([MARK + x for x in some]).tolist()))
                some, held = [], 0
        if some:
            found.update(zip(some, self.merge_batch([MARK + x for x in some]).tolist()))
        cache.update(found)
        return [sum(map(cache.__getitem__, ws)) for ws in split]


_mergers: dict[str, PieceMerger] = {}


def n_tokens(text: Column, model: str) -> Column:
    @F.arrow_udf("bigint")
    def count(col: pa.Array) -> pa.Array:
        # one merger and cache per worker process
        if model not in _mergers:
            _mergers[model] = PieceMerger(model)
        return pa.array(_mergers[model].count(col.to_pylist()), pa.int64())

    return count(text)


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = LIMIT, text: str = "text") -> DataFrame:
    """`docs` plus one struct column (first free name of `tokens`): n_bytes, n_tokens, over_limit."""
    prepare(docs.sparkSession)
    col, n = scratch(docs, "tokens", "n_tokens")
    t = text_of(text)
    return docs.withColumn(n, n_tokens(t, model)).withColumn(
        col, F.struct(F.octet_length(t).cast("long").alias("n_bytes"), F.col(n).alias("n_tokens"), (F.col(n) > limit).alias("over_limit"))
    ).drop(n)
