"""Quality rules with suffix-array repetition.

A batch of texts becomes one array of word ids. Prefix doubling ranks all suffixes of the batch at
once (a suffix never passes its own text's end), the kept rank levels give the longest common
prefix of suffix-array neighbours, and the larger of a suffix's two neighbour prefixes is the
longest repeated substring that starts there. The union of those spans is the union of the maximal
repeats of the longest-common-prefix intervals.

Cases: a null or blank text has no words and fails the base rules; repeated rows are judged alike;
an empty table gives an empty result; columns with clashing names pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import BLANKS, prepare, scratch, text_of

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
BASE_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class RepetitionLimits:
    """A text is rejected above either limit; `min_repeat` is the least repeat (words) that counts as covered."""

    min_repeat: int = 8
    max_covered: float = 0.15
    max_longest: int = 100


def longest_repeats(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per position, words of the longest substring starting there that starts elsewhere in the same text.

    `ids` are word ids of all texts; `ends[i]` is the end (exclusive) of the text of position i.
    """
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64)
    key = ends.astype(np.int64) * (int(ids.max()) + 1) + ids
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.cumsum(counts) - counts
    rank = (starts[inverse] + 1).astype(np.int64)
    active = np.flatnonzero(counts[inverse] > 1)
    levels, k = [(1, rank.astype(np.int32))], 1
    while len(active):
        far = active + k
        inside = far < ends[active]
        second = np.where(inside, rank[np.minimum(far, n - 1)], 0)
        both = rank[active] * (n + 1) + second
        order = np.argsort(both, kind="stable")
        sorted_key, old, at = both[order], rank[active[order]], np.arange(len(active))
        new_old = np.r_[True, old[1:] != old[:-1]]
        new_sub = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
        first_old = np.maximum.accumulate(np.where(new_old, at, 0))
        first_sub = np.maximum.accumulate(np.where(new_sub, at, 0))
        rank[active[order]] = old + first_sub - first_old
        single = new_sub & np.r_[new_sub[1:], True]
        active = np.sort(active[order[~single]])
        k *= 2
        if len(active):
            levels.append((k, rank.astype(np.int32)))
    suffixes = np.empty(n, np.int64)
    suffixes[rank - 1] = np.arange(n)
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for k, level in reversed(levels):
        # equal ranks at level k mean k equal words inside one text, so a + k never passes its end
        same = (a < n) & (b < n)
        same[same] = level[a[same]] == level[b[same]]
        lcp[same] += k
        a[same] += k
        b[same] += k
    out = np.zeros(n, np.int64)
    out[suffixes[:-1]] = lcp
    out[suffixes[1:]] = np.maximum(out[suffixes[1:]], lcp)
    return out


def _covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """Mask of positions inside a span [i, i + lengths[i]) with lengths[i] >= least."""
    n = len(lengths)
    at = np.flatnonzero(lengths >= least)
    reach = np.zeros(n + 1, np.int64)
    reach[at] = at + lengths[at]
    return np.maximum.accumulate(reach[:n]) > np.arange(n) if n else np.zeros(0, bool)


def repetition_stats(texts: list[bytes], least: int, batch_words: int = 1 << 20) -> np.ndarray:
    """Rows of (n_words, n_repeat_words, covered words, longest repeat), texts taken in bounded groups."""
    out = np.zeros((len(texts), 4), np.int64)
    group: list[tuple[int, list[bytes]]] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if not group:
            return
        seen: dict[bytes, int] = {}
        sizes = np.array([len(w) for _, w in group])
        ids = np.fromiter((seen.setdefault(w, len(seen)) for _, ws in group for w in ws), np.int64, int(sizes.sum()))
        stops = np.cumsum(sizes)
        longest = longest_repeats(ids, np.repeat(stops, sizes))
        begins = stops - sizes
        rows = [i for i, _ in group]
        out[rows, 0] = sizes
        out[rows, 1] = np.add.reduceat(_covered(longest, WINDOW), begins, dtype=np.int64)
        out[rows, 2] = np.add.reduceat(_covered(longest, least), begins, dtype=np.int64)
        out[rows, 3] = np.maximum.reduceat(longest, begins)
        group, held = [], 0

    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        if held and held + len(words) > batch_words:
            flush()
        group.append((i, words))
        held += len(words)
    flush()
    return out


STATS = "struct<n_words:bigint,n_repeat_words:bigint,covered_words:bigint,longest_repeat:bigint>"


def repetition(text: Column, limits: RepetitionLimits) -> Column:
    least = limits.min_repeat

    @F.arrow_udf(STATS)
    def stats(col: pa.Array) -> pa.Array:
        got = repetition_stats([x.encode() for x in col.to_pylist()], least)
        return pa.StructArray.from_arrays(
            [pa.array(got[:, i]) for i in range(4)], ["n_words", "n_repeat_words", "covered_words", "longest_repeat"]
        )

    return stats(text)


def quality_rules(docs: DataFrame, limits: RepetitionLimits = RepetitionLimits(), text: str = "text") -> DataFrame:
    """All rows and columns of `docs` plus a struct column (first free name of `quality`) with every measure and the verdict."""
    prepare(docs.sparkSession)
    col, stats = scratch(docs, "quality", "quality_stats")
    t = text_of(text)
    df = docs.withColumn(stats, repetition(t, limits))
    s = F.col(stats)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    failed = (s.n_words < LEAST_WORDS) | (F.lit(100) * s.n_repeat_words > F.lit(BASE_REPEAT_PERCENT) * s.n_words)
    repetitive = (s.covered_words > limits.max_covered * s.n_words) | (s.longest_repeat > limits.max_longest)
    return df.withColumn(
        col,
        F.struct(
            s.n_words.alias("n_words"),
            F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            s.n_repeat_words.alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & ~repetitive).alias("kept"),
            s.covered_words.alias("covered_words"),
            s.longest_repeat.alias("longest_repeat"),
        ),
    ).drop(stats)


def keep_good(docs: DataFrame, limits: RepetitionLimits = RepetitionLimits()) -> DataFrame:
    """The rows of `docs` that pass, with their own columns only."""
    judged = quality_rules(docs, limits)
    return judged.where(F.col(judged.columns[-1]).kept).select(*[F.col(f"`{c}`") for c in docs.columns])
