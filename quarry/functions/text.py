"""Text expressions: Column -> Column, all of them JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from quarry.rules import russian as ru

TOKEN = "[0-9a-zа-я]+"
WORD_RUN = r"[\p{L}\p{N}_]+"
# letters whose full case folding differs from lower-casing
_FOLD_PAIRS = (("ß", "ss"), ("ſ", "s"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
_EDGE_WS = r"(?U)^\s+|\s+$"

Words = list[str] | tuple[str, ...]


def let(value: Column, body) -> Column:
    """Bind `value` once: inside lambdas Spark would re-evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(c: Column) -> Column:
    """Case folding plus ё -> е."""
    return F.translate(casefold(c), "ё", "е")


def casefold(c: Column) -> Column:
    """Case folding that keeps ё."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), _FOLD_PAIRS, F.lower(c))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_WS, "")


def squash(c: Column) -> Column:
    """Collapse every whitespace run to one space and strip."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm(c: Column) -> Column:
    return squash(fold(c))


def any_in(c: Column, markers: Words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(m)) for m in markers])


def count_in(c: Column, markers: Words) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(m)).cast("int") for m in markers])


def matches(c: Column, pattern: str, *, ignore_case: bool = False) -> Column:
    return c.rlike(("(?iuU)" if ignore_case else "(?U)") + pattern)


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


# --- tokens and roots -------------------------------------------------------


def tokens(c: Column) -> Column:
    return extract_all(fold(c), TOKEN)


def is_number(t: Column) -> Column:
    # digits come before ":", so most words are settled without the pattern
    return (t < F.lit(":")) & t.rlike("^[0-9]+$")


def keep_token(t: Column, stop: Words) -> Column:
    return (~t.isin(*dict.fromkeys(stop))) & ((F.length(t) >= 3) | is_number(t))


def root(t: Column) -> Column:
    """Conservative prefix stem: digits whole, >=9 -> 6 chars, >=6 -> 5 chars."""
    n = F.length(t)
    return (
        F.when(is_number(t), t)
        .when(n >= 9, F.substring(t, 1, 6))
        .when(n >= 6, F.substring(t, 1, 5))
        .otherwise(t)
    )


def root_list(c: Column, stop: Words = ru.RETRIEVAL_STOP) -> Column:
    return F.transform(F.filter(tokens(c), lambda t: keep_token(t, stop)), root)


def root_set(c: Column, stop: Words = ru.CONTEXT_STOP) -> Column:
    return F.array_distinct(root_list(c, stop))


def content_roots(c: Column) -> Column:
    return F.array_distinct(root_list(c, ru.PLANNER_STOP))


def specific_roots(c: Column) -> Column:
    return F.array_except(content_roots(c), F.array(*[F.lit(r) for r in ru.GENERIC_ROOTS]))


def gate_tokens(c: Column) -> Column:
    """Unstemmed distinct tokens used by the evidence gate."""
    return F.array_distinct(F.filter(tokens(c), lambda t: keep_token(t, ru.GATE_STOP)))


def rewrite_terms(c: Column) -> Column:
    """Second stemmer: keeps ё, tokens of four or more characters, first five."""
    raw = extract_all(F.lower(c), "[0-9a-zа-яё]+")
    kept = F.filter(raw, lambda t: (~t.isin(*ru.REWRITE_STOP)) & (F.length(t) >= 4))
    return F.array_distinct(F.transform(kept, lambda t: F.substring(t, 1, 5)))


def acronym_candidates(c: Column) -> Column:
    """Initials of every run of 3..5 significant tokens."""
    raw = extract_all(F.translate(F.lower(c), "ё", "е"), TOKEN)
    kept = F.filter(
        raw, lambda t: (~t.isin(*ru.CONTEXT_STOP)) & (F.length(t) >= 3) & ~is_number(t)
    )
    def runs(initials: Column) -> Column:
        n = F.length(initials)

        def of(width: int) -> Column:
            starts = F.when(n >= width, F.sequence(F.lit(1), n - width + 1)).otherwise(
                F.array().cast("array<int>")
            )
            return F.transform(starts, lambda i: F.substr(initials, i, F.lit(width)))

        return F.array_distinct(F.concat(of(3), of(4), of(5)))

    return let(F.array_join(F.transform(kept, lambda t: F.substring(t, 1, 1)), ""), runs)


def hard_anchors(c: Column) -> Column:
    """Latin words, all-caps acronyms, multi-digit numbers, inner capitalised words."""
    latin = F.transform(extract_all(c, r"(?U)\b[A-Za-z][A-Za-z0-9_-]{2,}\b"), casefold)
    caps = F.transform(extract_all(c, r"(?U)\b[А-ЯЁA-Z]{2,8}\b"), fold)
    numbers = extract_all(c, r"(?U)\b\d{2,}\b")
    words = extract_all(c, "[A-Za-zА-Яа-яЁё0-9_-]+")
    inner = F.when(F.size(words) > 1, F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))).otherwise(
        F.array().cast("array<string>")
    )
    named = F.transform(
        F.filter(
            inner,
            lambda t: (F.length(t) >= 4) & t.rlike("^[A-ZА-ЯЁ]") & t.rlike("[a-zа-яё]"),
        ),
        fold,
    )
    return F.array_distinct(F.concat(latin, caps, numbers, named))


def numbers(c: Column) -> Column:
    return F.array_distinct(extract_all(c, r"(?U)\b\d{2,}\b"))


def latin_entities(c: Column) -> Column:
    return F.array_distinct(
        F.transform(extract_all(c, r"(?U)\b[A-Za-z][A-Za-z0-9_-]{2,}\b"), casefold)
    )


def sentences(c: Column) -> Column:
    flat = squash(c)
    parts = F.filter(
        F.transform(F.split(flat, r"(?<=[.!?;:])\s+"), lambda s: F.trim(s)), lambda s: s != ""
    )
    return parts


# --- citations and answer clean-up ---------------------------------------------

CITATION = r"\[\s*[SsСс]\s*(\d+)\s*\]"


def source_ids(c: Column) -> Column:
    return F.array_distinct(
        F.transform(extract_all(c, r"(?U)" + CITATION, 1), lambda n: F.concat(F.lit("S"), n))
    )


def canonical_citations(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)" + CITATION, r"[S$1]")


def strip_model_markup(c: Column) -> Column:
    """Drop reasoning tags and code fences around a model reply."""
    x = strip(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""))
    x = strip(F.regexp_replace(x, r"(?i)^\s*</think>\s*", ""))
    x = F.regexp_replace(x, r"(?i)^```(?:json)?\s*", "")
    return strip(F.regexp_replace(x, r"\s*```$", ""))


def strip_question_echo(answer: Column, query: Column) -> Column:
    def cut(v: Column) -> Column:
        rest = F.regexp_replace(F.substr(v["a"], F.length(v["q"]) + 1), r"^[ \t\r\n:\-—]+", "")
        echoed = (F.length(v["q"]) > 0) & F.startswith(casefold(v["a"]), casefold(v["q"]))
        return strip(F.when(echoed, rest).otherwise(v["a"]))

    return let(
        F.struct(
            F.regexp_replace(answer, r"(?U)^\s+", "").alias("a"),
            strip(F.regexp_replace(query, r"(?U)\s+", " ")).alias("q"),
        ),
        cut,
    )


def abstained(c: Column) -> Column:
    t = norm(c)
    hit = F.contains(t, F.lit(ru.ABSTAIN_MARKER))
    for p in ru.ABSTAIN_PATTERNS:
        hit = hit | matches(t, p)
    return hit


def cache_key(c: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(casefold(c), r"(?U)\s+", " "), r"^[ .!?\t\r\n]+|[ .!?\t\r\n]+$", ""
    )


# --- query normalisation ----------------------------------------------------------


def strip_polite_prefix(c: Column) -> Column:
    def cut(flat: Column) -> Column:
        rest = F.regexp_replace(
            F.regexp_replace(flat, "(?iuU)" + ru.POLITE_PREFIX, ""), r"^[ ,]+|[ ,]+$", ""
        )
        return F.coalesce(F.nullif(rest, F.lit("")), flat)

    return let(squash(c), cut)


def normalize_query(c: Column) -> Column:
    """Conversational wording -> the terminology the knowledge base uses."""
    i = "(?iuU)"

    def permit(q: Column) -> Column:
        colloquial = ~F.contains(casefold(q), F.lit(ru.WORK_PERMIT)) & matches(
            q, ru.WORK_PERMIT_CONTEXT, ignore_case=True
        )
        # only the first occurrence: the lazy prefix group is put back unchanged
        first = F.regexp_replace(q, "(?iuUs)^(.*?)" + ru.WORK_PERMIT_SHORT, "$1" + ru.WORK_PERMIT)
        return F.regexp_replace(
            F.when(colloquial, first).otherwise(q), i + ru.ISSUE_VERB, ru.ISSUE_VERB_CANONICAL
        )

    def dangerous(q: Column) -> Column:
        return F.when(
            F.contains(casefold(q), F.lit(ru.WORK_PERMIT)),
            F.regexp_replace(q, i + ru.DANGEROUS_WORK, ru.DANGEROUS_WORK_CANONICAL),
        ).otherwise(q)

    def fire(q: Column) -> Column:
        def decide(low: Column) -> Column:
            asks = matches(low, ru.FIRE_SIGNS) & matches(low, ru.FIRE_ACTION)
            # appended once: a query that already ends in the suffix is left alone
            ignition = matches(low, ru.IGNITION) & ~F.endswith(low, F.lit(" " + ru.IGNITION_SUFFIX))
            return (
                F.when(asks, F.lit(ru.FIRE_QUERY))
                .when(ignition, F.concat(q, F.lit(" " + ru.IGNITION_SUFFIX)))
                .otherwise(q)
            )

        return let(fold(q), decide)

    spaced = F.regexp_replace(strip_polite_prefix(c), i + ru.WORK_PERMIT_SPACED, ru.WORK_PERMIT)
    return let(let(let(spaced, permit), dangerous), fire)


def is_comparison(c: Column) -> Column:
    return any_in(fold(c), ru.COMPARISON_MARKERS)


def split_stream_pieces(c: Column, target: int) -> Column:
    """Greedy packing of `\\S+\\s*` pieces into strings of at most `target` chars."""
    pieces = extract_all(c, r"(?U)\S+\s*")
    empty = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("cur")
    )

    def step(acc: Column, p: Column) -> Column:
        full = (acc["cur"] != "") & (F.length(acc["cur"]) + F.length(p) > target)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"]).alias("done"),
            F.when(full, p).otherwise(F.concat(acc["cur"], p)).alias("cur"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"] == "", acc["done"]).otherwise(
            F.array_append(acc["done"], acc["cur"])
        )

    return F.aggregate(pieces, empty, step, finish)
