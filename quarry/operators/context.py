"""Context building: ordering, passage focus, duplicate removal, character budget.

All operators work on `hits`, an array of at most a few dozen structs per query, with
array expressions, so every query is one narrow row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.intents import answer_profile, membership_query, membership_text, sentence_adjustment
from quarry.functions.text import (
    acronym_candidates, count_in, fold, is_comparison, let, norm, root_set, sentences,
)
from quarry.rules import russian as ru
from quarry.settings import Settings

PASSAGE = "struct<idx:bigint,doc_id:string,chunk_id:string,title:string,section:string,url:string,text:string,score:double,lexical_coverage:double>"


# --- profile and ordering ---------------------------------------------------------


def profile_budgets(query: Column, s: Settings) -> Column:
    """struct(name, tokens, passage, context, chunks)."""
    caps = {
        "procedure": s.procedure_max_tokens, "fact": s.fact_max_tokens, "default": s.default_max_tokens,
    }

    def row(name: str) -> Column:
        passage, context, chunks = ru.PROFILE_LIMITS[name]
        return F.struct(
            F.lit(name).alias("name"),
            F.lit(min(s.naive_max_tokens, caps[name])).alias("tokens"),
            F.lit(min(s.focused_passage_chars, passage)).alias("passage"),
            F.lit(min(s.max_context_chars, context)).alias("context"),
            F.lit(min(s.context_max_chunks, chunks)).alias("chunks"),
        )

    name = answer_profile(query)
    return F.when(name == "procedure", row("procedure")).when(name == "fact", row("fact")).otherwise(row("default"))


def _split_by_anchor(hits: Column) -> tuple[Column, Column]:
    doc = F.element_at(hits, 1)["doc_id"]
    return F.filter(hits, lambda h: h["doc_id"] == doc), F.filter(hits, lambda h: h["doc_id"] != doc)


def _sorted_by(items: Column, key) -> Column:
    """Stable sort of an array by a struct key: position breaks ties."""
    keyed = F.transform(items, lambda h, i: F.struct(key(h).alias("k"), i.alias("i"), h.alias("h")))
    ordered = F.array_sort(
        keyed, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1)
        .when(a["i"] < b["i"], -1).otherwise(1)
    )
    return F.transform(ordered, lambda e: e["h"])


def coherent_order(query: Column, hits: Column, profile: Column, s: Settings) -> Column:
    """Procedures: the leading document's chunks first, nearest chunk numbers first."""
    if not s.procedure_source_coherence:
        return hits
    same, rest = _split_by_anchor(hits)
    anchor = F.element_at(hits, 1)
    near = _sorted_by(
        F.filter(same, lambda h: h["chunk_id"] != anchor["chunk_id"]),
        lambda h: F.struct(
            F.coalesce(F.abs(h["chunk_number"] - anchor["chunk_number"]), F.lit(9999)), -h["score"]
        ),
    )
    apply = (
        (profile == "procedure") & ~is_comparison(query) & (F.size(hits) >= 2) & (F.size(same) >= 2)
    )
    return F.when(apply, F.concat(F.array(anchor), near, rest)).otherwise(hits)


def intent_order(query: Column, hits: Column) -> Column:
    """Membership questions: role-bearing chunks of the leading document first."""
    same, rest = _split_by_anchor(hits)

    def key(h: Column) -> Column:
        t = fold(h["text"])
        explicit = F.when(membership_text(t), 3.0).otherwise(0.0)
        roles = F.least(F.lit(5), count_in(t, ru.ROLE_MARKERS)) * 0.45
        return F.struct(-(explicit + roles + h["score"] * 0.15), -h["score"])

    apply = membership_query(norm(query)) & (F.size(hits) >= 2) & (F.size(same) >= 2)
    return F.when(apply, F.concat(_sorted_by(same, key), rest)).otherwise(hits)


# --- sentence scoring and focus ----------------------------------------------------------


def sentence_score(qroots: Column, acronyms: Column, qnorm: Column, sentence: Column) -> Column:
    def score(v: Column) -> Column:
        sroots = v["roots"]
        overlap = F.size(F.array_intersect(qroots, sroots))
        bonus = F.when(F.arrays_overlap(acronyms, sroots), 0.18).otherwise(0.0)
        value = (
            0.82 * overlap / F.size(qroots)
            + 0.18 * F.least(F.lit(1.0), overlap / F.size(sroots) * 4.0)
            + bonus
            + sentence_adjustment(qnorm, v["norm"], v["n"])
        )
        return F.when((F.size(sroots) > 0) & (F.size(qroots) > 0), F.round(value, 9)).otherwise(0.0)

    # bound once: the adjustment reads the normalised sentence some twenty times
    parts = F.struct(
        root_set(sentence).alias("roots"), norm(sentence).alias("norm"), F.length(F.trim(sentence)).alias("n")
    )
    return let(parts, score)


def query_features(df: DataFrame, query_col: str = "query") -> DataFrame:
    q = F.col(query_col)
    return df.withColumns(
        {"_qroots": root_set(q), "_acronyms": acronym_candidates(q), "_qnorm": norm(q)}
    )


def _grow(sents: Column, scores: Column, radius: int, limit: Column) -> Column:
    """Window around the best sentence, grown toward the better neighbour within `limit`."""
    n = F.size(sents)
    top = F.array_max(scores)
    # the last of equally good sentences wins
    best = n - F.array_position(F.reverse(scores), top).cast("int") + 1

    def text(lo: Column, hi: Column) -> Column:
        return F.array_join(F.slice(sents, lo, hi - lo + 1), " ")

    start = F.struct(
        F.greatest(F.lit(1), best - radius).alias("lo"),
        F.least(n, best + radius).alias("hi"),
        F.lit(False).alias("stop"),
    )

    def step(w: Column, _: Column) -> Column:
        left = F.when(w["lo"] > 1, F.get(scores, w["lo"] - 2))
        right = F.when(w["hi"] < n, F.get(scores, w["hi"]))
        go_right = right.isNotNull() & (left.isNull() | (right >= left))
        lo = F.when(go_right, w["lo"]).otherwise(w["lo"] - 1)
        hi = F.when(go_right, w["hi"] + 1).otherwise(w["hi"])
        stop = w["stop"] | (left.isNull() & right.isNull())
        stop = stop | (F.length(text(F.greatest(lo, F.lit(1)), F.least(hi, n))) > limit)
        return F.struct(
            F.when(stop, w["lo"]).otherwise(lo).alias("lo"),
            F.when(stop, w["hi"]).otherwise(hi).alias("hi"),
            stop.alias("stop"),
        )

    return F.aggregate(sents, start, step, lambda w: F.trim(text(w["lo"], w["hi"])))


def _membership_block(sents: Column, limit: Column) -> Column:
    """Sentences from the composition statement on, up to `limit` chars or four roles."""
    marked = F.transform(sents, lambda x: membership_text(fold(x)))
    at = F.array_position(marked, F.lit(True)).cast("int")
    before = F.get(sents, at - 2)
    start = F.when((at > 1) & F.contains(fold(before), F.lit("состав")), at - 1).otherwise(at)
    block = F.slice(sents, start, F.size(sents))
    init = F.struct(F.lit("").alias("text"), F.lit(0).alias("roles"), F.lit(False).alias("stop"))

    def step(a: Column, x: Column) -> Column:
        joined = F.when(a["text"] == "", x).otherwise(F.concat(a["text"], F.lit(" "), x))
        skip = a["stop"] | ((a["text"] != "") & (F.length(joined) > limit))
        text = F.when(skip, a["text"]).otherwise(joined)
        roles = a["roles"] + F.when(skip, 0).otherwise(count_in(fold(x), ru.ROLE_MARKERS))
        return F.struct(
            text.alias("text"), roles.alias("roles"),
            (skip | (F.length(text) >= limit) | (roles >= 4)).alias("stop"),
        )

    return F.when(at > 0, F.aggregate(block, init, step, lambda a: a["text"]))


def focus_text(text: Column, features: Column, limit: Column, radius: int) -> Column:
    """Best passage of one chunk; `features` = struct(roots, acronyms, norm) of the query."""

    def focused(sents: Column) -> Column:
        window = let(
            F.transform(
                sents,
                lambda x: sentence_score(features["roots"], features["acronyms"], features["norm"], x),
            ),
            lambda scores: _grow(sents, scores, radius, limit),
        )
        block = F.when(membership_query(features["norm"]), _membership_block(sents, limit))
        return F.coalesce(block, window)

    return F.when(F.length(text) <= limit, text).otherwise(
        let(sentences(text), lambda sents: F.when(F.size(sents) == 0, text).otherwise(focused(sents)))
    )


def focus_hits(df: DataFrame, s: Settings) -> DataFrame:
    """hits -> passages; needs query features and `profile`."""

    def one(h: Column, v: Column) -> Column:
        text = focus_text(h["text"], v, v["limit"], s.focused_passage_neighbor_sentences)
        return F.struct(
            h["idx"].alias("idx"), h["doc_id"].alias("doc_id"), h["chunk_id"].alias("chunk_id"),
            h["title"].alias("title"), h["section"].alias("section"), h["url"].alias("url"),
            (text if s.focused_passages_enabled else h["text"]).alias("text"),
            h["score"].alias("score"), h["lexical_coverage"].alias("lexical_coverage"),
        )

    # the query side is bound once per row, not re-evaluated for every sentence
    bound = F.struct(
        F.col("_qroots").alias("roots"), F.col("_acronyms").alias("acronyms"), F.col("_qnorm").alias("norm"),
        F.col("profile.passage").alias("limit"), F.col("hits").alias("hits"),
    )
    return df.withColumn(
        "passages", let(bound, lambda v: F.transform(v["hits"], lambda h: one(h, v)))
    )


def cut_to_budget(text: Column, room: Column) -> Column:
    head = F.substr(text, F.lit(1), room)
    last = lambda mark: F.coalesce(
        F.length(head) - F.nullif(F.locate(mark[::-1], F.reverse(head)), F.lit(0)) - 1, F.lit(-1)
    )
    cut = F.greatest(last(". "), last("; "), last(": "))
    clipped = F.trim(F.when(cut >= 180, F.substr(head, F.lit(1), cut + 1)).otherwise(head))
    return F.when(F.length(text) > room, clipped).otherwise(text)


def dedup_and_budget(passages: Column, context: Column, chunks: Column, s: Settings) -> Column:
    """In order: drop near-duplicates of kept passages, stop at the character budget."""
    start = F.struct(
        F.array().cast(f"array<{PASSAGE}>").alias("kept"),
        F.array().cast("array<array<string>>").alias("roots"),
        F.lit(0).alias("used"),
        F.lit(False).alias("stop"),
    )

    def jaccard(a: Column, b: Column) -> Column:
        union = F.size(F.array_union(a, b))
        return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)

    def step(acc: Column, p: Column) -> Column:
        def with_roots(r: Column) -> Column:
            dup = F.exists(acc["roots"], lambda o: jaccard(r, o) >= s.context_duplicate_jaccard)
            overhead = F.length(p["title"]) + 30
            room = context - acc["used"] - overhead
            full = room <= 180
            skip = acc["stop"] | dup | full
            kept = F.struct(
                *[
                    (cut_to_budget(p["text"], room) if f == "text" else p[f]).alias(f)
                    for f in (
                        "idx", "doc_id", "chunk_id", "title", "section", "url", "text", "score",
                        "lexical_coverage",
                    )
                ]
            )
            return F.when(
                skip,
                F.struct(
                    acc["kept"].alias("kept"), acc["roots"].alias("roots"), acc["used"].alias("used"),
                    (acc["stop"] | (~dup & full)).alias("stop"),
                ),
            ).otherwise(
                let(
                    kept,
                    lambda k: F.struct(
                        F.array_append(acc["kept"], k).alias("kept"),
                        F.array_append(acc["roots"], root_set(k["text"])).alias("roots"),
                        (acc["used"] + F.length(k["text"]) + overhead).alias("used"),
                        (F.size(acc["kept"]) + 1 >= chunks).alias("stop"),
                    ),
                )
            )

        return let(root_set(p["text"]), with_roots)

    return let(passages, lambda ps: F.aggregate(ps, start, step, lambda acc: acc["kept"]))


def with_source_ids(passages: Column) -> Column:
    fields = (
        "idx", "doc_id", "chunk_id", "title", "section", "url", "text", "score", "lexical_coverage",
    )
    return F.transform(
        passages,
        lambda p, i: F.struct(
            F.concat(F.lit("S"), (i + 1).cast("string")).alias("source_id"), *[p[f].alias(f) for f in fields]
        ),
    )


def prepare_context(df: DataFrame, s: Settings, query_col: str = "query") -> DataFrame:
    """(…, hits) -> adds profile and `context`, the S-numbered passages of every query."""
    q = F.col(query_col)
    df = query_features(df.withColumn("profile", profile_budgets(q, s)), query_col)
    df = df.withColumn("hits", coherent_order(q, F.col("hits"), F.col("profile.name"), s))
    df = df.withColumn("hits", intent_order(q, F.col("hits")))
    df = focus_hits(df, s)
    return df.withColumn(
        "context",
        with_source_ids(
            dedup_and_budget(F.col("passages"), F.col("profile.context"), F.col("profile.chunks"), s)
        ),
    ).drop("passages")


def select_naive(hits: Column, limit: Column) -> Column:
    """First `limit` distinct (doc, chunk) hits with text, order kept."""
    keys = F.transform(hits, lambda h: F.struct(h["doc_id"], h["chunk_id"]))
    first = F.filter(hits, lambda h, i: (F.array_position(keys, F.struct(h["doc_id"], h["chunk_id"])) == i + 1)
                     & (F.trim(h["text"]) != ""))
    return F.slice(first, F.lit(1), limit)


# --- rendering ----------------------------------------------------------------------


def render_full(context: Column) -> Column:
    def block(c: Column) -> Column:
        section = F.when(F.coalesce(c["section"], F.lit("")) != "", F.concat(F.lit("Раздел: "), c["section"], F.lit("\n")))
        return F.concat(
            F.lit("SOURCE_ID: "), c["source_id"], F.lit("\n["), c["source_id"], F.lit("]\nДокумент: "), c["title"],
            F.lit("\n"), F.coalesce(section, F.lit("")), F.lit("Текст:\n"), F.trim(c["text"]),
        )

    return F.array_join(F.transform(context, block), "\n\n")


def render_compact(context: Column) -> Column:
    return F.array_join(
        F.transform(
            context,
            lambda c: F.concat(F.lit("["), c["source_id"], F.lit("] "), c["title"], F.lit(": "), F.trim(c["text"])),
        ),
        "\n",
    )
