"""Answers: deterministic extraction, post-hoc citation, reply normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.intents import membership_query, membership_text
from quarry.functions.text import (
    CITATION, any_in, canonical_citations, casefold, fold, let, norm, root_set, sentences, source_ids, strip,
    strip_question_echo,
)
from quarry.operators.context import sentence_score
from quarry.rules import russian as ru

PLACEHOLDER = "(?iuU)" + ru.PLACEHOLDER_PATTERN
ANSWER = "struct<answer:string,used_source_ids:array<string>,confidence:double>"


def _answer(text: Column, ids: Column, confidence: Column) -> Column:
    return F.struct(
        text.alias("answer"), ids.alias("used_source_ids"), confidence.cast("double").alias("confidence")
    )


# --- structured fallbacks -----------------------------------------------------------


def definition_fallback(qnorm: Column, context: Column) -> Column:
    """Known acronym whose expansion is fully covered by one of the first three passages."""
    options = []
    for acronym, expansion in ru.ACRONYM_DEFINITIONS:
        expected = F.array(*[F.lit(r) for r in _roots_of(expansion)])
        holder = F.filter(
            F.slice(context, 1, 3),
            lambda c: F.size(F.array_except(expected, root_set(F.concat(c["title"], F.lit(" "), c["text"])))) == 0,
        )
        asked = qnorm.rlike(rf"(?U)\b{acronym}\b")
        sid = F.get(holder, F.lit(0))["source_id"]
        options.append(
            F.when(
                asked & (F.size(holder) > 0),
                _answer(
                    F.concat(F.lit(f"{acronym.upper()} — {expansion} ["), sid, F.lit("].")), F.array(sid), F.lit(1.0)
                ),
            )
        )
    return F.when(any_in(qnorm, ru.DEFINITION_QUERY), F.coalesce(*options))


def _roots_of(text: str) -> list[str]:
    """Prefix stems of a constant phrase (same rule as `root`)."""
    cut = lambda t: t[:6] if len(t) >= 9 else t[:5] if len(t) >= 6 else t
    return [cut(t) for t in text.split()]


def membership_fallback(qnorm: Column, context: Column) -> Column:
    """Role-bearing sentences after the composition statement, at most five."""

    def labels(c: Column) -> Column:
        def after(sents: Column) -> Column:
            marked = F.transform(sents, lambda x: membership_text(fold(x)))
            at = F.array_position(marked, F.lit(True)).cast("int")
            rest = F.when(at > 0, F.slice(sents, at + 1, F.size(sents)))
            rest = F.filter(rest, lambda x: ~membership_text(fold(x)))
            clean = F.transform(
                rest,
                lambda x: F.regexp_replace(
                    F.regexp_replace(
                        F.regexp_replace(F.regexp_replace(x, r"^\s*\d+(?:\.\d+)*\.?\s*", ""), PLACEHOLDER, ""),
                        r"(?U)\s+", " ",
                    ),
                    r"^[ ;:.\-]+|[ ;:.\-]+$", "",
                ),
            )
            return F.slice(F.filter(clean, lambda x: (x != "") & any_in(fold(x), ru.ROLE_MARKERS)), 1, 5)

        return let(sentences(c["text"]), after)

    found = F.filter(
        F.transform(
            F.filter(context, lambda c: membership_text(fold(c["text"]))),
            lambda c: F.struct(labels(c).alias("labels"), c["source_id"].alias("sid")),
        ),
        lambda e: F.size(e["labels"]) > 0,
    )
    first = F.get(found, F.lit(0))
    return F.when(
        membership_query(qnorm) & (F.size(found) > 0),
        _answer(
            F.concat(
                F.lit(ru.MEMBERSHIP_ANSWER), F.array_join(first["labels"], "; "), F.lit(" ["), first["sid"], F.lit("].")
            ),
            F.array(first["sid"]), F.lit(1.0),
        ),
    )


# --- extractive answer ----------------------------------------------------------------


def extractive_sentences(df: DataFrame) -> DataFrame:
    """(qid, crank, source_id, doc_id, spos, sentence, score) of every usable sentence.

    Needs qid, context and the query features; one narrow explode, no join.
    """
    return (
        df.select("qid", "_qroots", "_acronyms", "_qnorm", F.posexplode("context").alias("crank", "c"))
        .select(
            "qid", "_qroots", "_acronyms", "_qnorm", "crank", F.col("c.source_id").alias("source_id"),
            F.col("c.doc_id").alias("doc_id"), F.col("c.lexical_coverage").alias("coverage"),
            F.posexplode(sentences(F.col("c.text"))).alias("spos", "sentence"),
        )
        .filter(
            (F.length("sentence") >= 24)
            & ~(F.endswith("sentence", F.lit(":")) & (F.length("sentence") < 220))
            & ~(F.contains(casefold(F.col("sentence")), F.lit(ru.DUTIES_HEADING)) & (F.length("sentence") < 180))
        )
        .withColumn(
            "score",
            F.round(
                sentence_score(F.col("_qroots"), F.col("_acronyms"), F.col("_qnorm"), F.col("sentence"))
                + 0.14 - 0.16 * F.col("crank") + 0.12 * F.col("coverage"),
                6,
            ),
        )
        .filter(F.col("score") > 0)
        .select("qid", "_qnorm", "crank", "source_id", "doc_id", "spos", "sentence", "score")
    )


def clean_sentence(c: Column) -> Column:
    x = F.regexp_replace(c, PLACEHOLDER, "")
    x = F.regexp_replace(x, r"(?U)\s+([,.;:)])", "$1")
    x = F.regexp_replace(x, r"(?U)([(:])\s+", "$1 ")
    x = strip(F.regexp_replace(x, r"(?U)\s{2,}", " "))
    return F.regexp_replace(x, r"[ .;:]+$", "")


def extractive_answer(df: DataFrame, max_sentences: Column) -> DataFrame:
    """(qid, extractive): answer, used ids, confidence for every query with a context.

    Sentences are ranked with windows over qid; a query's context holds at most a few
    passages, so each window partition is small.
    """
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "crank", "spos")
    whole = Window.partitionBy("qid")
    c = extractive_sentences(df.withColumn("_max", max_sentences))
    c = c.withColumn("pos", F.row_number().over(by_score))
    c = c.withColumn("best_doc", F.first("doc_id").over(by_score))
    c = c.filter(~any_in(F.col("_qnorm"), ru.EXTRACTIVE_PROCEDURE) | (F.col("doc_id") == F.col("best_doc")))
    strong = (F.col("crank") == 0) & (F.col("score") >= 0.45)
    c = c.withColumn("n_strong", F.sum(strong.cast("int")).over(whole))
    # two strong sentences of the first passage: they lead, its weak ones are dropped
    c = c.filter((F.col("n_strong") < 2) | strong | (F.col("crank") != 0)).withColumn(
        "order", F.struct(F.when((F.col("n_strong") >= 2) & ~strong, 1).otherwise(0), "pos")
    )
    key = F.trim(F.regexp_replace(casefold(F.col("sentence")), r"(?U)\W+", " "))
    c = c.withColumn("key", key).withColumn(
        "copy", F.row_number().over(Window.partitionBy("qid", "key").orderBy("order"))
    ).withColumn("lead", F.first("score").over(Window.partitionBy("qid").orderBy("order")))
    c = c.filter("copy = 1").withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("order")))
    limits = df.select("qid", max_sentences.alias("_max"))
    picked = c.join(limits, "qid").filter(F.col("n") <= F.col("_max"))
    part = F.concat(clean_sentence(F.col("sentence")), F.lit(" ["), F.col("source_id"), F.lit("]."))
    ranked = picked.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("n", part.alias("text"), "source_id"))).alias("parts"),
        F.max("lead").alias("lead"),
    ).select(
        "qid",
        _answer(
            F.array_join(F.transform("parts", lambda p: p["text"]), " "),
            F.array_distinct(F.transform("parts", lambda p: p["source_id"])),
            F.least(F.lit(1.0), F.col("lead")),
        ).alias("ranked"),
    )
    structured = df.select(
        "qid",
        F.coalesce(
            definition_fallback(F.col("_qnorm"), F.col("context")),
            membership_fallback(F.col("_qnorm"), F.col("context")),
        ).cast(ANSWER).alias("structured"),
    )
    nothing = _answer(F.lit(""), F.array().cast("array<string>"), F.lit(0.0))
    return structured.join(ranked, "qid", "left").select(
        "qid", F.coalesce("structured", "ranked", nothing).alias("extractive")
    )


# --- model replies -----------------------------------------------------------------------


def trim_incomplete_tail(c: Column) -> Column:
    """Text up to the last complete cited sentence, '' when there is none.

    Everything after the last unbalanced bracket is dropped first.  A citation closes a
    sentence when terminal punctuation stands right before or right after it.
    """
    depth_zero = F.regexp_replace(c, r"^((?:[^\[\]]|\][^\[]?|\[[^\[\]]*\])*)\[[^\]]*$", "$1")
    body = F.regexp_replace(depth_zero, r"(?U)\s+$", "")
    done = F.regexp_extract(
        body, r"(?sU)^(.*(?:[.!?]\s*\[S\d+\](?:\s*[.!?])?|\[S\d+\]\s*[.!?]))", 1
    )
    return F.regexp_replace(done, r"(?U)\s+$", "")


def posthoc_citations(text: Column, context: Column) -> Column:
    """Cite every sentence by its best-aligned passage; null when any sentence has none."""
    parts = F.filter(
        F.transform(F.split(text, r"(?U)(?<=[.!?])(?:\s+|$)|\n+"), strip), lambda p: p != ""
    )
    features = F.transform(
        context, lambda c: root_set(F.concat(c["title"], F.lit(" "), c["text"]))
    )

    def build(rows: Column) -> Column:
        ok = F.forall(rows, lambda e: e["exempt"] | e["sid"].isNotNull()) & F.exists(
            rows, lambda e: e["sid"].isNotNull()
        )
        cited = F.transform(
            rows,
            lambda e: F.when(e["sid"].isNull(), e["text"]).otherwise(
                F.concat(F.regexp_replace(e["text"], r"(?U)\s+$", ""), F.lit(" ["), e["sid"], F.lit("]"))
            ),
        )
        ids = F.array_distinct(F.filter(F.transform(rows, lambda e: e["sid"]), lambda x: x.isNotNull()))
        return F.when(ok, F.struct(F.array_join(cited, " ").alias("answer"), ids.alias("ids")))

    def with_features(f: Column) -> Column:
        # bind the passage roots once per row
        return let(
            F.transform(parts, lambda p: _align_with(p, f, context)), build
        )

    def _align_with(p: Column, f: Column, ctx: Column) -> Column:
        def best(r: Column) -> Column:
            scores = F.transform(
                f,
                lambda x, i: F.when(
                    F.arrays_overlap(r, x),
                    F.round(F.size(F.array_intersect(r, x)) / F.size(r) + 0.04 / (i + 1), 9),
                ).otherwise(0.0),
            )
            return let(
                scores,
                lambda v: F.when(
                    F.array_max(v) >= 0.28,
                    F.get(ctx, F.array_position(v, F.array_max(v)).cast("int") - 1)["source_id"],
                ),
            )

        cited = p.rlike(r"(?U)" + CITATION)
        return let(
            root_set(p),
            lambda r: F.struct(
                p.alias("text"),
                (cited | (F.size(r) == 0)).alias("exempt"),
                F.when(~cited & (F.size(r) > 0), best(r)).alias("sid"),
            ),
        )

    return let(features, with_features)


def normalize_reply(
    text: Column, query: Column, context: Column, truncated: Column, allow_posthoc: Column
) -> Column:
    """Plain reply -> struct(answer, used_source_ids, insufficient_context)."""
    x = strip_question_echo(strip(text), query)
    x = strip(F.regexp_replace(x, r"(?iuU)^\s*(?:S#|Ответ\s*:|A\s*:)\s*", ""))
    x = F.regexp_replace(x, r"(?iuU)(?<!\[)\bS#\s*", "")
    x = let(x, lambda t: F.when(truncated, trim_incomplete_tail(t)).otherwise(t))
    x = F.regexp_replace(x, r"(?mU)(?:^|\s)\d+[.)]\s*\[S\d+\](?=\s|$)", " ")
    x = canonical_citations(strip(F.regexp_replace(x, r"(?U)\s{2,}", " ")))
    allowed = F.transform(context, lambda c: c["source_id"])

    def finish(v: Column) -> Column:
        failed = (v["answer"] == "") | (F.size(v["ids"]) == 0)
        return F.struct(
            F.when(failed, F.lit(ru.MSG_SOURCES_INSUFFICIENT)).otherwise(v["answer"]).alias("answer"),
            F.when(failed, F.array().cast("array<string>")).otherwise(v["ids"]).alias("used_source_ids"),
            failed.alias("insufficient_context"),
        )

    def cite(t: Column) -> Column:
        own = F.struct(t.alias("answer"), F.array_intersect(source_ids(t), allowed).alias("ids"))

        def choose(v: Column) -> Column:
            post = F.when(
                allow_posthoc & (v["answer"] != "") & (F.size(v["ids"]) == 0),
                posthoc_citations(v["answer"], context),
            )
            return let(F.coalesce(post, v), finish)

        return let(own, choose)

    return let(x, cite)


def normalize_generated(answer: Column, declared: Column, insufficient: Column, context: Column) -> Column:
    """Canonical markers, doc/chunk aliases -> S-ids, source line when nothing is cited."""
    aliases = _longest_first(
        F.flatten(
            F.transform(
                context,
                lambda c: F.array(
                    F.struct(F.lower(c["doc_id"]).alias("a"), c["source_id"].alias("s")),
                    F.struct(F.lower(c["chunk_id"]).alias("a"), c["source_id"].alias("s")),
                ),
            )
        )
    )
    escape = lambda a: F.regexp_replace(a, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    mapped = F.aggregate(
        aliases, canonical_citations(strip(answer)),
        lambda acc, e: F.regexp_replace(
            acc, F.concat(F.lit(r"(?iuU)\[\s*"), escape(e["a"]), F.lit(r"\s*\]")),
            F.concat(F.lit("["), e["s"], F.lit("]")),
        ),
    )
    allowed = F.transform(context, lambda c: c["source_id"])

    def finish(text: Column) -> Column:
        cited = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(S\d+)\]"), F.lit(1)))
        wanted = F.array_distinct(declared)
        add_line = (F.size(cited) == 0) & (F.size(wanted) > 0) & ~insufficient
        line = F.array_join(F.transform(wanted, lambda i: F.concat(F.lit("["), i, F.lit("]"))), ", ")
        return F.struct(
            F.when(
                add_line,
                strip(F.concat(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit("\n\n" + ru.SOURCES_LINE), line)),
            ).otherwise(text).alias("answer"),
            F.when(F.size(cited) > 0, F.array_intersect(cited, allowed))
            .when(add_line, wanted)
            .otherwise(F.array().cast("array<string>")).alias("used_source_ids"),
            insufficient.alias("insufficient_context"),
        )

    return let(mapped, finish)


def _longest_first(aliases: Column) -> Column:
    # of equal aliases the one replaced first counts: the sort is stable, and reversed the later passage leads
    return F.array_sort(
        F.reverse(aliases), lambda x, y: F.when(F.length(x["a"]) > F.length(y["a"]), -1)
        .when(F.length(x["a"]) < F.length(y["a"]), 1).otherwise(0)
    )
