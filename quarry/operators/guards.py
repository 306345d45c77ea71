"""Answer guards: format, grounding, relevance, model verdicts, source resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.intents import membership_query
from quarry.functions.text import (
    any_in, fold, latin_entities, let, matches, norm, numbers, root_set, source_ids, specific_roots, strip,
)
from quarry.rules import russian as ru

URL = r"(?i)https?://\S+"
_ROOT_CUT = lambda t: t[:6] if len(t) >= 9 else t[:5] if len(t) >= 6 else t


def allowed_ids(context: Column) -> Column:
    return F.transform(context, lambda c: c["source_id"])


def _listed(prefix: str, ids: Column) -> Column:
    quoted = F.transform(F.array_sort(ids), lambda i: F.concat(F.lit("'"), i, F.lit("'")))
    return F.concat(F.lit(prefix + "["), F.array_join(quoted, ", "), F.lit("]"))


def format_issues(answer: Column, declared: Column, insufficient: Column, allowed: Column) -> Column:
    text = strip(answer)
    cited = source_ids(text)
    unknown_cited, unknown_declared = F.array_except(cited, allowed), F.array_except(declared, allowed)
    differ = (F.size(F.array_except(cited, declared)) > 0) | (F.size(F.array_except(declared, cited)) > 0)
    return F.array_compact(
        F.array(
            F.when(text == "", F.lit(ru.ISSUE_EMPTY)),
            F.when(F.size(unknown_cited) > 0, _listed(ru.ISSUE_UNKNOWN_CITED, unknown_cited)),
            F.when(F.size(unknown_declared) > 0, _listed(ru.ISSUE_UNKNOWN_DECLARED, unknown_declared)),
            F.when(~insufficient & (F.size(cited) == 0), F.lit(ru.ISSUE_NO_CITATIONS)),
            F.when(differ, F.lit(ru.ISSUE_MISMATCH)),
            F.when(text.rlike(URL), F.lit(ru.ISSUE_URL)),
        )
    )


def hard_format_issues(issues: Column) -> Column:
    return F.filter(issues, lambda i: F.contains(i, F.lit("URL")) | F.contains(i, F.lit("Несуществующие")))


# --- grounding ----------------------------------------------------------------------


def claims(answers: DataFrame) -> DataFrame:
    """(qid, cpos, part, clean, cited): the answer cut after each citation marker."""
    cut = F.split(
        F.regexp_replace("answer", r"(?i)(\[S\d+\](?:[.!?])?)", "$1\x1f"), "\x1f"
    )
    parts = F.filter(F.transform(cut, strip), lambda p: p != "")
    df = answers.select("qid", "context", F.posexplode(parts).alias("cpos", "part"))
    clean = F.regexp_replace("part", r"(?i)\[S\d+\]", "")
    clean = F.regexp_replace(clean, "(?iuU)" + ru.PLACEHOLDER_PATTERN, " ")
    clean = F.regexp_replace(clean, r"(?U)^\s*\d+[.)]\s*", "")
    clean = F.regexp_replace(clean, r"^[ \-—:;,.\t]+|[ \-—:;,.\t]+$", "")
    ids = F.transform(
        F.regexp_extract_all("part", F.lit(r"(?i)\[S(\d+)\]"), F.lit(1)), lambda n: F.concat(F.lit("S"), n)
    )
    return df.select("qid", "cpos", "context", clean.alias("clean"), ids.alias("cited"))


def claim_checks(answers: DataFrame, min_coverage: float) -> DataFrame:
    """One row per factual claim with its coverage and issues."""
    c = claims(answers)
    held = F.filter("context", lambda x: F.array_contains(F.col("cited"), x["source_id"]))
    # cited texts in citation order matter only as a set of roots, numbers and entities
    source = F.array_join(
        F.transform(
            held,
            lambda x: F.concat(x["title"], F.lit(" "), F.coalesce(x["section"], F.lit("")), F.lit(" "), x["text"]),
        ),
        " ",
    )
    c = c.withColumns({"roots": root_set(F.col("clean")), "source": source, "known": F.size(held)}).filter(
        F.size("roots") > 0
    )
    coverage = F.size(F.array_intersect("roots", root_set(F.col("source")))) / F.size("roots")
    checked = (F.size("cited") > 0) & (F.col("known") > 0)
    missing = lambda f: F.size(F.array_except(f(F.col("clean")), f(F.col("source")))) > 0
    c = c.withColumn("coverage", F.when(checked, coverage))
    return c.select(
        "qid", "cpos", "clean", "coverage",
        F.array_compact(
            F.array(
                F.when(F.size("cited") == 0, F.lit("uncited_claim")),
                F.when((F.size("cited") > 0) & (F.col("known") == 0), F.lit("unknown_citation")),
                F.when(checked & missing(numbers), F.lit("unsupported_number")),
                F.when(checked & missing(latin_entities), F.lit("unsupported_latin_entity")),
                F.when(F.col("coverage") < min_coverage, F.lit("low_claim_source_overlap")),
            )
        ).alias("issues"),
    )


def assess_grounding(answers: DataFrame, min_coverage: float) -> DataFrame:
    """answers(qid, answer, context) -> (qid, grounding: valid, min coverage, claims, issues)."""
    per = claim_checks(answers, min_coverage).groupBy("qid").agg(
        F.count("*").alias("n"),
        F.min("coverage").alias("low"),
        F.array_distinct(
            F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("cpos", "issues"))), lambda e: e["issues"]))
        ).alias("found"),
    )
    n = F.coalesce("n", F.lit(0))
    issues = F.array_distinct(
        F.concat(
            F.array_compact(F.array(F.when(F.col("answer").rlike(URL), F.lit("answer_contains_url")))),
            F.coalesce("found", F.array().cast("array<string>")),
            F.array_compact(F.array(F.when(n == 0, F.lit("no_factual_claims")))),
        )
    )
    return answers.select("qid", "answer").join(per, "qid", "left").select(
        "qid",
        F.struct(
            (F.size(issues) == 0).alias("valid"),
            F.round(F.coalesce("low", F.lit(0.0)), 6).alias("min_claim_coverage"),
            n.cast("long").alias("checked_claims"),
            issues.alias("issues"),
        ).alias("grounding"),
    )


# --- relevance --------------------------------------------------------------------------


def relevance_issues(query: Column, answer: Column) -> Column:
    q = norm(query)
    a = F.regexp_replace(fold(answer), "(?iuU)" + ru.PLACEHOLDER_PATTERN, " ")

    def issues(aroots: Column) -> Column:
        anchors = specific_roots(query)
        # only the first acronym found in the question decides
        expanded = F.lit(False)
        for acronym, meaning in reversed(ru.ACRONYM_MEANINGS):
            known = F.array(*[F.lit(_ROOT_CUT(w)) for w in meaning.split()])
            expanded = F.when(matches(q, rf"\b{acronym}\b"), F.arrays_overlap(known, aroots)).otherwise(expanded)
        soua = F.array(*[F.lit(_ROOT_CUT(w)) for w in ru.ACRONYM_MEANINGS[0][1].split()])
        shaped = matches(a, ru.DEFINITION_ANSWER) | (
            F.contains(q, F.lit(ru.ACRONYM_MEANINGS[0][0])) & (F.size(F.array_except(soua, aroots)) == 0)
        )
        who = matches(q, ru.WHO_PATTERN) | F.contains(q, F.lit(ru.WHO_MARKER))
        has = lambda c, m: F.contains(c, F.lit(m))
        return F.array_compact(
            F.array(
                F.when(
                    (F.size(anchors) > 0) & ~F.arrays_overlap(anchors, aroots) & ~expanded,
                    F.lit("answer_misses_query_object"),
                ),
                F.when(who & ~matches(a, ru.WHO_ANSWER), F.lit("answer_misses_who_intent")),
                F.when(
                    membership_query(q) & ~matches(a, ru.MEMBERSHIP_ANSWER_PATTERN),
                    F.lit("answer_misses_membership_intent"),
                ),
                F.when(
                    has(q, ru.AGREEMENT_MARKER) & ~has(a, ru.AGREEMENT_MARKER),
                    F.lit("answer_misses_agreement_action"),
                ),
                F.when(
                    has(q, ru.NOTIFY_MARKER) & ~has(a, ru.NOTIFY_MARKER),
                    F.lit("answer_misses_notification_action"),
                ),
                F.when(
                    any_in(q, ru.GUARD_DEFINITION_QUERY) & ~shaped, F.lit("answer_misses_definition_intent")
                ),
                F.when(
                    any_in(q, ru.TIME_QUERY) & ~(matches(a, ru.TIME_ANSWER_NUMBER) | any_in(a, ru.TIME_ANSWER)),
                    F.lit("answer_misses_time_intent"),
                ),
                F.when(
                    any_in(q, ru.GUARD_PROCEDURE_QUERY) & ~any_in(a, ru.PROCEDURE_ANSWER),
                    F.lit("answer_misses_procedure_intent"),
                ),
            )
        )

    return let(root_set(a), issues)


# --- model verdicts and sources ------------------------------------------------------------


def semantic_issues(evaluation: Column) -> Column:
    """Issues of an evaluator verdict struct; contradictory fields are all reported."""
    reason = strip(evaluation["reason"])
    clean = lambda xs: F.filter(F.transform(xs, strip), lambda x: x != "")
    return F.array_distinct(
        F.concat(
            F.array_compact(
                F.array(
                    F.when(
                        ~evaluation["valid"],
                        F.when(reason == "", F.lit(ru.SEMANTIC_NO_REASON)).otherwise(reason),
                    ),
                    F.when(~evaluation["answers_question"], F.lit(ru.SEMANTIC_INCOMPLETE)),
                    F.when(~evaluation["grounded_in_context"], F.lit(ru.SEMANTIC_UNGROUNDED)),
                )
            ),
            clean(evaluation["unsupported_claims"]),
            clean(evaluation["missing_citations"]),
        )
    )


def resolve_sources(answer: Column, context: Column) -> Column:
    """Cited passages in citation order."""
    def one(sid: Column) -> Column:
        c = F.get(F.filter(context, lambda x: x["source_id"] == sid), F.lit(0))
        return F.struct(
            c["source_id"].alias("source_id"), c["doc_id"].alias("doc_id"), c["chunk_id"].alias("chunk_id"),
            c["title"].alias("title"), c["section"].alias("section"), c["url"].alias("url"),
            c["score"].alias("score"),
        )

    known = F.array_intersect(source_ids(answer), allowed_ids(context))
    return F.transform(known, one)
