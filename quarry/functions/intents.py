"""Intent expressions over (query, text) columns, driven by the rule pack."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.functions.text import any_in, count_in, fold, matches, norm
from quarry.rules import russian as ru


def membership_query(q: Column) -> Column:
    """`q` is a normalised query."""
    return matches(q, ru.MEMBERSHIP_PATTERN) | F.contains(q, F.lit(ru.MEMBERSHIP_MARKER))


def membership_text(t: Column) -> Column:
    return F.contains(t, F.lit(ru.MEMBERSHIP_TEXT)) & matches(t, ru.MEMBERSHIP_VERB)


def direct_reason(query: Column) -> Column:
    return _first_match(query, 2)


def direct_answer(query: Column) -> Column:
    return _first_match(query, 1)


def _first_match(query: Column, field: int) -> Column:
    q = F.trim(F.regexp_replace(query, r"(?U)\s+", " "))
    hits = [
        F.when(q.rlike("(?iuU)^(?:" + rule[0] + ")$"), F.lit(rule[field]))
        for rule in ru.DIRECT_PATTERNS
    ]
    return F.coalesce(*hits)


def external_reason(query: Column) -> Column:
    return F.coalesce(
        *[F.when(query.rlike("(?iuU)" + p), F.lit(reason)) for p, reason in ru.EXTERNAL_PATTERNS]
    )


def preferred_sections(query: Column) -> Column:
    q = fold(query)
    none = F.array().cast("array<int>")
    return F.array_distinct(
        F.concat(
            *[
                F.when(any_in(q, phrases), F.array(*[F.lit(i) for i in ids])).otherwise(none)
                for phrases, ids in ru.SECTION_RULES
            ]
        )
    )


def business_text(section: Column, title: Column) -> Column:
    return fold(F.concat(F.coalesce(section, F.lit("")), F.lit(" "), title))


def business_adjustment(q: Column, text: Column) -> tuple[Column, Column]:
    """(boost, penalty) for obvious business intents; inputs already folded."""
    off_topic = any_in(text, ru.OFF_TOPIC_TEXT) & ~any_in(q, ru.OFF_TOPIC_EXEMPT)
    boost, penalty = F.lit(0.0), F.lit(0.0)
    for keywords, expected in ru.BUSINESS_RULES:
        asked, found = any_in(q, keywords), any_in(text, expected)
        boost = boost + F.when(asked & found, 0.18).otherwise(0.0)
        penalty = penalty + F.when(asked & ~found & off_topic, 0.12).otherwise(0.0)
    return boost, penalty


def text_head(text: Column) -> Column:
    return norm(F.substring(text, 1, 900))


def answerability(q: Column, whole: Column, head: Column) -> tuple[Column, Column]:
    """(bonus <= .18, penalty <= .30) from document-shape signals; inputs already normalised."""
    wants_definition = any_in(q, ru.DEFINITION_MARKERS)
    wants_action = any_in(q, ru.ANSWERABLE_ACTION_MARKERS)
    asks_duration = any_in(q, ru.DURATION_MARKERS)
    membership = membership_query(q)
    shape = membership_text(whole)
    roles = count_in(whole, ru.ROLE_MARKERS)
    zero = F.lit(0.0)

    def add(cond: Column, value: float) -> Column:
        return F.when(cond, value).otherwise(zero)

    bonus = (
        F.when(
            asks_duration,
            F.when(matches(whole, ru.DURATION_PATTERN), 0.08)
            .when(any_in(whole, ru.LIMIT_MARKERS), 0.06)
            .otherwise(zero),
        ).otherwise(zero)
        + add(wants_action & any_in(whole, ru.ANSWERABLE_VERBS), 0.045)
        + F.when(
            membership,
            F.when(shape, 0.14).when(any_in(whole, ru.COMPOSITION_MENTIONS), 0.03).otherwise(zero),
        ).otherwise(zero)
        + add(membership & (roles >= 2), 0.06)
        + add(any_in(q, ru.OWNER_QUERY) & any_in(whole, ru.OWNER_TEXT), 0.035)
    )
    penalty = (
        add(F.contains(head, F.lit(ru.CONTENTS_MARKER)), 0.22)
        + add(wants_action & ~wants_definition & any_in(head, ru.TERMS_MARKERS), 0.12)
        + add(membership & (roles < 2) & ~shape, 0.12)
        + add(membership & ~shape & any_in(whole, ru.MEETING_MARKERS), 0.06)
    )
    return F.least(F.lit(0.18), bonus), F.least(F.lit(0.30), penalty)


def sentence_adjustment(q: Column, s: Column, n: Column) -> Column:
    """Intent bonus of a normalised sentence `s` of length `n` for a normalised query."""
    who = any_in(q, ru.SENTENCE_WHO_QUERY)
    when_ = any_in(q, ru.SENTENCE_TIME_QUERY)
    action = any_in(q, ru.SENTENCE_ACTION_QUERY)
    definition = any_in(q, ru.DEFINITION_MARKERS)
    membership = membership_query(q)
    shape = membership_text(s) | F.contains(s, F.lit(ru.SENTENCE_COMPOSITION))
    unbracketed = F.regexp_replace(s, r"\[[^\]]+\]", " ")
    has_role = matches(unbracketed, ru.SENTENCE_ROLE_PATTERN) | matches(
        unbracketed, ru.SENTENCE_ORG_PATTERN
    )

    def add(cond: Column, value: float, other: float = 0.0) -> Column:
        return F.when(cond, value).otherwise(other)

    return (
        add(membership & shape, 0.65)
        + add(membership & (count_in(s, ru.ROLE_MARKERS) >= 2), 0.32)
        + add(membership & ~shape & any_in(s, ru.SENTENCE_TASKS), -0.35)
        + F.when(who, add(has_role, 0.42, -0.42)).otherwise(0.0)
        + add(who & any_in(s, ru.SENTENCE_WHO_VERBS), 0.16)
        + F.when(
            when_,
            F.when(matches(s, ru.DURATION_PATTERN), 0.30)
            .when(any_in(s, ru.SENTENCE_LIMITS), 0.24)
            .otherwise(0.0),
        ).otherwise(0.0)
        + add(action & any_in(s, ru.SENTENCE_ACTIONS), 0.20)
        + add(action & F.contains(s, F.lit(ru.DUTIES_HEADING)) & (n < 140), -0.22)
        + add(
            ~definition
            & (who | when_ | action)
            & (
                F.contains(s, F.lit(ru.TERMS_MARKERS[0]))
                | (F.contains(s, F.lit(" — ")) & any_in(s, ru.DEFINITION_TEXT))
            ),
            -0.18,
        )
        + add((n < 70) & matches(s, ru.HEADING_PATTERN), -0.10)
    )


def answer_profile(query: Column) -> Column:
    """procedure | fact | default."""
    q = norm(query)
    words = F.size(F.regexp_extract_all(q, F.lit("[0-9a-zа-я]+"), F.lit(0)))
    procedure = any_in(q, ru.MULTIPART_MARKERS) | any_in(q, ru.PROCEDURE_MARKERS)
    fact = (words <= 10) | any_in(q, ru.FACT_MARKERS)
    return F.when(procedure, "procedure").when(fact, "fact").otherwise("default")
