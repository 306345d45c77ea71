"""Row-level contracts for structured model output; a violation is a value, not a failure."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.functions.text import CITATION, strip
from quarry.operators.rewrites import clean_rewrites

GRADE = (
    "decision string, relevant_source_ids array<string>, missing_information array<string>, "
    "rewritten_queries array<string>, reason string"
)
ANSWER = "answer string, used_source_ids array<string>, insufficient_context boolean"
FAST = (
    "decision string, answer string, used_source_ids array<string>, rewritten_queries array<string>, reason string"
)
EVALUATION = (
    "valid boolean, answers_question boolean, grounded_in_context boolean, unsupported_claims array<string>, "
    "missing_citations array<string>, reason string"
)
SOURCE_IDS = ("S1", "S2", "S3", "S4", "S5")


def parse(raw: Column, schema: str) -> Column:
    """JSON reply -> struct; null when it is not JSON or any field is missing."""
    s = F.from_json(raw, schema)
    names = [f.strip().split()[0] for f in _fields(schema)]
    complete = F.lit(True)
    for n in names:
        complete = complete & s[n].isNotNull()
    keys = F.json_object_keys(raw)
    extra = F.size(F.array_except(keys, F.array(*[F.lit(n) for n in names]))) > 0
    return F.when(complete & ~F.coalesce(extra, F.lit(True)), s)


def _fields(schema: str) -> list[str]:
    return [p for p in schema.split(", ")]


def known_ids(ids: Column) -> Column:
    return F.size(F.array_except(ids, F.array(*[F.lit(i) for i in SOURCE_IDS]))) == 0


def check_answer(answer: Column, ids: Column, insufficient: Column) -> Column:
    """Violation message or null."""
    text = strip(answer)
    some = F.size(ids) > 0
    return (
        F.when(text == "", "empty answer")
        .when(insufficient & some, "sources with insufficient context")
        .when(insufficient & text.rlike("(?U)" + CITATION), "markers with insufficient context")
        .when(~insufficient & ~some, "no sources")
        .when(~known_ids(ids), "unknown source id")
    )


def check_fast(r: Column) -> Column:
    answer, ids = strip(r["answer"]), r["used_source_ids"]
    rewrites = clean_rewrites(r["rewritten_queries"], 2)
    is_answer, is_corrective = r["decision"] == "answer", r["decision"] == "corrective"
    return (
        F.when(~(is_answer | is_corrective), "unknown decision")
        .when(~known_ids(ids), "unknown source id")
        .when(is_answer & (answer == ""), "answer without text")
        .when(is_answer & (F.size(ids) == 0), "answer without sources")
        .when(is_answer & (F.size(rewrites) > 0), "answer with rewrites")
        .when(is_corrective & ((answer != "") | (F.size(ids) > 0)), "corrective with an answer")
        .when(is_corrective & (F.size(rewrites) == 0), "corrective without rewrites")
    )


def check_grade(r: Column, allowed: Column) -> Column:
    sufficient = r["decision"] == "sufficient"
    return (
        F.when(~r["decision"].isin("sufficient", "partial", "insufficient"), "unknown decision")
        .when(F.size(F.array_except(r["relevant_source_ids"], allowed)) > 0, "unknown source id")
        .when(sufficient & (F.size(r["relevant_source_ids"]) == 0), "sufficient without sources")
    )
