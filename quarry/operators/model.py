"""Model boundary: an injected provider called from Arrow batches, one client per task.

A provider is a picklable factory `() -> client`; a client has
`complete(system, user, max_tokens, timeout) -> str` and may raise ModelTimeout or
ModelUnavailable.  Errors become values in the `status` field, never task failures.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quarry.functions.text import strip_model_markup
from quarry.settings import Settings


class ModelUnavailable(RuntimeError):
    pass


class ModelTimeout(ModelUnavailable):
    pass


class Client(Protocol):
    def complete(self, system: str, user: str, max_tokens: int, timeout: float) -> str: ...


Provider = Callable[[], Client]

REPLY = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("status", T.StringType()),      # ok | timeout | unavailable
        T.StructField("truncated", T.BooleanType()),
    ]
)


def call_model(provider: Provider, system: str, user: Column, max_tokens: Column, timeout: float) -> Column:
    """reply struct(text, status, truncated); whole batches go to one client."""

    @F.pandas_udf(REPLY)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        client = provider()
        for users, limits in batches:
            rows = []
            for text, limit in zip(users, limits):
                try:
                    reply = client.complete(system, text, int(limit), timeout)
                    rows.append((reply, "ok", bool(getattr(client, "truncated", False))))
                except ModelTimeout:
                    rows.append((None, "timeout", False))
                except ModelUnavailable:
                    rows.append((None, "unavailable", False))
            yield pd.DataFrame(rows, columns=["text", "status", "truncated"])

    return run(user, max_tokens.cast("int"))


def with_reply(
    df: DataFrame, name: str, provider: Provider, system: str, user: Column, max_tokens: Column, s: Settings
) -> DataFrame:
    """Adds a cleaned reply struct; an empty reply counts as invalid."""
    suffix = F.lit("\n\n/no_think") if s.no_think else F.lit("")
    asked = F.when(F.contains(F.right(user, F.lit(50)), F.lit("/no_think")), user).otherwise(F.concat(user, suffix))
    raw = df.withColumn("_r", call_model(provider, system, asked, max_tokens, s.response_budget_seconds))
    text = strip_model_markup(F.col("_r.text"))
    status = F.when((F.col("_r.status") == "ok") & (text == ""), "invalid").otherwise(F.col("_r.status"))
    return raw.withColumn(
        name,
        F.struct(text.alias("text"), status.alias("status"), F.coalesce("_r.truncated", F.lit(False)).alias("truncated")),
    ).drop("_r")


class FirstSourceClient:
    """Deterministic offline stand-in: quotes the first source and cites it.

    Structured requests get the JSON shape their system prompt asks for.
    """

    truncated = False

    def complete(self, system: str, user: str, max_tokens: int, timeout: float) -> str:
        body = user.split("<SOURCES>\n")[-1].split("SOURCES:\n")[-1].split("\n</SOURCES>")[0].split("\nA:")[0]
        line = next((x for x in body.split("\n") if x.startswith("[S1]")), "")
        quote = line.split(": ", 1)[-1].split(". ")[0].strip(" .")
        if "SOURCE_ID: S1" in body:
            quote = body.split("Текст:\n", 1)[-1].split("\n\n")[0].split(". ")[0].strip(" .")
        answer = f"{quote} [S1]." if quote else ""
        if "relevant_source_ids" in system:
            return json.dumps(
                {"decision": "sufficient", "relevant_source_ids": ["S1"], "missing_information": [],
                 "rewritten_queries": [], "reason": "stub"}
            )
        if "rewritten_queries" in system:
            return json.dumps(
                {"decision": "answer", "answer": answer, "used_source_ids": ["S1"], "rewritten_queries": [], "reason": "stub"},
                ensure_ascii=False,
            )
        if "answers_question" in system:
            return json.dumps(
                {"valid": True, "answers_question": True, "grounded_in_context": True, "unsupported_claims": [],
                 "missing_citations": [], "reason": ""}
            )
        if "insufficient_context" in system:
            return json.dumps(
                {"answer": answer, "used_source_ids": ["S1"], "insufficient_context": False}, ensure_ascii=False
            )
        return answer


def estimate_tokens(text: Column) -> Column:
    """Token-count stand-in when no counting endpoint exists: about three characters each."""
    return F.ceil(F.length(text) / 3).cast("long")
