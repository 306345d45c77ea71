"""Numeric expressions: logistic, token budgets, prompt fitting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.settings import Settings


def sigmoid(x: Column) -> Column:
    """Logistic that never overflows: exp() only ever sees a non-positive value."""
    z = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + z)).otherwise(z / (1.0 + z))


def prompt_token_budget(
    want: Column, seconds: Column, prompt_tps: Column, decode_tps: Column, s: Settings
) -> Column:
    reserve = want / F.greatest(F.lit(1.0), decode_tps)
    room = F.greatest(F.lit(2.0), seconds - reserve - s.decode_margin_seconds)
    return F.greatest(
        F.lit(220), F.floor(prompt_tps * room * s.prompt_budget_safety)
    ).cast("long")


def output_token_budget(
    want: Column, seconds: Column, input_tokens: Column, prompt_tps: Column, decode_tps: Column,
    s: Settings,
) -> Column:
    if not s.adaptive_tokens:
        return want.cast("long")
    spent = F.when(input_tokens > 0, input_tokens / F.greatest(F.lit(1.0), prompt_tps)).otherwise(0.0)
    room = F.greatest(F.lit(1.0), seconds - spent - s.decode_margin_seconds)
    capacity = F.floor(decode_tps * room * s.prompt_budget_safety)
    floor = F.least(F.lit(s.min_answer_tokens), want)
    return F.greatest(floor, F.least(want, capacity)).cast("long")


def server_predict_budget(seconds: Column, s: Settings) -> Column:
    return F.least(
        F.lit(s.server_predict_budget_ms), F.greatest(F.lit(1000), ((seconds - 0.75) * 1000).cast("int"))
    ).cast("long")


def shrink_budgets(
    context: Column, passage: Column, chunks: Column, target: Column, used: Column
) -> Column:
    """One prompt-fitting step as struct(context, passage, chunks)."""
    ratio = F.greatest(F.lit(0.45), F.least(F.lit(0.90), target / used))
    return F.struct(
        F.greatest(F.lit(420), F.floor(context * ratio * 0.92)).cast("int").alias("context"),
        F.greatest(F.lit(260), F.floor(passage * ratio * 0.96)).cast("int").alias("passage"),
        F.when(ratio < 0.72, F.greatest(F.lit(2), F.least(chunks, F.lit(3))))
        .otherwise(chunks).cast("int").alias("chunks"),
    )
