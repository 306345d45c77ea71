"""Fixed-size passage windows and best-window selection for an injected scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.text import let, squash

EDGE = 40


def windows(text: Column, size: int, overlap: int) -> Column:
    """array<struct<k,start,end,text>>: overlapping windows snapped to word edges."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("overlap must be non-negative and smaller than the window")
    step = size - overlap

    def build(t: Column) -> Column:
        n = F.length(t)
        last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")

        def one(k: Column) -> Column:
            raw = k * step
            raw_end = F.least(raw + size, n)
            lead = F.locate(" ", F.substr(t, raw + 1, F.least(F.lit(EDGE), n - raw)))
            start = F.when((raw > 0) & (lead > 0), raw + lead).otherwise(raw)

            def close(start: Column) -> Column:
                low = F.greatest(start, raw_end - EDGE)
                back = F.locate(" ", F.reverse(F.substr(t, low + 1, raw_end - low)))
                end = F.when(
                    (raw_end < n) & (back > 0) & (raw_end - back > start), raw_end - back
                ).otherwise(raw_end)
                return let(
                    end,
                    lambda e: F.struct(
                        k.alias("k"), start.alias("start"), e.alias("end"),
                        F.trim(F.substr(t, start + 1, e - start)).alias("text"),
                    ),
                )

            return let(start, close)

        spans = F.transform(F.sequence(F.lit(0), last), one)
        return F.when(n > 0, F.filter(spans, lambda w: w["text"] != "")).otherwise(
            F.filter(spans, lambda _: F.lit(False))
        )

    return let(squash(text), build)


def select_passages(hits: DataFrame, scorer, size: int, overlap: int) -> DataFrame:
    """hits(qid, rank, query, text, …) -> the best window per hit; first wins ties.

    `scorer(query, passage)` is a Column function, typically an Arrow UDF that scores all
    windows of a batch at once.
    """
    rows = hits.select("*", F.explode(windows(F.col("text"), size, overlap)).alias("w"))
    raw = scorer(F.col("query"), F.col("w.text"))
    rows = rows.withColumn("_s", raw.cast("double"))
    finite = ~(F.isnan("_s") | F.col("_s").isNull() | (F.abs("_s") == float("inf")))
    rows = rows.withColumn(
        "passage_score",
        F.when(finite, F.col("_s")).otherwise(
            F.raise_error(F.lit("passage scorer returned a non-finite value")).cast("double")
        ),
    )
    best = Window.partitionBy("qid", "rank").orderBy(F.desc("passage_score"), F.col("w.k"))
    return (
        rows.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
        .withColumns(
            {
                "original_text_chars": F.length(squash(F.col("text"))),
                "text": F.col("w.text"),
                "passage_start": F.col("w.start"),
                "passage_end": F.col("w.end"),
                "selected_text_chars": F.length(F.col("w.text")),
            }
        )
        .drop("w", "_s", "_r")
    )
