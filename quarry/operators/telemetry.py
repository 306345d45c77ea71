"""Model-server throughput: medians and exponential moving averages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarry.session import materialize
from quarry.settings import Settings


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` dealt by ranges of (model, *order) and written, with the number of their range (`part`).

    The ranges are quantiles of the rows, so neither a model with most rows nor an outlier or a crowd at one value
    makes a part large; only rows alike in every ordering column share a part for certain.
    """
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(wide, "model", *order).withColumn("part", F.spark_partition_id()), "ranges")


def exact_medians(samples: DataFrame) -> DataFrame:
    """samples(model, tps) -> (model, samples, median), exact without collecting a group.

    Equal values are merged first (the hot model spreads over its values); the values are dealt by ranges, a part's counts
    add up to partial sums, and only the rows that hold a middle rank are kept.
    """
    values = samples.filter("tps IS NOT NULL").groupBy("model", "tps").agg(F.count("*").alias("n"))
    ranged = in_ranges(values, "tps")
    before = Window.partitionBy("model").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("model", "part").agg(F.sum("n").alias("in_part")).select(
        "model", "part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("below"),
        F.sum("in_part").over(Window.partitionBy("model")).alias("samples"),
    )
    upto = F.col("below") + F.sum("n").over(Window.partitionBy("model", "part").orderBy("tps"))
    ranked = ranged.join(parts, ["model", "part"]).withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n"))
    first, second = F.floor((F.col("samples") + 1) / 2), F.floor((F.col("samples") + 2) / 2)

    def at(rank):
        return F.max(F.when((F.col("from") < rank) & (F.col("upto") >= rank), F.col("tps")))

    return ranked.where((F.col("from") < second) & (F.col("upto") >= first)).groupBy("model").agg(
        F.first("samples").alias("samples"), ((at(first) + at(second)) / 2).alias("median")
    )


def throughput_medians(samples: DataFrame) -> DataFrame:
    """samples(model, tps) -> medians and the guidance label."""
    m = F.col("median")
    return exact_medians(samples).select(
        "model", "samples", F.round(m, 6).alias("median_tps"),
        F.when(m >= 10, "strong").when(m >= 6, "borderline")
        .otherwise("short-answer profile recommended").alias("guidance"),
    )


def ema_throughput(samples: DataFrame, s: Settings) -> DataFrame:
    """samples(model, ts, seq, tps) -> EMA after the last positive sample, seeded.

    ema_n = (1-a)^n * seed + sum a*(1-a)^(n-i) * x_i. A range of samples is a partial (n, part) of its count and its own
    weighted sum; a partial followed by m newer samples weighs (1-a)^m, so partials merge in any grouping and no task ranks
    a whole model. Samples alike in every column are one row with a count, whose weights are a geometric sum.
    """
    a = s.perf_ema_alpha
    kept = F.lit(1.0 - a)
    alike = samples.filter("tps > 0").groupBy("model", "ts", "seq", "tps").agg(F.count("*").alias("n"))
    ranged = in_ranges(alike, "ts", "seq", "tps")
    newer_rows = Window.partitionBy("model", "part").orderBy(F.desc("ts"), F.desc("seq"), F.desc("tps")).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.pow(kept, F.coalesce(F.sum("n").over(newer_rows), F.lit(0))) * (1 - F.pow(kept, F.col("n")))
    partials = ranged.withColumn("weighed", weight * F.col("tps")).groupBy("model", "part").agg(F.sum("n").alias("n"), F.sum("weighed").alias("weighed"))
    newer_parts = Window.partitionBy("model").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    merged = partials.withColumn("newer", F.coalesce(F.sum("n").over(newer_parts), F.lit(0)))
    return merged.groupBy("model").agg(
        F.sum("n").alias("samples"), F.sum(F.pow(kept, F.col("newer")) * F.col("weighed")).alias("part")
    ).select(
        "model", "samples",
        (F.col("part") + F.pow(kept, F.col("samples")) * s.initial_decode_tps).alias("tps"),
    )
