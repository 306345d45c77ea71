"""Mixing sources to target weights: Efraimidis-Spirakis sampling in native expressions.

Every document draws the key -ln(u) / quality, u from a hash of its id and text, so reruns agree.
A source's budget is whole epochs first; the rest goes to the documents with the smallest keys,
prefix-summed to the budget. Keys are cut into ordered buckets; (source, bucket) sums are
pre-aggregated, and only the one bucket in which a source's budget ends is sorted, so a source
that holds a third of all rows is never sorted in one task.

Cases: a null text has size 0; a null source is a source of its own, last in order; repeated rows
share one key and are interchangeable; empty tables give an empty result; columns of the input
pass through (`measure` and `mix` take free names for their own).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.common import WORD, scratch, stage, text_of
from quarry.session import small_side

#: Weights repeat over the sources in order; a target stops at CAP times its source.
WEIGHTS = (5, 2, 1)
CAP = 3
JUNK = "0123456789#*$%&|<>=_{}[]()+/^~@"
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Names:
    size: str
    key: str
    tie: str
    bucket: str
    source: str


def measure(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", buckets: int = 4096):
    """`docs` plus size, sampling key, tie-breaker, key bucket and source; returns the frame and the names."""
    n = Names(*scratch(docs, "size", "es_key", "es_tie", "es_bucket", "mix_source"))
    (digest,) = scratch(docs, "digest")
    t = text_of(text)
    quality = F.lit(0.25) + F.lit(0.75) * F.length(F.translate(t, JUNK, "")) / F.greatest(F.length(t), F.lit(1))
    tie = F.md5(F.concat(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.lit(":"), F.md5(t)))
    df = docs.withColumns({n.size: F.regexp_count(t, F.lit(WORD)).cast("long"), n.tie: tie, n.source: F.col(f"`{source}`")})
    u = (F.conv(F.substring(f"`{n.tie}`", 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    df = df.withColumn(digest, quality).withColumn(n.key, -F.log(u) / F.col(digest)).drop(digest)
    spread = F.lit(1.0) - F.exp(F.col(n.key) * F.lit(-0.7))
    return df.withColumn(n.bucket, F.least(F.floor(spread * buckets), F.lit(buckets - 1)).cast("int")), n


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> weight, target, epochs, rest. Windows here hold one row for each source."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(x) for x in WEIGHTS])
    df = sizes.withColumn("weight", F.get(w, (F.row_number().over(ordered) - 1) % len(WEIGHTS)))
    df = df.withColumn("cap", F.lit(CAP) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    df = df.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    ).withColumn("open", F.col("cap") >= F.col("level") * F.col("weight"))
    # the first open source in order of cap to weight sets the level of all open ones: it is the highest
    df = df.withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    df = df.withColumn(
        "target", F.when(F.col("open"), F.least(F.col("level") * F.col("weight"), F.col("cap"))).otherwise(F.col("cap")).cast("double")
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return df.withColumn("epochs", epochs.cast("long")).select(
        "source", "source_size", "weight", "target", "epochs",
        (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"),
    )


def budgets(measured: DataFrame, n: Names) -> DataFrame:
    """Per source: target, epochs, rest, the bucket where the rest ends and the words before it."""
    sums = stage(
        measured.groupBy(F.col(n.source).alias("source"), F.col(n.bucket).alias("bucket")).agg(F.sum(n.size).alias("words")),
        "mixsums",
    )
    plan = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    joined = filled.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source")))
    ends = joined.where(F.col("before") + F.col("words") > F.col("rest")).groupBy("s").agg(
        F.min(F.struct("bucket", "before")).alias("end")
    )
    out = plan.join(ends, F.col("s").eqNullSafe(F.col("source")), "left")
    return stage(
        out.select("source", "source_size", "weight", "target", "epochs", "rest",
                   F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("end_before")),
        "mixplan",
    )


def mix(measured: DataFrame, n: Names) -> DataFrame:
    """Measured rows plus one struct column `mix`: source_size, target, copies, taken.

    copies is the epochs plus one if the fractional selection takes the row. A row is taken while the
    words before it plus half its own stay within the rest, which keeps the sum nearest to the budget.
    """
    plan = budgets(measured, n)
    (m,) = scratch(measured, "mix")
    side = small_side(plan.select(F.struct("*").alias(m)), plan.count(), BROADCAST_SOURCES)
    df = measured.join(side, F.col(n.source).eqNullSafe(F.col(f"{m}.source")))
    p, b = (lambda c: F.col(f"{m}.{c}")), F.col(n.bucket)
    at_end = F.coalesce(b == p("end_bucket"), F.lit(False))

    def result(rows: DataFrame, picked) -> DataFrame:
        copies = p("epochs") + F.when(picked, F.lit(1)).otherwise(F.lit(0))
        return rows.withColumn(
            m,
            F.struct(p("source_size").alias("source_size"), F.round(p("target"), 6).alias("target"),
                     copies.alias("copies"), (copies * F.col(n.size)).alias("taken")),
        )

    easy = result(df.where(~at_end), (p("rest") > 0) & F.coalesce(b < p("end_bucket"), F.lit(True)))
    (before,) = scratch(df, "before")
    inside = Window.partitionBy(n.source).orderBy(n.key, n.tie).rowsBetween(Window.unboundedPreceding, -1)
    hard = df.where(at_end).withColumn(before, p("end_before") + F.coalesce(F.sum(n.size).over(inside), F.lit(0)))
    hard = result(hard, (p("rest") > 0) & (F.lit(2) * F.col(before) + F.col(n.size) <= F.lit(2) * p("rest"))).drop(before)
    return easy.unionByName(hard)


def mixed_copies(docs: DataFrame) -> DataFrame:
    """The training mix: every row of `docs` as many times as the mix takes it, its own columns only."""
    measured, n = measure(docs)
    out = mix(measured, n)
    (copy,) = scratch(out, "copy")
    copies = F.col(f"{out.columns[-1]}.copies")
    rows = out.where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
