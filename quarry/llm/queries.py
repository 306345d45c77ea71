"""The numbered queries of the training-data operators over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import (
    centroid_clusters, chat_format, decontaminate, jaccard_join, language_id, mixing, oracles, quality_rules, secret_scan, simhash_dedup,
    source_divergence, suffix_dedup, token_counts, training_order,
)
from quarry.llm.common import stage, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def op1_training_order(spark: SparkSession, d: str) -> DataFrame:
    """Every sequence with its slot, shard and stride of token ids, in training order."""
    return training_order.training_order(_docs(spark, d))


def op2_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    out = secret_scan.secret_spans(_docs(spark, d).select("doc_id", "text"))
    s = F.col("secrets")
    return out.select(
        "doc_id", s.n_assign.alias("n_assign"), s.n_access.alias("n_access"), s.n_hex.alias("n_hex"),
        F.sha2(secret_scan.joined(s.base), 256).alias("base_sha256"), secret_scan.joined(s.spans).alias("spans"),
    )


def op3_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_docs(spark, d)).drop("spans")


def op4_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_docs(spark, d))


def op5_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    """Leaked benchmark items: one row per document and item, with the best window."""
    docs = _docs(spark, d).select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, d, "benchmark")).select("doc_id", "leak.*").withColumn(
        "similarity", F.round("similarity", 6)
    )


def op6_language_id(spark: SparkSession, d: str) -> DataFrame:
    s = language_id.LanguageSettings()
    docs = _docs(spark, d).select("doc_id", "text", "lang")
    model = language_id.train(docs, s)
    out = language_id.identify(docs.select("doc_id", "text"), model, s)
    return out.select("doc_id", language_id.held_out(F.col("doc_id"), s.folds).alias("held_out"), "language.*")


def op7_mixing(spark: SparkSession, d: str) -> DataFrame:
    measured, n = mixing.measure(_docs(spark, d).select("doc_id", "text", "source"))
    measured = stage(measured.drop("text"), "measured")
    return mixing.mix(measured, n).select("doc_id", F.col(n.size).alias("size"), "mix.source_size", "mix.target", "mix.taken", "source", "mix.copies")


def op8_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.quality_rules(_docs(spark, d).select("doc_id", "text")).select(
        "doc_id", "quality.*"
    ).drop("longest_repeat")


def op9_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.token_counts(_docs(spark, d).select("doc_id", "text")).select("doc_id", "tokens.*")


def op10_chat_format(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role")),
    )).alias("t")).select(F.lit(-1).cast("long").alias("conv_id"), "t.turn", "t.role", F.lit(said).alias("text"))
    return chat_format.conversation_digests(chat_format.examples(turns.unionByName(extra)))


def op11_centroid_clusters(spark: SparkSession, d: str) -> DataFrame:
    return centroid_clusters.clustered(table(spark, d, "embeddings"))


def op12_source_divergence(spark: SparkSession, d: str) -> DataFrame:
    return source_divergence.audit(_docs(spark, d))


def op13_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.jaccard_components(_docs(spark, d))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES = {
    f.__name__: f
    for f in (
        op1_training_order, op2_secret_scan, op3_suffix_dedup, op4_simhash, op5_decontaminate, op6_language_id, op7_mixing, op8_quality_rules,
        op9_token_counts, op10_chat_format, op11_centroid_clusters, op12_source_divergence, op13_jaccard_join, pipeline,
    )
}
SQL: dict[str, str] = {
    "op7_mixing": oracles.MIXING, "op8_quality_rules": oracles.quality(), "op10_chat_format": oracles.CHAT, "op11_centroid_clusters": oracles.clusters(),
    "op12_source_divergence": oracles.DIVERGENCE, "op13_jaccard_join": oracles.JACCARD,
}
