"""Parquet tables -> the engine's `documents` and `queries` relations.

documents(doc_seq, doc_id, version, title, section, section_id, content, url,
          updated_at, is_actual)
queries(qid, query, top_k, section_id)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

REQUIRED = ("doc_id", "version", "title", "content", "url")


TEXT_TABLES = ("documents", "pages", "conversations")
#: Tasks for the bytes of a split: a row of text may stand for many rows of work.
SPLIT_PARTS = 4


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{base}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Text work is CPU-bound: rows that a few files hold are dealt over all cores.

    A split is a range of bytes, but a row group is read by one task whatever the splits, and a file may be a single
    row group; only inputs of as many files as cores are left alone (no shuffle).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(max(cores, splits * SPLIT_PARTS)) if splits < cores or len(df.inputFiles()) < cores else df


def documents_from_tables(spark: SparkSession, base: str) -> DataFrame:
    """`documents` joined with the quality label: quality 0 plays the archived status."""
    docs = read(spark, base, "documents").select("doc_id", "text", "source")
    labels = read(spark, base, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    first_line = F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("doc_seq"),
        F.col("doc_id").cast("string").alias("doc_id"),
        F.lit("1").alias("version"),
        F.when(first_line == "", F.concat(F.lit("doc "), F.col("doc_id"))).otherwise(first_line).alias("title"),
        F.col("source").alias("section"),
        F.regexp_extract("source", r"([0-9]+)", 1).alias("section_id"),
        F.col("text").alias("content"),
        F.concat(F.lit("kb://"), F.col("source"), F.lit("/"), F.col("doc_id")).alias("url"),
        F.lit("1970-01-01 00:00:00").cast("timestamp").alias("updated_at"),
        (F.coalesce(F.col("quality"), F.lit(1)) != 0).alias("is_actual"),
    )


def split_valid(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with every required field non-blank, quarantined rest)."""
    ok: Column = F.lit(True)
    for c in REQUIRED:
        ok = ok & (F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    return documents.filter(ok), documents.filter(~ok)


def actual_documents(documents: DataFrame) -> DataFrame:
    return split_valid(documents)[0].filter("is_actual")


def queries_from_benchmark(
    spark: SparkSession, base: str, top_k: int = 5, section_id: int = 0
) -> DataFrame:
    return read(spark, base, "benchmark").select(
        F.col("item_id").alias("qid"),
        F.col("text").alias("query"),
        F.lit(top_k).alias("top_k"),
        F.lit(section_id).alias("section_id"),
    )


def queries_from_conversations(
    spark: SparkSession, base: str, top_k: int = 5, section_id: int = 0
) -> DataFrame:
    return read(spark, base, "conversations").filter("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"),
        F.col("text").alias("query"),
        F.lit(top_k).alias("top_k"),
        F.lit(section_id).alias("section_id"),
    )
