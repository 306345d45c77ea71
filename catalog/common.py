"""Shared inputs of the query catalogue: one index per data folder and session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import retrieval as R
from quarry.operators.gates import hit_lists
from quarry.operators.indexing import Snapshot, ensure_index
from quarry.session import materialize, ship_package, work_dir
from quarry.settings import Settings
from quarry.sources.tables import documents_from_tables, queries_from_benchmark

SETTINGS = Settings()
_cache: dict[tuple, object] = {}


def _once(spark: SparkSession, *key, make):
    full = (spark.sparkContext.applicationId, *key)
    if full not in _cache:
        _cache[full] = make()
    return _cache[full]


def snapshot(spark: SparkSession, d: str) -> Snapshot:
    def make() -> Snapshot:
        ship_package(spark)
        root = f"{work_dir(spark)}/quarry-index/{spark.sparkContext.applicationId}-{abs(hash(d))}"
        return ensure_index(spark, documents_from_tables(spark, d), f"tables:{d}", root, SETTINGS)

    return _once(spark, "index", d, make=make)


def hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Top-k hits of every benchmark question, computed once and written."""
    return _once(
        spark, "hits", d, k,
        make=lambda: materialize(R.search(snapshot(spark, d), queries_from_benchmark(spark, d, k)), f"hits{k}"),
    )


def question_lists(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return queries_from_benchmark(spark, d, k).join(hit_lists(hits(spark, d, k)), "qid", "left")
