"""Question files in, answers out; document files in, refreshed index out.

Both streams use `foreachBatch` over stateless transforms.  A batch writes to its own
folder keyed by the batch id, so a replayed batch overwrites itself: exactly-once output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.indexing import Snapshot
from quarry.operators.model import Provider
from quarry.plans import latency
from quarry.plans.routing import route_queries
from quarry.plans.service import KnowledgeBase, accepted, validate_requests
from quarry.settings import Settings

QUESTION_SCHEMA = "qid long, query string, top_k int, section_id int, trace_id string"


def question_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    return (
        spark.readStream.schema(QUESTION_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
    )


def rejected(validated: DataFrame) -> DataFrame:
    """Invalid requests as result rows."""
    return latency.result(
        validated.filter("error IS NOT NULL"), answer=F.col("error"), status="invalid_argument", stage="rejected",
        retrievals=0, generations=0,
    )


def answer_batch(snap: Snapshot, requests: DataFrame, provider: Provider | None) -> DataFrame:
    checked = validate_requests(requests, snap.settings)
    return latency.answer_queries(snap, accepted(checked), provider).unionByName(rejected(checked))


def run_answers(
    stream: DataFrame, snapshot: Callable[[], Snapshot], out: str, checkpoint: str, provider: Provider | None = None
) -> StreamingQuery:
    """Answer every micro-batch on the snapshot that is current when the batch starts."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        answer_batch(snapshot(), batch, provider).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def run_routes(stream: DataFrame, snapshot: Callable[[], Snapshot], out: str, checkpoint: str) -> StreamingQuery:
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        snap = snapshot()
        asked = accepted(validate_requests(batch, snap.settings))
        route_queries(snap, asked).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def run_refresh(
    arrivals: DataFrame, kb: KnowledgeBase, documents: Callable[[], DataFrame], checkpoint: str
) -> StreamingQuery:
    """New document files trigger one refresh beside the live index, then the pointer moves."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            kb.run_sync(kb.start_sync().job_id, documents())

    return (
        arrivals.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
