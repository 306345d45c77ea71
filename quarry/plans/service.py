"""Service surface as tables: request validation, answer streaming, sync jobs, health."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions.text import split_stream_pieces, strip
from quarry.operators.indexing import IndexNotReady, Snapshot, load_manifest
from quarry.operators.refresh import refresh_index
from quarry.settings import Settings


def validate_requests(requests: DataFrame, s: Settings) -> DataFrame:
    """requests(qid, query, top_k, section_id, trace_id, …) -> clamped values and `error`.

    Rejected rows keep their id with a message; they never fail the job.
    """
    query = strip(F.coalesce("query", F.lit("")))
    trace = F.coalesce(F.nullif(strip(F.coalesce("trace_id", F.lit(""))), F.lit("")), F.uuid())
    error = (
        F.when(F.length("query") == 0, "query must not be empty")
        .when(F.length("query") > s.max_query_chars, f"query must not exceed {s.max_query_chars} characters")
        .when(F.octet_length("trace_id") > s.max_trace_id_bytes, f"trace_id must not exceed {s.max_trace_id_bytes} bytes")
    )
    wanted = F.when(F.coalesce("top_k", F.lit(0)) == 0, 5).otherwise(F.col("top_k"))
    return requests.withColumns(
        {
            "query": query, "trace_id": trace,
            "top_k": F.greatest(F.lit(1), F.least(wanted, F.lit(5))).cast("int"),
            "section_id": F.greatest(F.lit(0), F.coalesce("section_id", F.lit(0))).cast("int"),
        }
    ).withColumn("error", error)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter("error IS NULL").drop("error")


def answer_stream(results: DataFrame, s: Settings) -> DataFrame:
    """(qid, seq, kind, payload): route_info, token pieces, then the final result."""
    piece = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("payload"))
    tokens = F.transform(split_stream_pieces(F.col("answer"), s.token_chunk_chars), lambda p: piece("token", p))
    rows = [F.array(piece("route_info", F.col("route_type")))]
    if s.stream_tokens:
        rows.append(tokens)
    rows.append(
        F.array(
            piece(
                "final",
                F.to_json(
                    F.struct(
                        "answer", "route_type",
                        F.transform(
                            "sources",
                            lambda x: F.struct(
                                x["doc_id"].alias("doc_id"), x["title"].alias("title"),
                                x["url"].alias("url"), x["score"].alias("score"),
                            ),
                        ).alias("sources"),
                    )
                ),
            )
        )
    )
    return results.select("qid", F.posexplode(F.concat(*rows)).alias("seq", "row")).select("qid", "seq", "row.*")


# --- sync jobs ------------------------------------------------------------------------


@dataclass(frozen=True)
class SyncJob:
    job_id: str
    status: str
    processed_docs: int = 0
    total_docs: int = 0
    error: str = ""


class KnowledgeBase:
    """Index lifecycle: one active refresh at a time, readers keep their snapshot."""

    def __init__(self, spark: SparkSession, root: str, source_key: str, s: Settings) -> None:
        self.spark, self.root, self.source_key, self.settings = spark, root, source_key, s
        self.jobs: dict[str, SyncJob] = {}
        self.active: str | None = None
        self.snapshot: Snapshot | None = None

    def start_sync(self) -> SyncJob:
        current = self.jobs.get(self.active or "")
        if current and current.status in ("pending", "running"):
            return current
        total = self.snapshot.manifest["document_count"] if self.snapshot else 0
        job = SyncJob(f"kb-{uuid.uuid4().hex}", "pending", 0, total)
        self.jobs[job.job_id] = job
        self.active = job.job_id
        for key in [k for k in self.jobs if k != self.active][: max(0, len(self.jobs) - self.settings.max_sync_jobs)]:
            del self.jobs[key]
        return job

    def run_sync(self, job_id: str, documents: DataFrame) -> SyncJob:
        self._set(job_id, status="running")
        try:
            fresh = refresh_index(self.spark, documents, self.source_key, self.root, self.settings)
        except Exception as exc:  # noqa: BLE001 - reported in the job, the old index stays live
            self.active = None
            return self._set(job_id, status="failed", error=f"{type(exc).__name__}: {exc}"[:1000])
        self.snapshot, self.active = fresh, None
        n = fresh.manifest["document_count"]
        return self._set(job_id, status="completed", processed_docs=n, total_docs=n)

    def _set(self, job_id: str, **changes) -> SyncJob:
        self.jobs[job_id] = replace(self.jobs[job_id], **changes)
        return self.jobs[job_id]

    def sync_status(self, job_id: str) -> SyncJob:
        if not job_id.strip():
            raise ValueError("job_id is required")
        if job_id.strip() not in self.jobs:
            raise KeyError("sync job not found")
        return self.jobs[job_id.strip()]

    def jobs_table(self) -> DataFrame:
        schema = "job_id string, status string, processed_docs long, total_docs long, error string"
        rows = [(j.job_id, j.status, j.processed_docs, j.total_docs, j.error) for j in self.jobs.values()]
        return self.spark.createDataFrame(rows, schema)

    def health(self, model_ok: bool, model_status: str) -> dict:
        try:
            m = load_manifest(self.spark, self.root)
        except IndexNotReady:
            return {"healthy": False, "model_status": "not_initialized", "index_status": "not_initialized"}
        return {
            "healthy": bool(model_ok and m["chunk_count"] > 0),
            "model_status": model_status,
            "index_status": f"ready:documents={m['document_count']},chunks={m['chunk_count']}",
        }
