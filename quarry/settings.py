"""Engine settings: one frozen dataclass, validated on construction."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    # service
    max_concurrent_queries: int = 1
    stream_tokens: bool = True
    token_chunk_chars: int = 48
    max_sync_jobs: int = 100
    max_query_chars: int = 16_000
    max_trace_id_bytes: int = 128
    auto_build_index: bool = True

    # knowledge base
    kb_name: str = "kb"
    kb_base_url: str = ""
    kb_section_id: int = 0
    kb_per_page: int = 200
    kb_max_articles: int = 0

    # chunking
    chunk_size_chars: int = 1400
    chunk_overlap_chars: int = 180

    # embedding / sparse index
    embedding_backend: str = "hashing"
    embedding_model: str = "word+char-hashing"
    embedding_dimension: int = 768
    char_vocabulary_size: int = 25_000
    word_family_weight: float = 1.0
    char_family_weight: float = 0.45

    # retrieval
    dense_top_k: int = 60
    sparse_top_k: int = 80
    rerank_candidate_k: int = 80
    lexical_candidate_k: int = 80
    lexical_rerank_enabled: bool = True
    reranker_backend: str = "rrf"
    retrieval_min_score: float = 0.0
    max_chunks_per_document: int = 3
    optimized_retrieval_top_k: int = 10
    lexical_coverage_weight: float = 0.42
    lexical_title_weight: float = 0.16
    lexical_proximity_weight: float = 0.10
    lexical_document_weight: float = 0.10
    neighbor_expansion_enabled: bool = True
    neighbor_distance: int = 1
    neighbor_anchor_k: int = 3

    # context
    focused_passages_enabled: bool = True
    focused_passage_chars: int = 700
    focused_passage_neighbor_sentences: int = 1
    max_context_chars: int = 4200
    context_max_chunks: int = 5
    context_duplicate_jaccard: float = 0.88

    # model budgets
    model_max_tokens: int = 900
    naive_max_tokens: int = 160
    adaptive_tokens: bool = True
    fact_max_tokens: int = 300
    default_max_tokens: int = 550
    procedure_max_tokens: int = 600
    min_answer_tokens: int = 160
    decode_margin_seconds: float = 1.5
    perf_ema_alpha: float = 0.35
    initial_prompt_tps: float = 60.0
    initial_decode_tps: float = 10.0
    prompt_budget_safety: float = 0.90
    server_predict_budget_ms: int = 17_500
    no_think: bool = True

    # gates and guards
    quality_gate_enabled: bool = True
    gate_direct_enabled: bool = True
    gate_external_enabled: bool = True
    gate_clarify_enabled: bool = True
    weak_threshold: float = 0.42
    strong_threshold: float = 0.62
    grounding_guard_enabled: bool = True
    relevance_guard_enabled: bool = True
    grounding_min_claim_coverage: float = 0.18
    procedure_source_coherence: bool = True

    # deadlines, fallback, cache
    latency_optimized_mode: bool = False
    request_deadline_seconds: float = 23.5
    response_budget_seconds: float = 20.0
    extractive_fallback_enabled: bool = True
    extractive_min_score: float = 0.42
    answer_cache_size: int = 128

    # agentic plan
    max_retrieval_attempts: int = 2
    max_generation_attempts: int = 2
    validation_mode: str = "off"
    fast_naive_enabled: bool = True
    legacy_fallback_enabled: bool = True
    naive_context_top_k: int = 5
    passage_selection_enabled: bool = False
    passage_window_chars: int = 500
    passage_overlap_chars: int = 150

    # Spark-side bounds. A side is broadcast only when its row count has been
    # checked against `broadcast_rows`; a block of queries handed to the scoring
    # kernel never exceeds `query_block`.
    broadcast_rows: int = 500_000
    query_block: int = 512
    #: Index segments beside each other before their live rows are written as one.
    max_segments: int = 8
    #: Chunks of one slice of the inverted index: the lists that one task holds.
    posting_slice_chunks: int = 20_000
    index_buckets: int = 0          # 0 = derive from the corpus size
    bucket_target_chars: int = 64_000_000
    score_digits: int = 6

    def __post_init__(self) -> None:
        if self.chunk_overlap_chars >= self.chunk_size_chars:
            raise ValueError("chunk_overlap_chars must be smaller than chunk_size_chars")
        if self.passage_overlap_chars >= self.passage_window_chars:
            raise ValueError("passage_overlap_chars must be smaller than passage_window_chars")
        if self.rerank_candidate_k < self.naive_context_top_k:
            raise ValueError("rerank_candidate_k must be >= naive_context_top_k")
        if self.weak_threshold >= self.strong_threshold:
            raise ValueError("weak_threshold must be smaller than strong_threshold")
        if self.response_budget_seconds >= self.request_deadline_seconds:
            raise ValueError("response_budget_seconds must be smaller than request_deadline_seconds")
        if self.embedding_dimension % 2:
            object.__setattr__(self, "embedding_dimension", self.embedding_dimension + 1)
        object.__setattr__(self, "kb_per_page", max(1, min(int(self.kb_per_page), 700)))
        object.__setattr__(self, "kb_max_articles", max(0, int(self.kb_max_articles)))

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)

    @classmethod
    def from_env(cls, prefix: str = "QUARRY_") -> "Settings":
        """Read overrides such as QUARRY_CHUNK_SIZE_CHARS from the environment."""
        changes = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is None:
                continue
            kind = type(f.default)
            changes[f.name] = raw.strip().lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        return cls(**changes)
