"""Parameters of the jobs, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    embed_dim: int = 1536
    embed_batch: int = 96
    ocr_min_chars: int = 100
    chunk_target_tokens: int = 800
    chunk_max_tokens: int = 1500
    prompt_version: str = "v2"
    requests_per_minute: int = 300
    tokens_per_minute: int = 400_000
    full_context_tokens: int = 12_000
    retrieval_top_k: int = 12
    columns_per_call: int = 6
    batch_threshold_cells: int = 100
    fuzzy_threshold: float = 0.9
    assistant_top_k: int = 16
    history: int = 8
    max_distance: float = 0.6
    rrf_k: int = 60
    default_date: str = "2000-01-01"


#: What the operators take where a job says nothing else.
DEFAULTS = Settings()
