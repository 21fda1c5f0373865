"""Parameters of the experiment pipeline, with their usual values."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    sample_size: int = 250
    seed: int = 42
    max_scan: int = 200_000
    answer_min_chars: int = 10
    answer_max_chars: int = 100
    chunk_tokens: int = 512
    overlap_tokens: int = 51
    min_sentence_chars: int = 50
    window_sentences: int = 2
    similarity_threshold: float = 0.6
    top_k: int = 10
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    embedding_dim: int = 16


DEFAULTS = Settings()
STRATEGIES = ["heuristic", "semantic", "agentic"]
METHODS = ["sparse", "dense", "hybrid"]
