"""Parameters of hybrid search."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class HybridParams:
    rrf_k: float = 60.0
    w_vector: float = 1.0
    w_bm25: float = 1.0
    k_candidates: int = 50
    min_cosine: float = 0.40
    min_hybrid: float = 0.35
    min_bm25_term_matches: int = 2
    per_file: int = 3
    doc_penalty: float = 0.12
    test_penalty: float = 0.10


@dataclass(frozen=True)
class Bm25Params:
    """Constants of the ranking function; the weights are those of name, path and body."""

    k1: float = 1.2
    b: float = 0.75
    weights: tuple[float, ...] = (3.0, 2.0, 1.0)
    least_idf: float = 1e-6
