"""Constants of ranking and search."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """k1, k2, b: BM25. max_df: terms in more records are left out of ranking. fetch: up to so many results are looked up by their ids in the scan. The rest are caps on query expansion and snippets."""

    k1: float = 1.2
    k2: float = 100.0
    b: float = 0.0
    max_df: int = 100_000
    fetch: int = 1000
    prefix_terms: int = 10
    feedback_terms: int = 10
    window: int = 10_000
    pieces: int = 500


DEFAULTS = Settings()
