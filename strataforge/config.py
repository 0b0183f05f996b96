"""Settings that change results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 512
    chunk_overlap: int = 64
    max_file_bytes: int = 50 * 1024 * 1024
    top_k: int = 5
    max_top_k: int = 20

    def __post_init__(self):
        if self.chunk_size < 2 or self.chunk_overlap < 0:
            raise ValueError("chunk_size must be 2 or more and chunk_overlap 0 or more")
        # a chunk may end right after its middle; the next one must start beyond this one's start
        if self.chunk_overlap > self.chunk_size // 2:
            raise ValueError("chunk_overlap must be at most half of chunk_size, or chunking may not end")

    def limit(self, k: int | None) -> int:
        k = self.top_k if k is None else k
        if not 1 <= k <= self.max_top_k:
            raise ValueError(f"top_k must be from 1 to {self.max_top_k}")
        return k


DEFAULTS = Settings()
