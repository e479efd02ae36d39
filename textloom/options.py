"""Options of the chunking stages, with their bounds and defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkOptions:
    """Token budgets. ``target_tokens`` is accepted and has no effect; min may exceed max, no field is held against another."""

    target_tokens: int = 300
    min_tokens: int = 100
    max_tokens: int = 450
    overlap_ratio: float = 0.0
    overlap_tokens: int = 0

    def __post_init__(self) -> None:
        bounds = (self.target_tokens >= 50, self.min_tokens >= 1, self.max_tokens >= 10, 0 <= self.overlap_ratio <= 0.9, self.overlap_tokens >= 0)
        if not all(bounds):
            raise ValueError(f"an option is out of bounds: {self}")


@dataclass(frozen=True)
class BoundaryOptions:
    """Thresholds of boundary refinement; similarity without a scorer counts as an error for every pair."""

    similarity: bool = True
    high: float = 0.88
    low: float = 0.72
    llm: bool = False


@dataclass(frozen=True)
class IngestOptions:
    max_upload_mb: int = 20
    download_factor: int = 2
    timeout_seconds: int = 20
    allowed_hosts: str = ""
    ocr_below_chars: int = 40
    ocr_pages: int = 10


@dataclass(frozen=True)
class RateLimit:
    hits: int = 10
    seconds: int = 60
    exempt_paths: tuple[str, ...] = ("/health", "/metrics")
