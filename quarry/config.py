"""All settings of a retrieval run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    mode: str = "hybrid"  # vector, bm25 or hybrid
    rrf_k: int = 60
    rerank: bool = False
    pool: int = 25
    top_n: int = 5
    sources: int = 5
    token_budget: int = 2000
    upsert_batch: int = 100
    intent: bool = False
    zone: str = "UTC"
    authored_field: str = "last_edited_time"

    def __post_init__(self) -> None:
        if self.mode not in ("vector", "bm25", "hybrid"):
            raise ValueError(f"unknown retrieval mode: {self.mode}")
        if self.upsert_batch <= 0 or self.rrf_k <= 0:
            raise ValueError("batch and k must be positive")

    def today(self) -> str:
        """The calendar day in the zone; of a zone that is not known, in UTC."""
        from datetime import datetime, timezone
        from zoneinfo import ZoneInfo

        try:
            zone = ZoneInfo(self.zone)
        except (KeyError, ValueError, OSError):
            zone = timezone.utc
        return datetime.now(zone).date().isoformat()

    @staticmethod
    def of(mode: str = "hybrid", **others) -> Settings:  # noqa: ANN003
        """Settings with the mode as it is written in a configuration (case and space aside)."""
        return Settings(mode=mode.strip().lower(), **others)

    @property
    def depth(self) -> int:
        """How many candidates each strategy returns."""
        return self.pool if self.rerank else self.sources
