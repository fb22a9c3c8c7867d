"""Engine settings: thresholds, list sizes, weights and the fixed point in time that ages are counted from."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

CORPORA = ("homelab", "ai")


@dataclass(frozen=True)
class EngineConfig:
    """Defaults follow the reference calibration; ``test_config`` fits the sparse test vectors."""

    max_distance: float = 0.60
    reject: float = 0.25
    accept: float = 0.60
    margin: float = 0.05
    dead_low: float = 0.40
    dead_high: float = 0.60
    candidate_k: int = 25
    semantic_k: int = 20
    lexical_k: int = 5
    lexical_limit: int = 100
    alternate_rank: int = 5
    alternate_alone: float = 0.40
    top_k: int = 5
    half_life_days: float = 540.0
    decay_floor: float = 0.30
    demotion: float = 0.1
    redundant: float = 0.08
    isolated: float = 0.28
    relevance_slope: float = 8.0
    relevance_offset: float = -3.0
    ai_decay: str = "disabled"
    ai_half_life_days: float = 540.0
    ai_decay_floor: float = 0.30
    as_of: str = "2026-01-02 00:00:00"
    bm25: dict = field(default_factory=lambda: {"k1": 1.2, "b": 0.75, "title": 3.0, "summary": 2.0, "content": 1.0})

    def __post_init__(self):
        if not 0 <= self.reject <= self.accept <= 1:
            raise ValueError("thresholds must keep 0 <= reject <= accept <= 1")
        if not self.dead_low < self.dead_high:
            raise ValueError("the dead zone is empty")
        if not 0 < self.semantic_k <= self.candidate_k or self.top_k < 1:
            raise ValueError("list sizes don't fit together")
        if self.ai_decay not in ("disabled", "rational"):
            raise ValueError(f"no decay mode {self.ai_decay!r}")

    def fingerprint(self) -> str:
        """SHA-256 of the settings as canonical JSON: equal settings, equal print."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_config(**changes) -> EngineConfig:
    return EngineConfig(**({"max_distance": 0.85, "redundant": 0.60, "isolated": 0.65} | changes))
