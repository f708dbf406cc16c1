"""Thresholds of the verification ladder, as immutable settings."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class VerdictSettings:
    correct: float
    uncertain: float
    least_coverage: float
    top_k: int
    guard: float = 0.0


@dataclass(frozen=True)
class CorrectionSettings:
    window: int = 8
    flat_top_k: int = 40
    strong: float = 0.65
    full_ratio: float = 0.40
    low: float = 0.55
    flat_strong: float = 1.01  # above 1: a flat record never corrects a text by itself
    flat_low: float = 0.45


@dataclass(frozen=True)
class ScanSettings:
    tokens: int = 4
    ratio: float = 0.7
    idf: float = 8.0
    short_bonus: float = 6.0
    flat_tokens: int = 6
    flat_idf: float = 14.0
    posting_cap: int = 60
    soft_least: float = 0.6
    soft_slack: float = 0.2


@dataclass(frozen=True)
class Settings:
    sequence: VerdictSettings = VerdictSettings(0.94, 0.45, 0.40, 25)
    flat: VerdictSettings = VerdictSettings(0.88, 0.30, 0.70, 15, 0.20)
    correction: CorrectionSettings = field(default_factory=CorrectionSettings)
    scan: ScanSettings = field(default_factory=ScanSettings)
    verified_confidence: float = 0.75
    unsupported_confidence: float = 0.70
    unsupported_strength: float = 0.35
    short_words: int = 3
    exact_tokens: int = 3
    flat_exact_tokens: int = 4
    max_chars: int = 20_000
    segment_chars: int = 3_000
    context_chars: int = 110
    formula_share: float = 0.6
    quoted_coverage: float = 0.5
    quoted_coverage_flat: float = 0.75
    entity_score: float = 0.5
    entity_gap: int = 1
    k1: float = 1.2
    b: float = 0.75
    tf_cap: int = 65_535
