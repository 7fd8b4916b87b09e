"""Fixed values of the screening model: results depend on them exactly."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Class order, categories, policies, budgets and the constants of aggregation, sampling and mitigation.
CLASSES = ("Drawing", "Hentai", "Neutral", "Porn", "Sexy")
CATEGORIES = ("sexual", "violence", "gore", "weapons", "self-harm", "hate-imagery", "drugs")
SCREENED_BY_DEFAULT = ("sexual",)

VOUCH_RADIUS_MS = 2000
MERGE_GAP_MS = 2000
PAD_MS = 600
TOP_K = 3
MAX_CONFIDENCE = 0.99
BASE_PRIORITY = 0.15
EARLY_EXIT_SINGLE = 0.98
EARLY_EXIT_MARGIN = 0.2
CACHE_FRAMES = 24
NO_HASH = "0" * 16
RESERVOIR = 512
GOP_WALK = 24
MAX_INDEXED_BYTES = 300 * 1024 * 1024
SEEK_MARGIN_MS = 50
TRUSTED_COVERAGE = 0.9
SPAN_LEAD_MS = 250
WIDE_RATIO = 1.5


@dataclass(frozen=True)
class Policy:
    id: str
    weights: tuple[float, float, float, float, float]  # in the order of CLASSES
    frame_threshold: float
    single_threshold: float
    min_flagged: int
    gap_ms: int


POLICIES = {
    p.id: p
    for p in (
        Policy("strict", (0.05, 1.0, 0.0, 1.0, 0.7), 0.30, 0.80, 1, 0),
        Policy("balanced", (0.0, 1.0, 0.0, 1.0, 0.35), 0.55, 0.95, 2, 400),
        Policy("permissive", (0.0, 0.9, 0.0, 1.0, 0.1), 0.75, 0.98, 3, 1000),
    )
}
DEFAULT_POLICY = "balanced"


@dataclass(frozen=True)
class Budget:
    survey_frames: int = 16
    max_frames: int = 120
    max_ms: int = 15000
    hamming: int = 6
    target_ms: int = 45
    min_gap_ms: int = 250
    concurrency: int = 2


BUDGETS = {
    "medium": Budget(),
    "high": replace(Budget(), max_frames=160, max_ms=20000, concurrency=3),
    "low": replace(Budget(), survey_frames=10, max_frames=48, max_ms=9000, target_ms=90, concurrency=1),
}
BACKENDS = ("webgpu", "webgl", "wasm", "cpu")
