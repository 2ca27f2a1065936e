"""Defaults of the analysis. Every job takes a :class:`Policy`."""

from __future__ import annotations

from dataclasses import dataclass

# Scene-classification codes, version tags, weights and names that
# results and stored tables depend on.
VALID_CLASSES = (4, 5, 6)
CLOUD_CLASSES = (8, 9, 10)
SHADOW_CLASSES = (3,)
DETECTOR_VERSION = "ndvi-absolute-difference-v1"
PROCESSING_VERSION = "aoi-observation-quality-v1"
LEGACY_VERSION = "legacy-unassessed"
MASKING_METHOD = "sentinel-2-scl-nearest-v1"
DISPLAY_VERSION = "sentinel-2-rgb-percentile-v2"
EXPORT_VERSION = "investigation-v1"
QUALITY_AGGREGATION = "mean_min_usable_fraction"
OBSERVATION_STATES = (
    "discovered", "acquired", "valid_unusable", "usable", "failed", "legacy_unassessed",
)
SIGNAL_STATES = ("persistent", "recurrent", "transient", "isolated")
DECISIONS = ("accepted", "rejected", "investigate")
PRIORITY_WEIGHTS = {"urgent": 4, "high": 3, "normal": 2, "low": 1}
SEVERITY_WEIGHTS = {"high": 3, "medium": 2, "low": 1}
REQUIRED_BANDS = ("red", "nir")
QUALITY_BAND = "scl"
BAND_NAMES = ("B04 red", "B08 nir")
DISPLAY_BANDS = ("red", "green", "blue")
NOTE_LIMIT = 2000


@dataclass(frozen=True)
class Policy:
    """Tunable parameters with their defaults."""

    threshold: float = 0.20
    min_region_pixels: int = 4
    min_usable_fraction: float = 0.5
    iou_threshold: float = 0.25
    # Newest results per AOI that a search keeps; all of them by default.
    catalog_limit: int | None = None
    seasonal_days: int = 60
    coverage_epsilon: float = 1e-6
    # Physical layout: the side of the square pixel tiles that detection works on.
    tile: int = 256

    def __post_init__(self) -> None:
        if not 0 < self.threshold <= 2:
            raise ValueError("threshold must be in (0, 2]")
        if self.min_region_pixels < 1:
            raise ValueError("min_region_pixels must be at least 1")
        if not 0 < self.iou_threshold <= 1:
            raise ValueError("iou_threshold must be in (0, 1]")
        if self.tile < 2:
            raise ValueError("tile must be at least 2")
