"""Limits of an observation or a signal as evidence: codes with the facts behind them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from landshift.config import PROCESSING_VERSION
from landshift.functions.scoring import POOR_QUALITY


def _limit(acq_id: Column, code: str, fact: Column) -> Column:
    return F.struct(acq_id.cast("bigint").alias("acq_id"), F.lit(code).alias("code"), fact.cast("string").alias("fact"))


def observation_limits(
    acq_id: Column, state: Column, reason: Column, version: Column, mask_available: Column, display_available: Column
) -> Column:
    """Limits of one observation, as array<struct<acq_id, code, fact>>."""
    none = F.lit(None).cast("string")
    told = F.nullif(reason, F.lit(""))
    usable = state == "usable"
    return F.array_compact(F.array(
        F.when(state == "valid_unusable", _limit(acq_id, "too_few_usable_pixels", told)),
        F.when(state == "legacy_unassessed", _limit(acq_id, "never_assessed", none)),
        F.when(state == "failed", _limit(acq_id, "preparation_failed", told)),
        F.when(state.isin("discovered", "acquired"), _limit(acq_id, "preparation_pending", state)),
        F.when(usable & ~mask_available, _limit(acq_id, "no_class_mask", none)),
        F.when(usable & (version != PROCESSING_VERSION), _limit(acq_id, "other_mask_version", version)),
        F.when(usable & ~display_available, _limit(acq_id, "no_current_picture", none)),
    ))


def signal_limits(quality: Column) -> Column:
    """The limit of a weakly supported signal, in an array of at most one; it names no observation."""
    weak = (quality > 0) & (quality < POOR_QUALITY)
    return F.array_compact(F.array(F.when(weak, _limit(F.lit(None), "weak_quality_support", F.round(quality, 2)))))
