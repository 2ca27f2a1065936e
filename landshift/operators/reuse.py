"""Reuse of stored scenes, runs and analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.config import DETECTOR_VERSION, DISPLAY_VERSION, LEGACY_VERSION, Policy
from landshift.operators.skew import attach_group_values, rank_within
from landshift.session import materialize

TOLERANCE = 1e-6


def reusable_scenes(acquisitions: DataFrame) -> DataFrame:
    """Add ``reusable``: whether the artifacts of a stored scene are complete.

    Usable scenes need bands, mask and a display of the current version, screened-out
    scenes only the mask, other unusable scenes bands and mask; the rest is redone.
    """
    bands, mask = F.col("has_bands"), F.col("has_mask")
    display = F.col("has_display") & (F.col("visualization_version") == DISPLAY_VERSION)
    complete = (
        F.when(F.col("state") == "usable", bands & mask & display)
        .when((F.col("state") == "valid_unusable") & (F.col("evaluation_stage") == "scl_screening"), mask)
        .when(F.col("state") == "valid_unusable", bands & mask)
    )
    return acquisitions.withColumn("reusable", F.coalesce(complete, F.lit(False)))


def split_reuse(items: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(already complete, still to process) of the discovered items."""
    key = ["aoi_id", "item_id"]
    done = reusable_scenes(stored).where("reusable").select(*key)
    return items.join(done, key, "left_semi"), items.join(done, key, "left_anti")


def newest_runs(runs: DataFrame) -> DataFrame:
    """Newest quality-aware run of the current detector per pair."""
    aware = runs.where(
        F.col("quality_mask_used")
        & (F.col("quality_processing_version") != LEGACY_VERSION)
        & (F.col("detector_version") == DETECTOR_VERSION)
    )
    rest = ["run_id", "threshold", "min_region_pixels"]
    return aware.groupBy("before_acq", "after_acq").agg(
        F.max_by(F.struct(*rest), "run_id").alias("r")
    ).select("before_acq", "after_acq", "r.*")


def reusable_runs(runs: DataFrame, acquisitions: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Run that stands in for a new detection of its pair.

    Only the newest run is considered: if it was made with other settings, older ones
    are not tried.
    """
    ends = acquisitions.select("acq_id", "aoi_id", "state")
    before = ends.select(F.col("acq_id").alias("before_acq"), F.col("aoi_id").alias("before_aoi"), F.col("state").alias("before_state"))
    after = ends.select(F.col("acq_id").alias("after_acq"), F.col("aoi_id").alias("after_aoi"), F.col("state").alias("after_state"))
    return (
        newest_runs(runs)
        .join(before, "before_acq")
        .join(after, "after_acq")
        .where(
            (F.col("before_aoi") == F.col("after_aoi"))
            & (F.col("before_state") == "usable")
            & (F.col("after_state") == "usable")
            & (F.abs(F.col("threshold") - policy.threshold) <= TOLERANCE)
            & (F.col("min_region_pixels") == policy.min_region_pixels)
        )
        .select(F.col("before_aoi").alias("aoi_id"), "before_acq", "after_acq", "run_id")
    )


def plan_detections(intervals: DataFrame, reusable: DataFrame) -> DataFrame:
    """Intervals with the run they reuse; a NULL ``reused_run`` must be detected."""
    return intervals.join(
        reusable.select("before_acq", "after_acq", F.col("run_id").alias("reused_run")),
        ["before_acq", "after_acq"], "left",
    )


def matching_analyses(
    analyses: DataFrame,
    relationships: DataFrame,
    requested: DataFrame,
    reusable: DataFrame,
    policy: Policy = Policy(),
) -> DataFrame:
    """Newest stored analysis per AOI that already answers the request.

    It must have the same acquisitions in the same order, the same IoU threshold, and
    every interval must rest on the run that would be reused today. ``relationships``
    has (analysis_id, seq, before_acq, after_acq, run_id), ``requested`` one row per
    interval (aoi_id, seq, before_acq, after_acq). Comparing interval by interval means
    no id list is ever built.
    """
    wanted = requested.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("wanted"))
    same = (
        relationships.join(requested, ["seq", "before_acq", "after_acq"])
        .join(reusable.select("before_acq", "after_acq", "run_id"), ["before_acq", "after_acq", "run_id"])
        .groupBy("analysis_id", "aoi_id")
        .agg(F.count(F.lit(1)).alias("same"))
    )
    sizes = relationships.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("stored"))
    fitting = (
        same.join(sizes, "analysis_id")
        .join(wanted, "aoi_id")
        .where("same = stored and same = wanted")
        .join(analyses, "analysis_id")
        .where(F.abs(F.col("iou_threshold") - policy.iou_threshold) < TOLERANCE)
    )
    return fitting.groupBy("aoi_id").agg(F.max("analysis_id").alias("analysis_id"))


def orchestration_counts(planned: DataFrame) -> DataFrame:
    """Reused and generated detections per AOI."""
    return planned.groupBy("aoi_id").agg(
        F.count("reused_run").alias("reused_detections"),
        F.count_if(F.col("reused_run").isNull()).alias("generated_detections"),
    )


def progress(steps: DataFrame) -> DataFrame:
    """Counter of finished steps per AOI in processing order."""
    numbered = rank_within(materialize(steps, "steps"), ["aoi_id"], [F.col("position").asc()], "current")
    return attach_group_values(numbered, ["aoi_id"], ["position"], {"total": (F.sum, F.lit(1))})
