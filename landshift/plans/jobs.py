"""Composite jobs that run several stages for all AOIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.config import Policy
from landshift.operators import change, polygons, quality, regions, reuse, signals, tracks, triage
from landshift.session import materialize
from landshift.sources.pixel_store import within_scenes
from landshift.sources.tables import clip_to_aoi

KEYS = ["aoi_id", "acq_id"]


def acquire(pixels: DataFrame, scenes: DataFrame, aois: DataFrame, stored: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Observations of all discovered scenes, with their origin and the best per AOI.

    Complete stored scenes are reused. The others are screened on the class band alone, inside their AOI;
    only scenes that pass have their bands read, clipped to the AOI and assessed. Both reads tell the scan the
    range of the scenes they want, which skips row groups of a clustered pixel table.
    """
    done, todo = reuse.split_reuse(scenes, stored)
    classes = within_scenes(pixels.select(*KEYS, "row", "col", "scl"), todo)
    screened = materialize(quality.screen_scenes(clip_to_aoi(classes, todo, aois), todo, policy), "screened")
    rejected = screened.where(~F.col("passed")).withColumn("origin", F.lit("screened_unusable"))
    passed = todo.join(screened.where("passed").select(*KEYS), KEYS, "left_semi")
    clipped = clip_to_aoi(within_scenes(pixels, passed), passed, aois)
    assessed = quality.assess_scenes(clipped, passed, policy).withColumn("origin", F.lit("completed"))
    reused = stored.join(done.select(*KEYS), KEYS, "left_semi").withColumn("origin", F.lit("available"))
    columns = [*KEYS, "item_id", "ts", "state", "reason", "usable_percentage", "cloud_percentage", "shadow_percentage", "origin"]
    observations = materialize(
        reused.select(*columns).unionByName(rejected.select(*columns)).unionByName(assessed.select(*columns)),
        "observations",
    )
    best = quality.best_observation(observations).select(*KEYS, F.lit(True).alias("best"))
    return observations.join(best, KEYS, "left").withColumn("best", F.coalesce("best", F.lit(False)))


def analyse(found: regions.Detection, acquisitions: DataFrame, grids: DataFrame, policy: Policy = Policy()) -> dict[str, DataFrame]:
    """Tracks, signals, analyses and candidates of a detection, whether its runs are new or reused."""
    pairs = tracks.sweep(materialize(found.region_pixels(), "region-pixels"), policy)
    lines = materialize(tracks.track_regions(found.regions, pairs), "tracks")
    key = ["aoi_id", *tracks.TRACK]
    outlines = polygons.track_outlines(materialize(found.track_pixels(lines), "track-pixels"), grids, key)
    told = materialize(signals.build_signals(lines, found.regions, found.runs, policy, outlines), "signals")
    related = materialize(signals.build_relationships(found.runs, lines), "relationships")
    sequence = change.sequence(change.eligible(acquisitions))
    analyses = materialize(signals.build_analyses(sequence, found.runs, told, policy), "analyses")
    candidates = materialize(triage.triage(told, found.regions, found.runs, analyses, related), "candidates")
    return {"tracks": lines, "signals": told, "relationships": related, "analyses": analyses, "candidates": candidates}


def orchestrate(
    sequence: DataFrame,
    intervals: DataFrame,
    reusable_runs: DataFrame,
    reused_analyses: DataFrame,
    analyses: DataFrame,
    candidates: DataFrame,
) -> DataFrame:
    """Summary per AOI of a full analysis with reuse.

    AOIs with fewer than two eligible observations form no interval and get a verdict
    instead of an analysis.
    """
    eligible = sequence.groupBy("aoi_id").agg(F.count(F.lit(1)).alias("eligible"))
    counts = reuse.orchestration_counts(reuse.plan_detections(intervals, reusable_runs))
    triaged = candidates.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("candidates"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    return (
        eligible.join(counts, "aoi_id", "left")
        .join(analyses.select("aoi_id", "analysis_id", "state"), "aoi_id", "left")
        .join(reused_analyses.select("aoi_id", F.lit(True).alias("reused_analysis")), "aoi_id", "left")
        .join(triaged, "analysis_id", "left")
        .select(
            "aoi_id", "eligible", zero("reused_detections"), zero("generated_detections"),
            F.coalesce("reused_analysis", F.lit(False)).alias("reused_analysis"),
            F.when(F.col("eligible") < 2, "insufficient history").otherwise(F.col("state")).alias("state"),
            zero("candidates"),
        )
    )
