"""Temporal signals, relationships and analyses from region tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.config import QUALITY_AGGREGATION, SIGNAL_STATES, Policy
from landshift.functions import history
from landshift.operators import change
from landshift.operators.components import SCOPE
from landshift.operators.skew import number_buckets

# Regions per numbering slice of the birth order.
BIRTH_SLICE = 1 << 16


def interval_totals(runs: DataFrame) -> DataFrame:
    """Per analysis: intervals, quality and region pixels over all intervals."""
    return runs.groupBy("aoi_id").agg(
        F.count(F.lit(1)).cast("int").alias("interval_count"),
        F.sum("quality_support").alias("total_quality"),
        F.sum("filtered_changed_pixel_count").alias("total_pixels"),
    )


def track_entries(tracks: DataFrame, regions: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per (track, supporting region) with the facts of its interval."""
    facts = runs.select(
        *SCOPE, "run_id", "before_acq", "after_acq", "before_ts", "after_ts", "quality_support",
        F.col("mean_change_signal").alias("run_mean"),
        F.col("max_change_signal").alias("run_max"),
        history.midpoint_day(F.col("before_ts"), F.col("after_ts")).alias("mid_day"),
    )
    sizes = regions.select(*SCOPE, "region_no", "region_id", "pixel_count")
    return tracks.join(sizes, [*SCOPE, "region_no"]).join(facts, SCOPE)


def build_signals(
    tracks: DataFrame, regions: DataFrame, runs: DataFrame, policy: Policy = Policy(), outlines: DataFrame | None = None
) -> DataFrame:
    """One signal per track. A track has at most one region per interval, which bounds
    every array here by the number of intervals.

    ``outlines`` (aoi_id, birth_k, birth_no, geometry) are the dissolved regions of the tracks; without
    them signals have no column ``geometry``.
    """
    fields = (
        "k", "region_id", "iou", "pixel_count", "run_id", "before_acq", "after_acq",
        "before_ts", "after_ts", "quality_support", "run_mean", "run_max", "mid_day",
    )
    grouped = (
        track_entries(tracks, regions, runs)
        .groupBy("aoi_id", "birth_k", "birth_no")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("e"))
        .withColumn("_slice", F.floor(F.col("birth_no") / BIRTH_SLICE))
    )
    numbered = number_buckets(grouped, ["aoi_id"], ["birth_k", "_slice"], ["birth_no"], "signal_id").join(
        interval_totals(runs), "aoi_id"
    )
    total = lambda field: F.aggregate(
        F.col(f"e.{field}"), F.lit(0.0), lambda acc, v: acc + v.cast("double")
    )
    support = F.size("e")
    first, last = F.col("e")[0], F.element_at("e", -1)
    gaps = history.gap_count(F.col("e.k"))
    intervals = F.col("interval_count")
    quality = total("quality_support")
    shape = []
    if outlines is not None:
        numbered = numbered.join(outlines.select("aoi_id", "birth_k", "birth_no", "geometry"), ["aoi_id", "birth_k", "birth_no"], "left")
        shape = ["geometry"]
    return numbered.select(
        F.col("aoi_id").alias("analysis_id"),
        "aoi_id",
        "signal_id",
        "birth_k",
        "birth_no",
        support.alias("support_count"),
        intervals.alias("interval_count"),
        F.when(F.col("total_quality") > 0, quality / F.col("total_quality")).otherwise(0.0).alias("persistence_ratio"),
        gaps.alias("recurrence_count"),
        F.when((support == 1) & (intervals > 1), 1).otherwise(0).alias("transient_interval_count"),
        (total("iou") / support).alias("temporal_consistency"),
        (total("pixel_count") / F.greatest("total_pixels", F.lit(1))).alias("matched_region_coverage"),
        first["before_ts"].alias("first_change_ts"),
        last["after_ts"].alias("last_supporting_ts"),
        history.signal_state(support, intervals, gaps).alias("state"),
        intervals.alias("usable_interval_count"),
        support.alias("supporting_interval_count"),
        (quality / support).alias("quality_support"),
        first["before_acq"].alias("onset_before_acq"),
        first["after_acq"].alias("onset_after_acq"),
        first["before_ts"].alias("onset_start_ts"),
        first["after_ts"].alias("onset_end_ts"),
        history.season(F.col("e.mid_day"), intervals + 1, policy.seasonal_days).alias("season"),
        F.col("e.run_mean").alias("interval_means"),
        F.col("e.run_max").alias("interval_maxima"),
        F.col("e.region_id").alias("source_region_ids"),
        F.array_sort(F.array_distinct("e.run_id")).alias("detection_run_ids"),
        F.array_sort(F.array_distinct(F.concat("e.before_acq", "e.after_acq"))).alias("acquisition_ids"),
        *shape,
    )


def sort_signals(signals: DataFrame) -> DataFrame:
    """Presentation order; ``signal_id`` stays the creation order."""
    return signals.orderBy("analysis_id", "first_change_ts", F.col("source_region_ids")[0])


def build_relationships(runs: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row per interval with the number of regions matched into it."""
    matched = tracks.groupBy(*SCOPE).agg(F.count("from_no").alias("matched_region_count"))
    return runs.join(matched, SCOPE, "left").select(
        F.col("aoi_id").alias("analysis_id"),
        *SCOPE,
        "before_acq",
        "after_acq",
        F.col("run_id").alias("detection_run_id"),
        "region_count",
        F.col("filtered_changed_pixel_count").alias("changed_pixel_count"),
        F.coalesce("matched_region_count", F.lit(0)).cast("bigint").alias("matched_region_count"),
        "elapsed_days",
        "quality_support",
        F.lit("usable").alias("quality_state"),
        F.lit(True).alias("evaluated"),
    )


def relationship_regions(tracks: DataFrame) -> DataFrame:
    """Region id lists of the relationships, one row per region.

    ``region_id`` rows of an interval are its own regions; those with a
    ``matched_from`` are the regions matched into it.
    """
    own = change.region_id(change.run_id(F.col("aoi_id"), F.col("k")), F.col("region_no"))
    source = change.region_id(change.run_id(F.col("aoi_id"), F.col("from_k")), F.col("from_no"))
    return tracks.select(
        F.col("aoi_id").alias("analysis_id"),
        *SCOPE,
        own.alias("region_id"),
        F.when(F.col("from_no").isNotNull(), source).alias("matched_from"),
    )


def build_analyses(sequenced: DataFrame, runs: DataFrame, signals: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One analysis per AOI."""
    seen = sequenced.groupBy("aoi_id").agg(
        F.count(F.lit(1)).alias("observation_count"),
        history.elapsed_days(F.min("ts"), F.max("ts")).alias("temporal_span_days"),
    )
    evaluated = runs.groupBy("aoi_id").agg(
        F.count(F.lit(1)).alias("detector_run_count"), F.avg("quality_support").alias("quality_support")
    )
    states = signals.groupBy("aoi_id").agg(
        F.count(F.lit(1)).alias("signals"),
        *[F.count_if(F.col("state") == s).alias(s) for s in SIGNAL_STATES],
        F.count_if(F.col("season") == "seasonal_compatible").alias("seasonal"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint")
    joined = seen.join(evaluated, "aoi_id", "left").join(states, "aoi_id", "left")
    observations = F.col("observation_count")
    return joined.select(
        F.col("aoi_id").alias("analysis_id"),
        "aoi_id",
        F.lit(policy.iou_threshold).alias("iou_threshold"),
        zero("detector_run_count").alias("detector_run_count"),
        "observation_count",
        "temporal_span_days",
        observations.alias("usable_observation_count"),
        zero("detector_run_count").alias("usable_interval_count"),
        F.coalesce("quality_support", F.lit(0.0)).alias("quality_support"),
        F.lit(QUALITY_AGGREGATION).alias("quality_aggregation_method"),
        history.analysis_state(
            observations, zero("persistent"), zero("recurrent"), zero("transient"), zero("signals")
        ).alias("state"),
        F.when((observations < 4) | (zero("signals") == 0), "insufficient_temporal_evidence")
        .when(zero("seasonal") > 0, "seasonal_compatible")
        .otherwise("less_seasonal_compatible").alias("season"),
    )


def state_counts(signals: DataFrame) -> DataFrame:
    """Signals per state and analysis."""
    return signals.groupBy("analysis_id").agg(
        *[F.count_if(F.col("state") == s).alias(f"{s}_count") for s in SIGNAL_STATES]
    )
