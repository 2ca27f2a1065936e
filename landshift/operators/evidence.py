"""Evidence of candidates: intervals, observations, limits and export snapshots.

Lists inside an evidence row are as long as the candidate's track, never longer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.config import BAND_NAMES, DISPLAY_VERSION, EXPORT_VERSION
from landshift.functions import geometry, grids, limits

RUN_FIGURES = (
    "detector_version", "threshold", "min_region_pixels", "region_count", "quality_mask_used",
    "quality_processing_version", "quality_valid_pixel_count", "excluded_pixel_count",
    "excluded_cloud_pixel_count", "excluded_shadow_pixel_count", "raw_changed_pixel_count",
    "filtered_changed_pixel_count", "changed_pixel_percentage", "total_changed_area_m2",
    "largest_region_area_m2", "mean_region_area_m2", "median_region_area_m2",
    "mean_change_signal", "max_change_signal",
)


def evidence_intervals(candidates: DataFrame, runs: DataFrame, regions: DataFrame) -> DataFrame:
    """One row per candidate and run, with the candidate's own regions of that run."""
    run_refs = candidates.select("candidate_id", F.explode("detection_run_ids").alias("run_id"))
    region_refs = candidates.select("candidate_id", F.explode("source_region_ids").alias("region_id"))
    fields = ("region_id", "region_no", "pixel_count", "area_m2", "mean_change_signal", "max_change_signal")
    chosen = (
        region_refs.join(regions.select("run_id", *fields), "region_id")
        .groupBy("candidate_id", "run_id")
        .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("regions"))
    )
    figures = runs.select("run_id", "before_acq", "after_acq", *RUN_FIGURES)
    return run_refs.join(figures, "run_id").join(chosen, ["candidate_id", "run_id"], "left").withColumn(
        "regions", F.coalesce("regions", F.array().cast(chosen.schema["regions"].dataType))
    )


def evidence_observations(candidates: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """One row per candidate and acquisition.

    Shares are percentages over 100; mask and display count as available when their
    tables have the scene (``has_mask``, ``has_display``). Cloud cover and tile are those of the catalog.
    """
    refs = candidates.select("candidate_id", F.explode("acquisition_ids").alias("acq_id"))
    share = lambda name: (F.col(f"{name}_percentage") / 100.0).alias(f"{name}_fraction")
    display = F.col("has_display") & (F.col("visualization_version") == DISPLAY_VERSION)
    facts = acquisitions.select(
        "acq_id", "aoi_id", "item_id", "collection", "ts", "state", "reason", "grid", "processing_version",
        "masking_method", "visualization_version", share("usable"), share("cloud"), share("shadow"),
        share("invalid"), F.col("has_mask").alias("mask_available"),
        F.coalesce(display, F.lit(False)).alias("display_available"), "cloud_cover", "mgrs_tile",
        F.array(*map(F.lit, BAND_NAMES)).alias("bands"),
    )
    return refs.join(facts, "acq_id").withColumn(
        "limits",
        limits.observation_limits(
            F.col("acq_id"), F.col("state"), F.col("reason"), F.col("processing_version"),
            F.col("mask_available"), F.col("display_available"),
        ),
    )


def assemble(candidates: DataFrame, intervals: DataFrame, observations: DataFrame) -> DataFrame:
    """Evidence record per candidate: intervals, observations, alignment, limits."""
    by_run = intervals.groupBy("candidate_id").agg(
        F.array_sort(F.collect_list(F.struct("run_id", "before_acq", "after_acq", *RUN_FIGURES, "regions"))).alias("intervals")
    )
    fields = [c for c in observations.columns if c != "candidate_id"]
    by_scene = observations.groupBy("candidate_id").agg(
        F.array_sort(F.collect_list(F.struct("acq_id", *[c for c in fields if c != "acq_id"]))).alias("observations")
    )
    joined = candidates.join(by_run, "candidate_id").join(by_scene, "candidate_id")
    first = F.col("intervals")[0]
    scene = lambda acq: F.filter("observations", lambda o: o["acq_id"] == acq)[0]
    joined = joined.withColumns({
        "primary_run": first, "before": scene(first["before_acq"]), "after": scene(first["after_acq"]),
    })
    reasons = F.concat(
        F.flatten(F.transform("observations", lambda o: o["limits"])), limits.signal_limits(F.col("quality_support"))
    )
    details = grids.alignment(F.col("before.grid"), F.col("after.grid"))
    return joined.withColumns({
        "quality_limits": reasons,
        "is_quality_limited": F.size(reasons) > 0,
        "alignment": details,
        "is_spatially_aligned": details["aligned"],
    })


def pixel_centroids(track_pixels: DataFrame, grids_by_aoi: DataFrame) -> DataFrame:
    """Longitude and latitude of the centroid of each track's pixel set."""
    t = F.col("grid.transform")
    middle = track_pixels.groupBy("aoi_id", "birth_k", "birth_no").agg(
        F.avg(F.col("row") + 0.5).alias("row"), F.avg(F.col("col") + 0.5).alias("col")
    )
    return middle.join(grids_by_aoi, "aoi_id").select(
        "aoi_id", "birth_k", "birth_no",
        geometry.from_utm(t[2] + F.col("col") * t[0], t[5] + F.col("row") * t[4], F.col("grid.crs")).alias("centroid"),
    )


def snapshots(evidence: DataFrame, reviews: DataFrame, centroids: DataFrame) -> DataFrame:
    """Portable investigation snapshots as sorted-key JSON, without any file path.

    The candidate's outline (column ``geometry``) becomes GeoJSON.
    """
    reviewed = evidence.join(
        reviews.select("candidate_id", "decision", "note", "created_at", "updated_at"), "candidate_id", "left"
    ).join(centroids, ["aoi_id", "birth_k", "birth_no"], "left")
    run = F.col("primary_run")
    observation = lambda o: F.struct(
        o["ts"].alias("acquisition_datetime"), o["acq_id"].alias("acquisition_id"), o["aoi_id"].alias("aoi_id"),
        o["bands"].alias("bands"), o["cloud_cover"].alias("cloud_cover"),
        o["cloud_fraction"].alias("cloud_fraction"), o["collection"].alias("collection"),
        o["display_available"].alias("display_available"), o["invalid_fraction"].alias("invalid_fraction"),
        o["item_id"].alias("item_id"), o["masking_method"].alias("masking_method"), o["mgrs_tile"].alias("mgrs_tile"),
        o["state"].alias("observation_state"), o["mask_available"].alias("quality_mask_available"),
        o["processing_version"].alias("quality_processing_version"), o["reason"].alias("quality_reason"),
        o["shadow_fraction"].alias("shadow_fraction"), o["usable_fraction"].alias("usable_pixel_fraction"),
        o["visualization_version"].alias("visualization_version"),
    )
    summary = F.struct(*[run[c].alias(c) for c in sorted(RUN_FIGURES)])
    temporal = F.struct(
        F.col("first_change_ts").alias("first_change_datetime"), "interval_count",
        F.col("last_supporting_ts").alias("last_supporting_datetime"), "matched_region_coverage",
        "persistence_ratio", "quality_support", "recurrence_count", "state", "support_count",
        "temporal_consistency", "transient_interval_count",
    )
    fields = {
        "after_observation": observation(F.col("after")),
        "all_observations": F.transform("observations", observation),
        "analysis_id": F.col("analysis_id"),
        "analyst_review": F.struct(
            "created_at", F.coalesce("decision", F.lit("unreviewed")).alias("decision"), "note", "updated_at"
        ),
        "aoi_id": F.col("aoi_id"),
        "before_observation": observation(F.col("before")),
        "candidate_id": F.col("candidate_id"),
        "centroid": F.struct(F.col("centroid.y").alias("latitude"), F.col("centroid.x").alias("longitude")),
        "detection_summary": summary,
        "export_version": F.lit(EXPORT_VERSION),
        "geometry": F.parse_json(geometry.multi_geojson(F.col("geometry"))),
        "observation_quality": F.struct(
            "is_quality_limited", "quality_limits", F.col("alignment").alias("spatial_alignment")
        ),
        "priority": F.col("priority"),
        "provenance": F.struct(
            "acquisition_ids", F.col("primary_run.after_acq").alias("after_acquisition_id"),
            F.col("after.item_id").alias("after_item_id"),
            F.col("primary_run.before_acq").alias("before_acquisition_id"),
            F.col("before.item_id").alias("before_item_id"), F.col("before.grid.crs").alias("crs"),
            "detection_run_ids", F.col("primary_run.detector_version").alias("detector_version"),
            F.col("before.masking_method").alias("masking_method"),
            F.col("before.processing_version").alias("processing_version"),
            F.col("before.visualization_version").alias("visualization_version"),
        ),
        "rank": F.col("rank"),
        "score": F.col("score"),
        "severity": F.col("severity"),
        "signal_id": F.col("signal_id"),
        "system_explanation": F.col("explanation"),
        "temporal_evidence": temporal,
    }
    document = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return reviewed.select(
        "candidate_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("json")
    )
