"""Change regions and detection runs built from labelled tiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.config import DETECTOR_VERSION, PROCESSING_VERSION, Policy
from landshift.functions import spectral
from landshift.operators import change, reuse
from landshift.operators.components import (
    SCOPE, connect_fragments, explode_pixels, key_col, key_row, label_tiles, with_region_key,
)
from landshift.operators.skew import join_headers, number_buckets
from landshift.session import materialize
from landshift.sources.pixel_store import within_scenes

# Rows of the grid per numbering slice: bounds a slice whatever the region count.
NUMBER_BAND = 64


@dataclass(frozen=True)
class Detection:
    """Result tables of one detection job."""

    intervals: DataFrame
    tiles: DataFrame
    fragments: DataFrame
    regions: DataFrame
    runs: DataFrame
    # Intervals that must not be compared (aoi_id, k, before_acq, after_acq, rule); in no run.
    violations: DataFrame
    # Region pixels of reused intervals, as ``region_pixels`` gives them.
    reused_pixels: DataFrame | None = None

    def region_pixels(self) -> DataFrame:
        """Pixels of the kept regions. The join key is a tile fragment, hence bounded."""
        kept = self.fragments.select(*SCOPE, "label", "region_key", "region_no", "pixel_count")
        made = explode_pixels(self.tiles).join(kept, [*SCOPE, "label"]).drop("label")
        return made if self.reused_pixels is None else made.unionByName(self.reused_pixels.select(*made.columns))

    def region_areas(self) -> DataFrame:
        """Equal-area size of every kept region, summed over its pixels."""
        return self.region_pixels().groupBy(*SCOPE, "region_no").agg(F.sum("area").alias("area_m2"))

    def track_pixels(self, tracks: DataFrame) -> DataFrame:
        """Distinct pixels of each track: the union of its regions."""
        born = self.fragments.join(tracks, [*SCOPE, "region_no"]).select(
            *SCOPE, "label", "birth_k", "birth_no"
        )
        columns = ["aoi_id", "birth_k", "birth_no", "row", "col"]
        pixels = explode_pixels(self.tiles).join(born, [*SCOPE, "label"]).select(*columns)
        if self.reused_pixels is not None:
            salted = self.reused_pixels.select(*SCOPE, "region_no", "row", "col")
            pixels = pixels.unionByName(join_headers(salted, tracks.select(*SCOPE, "region_no", *columns[1:3]), (*SCOPE, "region_no")).select(*columns))
        return pixels.distinct()


@dataclass(frozen=True)
class Store:
    """Detection results of earlier jobs, by the scenes they compare and not by interval numbers."""

    runs: DataFrame
    regions: DataFrame
    pixels: DataFrame


PAIR = ["aoi_id", "before_acq", "after_acq"]


def to_store(found: Detection) -> Store:
    """What a later job needs to reuse the intervals of this one."""
    ends = found.runs.select(*SCOPE, "before_acq", "after_acq")
    by_pair = lambda rows: rows.join(ends, SCOPE).drop("k", "run_id", "region_id")
    return Store(found.runs.drop("k"), by_pair(found.regions), by_pair(found.region_pixels()))


def fragment_stats(pixels: DataFrame) -> DataFrame:
    """Statistics per tile fragment; the first stage of the region aggregate."""
    signal = F.col("signal").cast("double")
    return pixels.groupBy(*SCOPE, "label").agg(
        F.count(F.lit(1)).alias("pixels"),
        F.sum(signal).alias("signal_sum"),
        F.max(signal).alias("signal_max"),
        F.sum("area").alias("area"),
    )


def region_stats(fragments: DataFrame) -> DataFrame:
    """Size, area and signal per component.

    Areas are summed as decimals, so that the order of the fragments changes no digit.
    """
    return fragments.groupBy(*SCOPE, "region_key").agg(
        F.sum("pixels").alias("pixel_count"),
        F.sum(F.col("area").cast("decimal(28,9)")).cast("double").alias("area_m2"),
        (F.sum("signal_sum") / F.sum("pixels")).alias("mean_change_signal"),
        F.max("signal_max").alias("max_change_signal"),
    )


def keep_regions(regions: DataFrame, policy: Policy) -> DataFrame:
    """Components with enough pixels, numbered 1..k in raster order per run."""
    kept = regions.where(F.col("pixel_count") >= policy.min_region_pixels).withColumn(
        "_band", F.floor(key_row(F.col("region_key")) / NUMBER_BAND)
    )
    numbered = number_buckets(kept, SCOPE, ["_band"], ["region_key"], "region_no").drop("_band")
    run = change.run_id(F.col("aoi_id"), F.col("k"))
    return numbered.select(
        *SCOPE,
        run.alias("run_id"),
        "region_no",
        change.region_id(run, F.col("region_no")).alias("region_id"),
        "region_key",
        key_row(F.col("region_key")).alias("first_row"),
        key_col(F.col("region_key")).alias("first_col"),
        "pixel_count",
        "area_m2",
        "mean_change_signal",
        "max_change_signal",
    )


def run_exclusions(tiles: DataFrame, intervals: DataFrame, sizes: DataFrame) -> DataFrame:
    """Valid and excluded pixel counters over the whole grid of each interval."""
    counters = tiles.groupBy(*SCOPE).agg(
        F.sum("valid_pixels").alias("valid_pixels"),
        F.sum("cloud_pixels").alias("cloud_pixels"),
        F.sum("shadow_pixels").alias("shadow_pixels"),
        F.sum("raw_changed_pixels").alias("raw_changed_pixels"),
        F.sum("signal_sum").alias("signal_sum"),
        F.max("signal_max").alias("signal_max"),
    )
    joined = intervals.join(sizes, SCOPE).join(counters, SCOPE, "left")
    count = lambda name: F.coalesce(name, F.lit(0)).cast("bigint")
    raw, valid = count("raw_changed_pixels"), count("valid_pixels")
    return joined.select(
        *intervals.columns,
        valid.alias("quality_valid_pixel_count"),
        (F.col("grid_pixels") - valid).cast("bigint").alias("excluded_pixel_count"),
        count("cloud_pixels").alias("excluded_cloud_pixel_count"),
        count("shadow_pixels").alias("excluded_shadow_pixel_count"),
        raw.alias("raw_changed_pixel_count"),
        spectral.percentage6(raw, valid).alias("changed_pixel_percentage"),
        F.coalesce(F.try_divide("signal_sum", "raw_changed_pixels"), F.lit(0.0)).alias("mean_change_signal"),
        F.coalesce("signal_max", F.lit(0.0)).alias("max_change_signal"),
    )


def run_stats(exclusions: DataFrame, regions: DataFrame, policy: Policy) -> DataFrame:
    """Detection runs: counters joined with the statistics of their kept regions.

    The median is exact; its buffer holds one entry per distinct region area.
    """
    areas = regions.groupBy(*SCOPE).agg(
        F.count(F.lit(1)).alias("region_count"),
        F.sum("pixel_count").alias("filtered_changed_pixel_count"),
        F.sum("area_m2").alias("total_changed_area_m2"),
        F.max("area_m2").alias("largest_region_area_m2"),
        F.avg("area_m2").alias("mean_region_area_m2"),
        F.percentile("area_m2", F.lit(0.5)).alias("median_region_area_m2"),
    )
    joined = exclusions.join(areas, SCOPE, "left")
    for name in ("region_count", "filtered_changed_pixel_count"):
        joined = joined.withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))
    for name in (
        "total_changed_area_m2", "largest_region_area_m2", "mean_region_area_m2", "median_region_area_m2",
    ):
        joined = joined.withColumn(name, F.coalesce(name, F.lit(0.0)))
    return (
        joined.withColumn("detector_version", F.lit(DETECTOR_VERSION))
        .withColumn("quality_processing_version", F.lit(PROCESSING_VERSION))
        .withColumn("quality_mask_used", F.lit(True))
        .withColumn("threshold", F.lit(policy.threshold))
        .withColumn("min_region_pixels", F.lit(policy.min_region_pixels))
    )


def detect(
    pixels: DataFrame,
    acquisitions: DataFrame,
    policy: Policy = Policy(),
    equal_area: bool = True,
    aois: DataFrame | None = None,
    store: Store | None = None,
) -> Detection:
    """Change regions and runs for all neighbouring observations of all AOIs.

    Intervals whose headers forbid a comparison, and those without one usable pixel in
    common, are told as violations and give neither runs nor regions.

    With a ``store``, only intervals without a reusable run in it are detected, and only pixels of
    scenes at their ends are read. Stored runs and regions take the numbers that their intervals have
    today, so the result is that of a full detection.
    """
    optional = [c for c in ("processing_version", "mask_grid") if c in acquisitions.columns]
    ordered = change.sequence(change.eligible(acquisitions)).select(
        "aoi_id", "acq_id", "ts", "seq", "usable_percentage", "grid", *optional
    )
    checked = materialize(change.comparisons(ordered, aois, policy), "intervals")
    refused = checked.where(F.col("rule").isNotNull())
    allowed = checked.where(F.col("rule").isNull()).drop("rule")
    pairs, reused = allowed, None
    if store is not None:
        known = reuse.reusable_runs(store.runs, acquisitions, policy).select(*PAIR)
        reused = materialize(allowed.join(known, PAIR, "left_semi"), "reused-intervals")
        pairs = allowed.join(known, PAIR, "left_anti")
        ends = pairs.select("aoi_id", F.explode(F.array("before_acq", "after_acq")).alias("acq_id")).distinct()
        pixels = within_scenes(pixels, ends)
    opened = pairs.select("aoi_id", F.col("k").alias("seq"), F.lit(True).alias("opens"))
    sequenced = materialize(
        ordered.join(opened, ["aoi_id", "seq"], "left").withColumn("opens", F.coalesce("opens", F.lit(False))), "sequence"
    )
    # The scene that opens an interval has its grid.
    headers = sequenced.where("opens").select("aoi_id", F.col("seq").alias("k"), "grid")
    tiles = materialize(
        label_tiles(change.change_tiles(change.pixel_pairs(pixels, sequenced, policy), policy), policy, headers if equal_area else None),
        "tiles",
    )
    stars = connect_fragments(tiles, policy)
    fragments = materialize(with_region_key(fragment_stats(explode_pixels(tiles)), stars), "fragments")
    regions = materialize(keep_regions(region_stats(fragments), policy), "regions")
    kept = fragments.join(
        regions.select(*SCOPE, "region_key", "region_no", "pixel_count"), [*SCOPE, "region_key"]
    )
    sizes = headers.select(*SCOPE, (F.col("grid.width") * F.col("grid.height")).cast("bigint").alias("grid_pixels"))
    runs = materialize(run_stats(run_exclusions(tiles, pairs, sizes), regions, policy), "runs")
    told = ["aoi_id", "k", "before_acq", "after_acq"]
    violations = refused.select(*told, "rule").unionByName(
        missing_comparisons(runs).select(*told, F.lit("no usable pixel").alias("rule"))
    )
    compared = runs.where(F.col("quality_valid_pixel_count") > 0)
    if reused is None:
        return Detection(pairs, tiles, kept, regions, compared, violations)
    today = reused.select(*PAIR, "k", "run_id")
    figures = [c for c in compared.columns if c not in allowed.columns]
    old_runs = reused.join(store.runs.select(*PAIR, *figures), PAIR).select(*compared.columns)
    numbered = store.regions.join(today, PAIR).withColumn("region_id", change.region_id(F.col("run_id"), F.col("region_no")))
    old_pixels = materialize(join_headers(store.pixels, today.drop("run_id"), tuple(PAIR)).drop("before_acq", "after_acq"), "reused-pixels")
    return Detection(
        allowed, tiles, kept, materialize(regions.unionByName(numbered.select(*regions.columns)), "all-regions"),
        materialize(compared.unionByName(old_runs), "all-runs"), violations, old_pixels,
    )


def missing_comparisons(runs: DataFrame) -> DataFrame:
    """Intervals without a single usable comparison pixel."""
    return runs.where(F.col("quality_valid_pixel_count") == 0)
