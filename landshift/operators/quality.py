"""Scene screening and quality assessment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landshift.config import MASKING_METHOD, PROCESSING_VERSION, Policy
from landshift.functions import history, spectral
from landshift.operators.skew import join_headers

KEYS = ["aoi_id", "acq_id"]
CLASSES = ("invalid", "cloud", "shadow", "usable")


def _finish(counts: DataFrame, scenes: DataFrame, policy: Policy) -> DataFrame:
    """Counts per scene become percentages, a state and a reason.

    The denominator is the whole crop rectangle: pixels without a row are invalid.
    """
    total = (F.col("grid.width") * F.col("grid.height")).cast("bigint")
    joined = scenes.join(counts, KEYS, "left").withColumn("total_pixels", total)
    for name in ("cloud", "shadow", "usable"):
        joined = joined.withColumn(f"{name}_pixels", F.coalesce(f"{name}_pixels", F.lit(0)).cast("bigint"))
    joined = joined.withColumn(
        "invalid_pixels",
        F.col("total_pixels") - F.col("cloud_pixels") - F.col("shadow_pixels") - F.col("usable_pixels"),
    )
    for name in CLASSES:
        joined = joined.withColumn(
            f"{name}_percentage", spectral.percentage6(F.col(f"{name}_pixels"), F.col("total_pixels"))
        )
    usable, minimum = F.col("usable_pixels"), policy.min_usable_fraction
    return joined.withColumn(
        "state", history.quality_state(usable, F.col("total_pixels"), minimum)
    ).withColumn("reason", history.quality_reason(usable, F.col("total_pixels"), minimum))


def _count_classes(pixels: DataFrame, klass) -> DataFrame:
    return pixels.groupBy(*KEYS).agg(
        F.count_if(klass == "cloud").alias("cloud_pixels"),
        F.count_if(klass == "shadow").alias("shadow_pixels"),
        F.count_if(klass == "valid").alias("usable_pixels"),
    )


def screen_scenes(pixels: DataFrame, scenes: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Cheap upper bound from the class band alone; only ``scl`` is read.

    ``passed`` says whether the scene can still reach the usable share.
    """
    counts = _count_classes(pixels, spectral.scl_class(F.col("scl")))
    screened = _finish(counts, scenes, policy)
    return screened.withColumn("passed", F.col("state") == "usable")


def assess_scenes(pixels: DataFrame, scenes: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Full assessment: a pixel counts only if its bands are valid as well."""
    klass = F.when(
        spectral.bands_valid(F.col("red"), F.col("nir")), spectral.scl_class(F.col("scl"))
    ).otherwise("invalid")
    assessed = _finish(_count_classes(pixels, klass), scenes, policy)
    return assessed.withColumn("processing_version", F.lit(PROCESSING_VERSION)).withColumn(
        "masking_method", F.lit(MASKING_METHOD)
    )


def best_observation(acquisitions: DataFrame) -> DataFrame:
    """Best usable scene per AOI: clearest first, then earliest, then item id."""
    order = [
        F.coalesce("usable_percentage", F.lit(0.0)).desc(),
        F.coalesce("cloud_percentage", F.lit(100.0)).asc(),
        F.coalesce("shadow_percentage", F.lit(100.0)).asc(),
        F.col("ts").asc(),
        F.col("item_id").asc(),
    ]
    # One row per scene of an AOI: the window group is bounded by the catalog.
    window = Window.partitionBy("aoi_id").orderBy(*order)
    return (
        acquisitions.where(F.col("state") == "usable")
        .withColumn("_n", F.row_number().over(window))
        .where("_n = 1")
        .drop("_n")
    )


def resample_nearest(target: DataFrame, source: DataFrame, grids: DataFrame) -> DataFrame:
    """Class band on the grid of the bands by nearest neighbour.

    ``target`` has (aoi_id, acq_id, row, col), ``source`` the coarse class pixels and
    ``grids`` both headers per scene. The source cell of a target pixel centre is
    computed, so the join is an equi-join on the pixel key.
    """
    t, s = F.col("target_grid.transform"), F.col("source_grid.transform")
    x = t[2] + (F.col("col") + 0.5) * t[0]
    y = t[5] + (F.col("row") + 0.5) * t[4]
    keyed = join_headers(target, grids).select(
        *KEYS,
        "row",
        "col",
        F.floor((y - s[5]) / s[4]).cast("int").alias("source_row"),
        F.floor((x - s[2]) / s[0]).cast("int").alias("source_col"),
    )
    cells = source.select(
        *KEYS, F.col("row").alias("source_row"), F.col("col").alias("source_col"), "scl"
    )
    return keyed.join(cells, [*KEYS, "source_row", "source_col"], "left").select(
        *KEYS, "row", "col", F.coalesce("scl", F.lit(0)).alias("scl")
    )


def attach_classes(bands: DataFrame, classes: DataFrame) -> DataFrame:
    """Class band joined to band pixels; missing classes are 0."""
    key = [*KEYS, "row", "col"]
    return bands.join(classes.select(*key, "scl"), key, "left").withColumn(
        "scl", F.coalesce("scl", F.lit(0))
    )
