"""Observation sequences, intervals and pixel change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landshift.config import Policy
from landshift.functions import geometry, grids, history, spectral
from landshift.operators.skew import join_headers
from landshift.sources.pixel_store import join_scenes, on_tiles

# Ids carry their parents, so they are stable across runs: a run id holds the AOI and
# the interval, a region id the run and the region number. A part that does not fit its
# bits stops the job; it never runs into its neighbour.
AOI_BITS, INTERVAL_BITS, REGION_BITS = 26, 12, 25


def _fits(value, bits: int, what: str):
    value = value.cast("bigint")
    return F.when(value.between(0, (1 << bits) - 1), value).when(
        value.isNotNull(), F.raise_error(F.concat(F.lit(f"{what} does not fit {bits} bits: "), value.cast("string")))
    )


def run_id(aoi, k):
    return F.shiftleft(_fits(aoi, AOI_BITS, "AOI id"), INTERVAL_BITS) + _fits(k, INTERVAL_BITS, "interval number")


def region_id(run, number):
    return F.shiftleft(run.cast("bigint"), REGION_BITS) + _fits(number, REGION_BITS, "region number")


def eligible(acquisitions: DataFrame, start=None, end=None) -> DataFrame:
    """Usable observations with a positive usable share inside inclusive dates."""
    rows = acquisitions.where((F.col("state") == "usable") & (F.col("usable_percentage") > 0))
    if start is not None:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    return rows


def sequence(acquisitions: DataFrame) -> DataFrame:
    """0-based order of the observations of an AOI by time, then id."""
    window = Window.partitionBy("aoi_id").orderBy("ts", "acq_id")
    return acquisitions.withColumn("seq", (F.row_number().over(window) - 1).cast("int"))


def intervals(sequenced: DataFrame) -> DataFrame:
    """Neighbouring observations; N observations give N-1 rows."""
    window = Window.partitionBy("aoi_id").orderBy("seq")
    following = F.lead(F.struct("acq_id", "ts", "usable_percentage")).over(window)
    return (
        sequenced.withColumn("_next", following)
        .where(F.col("_next").isNotNull())
        .select(
            "aoi_id",
            F.col("seq").alias("k"),
            F.col("acq_id").alias("before_acq"),
            F.col("_next.acq_id").alias("after_acq"),
            F.col("ts").alias("before_ts"),
            F.col("_next.ts").alias("after_ts"),
            (F.least("usable_percentage", "_next.usable_percentage") / 100.0).alias("quality_support"),
            history.elapsed_days(F.col("ts"), F.col("_next.ts")).alias("elapsed_days"),
            run_id(F.col("aoi_id"), F.col("seq")).alias("run_id"),
        )
    )


def comparisons(sequenced: DataFrame, aois: DataFrame | None = None, policy: Policy = Policy()) -> DataFrame:
    """Intervals with the first rule that forbids comparing their scenes (``rule``, NULL if none).

    Headers decide: strictly increasing time, one processing version, grids that match,
    class masks (column ``mask_grid``, if there is one) that fit their bands, and, if AOIs
    are given, grids that cover them.
    """
    has = set(sequenced.columns)
    facts = sequenced.withColumns({
        "_version": F.col("processing_version") if "processing_version" in has else F.lit(None).cast("string"),
        "_mask": grids.mask_alignment(F.col("mask_grid"), F.col("grid")) if "mask_grid" in has else F.lit("aligned"),
        "_covers": F.lit(True),
    })
    if aois is not None:
        shape = aois.select("aoi_id", F.col("rings").alias("_rings"))
        box = geometry.bounds(geometry.project_rings(F.col("_rings"), F.col("grid.crs")))
        facts = facts.join(shape, "aoi_id", "left").withColumn(
            "_covers", F.coalesce(grids.covers_bounds(F.col("grid.bounds"), box, policy.coverage_epsilon), F.lit(False))
        ).drop("_rings")
    checked = ("ts", "grid", "_version", "_mask", "_covers")
    window = Window.partitionBy("aoi_id").orderBy("seq")
    facts = facts.withColumn("_after", F.lead(F.struct(*checked)).over(window)).where(F.col("_after").isNotNull())
    after = F.col("_after")
    grid_rule = grids.compatibility(F.col("grid"), after["grid"])
    rule = (
        F.when(F.col("ts") >= after["ts"], "time order")
        .when(~F.col("_version").eqNullSafe(after["_version"]), "processing version")
        .when(grid_rule != "compatible", F.concat(F.lit("grid: "), grid_rule))
        .when(F.col("_mask") != "aligned", F.concat(F.lit("mask: "), F.col("_mask")))
        .when(after["_mask"] != "aligned", F.concat(F.lit("mask: "), after["_mask"]))
        .when(~F.col("_covers") | ~after["_covers"], "coverage")
    )
    verdict = facts.select("aoi_id", F.col("seq").alias("k"), rule.alias("rule"))
    return intervals(sequenced).join(verdict, ["aoi_id", "k"])


def order_violations(acquisitions: DataFrame) -> DataFrame:
    """Observations whose timestamp does not increase strictly within their AOI."""
    window = Window.partitionBy("aoi_id").orderBy("ts", "acq_id")
    return acquisitions.withColumn("previous_ts", F.lag("ts").over(window)).where(
        F.col("previous_ts") >= F.col("ts")
    )


def request_checks(requests: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """Requested id sets (request_id, acq_id) checked for missing ids, equal
    timestamps and mixed AOIs."""
    known = acquisitions.select("acq_id", "aoi_id", "ts")
    return (
        requests.distinct()
        .join(known, "acq_id", "left")
        .groupBy("request_id")
        .agg(
            F.count(F.lit(1)).alias("requested"),
            F.count("aoi_id").alias("found"),
            F.countDistinct("ts").alias("timestamps"),
            F.countDistinct("aoi_id").alias("aois"),
        )
        .withColumn(
            "verdict",
            F.when(F.col("found") == 0, "no observations")
            .when(F.col("found") < F.col("requested"), "missing observations")
            .when(F.col("timestamps") < F.col("found"), "shared timestamp")
            .when(F.col("aois") > 1, "mixed AOIs")
            .otherwise("valid"),
        )
    )


def pixel_pairs(pixels: DataFrame, sequenced: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Band-valid pixels present in both observations of an interval.

    Where ``sequenced`` has a column ``opens``, only intervals that an observation opens count.

    A window over the pixel replaces the before/after self-join. Rows are partitioned
    by AOI tile, which also serves the window and every per-tile aggregate behind it,
    so the pixel table is shuffled once and one large AOI spreads over many tasks. Pixels of a
    clustered table (``pixel_store``, with the tiles of the policy) lie so already and are not shuffled.
    """
    clustered = "tile_row" in pixels.columns
    opens = F.col("opens") if "opens" in sequenced.columns else F.lit(True)
    observed = sequenced.select("aoi_id", "acq_id", "seq", opens.alias("opens"))
    side = policy.tile
    if clustered:
        joined = join_scenes(pixels.where(on_tiles(side)), observed)
    else:
        joined = join_headers(pixels, observed)
    place = {c: F.col(c) if clustered else F.floor(F.col(n) / side).cast("int") for c, n in (("tile_row", "row"), ("tile_col", "col"))}
    compact = (
        joined
        .where(spectral.bands_valid(F.col("red"), F.col("nir")))
        .select(
            "aoi_id",
            *[value.alias(name) for name, value in place.items()],
            "row",
            "col",
            "seq",
            "opens",
            spectral.ndvi(F.col("red"), F.col("nir")).alias("ndvi"),
            spectral.scl_code(F.col("scl")).alias("code"),
        )
    )
    tile = ["aoi_id", "tile_row", "tile_col"]
    window = Window.partitionBy(*tile, "row", "col").orderBy("seq")
    paired = (
        (compact if clustered else compact.repartition(*tile))
        .withColumn("_next", F.lead(F.struct("seq", "ndvi", "code")).over(window))
        .where(F.col("opens") & (F.col("_next.seq") == F.col("seq") + 1))
    )
    flags = spectral.comparison_flags(F.col("code"), F.col("_next.code"))
    return paired.select(
        *tile,
        F.col("seq").alias("k"),
        "row",
        "col",
        flags["valid"].alias("valid"),
        flags["cloud"].alias("cloud"),
        flags["shadow"].alias("shadow"),
        spectral.abs_delta(F.col("ndvi"), F.col("_next.ndvi"), flags["valid"]).alias("signal"),
    )


def is_changed(threshold: float):
    """Inclusive, and compared in single precision like the signal itself."""
    return F.col("valid") & (F.col("signal") >= F.lit(threshold).cast("float"))


def change_tiles(pairs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Counters and changed pixels per (interval, tile).

    The arrays hold at most ``tile * tile`` entries, in no order. Grouping extends the partitioning
    of the pairs, so this adds no shuffle.
    """
    changed = is_changed(policy.threshold)
    signal = F.col("signal").cast("double")
    return pairs.groupBy("aoi_id", "tile_row", "tile_col", "k").agg(
        F.count_if("valid").alias("valid_pixels"),
        F.count_if("cloud").alias("cloud_pixels"),
        F.count_if("shadow").alias("shadow_pixels"),
        F.count_if(changed).alias("raw_changed_pixels"),
        F.coalesce(F.sum(F.when(changed, signal)), F.lit(0.0)).alias("signal_sum"),
        F.coalesce(F.max(F.when(changed, signal)), F.lit(0.0)).alias("signal_max"),
        F.collect_list(F.when(changed, F.struct("row", "col", "signal"))).alias("changed"),
    )
