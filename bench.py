"""Headline queries on one local session; prints one JSON line.

Queries run in the order of the analysis chain. The first query that needs a stage
computes it and later ones read it, so the total is one full analysis, from band pixels
to exported evidence, plus the listed reports.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landshift.config import Policy
from landshift.operators.change import change_tiles
from landshift.operators.components import components, label_tiles
from landshift.operators.polygons import polygonize
from landshift.plans.chain import forget_chains
from landshift.plans.queries import QUERIES
from landshift.session import build_session, materialize

HEADLINE = [
    "src_pixels", "agg_scl_screen", "agg_scene_quality", "job_acquire", "job_detect", "cc_regions",
    "agg_run_stats", "join_region_overlap", "track_regions", "polygonize", "job_temporal", "job_triage",
    "join_candidate_review", "job_evidence", "job_provenance_audit", "job_export", "job_constraints",
    "agg_percentile_stretch", "prj_display", "prj_ndvi_preview", "sort_catalog", "stream_review_upsert",
]


def _mask(spark: SparkSession, side: int, keep, policy: Policy) -> DataFrame:
    """Tiles of a synthetic change mask, as detection would hand them over."""
    n = spark.range(side * side)
    row, col = F.floor(F.col("id") / side).cast("int"), F.pmod("id", F.lit(side)).cast("int")
    pixels = n.select(row.alias("row"), col.alias("col")).where(keep(F.col("row"), F.col("col"))).select(
        F.lit(1).cast("bigint").alias("aoi_id"), F.lit(0).alias("k"),
        F.floor(F.col("row") / policy.tile).cast("int").alias("tile_row"),
        F.floor(F.col("col") / policy.tile).cast("int").alias("tile_col"),
        "row", "col", F.lit(True).alias("valid"), F.lit(False).alias("cloud"), F.lit(False).alias("shadow"),
        F.lit(0.5).cast("float").alias("signal"),
    )
    return change_tiles(pixels, policy)


def full_mask(spark: SparkSession) -> DataFrame:
    """Published ceiling: label a full 4096 x 4096 mask in 15 s."""
    policy = Policy()
    tiles = materialize(label_tiles(_mask(spark, 4096, lambda r, c: F.lit(True), policy), policy), "bench-tiles")
    return components(tiles, policy).groupBy("region_key").count()


def many_components(spark: SparkSession) -> DataFrame:
    """Published ceiling: polygons of 4,096 components on a 512 x 512 mask in 5 s."""
    policy = Policy()
    block = lambda r, c: (F.pmod(r, F.lit(8)) < 4) & (F.pmod(c, F.lit(8)) < 4)
    tiles = materialize(label_tiles(_mask(spark, 512, block, policy), policy), "bench-tiles")
    pixels = components(tiles, policy).withColumn("region_no", F.col("region_key")).withColumn("pixel_count", F.lit(16))
    return polygonize(pixels)


CEILINGS = {"label_4096x4096_full_mask": full_mask, "polygonise_512x512_4096_components": many_components}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cores, "bench")
    # Start the JVM's and the Python workers' code paths before the clock runs.
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    forget_chains()
    timings = {}
    started = time.perf_counter()
    for name in HEADLINE:
        begun = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - begun, 3)
    total = round(time.perf_counter() - started, 3)
    ceilings = {}
    for name, build in CEILINGS.items():
        begun = time.perf_counter()
        build(spark).write.format("noop").mode("overwrite").save()
        ceilings[name] = round(time.perf_counter() - begun, 3)
    print(json.dumps({
        "metric": "change analysis from pixels to evidence, total wall time",
        "value": total,
        "unit": "sec",
        "queries": timings,
        "ceilings": ceilings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
