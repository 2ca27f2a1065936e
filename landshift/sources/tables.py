"""Pixel, AOI and result tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from landshift.functions import geometry
from landshift.operators.skew import join_headers, latest_by, spread_rows
from landshift.schemas import AOI_GEOJSON
from landshift.session import materialize
from landshift.sources.pixel_store import join_scenes


def parse_aois(raw: DataFrame) -> DataFrame:
    """AOI rows (aoi_id, geometry_json) with rings; NULL rings where unreadable."""
    parsed = F.from_json("geometry_json", AOI_GEOJSON)
    rings = F.when(parsed["type"] == "Polygon", geometry.rings_from_coordinates(parsed["coordinates"]))
    return spread_rows(raw).withColumn("rings", rings)


def aoi_verdict(rings: Column, boundary: Column) -> Column:
    """Why an AOI is refused, or ``valid``. Touching the boundary is allowed.

    Boxes are told by their bounds: a box is valid, and a boundary that is one covers what its bounds do.
    """
    a, b = geometry.bounds(boundary), geometry.bounds(rings)
    around = (a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3])
    valid = F.when(geometry.is_box(rings), True).otherwise(geometry.is_valid(rings))
    covered = F.when(~around, False).when(geometry.is_box(boundary), True).otherwise(geometry.covers(boundary, rings))
    return (
        F.when(rings.isNull(), "malformed")
        .when(F.size(rings) == 0, "empty")
        .when(~valid, "invalid")
        .when(~covered, "outside boundary")
        .otherwise("valid")
    )


def valid_aois(raw: DataFrame, boundary: DataFrame) -> DataFrame:
    """AOI list without unreadable, invalid or foreign polygons. ``boundary`` is a scalar.

    Verdicts are written first: a filter on them would be moved below the parsing and parse once per mention.
    """
    verdict = aoi_verdict(F.col("rings"), F.col("boundary_rings"))
    told = parse_aois(raw).withColumn("boundary_rings", boundary.scalar()).withColumn("_verdict", verdict).drop("boundary_rings")
    return materialize(told, "aoi-verdicts").where("_verdict = 'valid'").drop("_verdict")


def with_inside(pixels: DataFrame, scenes: DataFrame, aois: DataFrame, tiles: DataFrame | None = None) -> DataFrame:
    """Adds ``inside``: whether a pixel's centre lies in the AOI polygon.

    Scene headers and AOI rings are one row per scene or AOI. Comparisons with the outer
    and an inner box decide for most pixels; only those between run the polygon test. Headers meet
    clustered pixels in their tiles, others on a salted key, so a scene may hold most pixels. Boxes and
    edges are told once per AOI, by all tasks. ``tiles`` are all tiles of clustered pixels, if they are known.
    """
    rings = F.col("_rings")
    shapes = materialize(
        scenes.select("aoi_id", F.col("grid.crs").alias("_crs")).distinct()
        .join(aois.select("aoi_id", "rings"), "aoi_id")
        .select("aoi_id", "_crs", geometry.project_rings(F.col("rings"), F.col("_crs")).alias("_rings")),
        "aoi-shapes",
    )
    boxed = materialize(
        spread_rows(shapes).select(
            "aoi_id", "_crs", geometry.all_segments(rings).alias("_edges"), geometry.bounds(rings).alias("_box"), geometry.inner_box(rings).alias("_core")
        ),
        "aoi-boxes",
    )
    header = scenes.select("aoi_id", "acq_id", F.col("grid.transform").alias("_t"), F.col("grid.crs").alias("_crs"))
    x = F.col("_t")[2] + (F.col("col") + 0.5) * F.col("_t")[0]
    y = F.col("_t")[5] + (F.col("row") + 0.5) * F.col("_t")[4]
    if "tile_row" in pixels.columns:
        # The scenes of an AOI share its edges.
        facts = [c for c in boxed.columns if c not in ("aoi_id", "_crs")]
        by_crs = boxed.where("_crs is not null").groupBy("aoi_id", "_crs").agg(F.collect_list(F.struct(*facts)).alias("_in_crs"))
        areas = by_crs.groupBy("aoi_id").agg(F.map_from_entries(F.collect_list(F.struct("_crs", "_in_crs"))).alias("_areas"))
        met = join_scenes(pixels, header, tiles, areas).withColumn("_area", F.explode(F.element_at("_areas", F.col("_crs"))))
        met = met.select(*pixels.columns, "_t", *[F.col(f"_area.{c}").alias(c) for c in facts])
    else:
        met = join_headers(pixels, header.join(boxed, ["aoi_id", "_crs"]).drop("_crs"))
    located = met.withColumns({"_x": x, "_y": y})
    x, y, box, core = F.col("_x"), F.col("_y"), F.col("_box"), F.col("_core")
    clearly = F.coalesce((x > core[0]) & (x < core[2]) & (y > core[1]) & (y < core[3]), F.lit(False))
    near = x.between(box[0], box[2]) & y.between(box[1], box[3])
    inside = F.when(~near, False).when(clearly, True).otherwise(geometry.crossed_oddly(F.col("_edges"), x, y))
    return located.withColumn("inside", inside).drop("_t", "_edges", "_box", "_core", "_x", "_y")


def clip_to_aoi(pixels: DataFrame, scenes: DataFrame, aois: DataFrame) -> DataFrame:
    """Pixels whose centre lies in the AOI polygon, with the others dropped as nodata."""
    return with_inside(pixels, scenes, aois).where("inside").drop("inside")


def scan_acquisitions(acquisitions: DataFrame, aoi_id: int | None = None) -> DataFrame:
    """All acquisitions or those of one AOI, in time order."""
    rows = acquisitions if aoi_id is None else acquisitions.where(F.col("aoi_id") == aoi_id)
    return rows.orderBy("ts", "acq_id")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Stored rows after the incoming ones: the newest row per key wins."""
    return latest_by(stored.unionByName(incoming), keys, order)


def merge_acquisitions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Acquisitions keyed by (aoi_id, item_id).

    A processed scene replaces the stored row; ``created_at`` stays. A failed scene
    changes only state and reason of a stored row and keeps its other columns.
    """
    key = ["aoi_id", "item_id"]
    failed = (F.col("n.state") == "failed") & F.col("o").isNotNull()
    values = [c for c in incoming.columns if c not in (*key, "created_at", "state", "reason")]
    old = stored.select(*key, F.struct("state", "reason", "created_at", *values).alias("o"))
    new = incoming.select(*key, F.struct("state", "reason", "created_at", *values).alias("n"))
    pick = lambda c: F.when(F.col("n").isNull() | failed, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return old.join(new, key, "full_outer").select(
        *key,
        F.coalesce("n.state", "o.state").alias("state"),
        F.coalesce("n.reason", "o.reason").alias("reason"),
        F.coalesce("o.created_at", "n.created_at").alias("created_at"),
        *[pick(c).alias(c) for c in values],
    )


BUCKETS = 64


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a keyed table; a table that was never written is empty."""
    try:
        stored = spark.read.schema(_stored_schema(schema)).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], _stored_schema(schema))
    return stored.where("_marker = false").select(*schema.fieldNames())


def _stored_schema(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("_marker", BooleanType()), StructField("_bucket", IntegerType())])


def put(
    incoming: DataFrame,
    path: str,
    keys: list[str],
    scope: DataFrame | None = None,
    merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> None:
    """Write rows by key: what is stored under the keys of ``scope`` makes way for ``incoming``.

    ``scope`` names the keys that were worked on (those of ``incoming`` by default), so a run
    that now has no rows loses its old ones. ``merge(stored, incoming)`` may combine both instead.
    The table lies in buckets of its keys. Only buckets of the scope are read; they are staged
    and then replaced as whole partitions, so a repeated or resumed job leaves the same rows.
    A marker row per bucket keeps an emptied bucket from being passed over. One job at a time writes a table,
    and readers wait for it.
    """
    spark, schema = incoming.sparkSession, incoming.schema
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    worked = materialize((incoming if scope is None else scope).select(*keys).distinct(), "worked-keys")
    buckets = worked.select(bucket.alias("_bucket")).distinct()
    near = read_table(spark, path, schema).withColumn("_bucket", bucket).join(buckets, "_bucket", "left_semi").drop("_bucket")
    # Null keys are keys like others: a repeated write replaces their rows too.
    replaced = worked.select(*[F.col(k).alias(f"_w_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys])
    merged = merge(near, incoming) if merge else near.join(replaced, same, "left_anti").unionByName(incoming)
    rows = merged.select(*schema.fieldNames(), F.lit(False).alias("_marker"), bucket.alias("_bucket"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    markers = buckets.select(*empty, F.lit(True).alias("_marker"), "_bucket")
    staged = materialize(rows.unionByName(markers), "put")
    staged.repartition("_bucket", F.xxhash64(*keys) % 8).write.partitionBy("_bucket").mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(path)


def write_json(snapshots: DataFrame, path: str) -> None:
    """One JSON document per line, from a ``json`` column."""
    snapshots.select("json").write.mode("overwrite").text(path)
