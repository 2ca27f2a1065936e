"""Input tables of the registered queries, derived from the given Parquet tables.

Each function is an ordinary DataFrame query over a whole table. ``oracle.py`` holds
the same derivations as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landshift.config import PROCESSING_VERSION
from landshift.sources.pixel_store import gather, tile_columns

SIDE = 20  # side of the fixture grid in pixels
ORDERS_PER_AOI = 1500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.floor(F.col("l_orderkey") / ORDERS_PER_AOI) + 1).cast("bigint").alias("aoi_id"),
        (F.year("l_shipdate") - 1994).cast("int").alias("acq"),
        F.pmod(F.col("l_suppkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_orderkey"), F.lit(SIDE))
        .cast("int").alias("row"),
        F.pmod("l_partkey", F.lit(SIDE)).cast("int").alias("col"),
        "l_orderkey",
        "l_partkey",
        "l_quantity",
        "l_extendedprice",
    )


def tiles(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """The tiles that hold pixels."""
    return _keyed(spark, sf_dir).select("aoi_id", *[number.alias(c) for c, number in tile_columns(side).items()]).distinct()


def pixels(spark: SparkSession, sf_dir: str, side: int | None = None, buckets: int | None = None) -> DataFrame:
    """Band and class pixels; absent grid cells are nodata.

    With the ``side`` of tiles, line items are gathered by tile in ``buckets`` tasks, and pixels lie there as a pixel table wants them.
    """
    lines = _keyed(spark, sf_dir).select(
        "aoi_id", "acq", "row", "col", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_partkey").alias("part"),
        (F.col("l_partkey") * 31 + F.col("l_orderkey")).alias("mix"),
    )
    tile = []
    if side is not None:
        lines, tile = gather(lines, side, buckets), ["tile_row", "tile_col"]
    cells = lines.groupBy("aoi_id", *tile, "acq", "row", "col").agg(
        F.max("q").alias("q_max"), F.max("p").alias("p_max"), F.min("q").alias("q_min"), F.min("p").alias("p_min"),
        F.min("part").alias("part"), F.min("mix").alias("mix"),
    )
    code = F.pmod("mix", F.lit(12))
    overcast = (F.pmod(F.col("aoi_id") + F.col("acq"), F.lit(6)) == 0) & (F.pmod("part", F.lit(3)) > 0)
    scl = (
        F.when(overcast, 9).when(code == 0, 8).when(code == 1, 3).when(code == 2, 0)
        .when(code == 3, 5).when(code == 4, 6).otherwise(4)
    )
    return cells.select(
        "aoi_id",
        (F.col("aoi_id") * 100 + F.col("acq")).alias("acq_id"),
        "row",
        "col",
        (F.floor("q_max") * 20).cast("float").alias("red"),
        F.floor(F.floor("p_max") / 20).cast("float").alias("nir"),
        scl.cast("int").alias("scl"),
        F.floor(F.floor("p_min") / 25).cast("float").alias("green"),
        (F.floor("q_min") * 30).cast("float").alias("blue"),
        *tile,
    )


def _origin_x(aoi):
    return (F.lit(600000) + F.pmod(aoi, F.lit(1000)) * 200).cast("double")


ORIGIN_Y = 1500000.0


def grid(aoi, side: int = SIDE, resolution: float = 10.0, count: int = 2):
    """Grid header of a fixture scene."""
    x, extent = _origin_x(aoi), side * resolution
    lit = lambda v: F.lit(float(v))
    return F.struct(
        F.lit("EPSG:32643").alias("crs"),
        F.array(lit(resolution), lit(0), x, lit(0), lit(-resolution), lit(ORIGIN_Y)).alias("transform"),
        F.lit(side).alias("width"),
        F.lit(side).alias("height"),
        F.array(lit(resolution), lit(resolution)).alias("resolution"),
        F.array(x, lit(ORIGIN_Y - extent), x + extent, lit(ORIGIN_Y)).alias("bounds"),
        F.lit(count).alias("count"),
        F.lit("uint16").alias("dtype"),
        lit(0).alias("nodata"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene headers before any quality assessment."""
    return (
        _keyed(spark, sf_dir).select("aoi_id", "acq").distinct().select(
            "aoi_id",
            (F.col("aoi_id") * 100 + F.col("acq")).alias("acq_id"),
            F.concat(F.lit("scene/"), F.col("aoi_id").cast("string"), F.lit("."), F.col("acq").cast("string"))
            .alias("item_id"),
            F.lit("sentinel-2-l2a").alias("collection"),
            F.make_timestamp(
                1994 + F.col("acq"), (1 + F.pmod("aoi_id", F.lit(12))).cast("int"), F.lit(15),
                F.lit(0), F.lit(0), F.lit(0),
            ).cast("timestamp").alias("ts"),
            grid(F.col("aoi_id")).alias("grid"),
            (F.pmod(F.col("aoi_id") * 100 + F.col("acq"), F.lit(50)) / 2.0).alias("cloud_cover"),
            F.concat(F.lit("43P"), F.element_at(F.array(*map(F.lit, "GHKM")), (F.pmod("aoi_id", F.lit(4)) + 1).cast("int"))).alias("mgrs_tile"),
        )
    )


CUT = 45.0  # corner cut of the octagonal fixture AOI, in metres


def _ring(*points):
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in points])


def aois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One octagonal AOI per grid, in grid coordinates."""
    ids = table(spark, sf_dir, "orders").select(
        (F.floor(F.col("o_orderkey") / ORDERS_PER_AOI) + 1).cast("bigint").alias("aoi_id")
    ).distinct()
    x, y, size = _origin_x(F.col("aoi_id")), F.lit(ORIGIN_Y), SIDE * 10.0
    corner = [
        (x + CUT, y), (x + (size - CUT), y), (x + size, y - CUT), (x + size, y - (size - CUT)),
        (x + (size - CUT), y - size), (x + CUT, y - size), (x, y - (size - CUT)), (x, y - CUT), (x + CUT, y),
    ]
    return ids.select("aoi_id", F.array(_ring(*corner)).alias("rings"))


def box(left, bottom, right, top):
    """Rings of an axis-parallel box."""
    return F.array(_ring((left, bottom), (right, bottom), (right, top), (left, top), (left, bottom)))


CATALOG_COLLECTION = "sentinel-2-l2a"


def catalog_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog items from events: ragged assets, unordered cloud cover, box footprints."""
    e = table(spark, sf_dir, "events")
    href = lambda band: F.struct(F.concat(F.lit(f"https://example.org/{band}/"), F.col("event_id").cast("string")).alias("href"))
    has = lambda band, kinds: F.when(~F.col("event_type").isin(*kinds), F.struct(F.lit(band).alias("key"), href(band).alias("value")))
    assets = F.map_from_entries(F.array_compact(F.array(
        has("red", []), has("nir", ["signup"]), has("scl", ["view"]), has("green", ["click"]), has("blue", ["click"]),
    )))
    shift = F.pmod("event_id", F.lit(10)).cast("double")
    left, bottom = F.lit(76.0) + shift * 0.25, F.lit(11.5) + shift * 0.125
    return e.select(
        F.format_string("item-%06d", "event_id").alias("item_id"),
        F.when(F.pmod("event_id", F.lit(11)) == 0, "landsat-c2-l2").otherwise(CATALOG_COLLECTION).alias("collection"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "n/a")
        .otherwise(F.format_string("%.4f", F.col("value") / 5.0)).alias("cloud_cover"),
        assets.alias("assets"),
        F.when(F.pmod("event_id", F.lit(17)) != 0, box(left, bottom, left + 2.0, bottom + 2.0)).alias("rings"),
    )


def catalog_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items as lines of feature collections; every third footprint is a multi-polygon."""
    ring = F.transform(F.col("rings")[0], lambda p: F.array(p["x"], p["y"]))
    polygon = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring)).alias("coordinates")))
    third = F.pmod(F.substring("item_id", 6, 12).cast("int"), F.lit(3)) == 0
    shape = F.when(F.col("rings").isNull(), "null").otherwise(F.when(third, multi).otherwise(polygon))
    feature = F.concat(
        F.lit('{"id":"'), F.col("item_id"), F.lit('","collection":"'), F.col("collection"), F.lit('","geometry":'), shape,
        F.lit(',"properties":'), F.to_json(F.create_map(
            F.lit("datetime"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("eo:cloud_cover"), F.col("cloud_cover"))),
        F.lit(',"assets":'), F.to_json("assets"), F.lit("}"),
    )
    return catalog_items(spark, sf_dir).select(F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}")).alias("value"))


def catalog_aois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four AOI boxes that the catalog items are searched for."""
    ids = table(spark, sf_dir, "events").select(
        (F.pmod("user_id", F.lit(4)) + 1).cast("bigint").alias("aoi_id")
    ).distinct()
    left, bottom = F.lit(77.0) + F.col("aoi_id") * 0.25, F.lit(12.0) + F.col("aoi_id") * 0.25
    return ids.select("aoi_id", box(left, bottom, left + 0.25, bottom + 0.25).alias("rings"))


BOUNDARY = (74.0, 11.0, 79.0, 18.5)


def boundary(spark: SparkSession) -> DataFrame:
    """The one-row table with the domain boundary."""
    return spark.range(1).select(box(*[F.lit(v) for v in BOUNDARY]).alias("boundary_rings"))


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_rows(table(spark, sf_dir, "orders"))


def review_rows(o: DataFrame) -> DataFrame:
    """Review decisions from orders; some candidates and decisions do not exist."""
    step = F.substring("o_orderpriority", 1, 1)
    decision = (
        F.when(step == "1", "accepted").when(step == "2", "rejected").when(step == "3", "investigate")
        .when(step == "4", "unreviewed").otherwise("escalate")
    )
    note = F.when(
        F.pmod("o_orderkey", F.lit(4)) == 0,
        F.concat(F.lit("  status "), F.col("o_orderstatus"), F.lit(" checked\n")),
    ).when(F.pmod("o_orderkey", F.lit(4)) == 1, " \t ")
    return o.select(
        F.format_string(
            "analysis-%d-signal-%d",
            (F.floor(F.col("o_orderkey") / ORDERS_PER_AOI) + 1).cast("bigint"),
            F.pmod("o_custkey", F.lit(40)) + 1,
        ).alias("candidate_id"),
        decision.alias("decision"),
        note.alias("note"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_orderkey").alias("log_id"),
    )


def stored_runs(spark: SparkSession, sf_dir: str, intervals: DataFrame) -> DataFrame:
    """Stored runs of earlier requests, some with other settings.

    Interval ``k`` of an AOI gets the runs of the orders whose key picks that AOI and k.
    """
    o = table(spark, sf_dir, "orders").select(
        (F.floor(F.col("o_orderkey") / ORDERS_PER_AOI) + 1).cast("bigint").alias("aoi_id"),
        F.pmod("o_custkey", F.lit(7)).cast("int").alias("k"),
        F.col("o_orderkey").alias("run_id"),
        F.when(F.pmod("o_orderkey", F.lit(5)) == 0, 0.3).otherwise(0.2).alias("threshold"),
        F.when(F.pmod("o_orderkey", F.lit(7)) == 0, 8).otherwise(4).alias("min_region_pixels"),
        (F.pmod("o_orderkey", F.lit(3)) > 0).alias("quality_mask_used"),
        F.when(F.pmod("o_orderkey", F.lit(4)) == 0, "legacy-unassessed").otherwise(PROCESSING_VERSION)
        .alias("quality_processing_version"),
        F.lit("ndvi-absolute-difference-v1").alias("detector_version"),
    )
    return o.join(intervals.select("aoi_id", "k", "before_acq", "after_acq"), ["aoi_id", "k"]).drop("k", "aoi_id")
