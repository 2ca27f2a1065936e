"""Scene catalogs: saved search results as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landshift.config import QUALITY_BAND, REQUIRED_BANDS, Policy
from landshift.functions import geometry, text
from landshift.operators.skew import rank_within
from landshift.schemas import CATALOG_PAGE, MULTIPOLYGON_COORDINATES, POLYGON_COORDINATES
from landshift.session import materialize


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Items of saved feature collections, one collection per line.

    A multi-polygon gives one row per part. Items with another geometry or none keep one row
    with NULL rings; :func:`unreadable_items` lists them.
    """
    pages = spark.read.schema(CATALOG_PAGE).json(path)
    kind = F.get_json_object("f.geometry", "$.type")
    one = F.array(F.from_json("f.geometry", POLYGON_COORDINATES)["coordinates"])
    many = F.from_json("f.geometry", MULTIPOLYGON_COORDINATES)["coordinates"]
    parts = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    return pages.select(F.explode("features").alias("f")).select(
        F.col("f.id").alias("item_id"),
        F.col("f.collection").alias("collection"),
        text.parse_iso(F.element_at("f.properties", F.lit("datetime"))).alias("ts"),
        F.element_at("f.properties", F.lit("eo:cloud_cover")).alias("cloud_cover"),
        F.col("f.assets").alias("assets"),
        kind.alias("geometry_type"),
        F.explode_outer(parts).alias("_part"),
    ).withColumn("rings", geometry.rings_from_coordinates(F.col("_part"))).drop("_part")


def unreadable_items(items: DataFrame) -> DataFrame:
    """Items that no search can find, with the type of geometry they have."""
    return items.where(F.col("rings").isNull()).select("item_id", "collection", "geometry_type")


def has_asset(assets: Column, band: str) -> Column:
    """Band present with a non-empty href."""
    return F.coalesce(F.try_element_at(assets, F.lit(band))["href"] != "", F.lit(False))


def has_required_assets(assets: Column) -> Column:
    present = has_asset(assets, QUALITY_BAND)
    for band in REQUIRED_BANDS:
        present = present & has_asset(assets, band)
    return present


def cloud_order(cloud_cover: Column) -> Column:
    """Cloud cover as a number; anything else sorts last."""
    return cloud_cover.try_cast("double")


CELL_DEGREES = 1.0


def meeting(items: DataFrame, aois: DataFrame) -> DataFrame:
    """Items joined with every AOI that their footprint meets (aoi_id, aoi_rings).

    Both sides are spread over the grid cells of their boxes and joined on the cell. A pair
    counts in the cell of the lower left corner of what its boxes share, hence once. The boxes
    decide first; only pairs of meeting boxes run the polygon test. The cells of the AOIs are a stage table, so that
    few AOIs are known to be few, and items that share a cell are not collected to meet them.
    """
    cell = lambda value: F.floor(value / CELL_DEGREES).cast("int")

    def spread(rows: DataFrame, box: str, prefix: str) -> DataFrame:
        b = F.col(box)
        return rows.withColumn(f"{prefix}x", F.explode(F.sequence(cell(b[0]), cell(b[2])))).withColumn(
            f"{prefix}y", F.explode(F.sequence(cell(b[1]), cell(b[3])))
        )

    left = items.drop("aoi_id", "aoi_rings").where(F.col("rings").isNotNull()).withColumn("_box", geometry.bounds(F.col("rings")))
    right = aois.select("aoi_id", F.col("rings").alias("aoi_rings"), geometry.bounds(F.col("rings")).alias("_aoi_box"))
    a, b = F.col("_box"), F.col("_aoi_box")
    return (
        spread(left, "_box", "_i").join(
            materialize(spread(right, "_aoi_box", "_a"), "aoi-cells"),
            (F.col("_ix") == F.col("_ax")) & (F.col("_iy") == F.col("_ay"))
            & (F.col("_ix") == cell(F.greatest(a[0], b[0]))) & (F.col("_iy") == cell(F.greatest(a[1], b[1]))),
        )
        .where((a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1]))
        .where(
            F.when(geometry.is_box(F.col("rings")) & geometry.is_box(F.col("aoi_rings")), True)
            .otherwise(geometry.intersects(F.col("rings"), F.col("aoi_rings")))
        )
        .drop("_box", "_aoi_box", "_ix", "_iy", "_ax", "_ay")
    )


def search(items: DataFrame, aois: DataFrame, collection: str, start: str, end: str, policy: Policy = Policy()) -> DataFrame:
    """Items of one collection that meet an AOI in a closed time range, one row per AOI met.

    A limit in the policy is part of the search: it keeps the newest items per AOI.
    """
    hits = meeting(
        items.where(
            (F.col("collection") == collection)
            & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
        ),
        aois,
    )
    if policy.catalog_limit is None:
        return hits
    newest = Window.partitionBy("aoi_id").orderBy(F.col("ts").desc(), "item_id")
    return hits.withColumn("result_no", F.dense_rank().over(newest)).where(F.col("result_no") <= policy.catalog_limit)


def covering(found: DataFrame) -> DataFrame:
    """Search results with all bands whose valid footprint covers the AOI, each item once per AOI."""
    a, b = geometry.bounds(F.col("rings")), geometry.bounds(F.col("aoi_rings"))
    around = (a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3])
    # Most footprints are told by their boxes; a footprint that is a box covers what its bounds do.
    exact = F.when(geometry.is_box(F.col("rings")), True).otherwise(
        geometry.is_valid(F.col("rings")) & geometry.covers(F.col("rings"), F.col("aoi_rings"))
    )
    whole = found.where(has_required_assets(F.col("assets"))).where(around).where(exact)
    return whole.dropDuplicates(["aoi_id", "item_id"])


def domain_violations(found: DataFrame, boundary: DataFrame) -> DataFrame:
    """Footprints that do not touch the domain boundary. These are errors, not drops.

    ``boundary`` is one row with one column of rings; it is read as a scalar.
    """
    return (
        found.where(has_required_assets(F.col("assets")) & geometry.is_valid(F.col("rings")))
        .withColumn("boundary_rings", boundary.scalar())
        .where(~geometry.intersects(F.col("rings"), F.col("boundary_rings")))
        .drop("boundary_rings")
    )


def ranked(covered: DataFrame) -> DataFrame:
    """Position per AOI: clearest first, then earliest, then item id."""
    # Written first: range partitioning reads its input twice.
    cloud = materialize(covered.withColumn("_cloud", cloud_order(F.col("cloud_cover"))), "covered")
    order = [F.col("_cloud").asc_nulls_last(), F.col("ts").asc(), F.col("item_id").asc()]
    return rank_within(cloud, ["aoi_id"], order, "position").drop("_cloud")


def best(covered: DataFrame) -> DataFrame:
    """The first item of each AOI in that order, as an aggregate."""
    cloud = cloud_order(F.col("cloud_cover"))
    rank = F.struct(F.isnull(cloud).alias("n"), cloud.alias("c"), F.col("ts"), F.col("item_id"))
    return covered.groupBy("aoi_id").agg(F.min_by(F.struct(*[c for c in covered.columns if c != "aoi_id"]), rank).alias("_best")).select("aoi_id", "_best.*")


def discover(items: DataFrame, aois: DataFrame, collection: str, start: str, end: str, policy: Policy = Policy()) -> DataFrame:
    return ranked(covering(search(items, aois, collection, start, end, policy)))
