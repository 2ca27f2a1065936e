"""Region overlap and region tracks over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.config import Policy
from landshift.operators.components import SCOPE
from landshift.session import materialize, stage_path


TRACK = ["birth_k", "birth_no"]
REGION = [*SCOPE, "region_no"]
SOURCE = ["aoi_id", "from_k", "from_no"]


def _stacks(region_pixels: DataFrame, policy: Policy) -> DataFrame:
    """Overlay faces of at least two regions: the regions of a face in the order of intervals, and its size in pixels."""
    side = policy.tile
    tile = ["aoi_id", "_tr", "_tc"]
    return (
        region_pixels.withColumn("_tr", F.floor(F.col("row") / side))
        .withColumn("_tc", F.floor(F.col("col") / side))
        .repartition(*tile)
        .groupBy(*tile, "row", "col")
        .agg(F.array_sort(F.collect_list(F.struct("k", "region_no", "pixel_count"))).alias("stack"))
        .where(F.size("stack") > 1)
        .groupBy("aoi_id", "stack")
        .agg(F.count(F.lit(1)).alias("pixels"))
    )


def overlay_faces(region_pixels: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The regions of every overlay face in the order of intervals, one row per face and region.

    The regions that cover a pixel form its stack, which is never longer than the number of
    intervals; pixels of an AOI with the same stack are one face. ``pixels`` is the size of the face and
    ``next_k`` the interval in which a region covers it again. Faces of a single region are left out.
    """
    stacks = _stacks(region_pixels, policy).withColumn("face", F.monotonically_increasing_id())
    entries = stacks.select("face", "aoi_id", "pixels", "stack", F.posexplode("stack").alias("_at", "_r"))
    return entries.select(
        "face", "aoi_id", F.col("_r.k").alias("k"), F.col("_r.region_no").alias("region_no"), F.col("_r.pixel_count").alias("pixel_count"),
        "pixels", (F.col("_at") > 0).alias("again"), F.try_element_at("stack", F.col("_at") + 2)["k"].alias("next_k"),
    )


def open_links(links: DataFrame, ends: DataFrame) -> DataFrame:
    """Links whose earlier region is the end of a track, with the track's birth."""
    births = ends.select("aoi_id", F.col("k").alias("from_k"), F.col("region_no").alias("from_no"), *TRACK)
    return links.join(births, SOURCE)


def best_matches(links: DataFrame) -> DataFrame:
    """Best open track per region: highest IoU, then the oldest track."""
    choice = F.struct("iou", (-F.col("birth_k")).alias("k"), (-F.col("birth_no")).alias("no"))
    return links.groupBy(*REGION).agg(
        F.max_by(F.struct("from_k", "from_no", *TRACK, "iou"), choice).alias("m")
    ).select(*REGION, "m.*")


def track_winners(matches: DataFrame) -> DataFrame:
    """The first region in order that claims a track keeps it."""
    track = ["aoi_id", *TRACK]
    rest = [c for c in matches.columns if c not in track]
    first = matches.groupBy(*track).agg(F.min_by(F.struct(*rest), "region_no").alias("_first"))
    return first.select(*track, *[F.col(f"_first.{c}").alias(c) for c in rest]).select(*matches.columns)


def with_births(regions: DataFrame, won: DataFrame) -> DataFrame:
    """Matched regions continue their track; all others start one. Other columns stay."""
    rest = [c for c in regions.columns if c not in REGION]
    return regions.join(won, REGION, "left").select(
        *REGION,
        F.coalesce("birth_k", "k").alias("birth_k"),
        F.coalesce("birth_no", "region_no").alias("birth_no"),
        F.coalesce("iou", F.lit(1.0)).alias("iou"),
        "from_k",
        "from_no",
        *rest,
    )


def no_matches(links: DataFrame) -> DataFrame:
    """Empty result of a matching step."""
    return links.where(F.lit(False)).select(
        *REGION, F.col("k").alias("birth_k"), F.col("region_no").alias("birth_no"), "iou", "from_k", "from_no"
    )


END = ["aoi_id", "end_k", "end_no"]


def _touching(visits: DataFrame, posted: DataFrame, closed: DataFrame) -> DataFrame:
    """Faces that an interval covers again, with the track ends that still wait in them."""
    return posted.join(closed, END, "left_anti").join(visits.drop("aoi_id"), "face")


def _end_pairs(touching: DataFrame, minimum: float) -> DataFrame:
    """(open end, region) pairs with their IoU, which sizes alone may rule out."""
    reachable = F.least("end_pixels", "pixel_count") >= F.greatest("end_pixels", "pixel_count") * minimum
    shared = touching.where(reachable).groupBy(
        *REGION, F.col("end_k").alias("from_k"), F.col("end_no").alias("from_no"), *TRACK,
        F.col("end_pixels").alias("from_pixels"), F.col("pixel_count").alias("to_pixels"),
    ).agg(F.sum("pixels").alias("shared"))
    union = F.col("from_pixels") + F.col("to_pixels") - F.col("shared")
    return shared.withColumn("iou", F.col("shared") / union).where(F.col("iou") >= minimum)


def sweep(region_pixels: DataFrame, policy: Policy = Policy(), minimum: float | None = None) -> DataFrame:
    """Pairs of an open track end and a later region that share pixels, with their IoU.

    A region is the end of its track until a later one continues the track (``won``). No two regions are
    compared unless the earlier one is still an end: a field that stays the same over n intervals
    gives n - 1 pairs. ``minimum`` is the least IoU that is told, the one that links by default.

    The sweep goes over the intervals, for all AOIs at once. A posting says that an end waits in a face. It
    is filed under the interval that covers the face next, so a step reads the postings of the faces
    that it visits and no others, and files those that go on. An end that another face has closed
    since is dropped when its posting is read. Every step is written, so a lost executor replays one step.
    """
    least = policy.iou_threshold if minimum is None else min(minimum, policy.iou_threshold)
    spark = region_pixels.sparkSession
    faces = materialize(overlay_faces(region_pixels, policy), "faces", partition_by=("k",))
    steps = faces.groupBy("k").agg(F.bool_or("again").alias("again"), F.max("next_k").alias("last")).orderBy("k").collect()
    aoi = faces.schema["aoi_id"].dataType.simpleString()
    path = stage_path(spark, "sweep")
    posted_schema = f"aoi_id {aoi}, face bigint, end_k int, end_no bigint, end_pixels bigint, birth_k int, birth_no bigint"
    pair_schema = (
        f"aoi_id {aoi}, k int, region_no bigint, from_k int, from_no bigint, birth_k int, birth_no bigint, "
        "from_pixels bigint, to_pixels bigint, shared bigint, iou double"
    )
    won_schema = f"aoi_id {aoi}, k int, region_no bigint, from_k int, from_no bigint, birth_k int, birth_no bigint"
    read = lambda what, schema: spark.read.schema(schema).parquet(*[f"{path}/{what}/step={k}" for k in done]) if done else spark.createDataFrame([], schema)
    ends_of = lambda won: won.select("aoi_id", F.col("from_k").alias("end_k"), F.col("from_no").alias("end_no"))
    done: list[int] = []
    for k, again, last in steps:
        visits = faces.where(F.col("k") == k)
        won, waiting = spark.createDataFrame([], won_schema), None
        if again:
            posted = spark.read.schema(posted_schema).parquet(f"{path}/posted/step=*/next_k={k}")
            touching = _touching(visits, posted, ends_of(read("won", won_schema)))
            at = f"{path}/pairs/step={k}"
            _end_pairs(touching, least).write.parquet(at)
            found = spark.read.schema(pair_schema).parquet(at)
            winners = track_winners(best_matches(found.where(F.col("iou") >= policy.iou_threshold)))
            at = f"{path}/won/step={k}"
            winners.select(*REGION, "from_k", "from_no", *TRACK).write.parquet(at)
            won = spark.read.schema(won_schema).parquet(at)
            waiting = touching.join(ends_of(won), END, "left_anti").where("next_k is not null")
            done.append(k)
        if last is None:  # no face is covered again
            continue
        own = visits.where("next_k is not null").join(won.select(*REGION, *TRACK), REGION, "left").select(
            "aoi_id", "face", F.col("k").alias("end_k"), F.col("region_no").alias("end_no"), F.col("pixel_count").alias("end_pixels"),
            F.coalesce("birth_k", "k").alias("birth_k"), F.coalesce("birth_no", "region_no").alias("birth_no"), "next_k",
        )
        filed = own if waiting is None else own.unionByName(waiting.select(*own.columns))
        filed.hint("rebalance", "next_k").write.partitionBy("next_k").parquet(f"{path}/posted/step={k}")
    pairs, won = read("pairs", pair_schema), read("won", won_schema)
    mark = won.select(*REGION, "from_k", "from_no", F.lit(True).alias("won"))
    return pairs.join(mark, [*REGION, "from_k", "from_no"], "left").withColumn("won", F.coalesce("won", F.lit(False)))


def region_overlap(region_pixels: DataFrame, policy: Policy = Policy(), minimum: float | None = None) -> DataFrame:
    """All earlier/later region pairs of an AOI that share pixels, with their IoU; the least one told is ``minimum``.

    Pairs are formed per overlay face rather than per pixel, and a face is never longer than the number
    of intervals. Pairs whose sizes alone rule out the wanted IoU are not formed.
    """
    minimum = policy.iou_threshold if minimum is None else minimum
    count = lambda r: r["pixel_count"]
    reachable = lambda a, b: F.least(count(a), count(b)) >= F.greatest(count(a), count(b)) * minimum
    later = F.filter("stack", lambda r: (r["k"] > F.col("_early.k")) & reachable(F.col("_early"), r))
    pairs = (
        _stacks(region_pixels, policy).withColumn("_early", F.explode("stack"))
        .select("aoi_id", "pixels", "_early", F.explode(later).alias("_late"))
    )
    shared = pairs.groupBy(
        "aoi_id", F.col("_early.k").alias("from_k"), F.col("_early.region_no").alias("from_no"), F.col("_late.k").alias("k"),
        F.col("_late.region_no").alias("region_no"), F.col("_early.pixel_count").alias("from_pixels"), F.col("_late.pixel_count").alias("to_pixels"),
    ).agg(F.sum("pixels").alias("shared"))
    union = F.col("from_pixels") + F.col("to_pixels") - F.col("shared")
    return shared.withColumn("iou", F.col("shared") / union).where(F.col("iou") >= minimum)


def track_regions(regions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Assign every region to a track, named by the region that started it.

    ``pairs`` come from ``sweep``. Matching looks at the last region of each track, however old; a region
    that loses its best track starts a new one, and so do regions that overlap nothing.
    """
    won = pairs.where("won").select(*REGION, *TRACK, "iou", "from_k", "from_no")
    return with_births(regions.select(*REGION), won)
