"""The analysis chain over all AOIs of a data set, stage by stage.

A stage is computed on first use and kept as a stage table, as a user would keep
detection runs and reuse them in later analyses.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landshift.config import Policy
from landshift.operators import change, polygons, quality, regions, signals, tracks, triage
from landshift.plans import fixtures
from landshift.session import configure, materialize
from landshift.sources import pixel_store, tables

# The fixture grid is 20 pixels wide; tiles of 16 make regions cross tile borders.
FIXTURE_POLICY = Policy(tile=16)
TRACK_KEY = ["aoi_id", "birth_k", "birth_no"]


class Chain:
    """Lazily built stages of one data set."""

    def __init__(self, spark: SparkSession, sf_dir: str, policy: Policy = FIXTURE_POLICY):
        self.spark = configure(spark)
        self.sf_dir = sf_dir
        self.policy = policy

    @cached_property
    def buckets(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    @cached_property
    def pixel_table(self) -> pixel_store.PixelTable:
        """Pixels as delivered, over the whole grid of their scenes, clustered by tile."""
        return pixel_store.write(fixtures.pixels(self.spark, self.sf_dir, self.policy.tile, self.buckets), self.policy.tile, self.buckets)

    @cached_property
    def raw_pixels(self) -> DataFrame:
        return self.pixel_table.read(self.spark)

    @cached_property
    def aois(self) -> DataFrame:
        return materialize(fixtures.aois(self.spark, self.sf_dir), "aois")

    @cached_property
    def located_pixels(self) -> DataFrame:
        """Pixels as delivered, with whether they lie in their AOI; shuffled and written once.

        Where another query has kept the delivered pixels, they are read and stay in their buckets.
        """
        side, tiles = self.policy.tile, None
        if "pixel_table" in self.__dict__:
            delivered = self.raw_pixels
        else:
            delivered = fixtures.pixels(self.spark, self.sf_dir, side, self.buckets)
            tiles = fixtures.tiles(self.spark, self.sf_dir, side)
        return pixel_store.write(tables.with_inside(delivered, self.scenes, self.aois, tiles), side, self.buckets).read(self.spark)

    @cached_property
    def pixels(self) -> DataFrame:
        """Pixels inside their AOI; the others count as nodata."""
        return self.located_pixels.where("inside").drop("inside")

    @cached_property
    def scenes(self) -> DataFrame:
        return materialize(fixtures.scenes(self.spark, self.sf_dir), "scenes")

    @cached_property
    def acquisitions(self) -> DataFrame:
        return materialize(quality.assess_scenes(self.pixels, self.scenes, self.policy), "acquisitions")

    @cached_property
    def sequence(self) -> DataFrame:
        return change.sequence(change.eligible(self.acquisitions))

    @cached_property
    def detection(self) -> regions.Detection:
        return regions.detect(self.pixels, self.acquisitions, self.policy, aois=self.aois)

    @cached_property
    def region_pixels(self) -> DataFrame:
        return materialize(self.detection.region_pixels(), "region-pixels")

    @cached_property
    def overlap(self) -> DataFrame:
        return materialize(tracks.sweep(self.region_pixels, self.policy), "overlap")

    @cached_property
    def tracks(self) -> DataFrame:
        return materialize(tracks.track_regions(self.detection.regions, self.overlap), "tracks")

    @cached_property
    def grids(self) -> DataFrame:
        """One grid header per AOI."""
        return self.scenes.groupBy("aoi_id").agg(F.any_value("grid").alias("grid"))

    @cached_property
    def track_pixels(self) -> DataFrame:
        return materialize(self.detection.track_pixels(self.tracks), "track-pixels")

    @cached_property
    def outlines(self) -> DataFrame:
        return materialize(polygons.track_outlines(self.track_pixels, self.grids, TRACK_KEY), "outlines")

    @cached_property
    def signals(self) -> DataFrame:
        d = self.detection
        return materialize(signals.build_signals(self.tracks, d.regions, d.runs, self.policy, self.outlines), "signals")

    @cached_property
    def relationships(self) -> DataFrame:
        return materialize(signals.build_relationships(self.detection.runs, self.tracks), "relationships")

    @cached_property
    def analyses(self) -> DataFrame:
        return materialize(
            signals.build_analyses(self.sequence, self.detection.runs, self.signals, self.policy), "analyses"
        )

    @cached_property
    def candidates(self) -> DataFrame:
        d = self.detection
        return materialize(
            triage.triage(self.signals, d.regions, d.runs, self.analyses, self.relationships), "candidates"
        )

    @cached_property
    def reviews(self) -> DataFrame:
        return materialize(triage.current_reviews(fixtures.review_log(self.spark, self.sf_dir)), "reviews")

    @cached_property
    def reviewed(self) -> DataFrame:
        return triage.with_review_state(self.candidates, self.reviews)


_chains: dict[tuple[str, str], Chain] = {}


def chain(spark: SparkSession, sf_dir: str) -> Chain:
    """The shared chain of a data set in this application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _chains:
        _chains[key] = Chain(spark, sf_dir)
    configure(spark)
    return _chains[key]


def forget_chains() -> None:
    """Drop the kept stages, so that the next query computes everything again."""
    _chains.clear()
