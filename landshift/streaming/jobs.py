"""Streaming jobs: scenes and reviews that arrive over time.

Arrivals carry event times. A watermark bounds how late a row may come; within it the state store knows the keys
that were delivered, so repeated deliveries are dropped, and rows later than that are left out.

A stream appends every micro-batch to a log, in a folder named by the batch. A batch that is run again after a
failure overwrites its own folder, so the log holds each batch once. Every ``COMPACT`` batches the log is folded:
all rows so far become one base folder with the rows that a later result can still depend on. Readers take
the newest complete base and the few batches behind it, so a read does not grow with the age of the log. One stream
writes a log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from landshift.operators.skew import latest_by
from landshift.operators.triage import current_reviews, decided


def read_arrivals(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Stream of the Parquet files of a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


COMPACT = 16
SCENE_DELAY = "30 days"
REVIEW_DELAY = "30 days"

Prepare = Callable[[DataFrame], DataFrame]
# Rows of a log after a batch, and after the batch before it, to the rows that are kept.
Fold = Callable[[DataFrame, DataFrame], DataFrame]


def _folders(spark: SparkSession, log: str) -> tuple[list[int], list[int], Callable[[str], None]]:
    """Complete bases and batches of a log, in order, and a way to remove a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"base_id": [], "batch_id": []}
    if files.exists(path):
        for status in files.listStatus(path):
            kind, _, number = status.getPath().getName().partition("=")
            if kind in found and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found[kind].append(int(number))
    remove = lambda folder: files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{log}/{folder}"), True)
    return sorted(found["base_id"]), sorted(found["batch_id"]), remove


def read_log(spark: SparkSession, log: str, schema, upto: int | None = None) -> DataFrame:
    """The newest base and the batches behind it; with ``upto`` as they stood after that batch."""
    bases, batches, _ = _folders(spark, log)
    bases = [n for n in bases if upto is None or n < upto]
    last = bases[-1] if bases else -1
    paths = [f"{log}/base_id={last}"] if bases else []
    paths += [f"{log}/batch_id={n}" for n in batches if n > last and (upto is None or n <= upto)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def compact(spark: SparkSession, log: str, schema, upto: int, fold: Fold) -> None:
    """Fold all rows up to a batch into a base, and remove what the base before it had replaced."""
    fold(read_log(spark, log, schema, upto), read_log(spark, log, schema, upto - 1)).write.mode("overwrite").parquet(f"{log}/base_id={upto}")
    bases, batches, remove = _folders(spark, log)
    before = [n for n in bases if n < upto]
    for n in before[:-1]:
        remove(f"base_id={n}")
    for n in batches:
        if before and n <= before[-1]:  # readers of the base before this one may still be at work
            remove(f"batch_id={n}")


def append_batches(
    stream: DataFrame, log: str, checkpoint: str, prepare: Prepare, fold: Fold, every: int = COMPACT, mode: str = "append"
) -> StreamingQuery:
    """Run the available data through ``prepare`` into the log, batch by batch, and fold the log now and then."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ready = prepare(batch)
        ready.write.mode("overwrite").parquet(f"{log}/batch_id={batch_id}")
        if (batch_id + 1) % every == 0:
            compact(batch.sparkSession, log, ready.schema, batch_id, fold)

    return (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest_scenes(rows: DataFrame) -> DataFrame:
    return latest_by(rows, ["aoi_id", "item_id"], ["ts", "version"])


def ingest_scenes(scenes: DataFrame, log: str, checkpoint: str, delay: str = SCENE_DELAY, every: int = COMPACT) -> StreamingQuery:
    """Scene rows keyed by (aoi_id, item_id).

    A delivery (its version) that is repeated within the watermark is dropped by the state store; what remains of a
    batch shrinks to the newest row of each scene.
    """
    once = scenes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["aoi_id", "item_id", "version"])
    return append_batches(once, log, checkpoint, newest_scenes, lambda rows, _: newest_scenes(rows), every)


def current_scenes(spark: SparkSession, log: str, schema) -> DataFrame:
    """Newest row per scene over all batches."""
    return newest_scenes(read_log(spark, log, schema))


def settled_reviews(rows: DataFrame, before: DataFrame, delay: str) -> DataFrame:
    """The log rows that a review can still depend on.

    The next batch takes no row that is older than the newest one of ``before``, the log without its latest batch, less
    the delay. Of the rows up to that horizon a candidate keeps its last reset and, behind it, the first and the
    last decision; newer rows all stay.
    """
    at = F.struct("ts", "log_id")
    horizon = before.agg((F.max("ts") - F.expr(f"INTERVAL {delay}")).alias("_horizon"))
    marked = rows.join(F.broadcast(horizon))  # one row
    late = marked.where("_horizon is null or ts > _horizon").drop("_horizon")
    old = marked.where("ts <= _horizon").drop("_horizon").where(decided())
    reset = F.col("decision") == "unreviewed"
    resets = old.groupBy("candidate_id").agg(F.max(F.when(reset, at)).alias("_reset"))
    standing = old.join(resets, "candidate_id").where(at >= F.coalesce("_reset", at))
    row = F.struct(*rows.columns)
    ends = standing.groupBy("candidate_id").agg(
        F.array_distinct(F.array_compact(F.array(
            F.max_by(row, F.when(reset, at)), F.min_by(row, F.when(~reset, at)), F.max_by(row, F.when(~reset, at)),
        ))).alias("_ends")
    )
    return late.unionByName(ends.select(F.explode("_ends").alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in rows.columns]))


def ingest_reviews(reviews: DataFrame, log: str, checkpoint: str, delay: str = REVIEW_DELAY, every: int = COMPACT) -> StreamingQuery:
    """Review decisions as they come; a decision (its ``log_id``) counts once, and not later than the watermark."""
    once = reviews.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["log_id"])
    return append_batches(once, log, checkpoint, lambda batch: batch, lambda rows, before: settled_reviews(rows, before, delay), every)


def review_state(spark: SparkSession, log: str, schema) -> DataFrame:
    return current_reviews(read_log(spark, log, schema))


def newest_counts(rows: DataFrame) -> DataFrame:
    return latest_by(rows, ["aoi_id", "state"], ["version"])


PROGRESS = "aoi_id bigint, state string, completed bigint, version bigint"


def count_progress(steps: DataFrame, out: str, checkpoint: str, every: int = COMPACT) -> StreamingQuery:
    """Finished steps per AOI and state, kept up to date while steps arrive.

    Update mode hands over only the counters a batch has changed. A counter only grows, so the larger one is the newer.
    """
    counters = steps.groupBy("aoi_id", "state").agg(F.count(F.lit(1)).alias("completed"))
    versioned = lambda batch: batch.withColumn("version", F.col("completed"))
    return append_batches(counters, out, checkpoint, versioned, lambda rows, _: newest_counts(rows), every, "update")


def current_progress(spark: SparkSession, out: str) -> DataFrame:
    return newest_counts(read_log(spark, out, PROGRESS)).drop("version")
