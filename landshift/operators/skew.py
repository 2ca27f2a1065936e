"""Helpers that keep hot keys from landing in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landshift.session import materialize

SALTS = 64
SALT_BLOCK = 16  # side of the pixel blocks that share a salt


def attach_group_values(
    rows: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    values: dict[str, tuple[Callable[[Column], Column], Column]],
    salts: int = SALTS,
) -> DataFrame:
    """Add per-key aggregates to every row without collecting a key in one task.

    ``values`` maps a new column to (aggregate, expression); the aggregate must
    combine with itself (min, max, sum, bool_or ...). Rows are salted by ``spread``.
    The aggregate runs per (key, salt), then per key, and is joined back on
    (key, salt), so a key that holds a third of all rows is shared by ``salts`` join
    groups while a rare key is not replicated at all.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    partial = salted.groupBy(*keys, "_salt").agg(
        *[fn(expr).alias(name) for name, (fn, expr) in values.items()]
    )
    total = partial.groupBy(*keys).agg(
        *[fn(F.col(name)).alias(name) for name, (fn, _) in values.items()],
        F.collect_list("_salt").alias("_salts"),
    )
    per_salt = total.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return salted.join(per_salt, [*keys, "_salt"]).drop("_salt")


def join_headers(pixels: DataFrame, headers: DataFrame, keys: tuple[str, ...] = ("aoi_id", "acq_id")) -> DataFrame:
    """Pixels with the facts of their scene, on a salted key: a scene that holds most pixels is many join groups.

    Blocks of the grid are dealt to the salts, and a header is copied only for the salts that its pixels have. Headers of few
    pixels, as of regions, are hardly copied, so where the planner broadcasts them, the driver holds no copy per salt.
    """
    block = [F.floor(F.col(c) / SALT_BLOCK) for c in ("row", "col")]
    salted = pixels.withColumn("_salt", F.pmod(F.xxhash64(*block), F.lit(SALTS)).cast("int"))
    copies = salted.select(*keys, "_salt").distinct().join(headers, list(keys))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def number_buckets(
    rows: DataFrame,
    keys: Sequence[str],
    bucket: Sequence[str],
    order: Sequence[str],
    name: str,
) -> DataFrame:
    """1-based numbering per key, where ``bucket`` cuts each key into ordered slices.

    Slices must be bounded and ordered like ``order``. Rows are numbered inside their
    slice and shifted by the size of the slices before it.
    """
    sizes = rows.groupBy(*keys, *bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, *bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, *bucket).orderBy(*order)
    return (
        rows.withColumn("_position", F.row_number().over(inside))
        .join(offsets, [*keys, *bucket])
        .withColumn(name, (F.col("_offset") + F.col("_position")).cast("bigint"))
        .drop("_offset", "_position")
    )


def rank_within(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1-based rank per key under a total order, with no bound on the size of a key.

    Rows are range-partitioned by key and order, so a large key spans several
    partitions; the slices are written once and then numbered by partition.
    """
    total_order = [*[F.col(k).asc() for k in keys], *order]
    sliced = materialize(
        rows.repartitionByRange(*total_order).withColumn("_slice", F.spark_partition_id()), "ranked"
    )
    return number_buckets(sliced, keys, ["_slice"], order, name).drop("_slice")


def spread_rows(rows: DataFrame) -> DataFrame:
    """Rows over all tasks, for work that a file of few bytes would leave to one task. The number is set: AQE keeps it."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def latest_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key, as an aggregate: rows of a hot key combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in (*order, *rest)]).select(*rows.columns)
