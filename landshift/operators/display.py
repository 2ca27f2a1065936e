"""Display and preview pixels.

Both are images: every cell of a crop rectangle is told, stored or not. Rectangles are cut into tiles, and only
tiles and stored pixels are shuffled; the empty cells come into being inside a tile's task.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landshift.config import DISPLAY_BANDS, VALID_CLASSES
from landshift.functions import geometry, spectral
from landshift.operators.skew import join_headers

KEYS = ["aoi_id", "acq_id"]
DEFAULT_LOW, DEFAULT_HIGH = 0.0, 3000.0
TILE = 256  # side of the tiles that a rectangle is filled in

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def aoi_windows(scenes: DataFrame, aois: DataFrame) -> DataFrame:
    """The crop rectangle of each scene: the cells that the box of its AOI touches (top, left, bottom, right; ends exclusive)."""
    t = F.col("grid.transform")
    box = geometry.bounds(geometry.project_rings(F.col("rings"), F.col("grid.crs")))
    boxed = scenes.select(*KEYS, "grid").join(aois.select("aoi_id", "rings"), "aoi_id").withColumn("_box", box)
    cell = lambda value, start, step: (value - start) / step
    left, right = cell(F.col("_box")[0], t[2], t[0]), cell(F.col("_box")[2], t[2], t[0])
    top, bottom = cell(F.col("_box")[3], t[5], t[4]), cell(F.col("_box")[1], t[5], t[4])
    clip = lambda v, size: F.greatest(F.lit(0), F.least(v.cast("int"), F.col(size))).cast("int")
    return boxed.select(
        *KEYS, clip(F.floor(top), "grid.height").alias("top"), clip(F.floor(left), "grid.width").alias("left"),
        clip(F.ceil(bottom), "grid.height").alias("bottom"), clip(F.ceil(right), "grid.width").alias("right"),
    )


def _fill(keys: list[str], values: list[str]):
    def run(key: tuple, tiles: pa.Table, pixels: pa.Table) -> pa.Table:
        top, left, bottom, right = (tiles.column(c)[0].as_py() if tiles.num_rows else 0 for c in ("top", "left", "bottom", "right"))
        height, width = max(bottom - top, 0), max(right - left, 0)
        row, col = pixels.column("row").to_numpy() - top, pixels.column("col").to_numpy() - left
        inside = np.flatnonzero((row >= 0) & (row < height) & (col >= 0) & (col < width))
        at = np.full(height * width, -1, dtype=np.int64)
        at[row[inside] * width + col[inside]] = inside
        source = pa.array(at, mask=at < 0)
        cells = np.arange(height * width)
        columns = {k: pa.array([v.as_py()] * len(cells), v.type) for k, v in zip(keys, key)}
        columns["row"] = pa.array((cells // max(width, 1) + top).astype(np.int32))
        columns["col"] = pa.array((cells % max(width, 1) + left).astype(np.int32))
        return pa.table(columns | {v: pixels.column(v).combine_chunks().take(source) for v in values})

    return run


def fill_windows(pixels: DataFrame, windows: DataFrame, keys: list[str], values: list[str], side: int = TILE) -> DataFrame:
    """Every cell of each window with the values of its pixel, NULL where none is stored.

    ``pixels`` has at most one row per (keys, row, col); ``windows`` has (keys, top, left, bottom, right). A task
    fills one tile, at most ``side * side`` cells.
    """
    whole = windows.where("bottom > top and right > left")
    tiles = whole.withColumn("_tr", F.explode(F.sequence(F.floor(F.col("top") / side), F.floor((F.col("bottom") - 1) / side)))).withColumn(
        "_tc", F.explode(F.sequence(F.floor(F.col("left") / side), F.floor((F.col("right") - 1) / side)))
    ).select(
        *[F.col(k).alias(k) for k in keys], "_tr", "_tc", F.greatest("top", F.col("_tr") * side).alias("top"), F.greatest("left", F.col("_tc") * side).alias("left"),
        F.least("bottom", (F.col("_tr") + 1) * side).alias("bottom"), F.least("right", (F.col("_tc") + 1) * side).alias("right"),
    )
    placed = pixels.select(
        *[F.col(k).alias(k) for k in keys], F.floor(F.col("row") / side).alias("_tr"), F.floor(F.col("col") / side).alias("_tc"), "row", "col", *values
    )
    kind = lambda c: f"{c} {pixels.schema[c].dataType.simpleString()}"
    schema = ", ".join([*map(kind, keys), "row int, col int", *map(kind, values)])
    tile = [*keys, "_tr", "_tc"]
    return tiles.groupBy(*tile).cogroup(placed.groupBy(*tile)).applyInArrow(_fill(keys, values), schema)


def stretch_limits(pixels: DataFrame, inside) -> DataFrame:
    """2nd and 98th percentile per scene and band over valid pixels inside the AOI.

    Exact: equal values are counted before the shuffle, and bands are 16-bit integers, so a scene has at
    most 65,536 counts per band. Bytes are cut at whole numbers, so the last bit of a limit shows.
    """
    accepted = lambda b: inside & spectral.finite(F.col(b)) & (F.col(b) > 0) & F.col("scl").isin(*VALID_CLASSES)
    values = F.array(*[
        F.struct(F.lit(i).alias("band"), F.when(accepted(b), F.col(b).cast("double")).alias("value")) for i, b in enumerate(DISPLAY_BANDS)
    ])
    scale = [*KEYS, "band"]
    counts = pixels.select(*KEYS, F.explode(values).alias("_v")).select(*KEYS, "_v.*").groupBy(*scale, "value").agg(
        F.count("value").alias("n")  # the row of NULL counts nothing and keeps scenes without valid pixels
    )
    seen = Window.partitionBy(*scale)
    ranked = counts.withColumns({"until": F.sum("n").over(seen.orderBy("value")), "last": F.sum("n").over(seen) - 1})
    ends = {}
    for i, b in enumerate(DISPLAY_BANDS):
        for side, q in (("low", 0.02), ("high", 0.98)):
            at = F.col("last") * F.lit(q)
            reached = lambda rank: F.min(F.when((F.col("band") == i) & (F.col("until") > rank), F.col("value")))
            ends[f"{b}_{side}"] = F.struct(
                reached(F.floor(at)).alias("lower"), reached(F.ceil(at)).alias("upper"),
                F.max(F.when(F.col("band") == i, at - F.floor(at))).alias("part"),
            )
    limits = ranked.groupBy(*KEYS).agg(*[e.alias(name) for name, e in ends.items()]).select(
        *KEYS, *[spectral.interpolate(F.col(name)["lower"], F.col(name)["upper"], F.col(name)["part"]).alias(name) for name in ends]
    )
    high = lambda b: F.greatest(F.col(f"{b}_high"), F.when(F.col(f"{b}_high") <= F.col(f"{b}_low"), F.col(f"{b}_low") + 1.0))
    return limits.select(
        *KEYS, *[F.coalesce(f"{b}_low", F.lit(DEFAULT_LOW)).alias(f"{b}_low") for b in DISPLAY_BANDS],
        *[F.coalesce(high(b), F.lit(DEFAULT_HIGH)).alias(f"{b}_high") for b in DISPLAY_BANDS],
    )


def display_pixels(pixels: DataFrame, limits: DataFrame, inside, windows: DataFrame | None = None) -> DataFrame:
    """RGBA bytes; everything inside the AOI is opaque, clouds included.

    With ``windows`` every cell of the crop rectangle is told; cells without a stored pixel are 0 and transparent.
    """
    shown = join_headers(pixels, limits).select(
        *KEYS,
        "row",
        "col",
        *[
            spectral.stretch_byte(F.col(b), F.col(f"{b}_low"), F.col(f"{b}_high"), inside).alias(b)
            for b in DISPLAY_BANDS
        ],
        spectral.alpha_byte(inside, *[F.col(b) for b in DISPLAY_BANDS]).alias("alpha"),
    )
    if windows is None:
        return shown
    filled = fill_windows(shown, windows, KEYS, [*DISPLAY_BANDS, "alpha"])
    return filled.select(*KEYS, "row", "col", *[F.coalesce(c, F.lit(0)).alias(c) for c in (*DISPLAY_BANDS, "alpha")])


def alpha_pixels(pixels: DataFrame, inside, windows: DataFrame) -> DataFrame:
    """The alpha bytes of ``display_pixels`` over every cell of the crop rectangles. No limit shows in them, so none is told."""
    opaque = pixels.select(*KEYS, "row", "col", spectral.alpha_byte(inside, *[F.col(b) for b in DISPLAY_BANDS]).alias("alpha"))
    filled = fill_windows(opaque.where("alpha > 0"), windows, KEYS, ["alpha"])
    return filled.select(*KEYS, "row", "col", F.coalesce("alpha", F.lit(0)).alias("alpha"))


def preview_pixels(pixels: DataFrame, footprint: DataFrame) -> DataFrame:
    """Grey NDVI of each candidate on each of its acquisitions, over the box of its pixels.

    ``footprint`` has (candidate_id, aoi_id, acq_id, row, col): the pixel set of the
    candidate. Cells outside the set, and pixels without an NDVI value or with an empty band, get 235.
    """
    joined = footprint.join(pixels.select(*KEYS, "row", "col", "red", "nir"), [*KEYS, "row", "col"])
    filled = (F.col("red") != 0) & (F.col("nir") != 0)
    value = F.when(filled, spectral.ndvi(F.col("red"), F.col("nir")))
    keys = ["candidate_id", *KEYS]
    windows = footprint.groupBy(*keys).agg(
        F.min("row").alias("top"), F.min("col").alias("left"), (F.max("row") + 1).alias("bottom"), (F.max("col") + 1).alias("right")
    )
    cells = fill_windows(joined.select(*keys, "row", "col", value.alias("value")), windows, keys, ["value"])
    return cells.select(*keys, "row", "col", spectral.ndvi_gray(F.col("value")).alias("gray"))
