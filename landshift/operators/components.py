"""8-connected components over tiled pixels.

Tiles are labelled on their own, in parallel; then only pixels on tile borders are
joined, and the resulting fragment graph is contracted to stars by alternating the
large-star and small-star operations (Kiveris et al., SoCC 2014). A component is
named by its first pixel in row-major order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.config import Policy
from landshift.functions import lattice
from landshift.operators.skew import attach_group_values
from landshift.session import materialize

SCOPE = ["aoi_id", "k"]
NOMINAL_AREA = 100.0  # of a pixel whose grid is not known
LATTICES = 64  # tiles whose cell sizes a task remembers

# Executors need not have this package installed: the labelling functions travel with
# the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pixel_key(row, col):
    """Row-major order as one number, independent of the grid width."""
    return F.shiftleft(row.cast("bigint"), 32) + col.cast("bigint")


def key_row(key):
    return F.shiftright(key, 32).cast("int")


def key_col(key):
    return key.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _roots(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each component, by hooking roots and halving paths."""
    parent = np.arange(count)
    while left.size:
        a, b = parent[left], parent[right]
        open_edges = a != b
        left, right, a, b = left[open_edges], right[open_edges], a[open_edges], b[open_edges]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            shorter = parent[parent]
            if np.array_equal(shorter, parent):
                break
            parent = shorter
    return parent


def _meet(position: np.ndarray, step: int, dense: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sorted positions that are ``step`` apart."""
    if dense is None:
        at = np.searchsorted(position, position + step)
        at[at == position.size] = 0
        hit = np.flatnonzero(position[at] == position + step)
        return hit, at[hit]
    at = dense[position + step]
    hit = np.flatnonzero(at >= 0)
    return hit, at[hit]


def label_pixels(group: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Index of the first pixel, in row-major order, of each pixel's component.

    Groups never connect; the order of the input does not matter. Runs of neighbours in
    a row are merged first, so that only runs enter the component search.
    """
    if group.size == 0:
        return np.zeros(0, dtype=np.int64)
    width = int(col.max()) + 3
    height = int(row.max()) + 2
    position = (group.astype(np.int64) * height + row) * width + col + 1
    order = None
    if np.any(position[1:] < position[:-1]):
        order = np.argsort(position, kind="stable")
        position = position[order]
    starts = np.concatenate([[True], position[1:] != position[:-1] + 1])
    run = np.cumsum(starts) - 1
    dense = None
    if position[-1] < 16 * position.size:
        dense = np.full(int(position[-1]) + width + 2, -1, dtype=np.int64)
        dense[position] = np.arange(position.size)
    left, right = [], []
    for step in (width - 1, width, width + 1):
        a, b = (run[i] for i in _meet(position, step, dense))
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: a.size]
        left.append(a[fresh])
        right.append(b[fresh])
    roots = _roots(int(run[-1]) + 1, np.concatenate(left), np.concatenate(right))
    first = np.flatnonzero(starts)[roots][run]
    if order is None:
        return first
    original = np.empty_like(first)
    original[order] = order[first]
    return original


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), values)


class _Lattices(dict):
    """Cell sizes of the tiles that a task has met lately; the intervals of a tile share them."""

    def __missing__(self, key: tuple) -> np.ndarray:
        if len(self) >= LATTICES:
            self.pop(next(iter(self)))
        crs, transform, top, left, side = key
        self[key] = found = lattice.cell_areas(crs, transform, top, left, side, side)
        return found


def _pixel_areas(batch: pa.RecordBatch, known: _Lattices, group: np.ndarray, local_row: np.ndarray, local_col: np.ndarray) -> np.ndarray:
    """Sizes of all pixels; none at all where no tile has a grid."""
    if batch.column("crs").null_count == batch.num_rows:
        return np.zeros(0)
    areas = np.full(len(group), NOMINAL_AREA)
    bounds = np.searchsorted(group, np.arange(batch.num_rows + 1))
    columns = [batch.column(c).to_pylist() for c in ("crs", "transform", "tile_row", "tile_col", "side")]
    for n, (crs, transform, tile_row, tile_col, side) in enumerate(zip(*columns)):
        at = slice(bounds[n], bounds[n + 1])
        if crs is not None and bounds[n] < bounds[n + 1]:
            areas[at] = known[crs, tuple(transform), tile_row * side, tile_col * side, side][local_row[at], local_col[at]]
    return areas


def _label_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Lattices()
    for batch in batches:
        changed = batch.column("changed")
        pixels = changed.flatten()
        lengths = np.diff(changed.offsets.to_numpy())
        group = np.repeat(np.arange(len(lengths)), lengths)
        side = batch.column("side").to_numpy()
        row = pixels.field("row").to_numpy(zero_copy_only=False).astype(np.int64)
        col = pixels.field("col").to_numpy(zero_copy_only=False).astype(np.int64)
        local_row = row - (batch.column("tile_row").to_numpy() * side)[group]
        local_col = col - (batch.column("tile_col").to_numpy() * side)[group]
        first = label_pixels(group, local_row, local_col)
        labels = (row[first] << 32) + col[first]
        last = side[group] - 1
        edge = np.flatnonzero((local_row == 0) | (local_col == 0) | (local_row == last) | (local_col == last))
        border = pa.StructArray.from_arrays(
            [pa.array(row[edge].astype(np.int32)), pa.array(col[edge].astype(np.int32)), pa.array(labels[edge])],
            names=["row", "col", "label"],
        )
        areas = _pixel_areas(batch, known, group, local_row, local_col)
        names = [n for n in batch.schema.names if n not in ("side", "crs", "transform")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in names]
            + [_lists(lengths, pa.array(labels)), _lists(lengths if len(areas) else 0 * lengths, pa.array(areas)), _lists(np.bincount(group[edge], minlength=len(lengths)), border)],
            names=[*names, "labels", "areas", "border"],
        )


def label_tiles(tiles: DataFrame, policy: Policy = Policy(), headers: DataFrame | None = None) -> DataFrame:
    """Label the changed pixels of every tile on its own.

    Adds ``labels`` and ``areas``, one per entry of ``changed`` (no areas without grids), and ``border``, the labelled pixels on
    the rim of the tile, which is all that joining tiles has to read. ``headers`` (aoi_id, k, grid) give
    equal-area sizes; pixels without a grid count as nominal ones. Headers meet tiles, never pixels.
    """
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiles.schema.fields)
    if headers is None:
        placed = tiles.withColumns({"crs": F.lit(None).cast("string"), "transform": F.lit(None).cast("array<double>")})
    else:
        known = headers.select(*SCOPE, F.col("grid.crs").alias("crs"), F.col("grid.transform").alias("transform"))
        placed = tiles.join(known, SCOPE, "left")
    return placed.select(*tiles.columns, "crs", "transform", F.lit(policy.tile).alias("side")).mapInArrow(
        _label_batches, f"{fields}, labels array<bigint>, areas array<double>, border array<struct<row:int,col:int,label:bigint>>"
    )


def explode_pixels(labelled: DataFrame) -> DataFrame:
    """One row per changed pixel."""
    return labelled.select(
        *SCOPE, F.explode(F.arrays_zip("changed", "labels", "areas")).alias("_p")
    ).select(
        *SCOPE,
        F.col("_p.changed.row").alias("row"),
        F.col("_p.changed.col").alias("col"),
        F.col("_p.changed.signal").alias("signal"),
        F.col("_p.labels").alias("label"),
        F.coalesce("_p.areas", F.lit(NOMINAL_AREA)).alias("area"),
    )


def border_edges(labelled: DataFrame, side: int) -> DataFrame:
    """Pairs of fragments that touch across a tile border, larger label first."""
    edge = labelled.select(*SCOPE, F.inline("border"))
    forward = F.array(*[
        F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"))
        for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))
    ])
    outside = lambda p: (
        (F.floor(p["row"] / side) != F.floor(F.col("row") / side))
        | (F.floor(p["col"] / side) != F.floor(F.col("col") / side))
    )
    reach = edge.select(*SCOPE, F.col("label").alias("a"), F.explode(F.filter(forward, outside)).alias("_p"))
    reach = reach.select(*SCOPE, "a", F.col("_p.row").alias("row"), F.col("_p.col").alias("col"))
    met = reach.join(edge.withColumnRenamed("label", "b"), [*SCOPE, "row", "col"])
    return (
        met.where("a <> b")
        .select(*SCOPE, F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.select(*SCOPE, F.col("small").alias("node"), F.col("big").alias("other")).unionByName(
        edges.select(*SCOPE, F.col("big").alias("node"), F.col("small").alias("other"))
    )
    nearest = attach_group_values(both, [*SCOPE, "node"], ["other"], {"low": (F.min, F.col("other"))})
    return (
        nearest.where("other > node")
        .select(*SCOPE, F.col("other").alias("big"), F.least("low", "node").alias("small"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    nearest = attach_group_values(edges, [*SCOPE, "big"], ["small"], {"low": (F.min, F.col("small"))})
    own = nearest.select(*SCOPE, "big", F.col("low").alias("small"))
    others = nearest.where("small <> low").select(
        *SCOPE, F.col("small").alias("big"), F.col("low").alias("small")
    )
    return own.unionByName(others).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """No node is both centre and leaf, and no leaf has two centres."""
    roles = edges.select(*SCOPE, F.col("big").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(
        edges.select(*SCOPE, F.col("small").alias("node"), F.lit(0).alias("leaf"), F.lit(1).alias("centre"))
    )
    counts = roles.groupBy(*SCOPE, "node").agg(F.sum("leaf").alias("leaf"), F.sum("centre").alias("centre"))
    return counts.where("leaf > 1 or (leaf > 0 and centre > 0)").isEmpty()


def resolve_stars(edges: DataFrame) -> DataFrame:
    """Contract edges until each component is one star around its smallest label.

    The number of rounds grows with the logarithm of the component size. Every round
    is written out, so a lost executor never replays earlier rounds.
    """
    edges = materialize(edges, "fragment-edges")
    while not _is_star_forest(edges):
        edges = materialize(_small_star(_large_star(edges)), "fragment-stars")
    return edges


def connect_fragments(labelled: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Map from tile labels to component labels, for labels that differ."""
    stars = resolve_stars(border_edges(labelled, policy.tile))
    return stars.select(*SCOPE, F.col("big").alias("label"), F.col("small").alias("region_key"))


def components(labelled: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Changed pixels with their component (``region_key``)."""
    return with_region_key(explode_pixels(labelled), connect_fragments(labelled, policy))


def with_region_key(rows: DataFrame, stars: DataFrame) -> DataFrame:
    return rows.join(stars, [*SCOPE, "label"], "left").withColumn(
        "region_key", F.coalesce("region_key", "label")
    )
