import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import grid
from landshift import schemas
from landshift.functions import geometry
from landshift.operators import polygons


def outlines(spark, mask):
    cells = [(1, 0, int(r), int(c), 1, int(mask.sum())) for r, c in zip(*np.nonzero(mask))]
    pixels = spark.createDataFrame(cells, "aoi_id bigint, k int, row int, col int, region_no bigint, pixel_count bigint")
    return polygons.polygonize(pixels)


def test_hole(spark):
    mask = np.ones((5, 5), dtype=bool)
    mask[1:4, 1:4] = False
    found = outlines(spark, mask).collect()
    assert len(found) == 1
    rings = [[(p.x, p.y) for p in ring] for ring in found[0].rings]
    assert len(rings) == 2 and len(rings[0]) == 5 and len(rings[1]) == 5


def test_diagonal_pixels_give_two_polygons(spark):
    assert outlines(spark, np.eye(2, dtype=bool)).count() == 2


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_random_masks_keep_area_topology_and_holes(spark, share):
    mask = np.random.default_rng(5).random((30, 30)) < share
    rows = outlines(spark, mask).select(
        geometry.polygon_area(F.col("rings")).alias("a"), geometry.signed_area(F.col("rings")[0]).alias("s"),
        F.size("rings").alias("n"), "rings", geometry.is_valid(F.col("rings")).alias("valid"),
    ).collect()
    assert sum(r.a for r in rows) == mask.sum()
    assert all(r.s > 0 for r in rows)
    joins = (mask[:, 1:] & mask[:, :-1]).sum() + (mask[1:] & mask[:-1]).sum()
    blocks = (mask[1:, 1:] & mask[1:, :-1] & mask[:-1, 1:] & mask[:-1, :-1]).sum()
    assert len(rows) - sum(r.n - 1 for r in rows) == mask.sum() - joins + blocks
    for r in rows:  # every hole lies in the box of its shell
        box = lambda ring: (min(p.x for p in ring), min(p.y for p in ring), max(p.x for p in ring), max(p.y for p in ring))
        shell = box(r.rings[0])
        assert all(shell[0] < b[0] and shell[1] < b[1] and shell[2] > b[2] and shell[3] > b[3] for b in map(box, r.rings[1:]))


def test_nested_islands(spark):
    mask = np.ones((11, 11), dtype=bool)
    mask[1:10, 1:10] = False
    mask[3:8, 3:8] = True
    mask[4:7, 4:7] = False
    mask[5, 5] = True
    found = sorted((r.rings for r in outlines(spark, mask).collect()), key=lambda rings: -len(rings[0]) * 100 - rings[0][0].x * -1)
    assert sorted(len(rings) for rings in found) == [1, 2, 2]
    assert sorted((min(p.x for p in rings[0]), min((p.x for p in rings[1]), default=None) if len(rings) > 1 else None) for rings in found) == [
        (0.0, 1.0), (3.0, 4.0), (5.0, None),
    ]


def test_georeferenced_outline(spark):
    grids = spark.createDataFrame([(1, grid(4, 4))], f"aoi_id bigint, grid {schemas.GRID}")
    row = polygons.georeference(outlines(spark, np.ones((4, 4), dtype=bool)), grids).first()
    corners = {(p.x, p.y) for p in row.map_rings[0]}
    assert corners == {(600000.0, 5000000.0), (600040.0, 5000000.0), (600040.0, 4999960.0), (600000.0, 4999960.0)}
    assert row.geojson.startswith('{"coordinates":[[[')
    assert all(10.2 < p.x < 10.3 and 45.1 < p.y < 45.2 for p in row.lonlat_rings[0])
