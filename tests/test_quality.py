import numpy as np

from helpers import grid, pixel_rows, pixel_table, scene_table
from landshift import schemas
from landshift.config import Policy
from landshift.operators import quality


def test_scene_quality_counts(spark):
    red = np.full((3, 6), 10)
    red[2, 5] = 0
    scl = [[5, 4, 9, 3, 6, 3], [0, 8, 4, 11, 4, 5], [10, 4, 1, 4, 2, 6]]
    pixels = pixel_table(spark, pixel_rows(1, red, np.full((3, 6), 20), scl))
    row = quality.assess_scenes(pixels, scene_table(spark, [1], 6, 3)).first()
    assert (row.invalid_pixels, row.cloud_pixels, row.shadow_pixels, row.usable_pixels) == (5, 3, 2, 8)
    assert row.total_pixels == 18
    assert (row.state, row.reason) == ("valid_unusable", "insufficient_usable_pixels")


def test_half_usable_passes(spark):
    scl = [[5, 4, 9, 3, 6, 4], [0, 8, 4, 9, 4, 5], [10, 4, 1, 4, 2, 3]]
    pixels = pixel_table(spark, pixel_rows(1, np.full((3, 6), 10), np.full((3, 6), 20), scl))
    row = quality.assess_scenes(pixels, scene_table(spark, [1], 6, 3)).first()
    assert row.usable_pixels == 9
    assert (row.state, row.usable_percentage) == ("usable", 50.0)


def test_all_cloud_and_empty_scene(spark):
    pixels = pixel_table(spark, pixel_rows(1, np.full((2, 2), 1), np.full((2, 2), 2), np.full((2, 2), 9)))
    rows = quality.assess_scenes(pixels, scene_table(spark, [1, 2], 2, 2)).collect()
    assert {(r.acq_id, r.state, r.reason, r.invalid_pixels) for r in rows} == {
        (1, "valid_unusable", "no_usable_pixels", 0), (2, "valid_unusable", "no_usable_pixels", 4),
    }


def test_screening_is_an_upper_bound(spark):
    red = np.full((2, 2), 10)
    red[0] = 0
    pixels = pixel_table(spark, pixel_rows(1, red, np.full((2, 2), 20), [[4, 4], [4, 9]]))
    scenes = scene_table(spark, [1], 2, 2)
    assert quality.screen_scenes(pixels, scenes).first().passed
    assert quality.assess_scenes(pixels, scenes).first().state == "valid_unusable"


def test_nearest_resampling_replicates_cells(spark):
    coarse = spark.createDataFrame(
        [(1, 1, 0, 0, 4), (1, 1, 0, 1, 8), (1, 1, 1, 0, 3)], "aoi_id bigint, acq_id bigint, row int, col int, scl int"
    )
    target = spark.createDataFrame(
        [(1, 1, r, c) for r in range(4) for c in range(4)], "aoi_id bigint, acq_id bigint, row int, col int"
    )
    wide = grid(2, 2, transform=[20.0, 0.0, 600000.0, 0.0, -20.0, 5000000.0])
    grids = spark.createDataFrame(
        [(1, 1, grid(4, 4), wide)],
        f"aoi_id bigint, acq_id bigint, target_grid {schemas.GRID}, source_grid {schemas.GRID}",
    )
    rows = quality.resample_nearest(target, coarse, grids).collect()
    found = np.zeros((4, 4), dtype=int)
    for r in rows:
        found[r.row, r.col] = r.scl
    assert found.tolist() == np.repeat(np.repeat([[4, 8], [3, 0]], 2, axis=0), 2, axis=1).tolist()


def test_best_observation_breaks_ties_by_time(spark):
    scl = np.full((2, 2), 4)
    bands = np.full((2, 2), 10), np.full((2, 2), 20)
    pixels = pixel_table(spark, *[pixel_rows(a, *bands, scl) for a in (1, 2, 3)])
    best = quality.best_observation(quality.assess_scenes(pixels, scene_table(spark, [3, 2, 1], 2, 2), Policy()))
    assert best.first().acq_id == 1
