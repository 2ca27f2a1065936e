import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import broadcast_rows, flood_fill, pixel_rows, pixel_table, scene_table
from landshift.config import Policy
from landshift.operators import change, components, quality, regions, tracks
from landshift.session import materialize


def run(spark, before, after, scl_before=None, scl_after=None, policy=None, equal_area=False):
    before, after = np.asarray(before), np.asarray(after)
    red = np.full(before.shape, 2)
    fours = np.full(before.shape, 4)
    pixels = pixel_table(
        spark,
        pixel_rows(1, red, before, fours if scl_before is None else scl_before),
        pixel_rows(2, red, after, fours if scl_after is None else scl_after),
    )
    policy = policy or Policy(min_usable_fraction=0.1)
    scenes = scene_table(spark, [1, 2], before.shape[1], before.shape[0])
    acquisitions = quality.assess_scenes(pixels, scenes, policy)
    return regions.detect(pixels, acquisitions, policy, equal_area=equal_area)


def test_exclusion_counters(spark):
    steady = np.full((2, 3), 6)
    found = run(
        spark, steady, steady, [[4, 8, 0], [4, 4, 3]], [[4, 4, 4], [4, 9, 3]],
        Policy(min_region_pixels=1, min_usable_fraction=0.1),
    )
    row = found.runs.first()
    assert row.quality_valid_pixel_count == 2
    assert row.excluded_cloud_pixel_count == 2
    assert row.excluded_shadow_pixel_count == 1
    assert row.excluded_pixel_count == 4


@pytest.mark.parametrize("minimum,count,filtered", [(1, 2, 5), (4, 1, 4)])
def test_region_filter_keeps_raw_count(spark, minimum, count, filtered):
    before = np.full((4, 4), 6)
    after = before.copy()
    after[0, 0] = 2
    after[2:4, 2:4] = 2
    found = run(spark, before, after, policy=Policy(min_region_pixels=minimum, min_usable_fraction=0.1))
    row = found.runs.first()
    assert (row.region_count, row.raw_changed_pixel_count, row.filtered_changed_pixel_count) == (count, 5, filtered)
    assert row.mean_change_signal == pytest.approx(0.5)
    assert row.changed_pixel_percentage == 31.25


def test_threshold_is_inclusive_in_single_precision(spark):
    before, after = np.full((2, 2), 6), np.full((2, 2), 2)
    found = run(spark, before, after, policy=Policy(threshold=0.5, min_usable_fraction=0.1))
    assert found.runs.first().raw_changed_pixel_count == 4


def test_ring_with_hole_has_equal_area_close_to_nominal(spark):
    before = np.full((5, 5), 6)
    after = np.full((5, 5), 2)
    after[1:4, 1:4] = 6
    row = run(spark, before, after, equal_area=True).regions.first()
    assert row.pixel_count == 16
    assert row.area_m2 == pytest.approx(1600, rel=2e-3)


def test_diagonal_pixels_are_one_region(spark):
    before = np.full((2, 2), 6)
    found = run(spark, before, [[2, 6], [6, 2]], policy=Policy(min_region_pixels=2, min_usable_fraction=0.1))
    row = found.regions.first()
    assert (row.pixel_count, row.area_m2) == (2, 200.0)


def mask_tiles(spark, masks: dict[int, np.ndarray], side: int):
    rows = [(1, k, int(r), int(c), 0.5) for k, m in masks.items() for r, c in zip(*np.nonzero(m))]
    pixels = spark.createDataFrame(rows, "aoi_id bigint, k int, row int, col int, signal float")
    return (
        pixels.withColumn("tile_row", F.floor(F.col("row") / side).cast("int"))
        .withColumn("tile_col", F.floor(F.col("col") / side).cast("int"))
        .groupBy("aoi_id", "tile_row", "tile_col", "k")
        .agg(F.shuffle(F.collect_list(F.struct("row", "col", "signal"))).alias("changed"))
    )


def spiral(size: int) -> np.ndarray:
    mask = np.zeros((size, size), dtype=bool)
    top, left, bottom, right = 0, 0, size - 1, size - 1
    while top <= bottom and left <= right:
        mask[top, left:right + 1] = True
        mask[top:bottom + 1, right] = True
        mask[bottom, left:right + 1] = True
        mask[top + 2:bottom + 1, left] = True
        if top + 2 <= bottom and left + 1 <= right:
            mask[top + 2, left:left + 2] = True
        top, left, bottom, right = top + 2, left + 2, bottom - 2, right - 2
    return mask


@pytest.mark.parametrize("side", [3, 5, 64])
def test_components_match_flood_fill(spark, side):
    rng = np.random.default_rng(side)
    masks = {k: rng.random((23, 31)) < share for k, share in enumerate((0.1, 0.35, 0.45, 0.7))}
    masks[4] = spiral(25)
    policy = Policy(tile=side)
    labelled = components.components(components.label_tiles(mask_tiles(spark, masks, side), policy), policy)
    found = labelled.select(
        "k", "row", "col", components.key_row(F.col("region_key")).alias("r"), components.key_col(F.col("region_key")).alias("c")
    ).collect()
    expected = {(k, *at): first for k, m in masks.items() for at, first in flood_fill(m).items()}
    assert {(x.k, x.row, x.col): (x.r, x.c) for x in found} == expected


def test_full_mask_is_one_component():
    side = 1024
    row, col = np.divmod(np.arange(side * side), side)
    first = components.label_pixels(np.zeros(side * side, dtype=np.int64), row, col)
    assert not first.any()


def test_regions_do_not_depend_on_partitions_or_tiles(spark):
    rng = np.random.default_rng(3)
    before = np.full((19, 17), 6)
    after = np.where(rng.random((19, 17)) < 0.4, 2, 6)
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions, tile in ((1, 256), (7, 4)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found = run(spark, before, after, policy=Policy(tile=tile, min_usable_fraction=0.1))
        rows = found.regions.select("region_no", "first_row", "first_col", "pixel_count", "mean_change_signal").collect()
        results.append(sorted(tuple(r) for r in rows))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1] and results[0]


def test_pixel_gap_is_not_bridged(spark):
    """A pixel that misses the middle observation takes part in no interval."""
    ones = np.full((1, 2), 2)
    middle = [[6, 0]]
    pixels = pixel_table(
        spark, pixel_rows(1, ones, [[6, 6]], [[4, 4]]), pixel_rows(2, ones, middle, [[4, 4]]), pixel_rows(3, ones, [[2, 2]], [[4, 4]]),
    )
    acquisitions = quality.assess_scenes(pixels, scene_table(spark, [1, 2, 3], 2, 1), Policy(min_usable_fraction=0.1))
    pairs = change.pixel_pairs(pixels, change.sequence(change.eligible(acquisitions)))
    assert sorted((r.k, r.col) for r in pairs.collect()) == [(0, 0), (1, 0)]


def test_incomparable_pairs_are_told_and_not_compared(spark):
    """One AOI per rule; AOI 1 has a pair that may be compared."""
    from datetime import datetime

    from helpers import grid

    ok, before, after = grid(4, 4), np.full((4, 4), 6), np.full((4, 4), 2)
    scenes, parts = [], []
    cases = {
        1: ({}, "v", 2), 2: ({"crs": "EPSG:32633"}, "v", 2), 3: ({"transform": [20.0, 0.0, 600000.0, 0.0, -20.0, 5000000.0]}, "v", 2),
        4: ({}, "v", 1), 5: ({}, "other", 2), 6: ({"count": 3}, "v", 2), 7: ({}, "v", 2),
    }
    for aoi, (change_, version, month) in cases.items():
        scl = np.full((4, 4), 4)
        left, right = scl.copy(), scl.copy()
        if aoi == 7:  # usable halves that do not meet
            left[:, :2], right[:, 2:] = 9, 9
        parts += [pixel_rows(10 * aoi, np.full((4, 4), 2), before, left, aoi), pixel_rows(10 * aoi + 1, np.full((4, 4), 2), after, right, aoi)]
        scenes += [(aoi, 10 * aoi, datetime(2024, 1, 1), ok, "v"), (aoi, 10 * aoi + 1, datetime(2024, month, 1), {**ok, **change_}, version)]
    from landshift import schemas

    headers = spark.createDataFrame(scenes, f"aoi_id bigint, acq_id bigint, ts timestamp, grid {schemas.GRID}, processing_version string").withColumns(
        {"state": F.lit("usable"), "usable_percentage": F.lit(50.0)}
    )
    found = regions.detect(pixel_table(spark, *parts), headers, Policy(min_region_pixels=1), equal_area=False)
    assert {(r.aoi_id, r.rule) for r in found.violations.collect()} == {
        (2, "grid: crs"), (3, "grid: transform"), (4, "time order"), (5, "processing version"), (6, "grid: band count"), (7, "no usable pixel"),
    }
    assert [r.aoi_id for r in found.runs.collect()] == [1]
    assert {r.aoi_id for r in found.regions.collect()} == {1}


def test_ids_that_do_not_fit_stop_the_job(spark):
    for aoi, k in ((1 << change.AOI_BITS, 0), (1, 1 << change.INTERVAL_BITS), (-1, 0)):
        frame = spark.createDataFrame([(aoi, k)], "aoi bigint, k int")
        with pytest.raises(Exception, match="does not fit"):
            frame.select(change.run_id(F.col("aoi"), F.col("k"))).collect()
    top = spark.createDataFrame([((1 << change.AOI_BITS) - 1, (1 << change.INTERVAL_BITS) - 1, (1 << change.REGION_BITS) - 1)], "a bigint, k int, n bigint")
    assert top.select(change.region_id(change.run_id(F.col("a"), F.col("k")), F.col("n"))).first()[0] == 2**63 - 1


def scenes_of_growth(spark):
    """Five scenes in which regions appear, grow and vanish."""
    rng = np.random.default_rng(11)
    shape, red = (24, 24), np.full((24, 24), 2)
    rows = []
    for acq in range(1, 6):
        nir = np.full(shape, 6)
        for _ in range(3):
            r, c = rng.integers(0, 18, 2)
            nir[r : r + rng.integers(2, 7), c : c + rng.integers(2, 7)] = 2
        rows.append(pixel_rows(acq, red, nir, np.full(shape, 4)))
    pixels = pixel_table(spark, *rows)
    policy = Policy(tile=8, min_usable_fraction=0.1)
    return pixels, quality.assess_scenes(pixels, scene_table(spark, [1, 2, 3, 4, 5], 24, 24), policy), policy


def test_reused_intervals_are_not_read_and_give_a_full_result(spark):
    pixels, acquisitions, policy = scenes_of_growth(spark)
    full = regions.detect(pixels, acquisitions, policy)
    rows = lambda frame: sorted(map(str, frame.select(*sorted(frame.columns)).collect()))
    # Yesterday scene 3 was not there: the pairs were (1, 2), (2, 4), (4, 5), the last one is interval 3 today.
    order = [r.acq_id for r in change.sequence(change.eligible(acquisitions)).orderBy("seq").collect()]
    missing = order[2]
    old = regions.detect(pixels.where(F.col("acq_id") != missing), acquisitions.where(F.col("acq_id") != missing), policy)
    # Pixels of the first scene are gone: its interval is reused.
    found = regions.detect(pixels.where(F.col("acq_id") != order[0]), acquisitions, policy, store=regions.to_store(old))
    assert sorted(r.k for r in found.tiles.select("k").distinct().collect()) == [1, 2]
    assert rows(found.runs) == rows(full.runs)
    assert rows(found.regions) == rows(full.regions)
    assert rows(found.region_pixels()) == rows(full.region_pixels())
    assert rows(found.intervals) == rows(full.intervals)


def test_reused_regions_are_not_broadcast_once_per_salt(spark):
    pixels, acquisitions, policy = scenes_of_growth(spark)
    full = regions.detect(pixels, acquisitions, policy)
    store = regions.to_store(full)
    stored = regions.Store(store.runs, store.regions, materialize(store.pixels, "stored-pixels"))
    found = regions.detect(pixels, acquisitions, policy, store=stored)
    lines = materialize(tracks.track_regions(found.regions, tracks.sweep(full.region_pixels(), policy)), "tracks")
    rows, sent = broadcast_rows(found.track_pixels(lines))
    assert sorted(rows) == sorted(full.track_pixels(lines).collect()) and rows
    assert max(sent, default=0) <= found.reused_pixels.count() < 64 * lines.count()


def test_a_store_of_other_settings_is_passed_over(spark):
    pixels, acquisitions, policy = scenes_of_growth(spark)
    stored = regions.to_store(regions.detect(pixels, acquisitions, Policy(tile=8, min_usable_fraction=0.1, threshold=0.3)))
    found = regions.detect(pixels, acquisitions, policy, store=stored)
    assert found.reused_pixels.isEmpty() and found.tiles.select("k").distinct().count() == 4


def test_areas_are_those_of_the_projected_corners(spark):
    from landshift.functions import geometry, lattice

    crs, transform = "EPSG:32643", [10.0, 0.0, 600000.0, 0.0, -10.0, 1500000.0]
    made = lattice.cell_areas(crs, transform, 3, 5, 4, 6)
    x, y = F.lit(600000.0) + F.col("c") * 10.0, F.lit(1500000.0) - F.col("r") * 10.0
    cells = spark.createDataFrame([(r, c) for r in range(3, 7) for c in range(5, 11)], "r int, c int")
    want = cells.select("r", "c", geometry.pixel_area_m2(x, y, F.lit(10.0), F.lit(10.0), F.lit(crs)).alias("a")).orderBy("r", "c").collect()
    assert made.ravel() == pytest.approx([w.a for w in want], abs=1e-6)
