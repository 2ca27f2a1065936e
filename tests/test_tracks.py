import random

import pytest

from landshift.config import Policy
from landshift.operators import tracks


def tables(spark, regions):
    pixels, sizes = [], []
    for k, found in regions.items():
        for no, cells in enumerate(found, start=1):
            sizes.append((1, k, no, len(cells)))
            pixels += [(1, k, r, c, no, len(cells)) for r, c in cells]
    return (
        spark.createDataFrame(pixels, "aoi_id bigint, k int, row int, col int, region_no bigint, pixel_count bigint"),
        spark.createDataFrame(sizes, "aoi_id bigint, k int, region_no bigint, pixel_count bigint"),
    )


def box(top, left, height, width):
    return {(r, c) for r in range(top, top + height) for c in range(left, left + width)}


def track(spark, regions, threshold=0.25):
    pixels, sizes = tables(spark, regions)
    policy = Policy(iou_threshold=threshold, tile=4)
    found = tracks.track_regions(sizes, tracks.sweep(pixels, policy)).collect()
    assert len(found) == sum(len(v) for v in regions.values())
    return {(r.k, r.region_no): ((r.birth_k, r.birth_no), round(r.iou, 9)) for r in found}


def holds_rules(regions, found, threshold):
    """What any right assignment fulfils, read off the assignment itself."""
    members: dict = {}
    for (k, no), (birth, _) in sorted(found.items()):
        members.setdefault(birth, []).append((k, no))
    pixels = lambda region: regions[region[0]][region[1] - 1]
    shared = lambda a, b: len(pixels(a) & pixels(b)) / len(pixels(a) | pixels(b))
    before = lambda birth, k: max((m for m in members[birth] if m[0] < k), default=None)

    def favourite(region):
        """The open track that a region overlaps most; the oldest of equals."""
        ends = [(birth, before(birth, region[0])) for birth in members]
        fits = [(shared(end, region), birth) for birth, end in ends if end and shared(end, region) >= threshold]
        return min(fits, key=lambda f: (-f[0], f[1]), default=(None, None))

    for birth, line in members.items():
        assert line[0] == birth and len({k for k, _ in line}) == len(line)
    for region, (birth, iou) in found.items():
        best, wanted = favourite(region)
        if birth != region:  # it continues the track it fits best, and no region before it wanted that one
            assert birth == wanted and abs(iou - best) < 1e-9
            assert all(favourite((region[0], no))[1] != wanted for no in range(1, region[1]))
        elif wanted is not None:  # it lost its favourite to a region before it
            assert iou == 1.0
            assert any(favourite((region[0], no))[1] == wanted for no in range(1, region[1]))


def test_gap_is_linked_and_identical_regions_have_full_overlap(spark):
    regions = {0: [box(0, 0, 3, 3)], 1: [box(8, 8, 2, 2)], 2: [box(0, 0, 3, 3)]}
    found = track(spark, regions)
    assert found[(2, 1)] == ((0, 1), 1.0)
    assert found[(1, 1)] == ((1, 1), 1.0)


def test_loser_starts_a_new_track_without_second_choice(spark):
    """Both later regions fit the first track best; the second could also take the other."""
    regions = {0: [box(0, 0, 4, 8), box(0, 8, 4, 2)], 1: [box(0, 0, 4, 4), box(0, 4, 4, 6)]}
    # 16 of 32 and 16 of 40 pixels with the first track; the second track holds 8 of 24.
    assert track(spark, regions) == {(0, 1): ((0, 1), 1.0), (0, 2): ((0, 2), 1.0), (1, 1): ((0, 1), 0.5), (1, 2): ((1, 2), 1.0)}


@pytest.mark.parametrize("seed", range(3))
def test_random_sequences_follow_the_rules(spark, seed):
    rng = random.Random(seed)
    regions = {}
    for k in range(5):
        used, found = set(), []
        for _ in range(8):
            cells = box(rng.randrange(8), rng.randrange(8), rng.randint(2, 4), rng.randint(2, 4)) - used
            if len(cells) >= 2:
                used |= cells
                found.append(cells)
        regions[k] = found
    holds_rules(regions, track(spark, regions, 0.2), 0.2)


def pairs_of(spark, regions, **options):
    pixels, _ = tables(spark, regions)
    return tracks.sweep(pixels, Policy(iou_threshold=0.25, tile=4), **options).collect()


def test_a_stable_field_is_compared_once_per_interval(spark):
    """Six intervals with the same two regions: five pairs each, not 15."""
    regions = {k: [box(0, 0, 5, 5), box(0, 7, 3, 3)] for k in range(6)}
    found = pairs_of(spark, regions)
    assert sorted((p.from_k, p.from_no, p.k, p.region_no, p.iou) for p in found) == sorted(
        (k, no, k + 1, no, 1.0) for k in range(5) for no in (1, 2)
    )
    assert {(p.birth_k, p.won) for p in found} == {(0, True)}


def test_overlap_tells_pairs_that_no_track_links(spark):
    """Three intervals with the same region, and a smaller one: all pairs, not only those of open ends."""
    pixels, _ = tables(spark, {0: [box(0, 0, 5, 5)], 1: [box(0, 0, 5, 5)], 2: [box(0, 0, 5, 5)], 3: [box(0, 0, 2, 2)]})
    policy = Policy(iou_threshold=0.25, tile=4)
    told = lambda **options: sorted((p.from_k, p.k, p.shared) for p in tracks.region_overlap(pixels, policy, **options).collect())
    assert told() == [(0, 1, 25), (0, 2, 25), (1, 2, 25)]
    assert told(minimum=0.0) == [(0, 1, 25), (0, 2, 25), (0, 3, 4), (1, 2, 25), (1, 3, 4), (2, 3, 4)]


def test_an_end_that_another_face_closed_is_passed_over(spark):
    """The first region is continued on its left half; its right half is covered again much later."""
    regions = {0: [box(0, 0, 4, 8)], 1: [box(0, 0, 4, 5)], 3: [box(0, 5, 4, 3)], 4: [box(0, 0, 4, 8)]}
    found = {(p.from_k, p.k): (p.shared, p.won) for p in pairs_of(spark, regions, minimum=0.0)}
    assert found == {(0, 1): (20, True), (1, 4): (20, True), (3, 4): (12, False)}


def test_ends_stay_open_over_any_gap(spark):
    regions = {0: [box(0, 0, 3, 3)], 40: [box(0, 0, 3, 4)], 41: [box(9, 9, 2, 2)]}
    found = pairs_of(spark, regions)
    assert [(p.from_k, p.k, p.shared, p.won) for p in found] == [(0, 40, 9, True)]
    assert pairs_of(spark, {5: [box(0, 0, 3, 3)]}) == []
