import pytest
from pyspark.sql import functions as F

from landshift.functions import geometry
from landshift.schemas import RINGS

SQUARE = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]
DONUT = SQUARE + [[(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)]]
BOW = [[(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]]
SMALL = [[(1.5, 1.5), (2.5, 1.5), (2.5, 2.5), (1.5, 2.5), (1.5, 1.5)]]
EDGE = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]]
FAR = [[(9.0, 9.0), (10.0, 9.0), (10.0, 10.0), (9.0, 9.0)]]
CORNER = [[(4.0, 4.0), (5.0, 4.0), (5.0, 5.0), (4.0, 4.0)]]


def both(spark, left, right, predicate):
    df = spark.createDataFrame([(left, right)], f"a {RINGS}, b {RINGS}")
    return df.select(predicate(F.col("a"), F.col("b"))).first()[0]


@pytest.mark.parametrize("left,right,expected", [
    (SQUARE, SMALL, True), (SQUARE, EDGE, True), (SQUARE, SQUARE, True), (DONUT, SMALL, False), (DONUT, EDGE, False),
    (SMALL, SQUARE, False), (SQUARE, FAR, False), (SQUARE, DONUT, True),
])
def test_covers(spark, left, right, expected):
    assert both(spark, left, right, geometry.covers) is expected


@pytest.mark.parametrize("left,right,expected", [
    (SQUARE, SMALL, True), (SMALL, SQUARE, True), (DONUT, SMALL, False), (SQUARE, CORNER, True), (SQUARE, FAR, False),
])
def test_intersects(spark, left, right, expected):
    assert both(spark, left, right, geometry.intersects) is expected


def test_valid(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate((SQUARE, DONUT, BOW, [[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]))], f"id int, r {RINGS}")
    rows = df.select("id", geometry.is_valid(F.col("r")).alias("v")).collect()
    assert {r.id: r.v for r in rows} == {0: True, 1: True, 2: False, 3: False}


def test_centroid_and_area_with_hole(spark):
    ring = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]
    df = spark.createDataFrame([(SQUARE + [ring],)], f"r {RINGS}")
    row = df.select(geometry.centroid(F.col("r")).alias("c"), geometry.polygon_area(F.col("r")).alias("a")).first()
    assert row.a == 15.0
    assert (row.c.x, row.c.y) == pytest.approx(((32 - 1.5) / 15, (32 - 1.5) / 15))


def test_projections_match_published_figures(spark):
    """Meridian arc of 45 degrees, and the extent of the equal-area grid."""
    row = spark.range(1).select(
        geometry.to_utm(F.lit(9.0), F.lit(45.0), F.lit("EPSG:32632")).alias("u"),
        geometry.to_utm(F.lit(9.0), F.lit(-45.0), F.lit("EPSG:32732")).alias("s"),
        geometry.to_equal_area(F.lit(180.0), F.lit(85.0445664)).alias("e"),
    ).first()
    assert row.u.x == pytest.approx(500000)
    assert row.u.y == pytest.approx(0.9996 * 4984944.378, abs=0.001)
    assert row.s.y == pytest.approx(10000000 - 0.9996 * 4984944.378, abs=0.001)
    assert (row.e.x, row.e.y) == pytest.approx((17367530.45, 7314540.83), abs=0.01)


def ring(*points):
    return [tuple(map(float, p)) for p in (*points, points[0])]


SHELL = ring((0, 0), (10, 0), (10, 10), (0, 10))
HOLE = ring((2, 2), (2, 4), (4, 4), (4, 2))


def judged(spark, expression, rows):
    frame = spark.createDataFrame(rows, f"a {RINGS}, b {RINGS}, want boolean")
    return [(r.got, r.want) for r in frame.select(expression.alias("got"), "want").collect()]


def test_covers_notches_holes_and_shared_edges(spark):
    notch = ring((0, 0), (1, 0), (1.5, 1), (2, 0), (10, 0), (10, 2), (0, 2))
    box = lambda l, b, r, t: [ring((l, b), (r, b), (r, t), (l, t))]
    rows = [
        ([notch], box(0, 0, 10, 2), False), ([notch], box(2, 0, 10, 2), True), ([notch], [notch], True),
        ([SHELL], box(0, 0, 10, 10), True), ([SHELL], box(0, 0, 5, 10), True), ([SHELL], box(5, 5, 11, 6), False),
        ([SHELL, HOLE], box(2, 2, 4, 4), False), ([SHELL, HOLE], box(4, 2, 6, 4), True), ([SHELL, HOLE], box(1, 1, 5, 5), False),
        ([SHELL, HOLE], [SHELL, HOLE], True), ([SHELL, HOLE], [SHELL], False), ([SHELL], [SHELL, HOLE], True),
        ([SHELL, HOLE], [ring((1, 1), (5, 1), (5, 5), (1, 5)), HOLE], True), ([SHELL, HOLE], box(3, 2, 6, 4), False),
    ]
    assert all(got == want for got, want in judged(spark, geometry.covers(F.col("a"), F.col("b")), rows))


def test_valid_polygons(spark):
    repeated = [(0.0, 0.0), (10.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    far = ring((20, 20), (20, 22), (22, 22), (22, 20))
    nested, touching = ring((2.5, 2.5), (2.5, 3), (3, 3), (3, 2.5)), ring((0, 5), (2, 6), (2, 5))
    shared = ring((4, 2), (4, 4), (6, 4), (6, 2))
    bow, spike = ring((0, 0), (4, 4), (4, 0), (0, 4)), ring((0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2))
    rows = [
        ([SHELL], None, True), ([repeated], None, True), ([SHELL, HOLE], None, True), ([SHELL, far], None, False),
        ([SHELL, HOLE, nested], None, False), ([SHELL, HOLE, shared], None, False), ([SHELL, touching], None, True),
        ([bow], None, False), ([spike], None, False), ([HOLE, SHELL], None, False), ([], None, False), (None, None, False),
    ]
    assert all(got == want for got, want in judged(spark, geometry.is_valid(F.col("a")), rows))
