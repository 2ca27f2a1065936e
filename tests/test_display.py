"""Display limits."""

import math
import random

from pyspark.sql import functions as F

from landshift.operators import display


def test_limits_round_once_between_two_values(spark):
    draw = random.Random(5)
    scenes = {s: [draw.randint(1, 4000) for _ in range(draw.randint(2, 60))] for s in range(60)}
    rows = [(1, s, i, 0, float(v), float(v), None, 4) for s, values in scenes.items() for i, v in enumerate(values)]
    pixels = spark.createDataFrame(rows, "aoi_id bigint, acq_id bigint, row int, col int, red float, green float, blue float, scl int")
    told = {r.acq_id: r for r in display.stretch_limits(pixels, F.lit(True)).collect()}
    for s, values in scenes.items():
        ordered = sorted(map(float, values))
        for q, limit in ((0.02, told[s].red_low), (0.98, told[s].green_high)):
            at = (len(ordered) - 1) * q
            lower, upper, part = ordered[math.floor(at)], ordered[math.ceil(at)], at - math.floor(at)
            assert limit == math.fma(lower, 1 - part, upper * part)
        assert (told[s].blue_low, told[s].blue_high) == (display.DEFAULT_LOW, display.DEFAULT_HIGH)


def test_alpha_is_told_without_limits(spark):
    draw = random.Random(7)
    value = lambda: draw.choice([None, float(draw.randint(1, 4000))])
    rows = [(1, s, r, c, value(), value(), value(), 4, draw.random() < 0.7) for s in (1, 2) for r in range(9) for c in range(9) if draw.random() < 0.6]
    pixels = spark.createDataFrame(rows, "aoi_id bigint, acq_id bigint, row int, col int, red float, green float, blue float, scl int, inside boolean")
    windows = spark.createDataFrame([(1, s, 1, 0, 8, 12) for s in (1, 2, 3)], "aoi_id bigint, acq_id bigint, top int, left int, bottom int, right int")
    inside = F.col("inside")
    whole = display.display_pixels(pixels, display.stretch_limits(pixels, inside), inside, windows)
    alpha = display.alpha_pixels(pixels, inside, windows)
    assert "Window" not in alpha._jdf.queryExecution().optimizedPlan().toString()
    show = lambda frame: sorted((r.acq_id, r.row, r.col, r.alpha) for r in frame.collect())
    assert show(alpha) == show(whole) and len(show(alpha)) == 3 * 7 * 12


def test_alpha_query_tells_no_limits(spark):
    from landshift.plans.queries import QUERIES

    assert "Window" not in QUERIES["fn_alpha"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
