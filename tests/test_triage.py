from datetime import datetime

import pytest
from pyspark.sql import functions as F

from landshift.config import PROCESSING_VERSION
from landshift.functions import history, limits, scoring
from landshift.operators import reuse, triage


def score(spark, **changes):
    values = {
        "persistence": 1.0, "consistency": 0.9, "delta": 0.2, "area": 100.0, "quality": 0.0, "coverage": 0.25,
        "state": "persistent", **changes,
    }
    df = spark.createDataFrame([tuple(values.values())], list(values))
    parts = scoring.score_parts(*[F.col(c) for c in ("persistence", "consistency", "delta", "area", "quality", "coverage")])
    df = df.withColumn("p", parts).withColumn(
        "severity", scoring.severity(F.col("p.norm_delta"), F.col("p.norm_area"), F.col("p.magnitude"))
    )
    return df.withColumn(
        "priority", scoring.priority(F.col("state"), F.col("p.score"), F.col("severity"), F.col("quality"))
    ).first()


def test_known_candidate(spark):
    row = score(spark)
    assert row.p.score == pytest.approx(0.575)
    assert (row.severity, row.priority) == ("low", "high")


def test_poor_quality_blocks_urgent(spark):
    assert score(spark, delta=0.9, area=20000.0, quality=0.8).priority == "urgent"
    assert score(spark, delta=0.9, area=20000.0, quality=0.3).priority == "high"


@pytest.mark.parametrize("field", ["persistence", "consistency", "delta", "area", "quality"])
def test_score_is_monotone(spark, field):
    low = {"persistence": 0.3, "consistency": 0.3, "delta": 0.3, "area": 900.0, "quality": 0.3}
    high = {**low, field: low[field] * 1.5}
    assert score(spark, **high).p.score > score(spark, **low).p.score


def test_explanations_are_codes_with_numbers(spark):
    rows = [(1, 0.7, 0.39, 0.4, 0.71), (2, 0.5, 0.5, 0.19, 0.39), (3, 0.1, 0.7, 0.3, 0.0)]
    frame = spark.createDataFrame(rows, "id int, p double, c double, m double, q double")
    parts = F.struct(
        F.col("p").alias("temporal_persistence"), F.col("c").alias("temporal_consistency"),
        F.col("m").alias("change_magnitude"), F.lit(0.6).alias("score"),
    )
    told = scoring.explain(parts, F.lit("persistent"), F.lit("high"), F.lit("urgent"), F.lit(900.0), F.lit(0.3), F.col("q"))
    found = {r.id: r.e for r in frame.select("id", told.alias("e")).collect()}
    names = lambda entries: {m.measure: m.value for m in entries}
    assert names(found[1].raised_by) == {"temporal_persistence": 0.7, "change_magnitude": 0.4, "quality_support": 0.71}
    assert names(found[1].lowered_by) == {"temporal_consistency": 0.39}
    assert names(found[2].raised_by) == {} and names(found[2].lowered_by) == {"change_magnitude": 0.19, "quality_support": 0.39}
    assert names(found[3].lowered_by) == {"temporal_persistence": 0.1}  # no support at all is no weak support
    assert (found[1].severity_basis.area_m2, found[1].priority_basis.priority) == (900.0, "urgent")


def test_limits_name_their_facts(spark):
    rows = [(1, "valid_unusable", "few", "v", True, True), (2, "failed", "", "v", True, True), (3, "usable", None, "old", False, False),
            (4, "acquired", None, "v", True, True), (5, "usable", None, PROCESSING_VERSION, True, True)]
    frame = spark.createDataFrame(rows, "acq_id int, state string, reason string, version string, mask boolean, display boolean")
    told = limits.observation_limits(*[F.col(c) for c in ("acq_id", "state", "reason", "version", "mask", "display")])
    found = {r.acq_id: [(m.code, m.fact) for m in r.t] for r in frame.select("acq_id", told.alias("t")).collect()}
    assert found == {
        1: [("too_few_usable_pixels", "few")], 2: [("preparation_failed", None)], 4: [("preparation_pending", "acquired")], 5: [],
        3: [("no_class_mask", None), ("other_mask_version", "old"), ("no_current_picture", None)],
    }


def test_season_and_gaps(spark):
    df = spark.createDataFrame(
        [(1, [10, 70], 4, [0, 1]), (2, [10, 71], 4, [0, 3]), (3, [360, 5], 5, [0, 2, 3]), (4, [10], 4, [2]), (5, [10, 20], 3, [0, 1])],
        "id int, days array<int>, n int, idx array<int>",
    )
    rows = df.select("id", history.season(F.col("days"), F.col("n"), 60).alias("s"), history.gap_count(F.col("idx")).alias("g")).collect()
    assert {r.id: (r.s, r.g) for r in rows} == {
        1: ("seasonal_compatible", 0), 2: ("less_seasonal_compatible", 1), 3: ("seasonal_compatible", 1),
        4: ("less_seasonal_compatible", 0), 5: ("insufficient_temporal_evidence", 0),
    }


def review_log(spark):
    day = lambda d: datetime(2024, 1, d)
    rows = [
        (1, "a", "accepted", " first ", day(1)), (2, "a", "rejected", None, day(3)),
        (3, "b", "accepted", "x", day(1)), (4, "b", "unreviewed", None, day(2)),
        (5, "c", "accepted", None, day(1)), (6, "c", "unreviewed", None, day(2)), (7, "c", "investigate", "\t", day(5)),
        (8, "d", "maybe", None, day(1)), (9, "e", "accepted", "n" * 2001, day(1)),
    ]
    return spark.createDataFrame(rows, "log_id bigint, candidate_id string, decision string, note string, ts timestamp")


def test_review_log(spark):
    rows = {r.candidate_id: r for r in triage.current_reviews(review_log(spark)).collect()}
    assert set(rows) == {"a", "c"}
    assert (rows["a"].decision, rows["a"].note, rows["a"].created_at.day, rows["a"].updated_at.day) == ("rejected", None, 1, 3)
    assert (rows["c"].decision, rows["c"].note, rows["c"].created_at.day) == ("investigate", None, 5)
    broken = {(r.candidate_id, r.rule) for r in triage.review_violations(review_log(spark)).collect()}
    assert broken == {("d", "unknown decision"), ("e", "note too long")}


def test_only_the_newest_run_is_reused(spark):
    acquisitions = spark.createDataFrame([(1, 7, "usable"), (2, 7, "usable")], "acq_id bigint, aoi_id bigint, state string")
    run = lambda run_id, threshold: (1, 2, run_id, threshold, 4, True, "aoi-observation-quality-v1", "ndvi-absolute-difference-v1")
    schema = (
        "before_acq bigint, after_acq bigint, run_id bigint, threshold double, min_region_pixels int, "
        "quality_mask_used boolean, quality_processing_version string, detector_version string"
    )
    fitting = spark.createDataFrame([run(5, 0.3), run(6, 0.2)], schema)
    outdated = spark.createDataFrame([run(5, 0.2), run(6, 0.3)], schema)
    assert [r.run_id for r in reuse.reusable_runs(fitting, acquisitions).collect()] == [6]
    assert reuse.reusable_runs(outdated, acquisitions).isEmpty()
