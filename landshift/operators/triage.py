"""Candidates: physical metrics, score, rank, filters, reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.config import DECISIONS
from landshift.functions import scoring, text
from landshift.operators.skew import attach_group_values, rank_within

DEFAULT_DELTA = 0.20


def source_regions(signals: DataFrame, regions: DataFrame) -> DataFrame:
    """Signals joined to their source regions, one row per region."""
    refs = signals.select("analysis_id", "signal_id", F.explode("source_region_ids").alias("region_id"))
    return refs.join(
        regions.select("region_id", "pixel_count", "area_m2", "mean_change_signal", "max_change_signal"),
        "region_id",
    )


def _runs_of(signals: DataFrame, runs: DataFrame) -> DataFrame:
    refs = signals.select("analysis_id", "signal_id", F.explode("detection_run_ids").alias("run_id"))
    return refs.join(
        runs.select("run_id", "total_changed_area_m2", "mean_change_signal", "max_change_signal"), "run_id"
    ).groupBy("analysis_id", "signal_id").agg(
        F.max("total_changed_area_m2").alias("run_area"),
        F.avg("mean_change_signal").alias("run_mean"),
        F.max("max_change_signal").alias("run_max"),
    )


def physical_metrics(signals: DataFrame, regions: DataFrame, runs: DataFrame) -> DataFrame:
    """Add area, mean and maximum change per signal.

    Source regions decide: largest area, mean of means, largest maximum. Without any,
    the interval figures stand in; an unknown area then comes from the runs, and so do
    mean and maximum where the interval lists are empty and a run shows a signal.
    """
    key = ["analysis_id", "signal_id"]
    found = source_regions(signals, regions).groupBy(*key).agg(
        F.max("area_m2").alias("region_area"),
        F.avg("mean_change_signal").alias("region_mean"),
        F.max("max_change_signal").alias("region_max"),
    )
    joined = signals.join(found, key, "left").join(_runs_of(signals, runs), key, "left")
    has_regions = F.col("region_area").isNotNull()
    average = lambda values: F.try_divide(
        F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v), F.size(values)
    )
    positive = lambda value: F.when(value > 0, value)
    mean_delta = F.coalesce(
        average(F.col("interval_means")), positive(F.col("run_mean")), F.lit(DEFAULT_DELTA)
    )
    max_delta = F.coalesce(
        F.array_max("interval_maxima"), positive(F.col("run_max")), F.lit(DEFAULT_DELTA)
    )
    return joined.withColumns({
        "area_m2": F.when(has_regions, F.col("region_area")).otherwise(F.coalesce("run_area", F.lit(0.0))),
        "mean_delta": F.when(has_regions, F.col("region_mean")).otherwise(mean_delta),
        "max_delta": F.when(has_regions, F.col("region_max")).otherwise(max_delta),
    }).drop("region_area", "region_mean", "region_max", "run_area", "run_mean", "run_max")


def triageable(analyses: DataFrame, relationships: DataFrame, runs: DataFrame) -> DataFrame:
    """Analyses checked for completeness: ``verdict`` is ``ok`` or the reason against."""
    checked = (
        relationships.join(
            runs.select(F.col("run_id").alias("detection_run_id"), F.lit(1).alias("known")),
            "detection_run_id", "left",
        )
        .groupBy("analysis_id")
        .agg(F.count(F.lit(1)).alias("relationship_count"), F.count("known").alias("known_runs"))
    )
    count = F.coalesce("relationship_count", F.lit(0))
    return analyses.join(checked, "analysis_id", "left").select(
        "analysis_id",
        "detector_run_count",
        count.cast("bigint").alias("relationship_count"),
        F.when(F.col("state") == "insufficient_history", "insufficient history")
        .when(count != F.col("detector_run_count"), "incomplete detection data")
        .when(F.coalesce("known_runs", F.lit(0)) != count, "missing detection run")
        .otherwise("ok").alias("verdict"),
    )


def score_signals(measured: DataFrame) -> DataFrame:
    """Score, severity, priority and explanation of measured signals."""
    scored = measured.withColumn(
        "parts",
        scoring.score_parts(
            F.col("persistence_ratio"), F.col("temporal_consistency"), F.col("mean_delta"),
            F.col("area_m2"), F.col("quality_support"), F.col("matched_region_coverage"),
        ),
    ).withColumn("score", F.col("parts.score"))
    scored = scored.withColumn(
        "severity",
        scoring.severity(F.col("parts.norm_delta"), F.col("parts.norm_area"), F.col("parts.magnitude")),
    ).withColumn(
        "priority",
        scoring.priority(F.col("state"), F.col("score"), F.col("severity"), F.col("quality_support")),
    )
    return scored.withColumn(
        "candidate_id", text.candidate_id(F.col("analysis_id"), F.col("signal_id"))
    ).withColumn(
        "explanation",
        scoring.explain(
            F.col("parts"), F.col("state"), F.col("severity"), F.col("priority"), F.col("area_m2"),
            F.col("mean_delta"), F.col("quality_support"),
        ),
    )


def triage(
    signals: DataFrame, regions: DataFrame, runs: DataFrame, analyses: DataFrame, relationships: DataFrame
) -> DataFrame:
    """Ranked candidates of every analysis that may be triaged."""
    allowed = triageable(analyses, relationships, runs).where("verdict = 'ok'").select("analysis_id")
    scored = score_signals(physical_metrics(signals.join(allowed, "analysis_id", "left_semi"), regions, runs))
    return rank_within(scored, ["analysis_id"], scoring.rank_order(), "rank")


# --- reviews ----------------------------------------------------------------------


def review_violations(log: DataFrame) -> DataFrame:
    """Log rows that no review may be made of: unknown decision or overlong note."""
    return log.select(
        "log_id",
        "candidate_id",
        F.when(~F.col("decision").isin(*DECISIONS, "unreviewed"), "unknown decision")
        .when(~text.note_fits(F.col("note")), "note too long").alias("rule"),
    ).where(F.col("rule").isNotNull())


def decided():
    """Whether a log row may count: a known decision with a note that fits."""
    return F.col("decision").isin(*DECISIONS, "unreviewed") & text.note_fits(F.col("note"))


def current_reviews(log: DataFrame) -> DataFrame:
    """State of every reviewed candidate after its whole log.

    The newest decision wins. ``unreviewed`` deletes the review, so ``created_at`` is
    the first decision after the last reset.
    """
    valid = log.where(decided())
    at = F.struct("ts", "log_id")
    marked = attach_group_values(
        valid, ["candidate_id"], ["log_id"],
        {"last_reset": (F.max, F.when(F.col("decision") == "unreviewed", at))},
    )
    standing = marked.where(
        (F.col("decision") != "unreviewed") & (F.col("last_reset").isNull() | (at > F.col("last_reset")))
    )
    return standing.groupBy("candidate_id").agg(
        F.max_by("decision", at).alias("decision"),
        F.max_by(F.struct(text.normalize_note(F.col("note")).alias("note")), at)["note"].alias("note"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
    )


def with_review_state(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """The review table alone decides; no review means ``unreviewed``."""
    decided = reviews.select("candidate_id", F.col("decision").alias("review_state"))
    return candidates.join(decided, "candidate_id", "left").withColumn(
        "review_state", F.coalesce("review_state", F.lit("unreviewed"))
    )


def filter_candidates(
    candidates: DataFrame,
    analysis_id: int | None = None,
    priority: str | None = None,
    severity: str | None = None,
    review_state: str | None = None,
    temporal_state: str | None = None,
    min_score: float | None = None,
    min_quality: float | None = None,
) -> DataFrame:
    """Conjunction of the given filters over reviewed candidates."""
    for name, value in {
        "analysis_id": analysis_id, "priority": priority, "severity": severity,
        "review_state": review_state, "state": temporal_state,
    }.items():
        if value is not None:
            candidates = candidates.where(F.col(name) == value)
    if min_score is not None:
        candidates = candidates.where(F.col("score") >= min_score)
    if min_quality is not None:
        candidates = candidates.where(F.col("quality_support") >= min_quality)
    return candidates


def top_candidates(candidates: DataFrame, count: int = 5) -> DataFrame:
    """First candidates of every analysis; the rank is already known."""
    return candidates.where(F.col("rank") <= count)


def page_candidates(candidates: DataFrame, size: int = 20) -> DataFrame:
    """Page number and number of pages per candidate."""
    last = attach_group_values(candidates, ["analysis_id"], ["candidate_id"], {"_last": (F.max, F.col("rank"))})
    number = lambda rank: F.ceil(F.col(rank) / size).cast("int")
    return last.withColumns({"page": number("rank"), "pages": number("_last")}).drop("_last")


KEPT = ("review_state", "created_at", "updated_at")


def upsert_candidates(stored: DataFrame, triaged: DataFrame, now) -> DataFrame:
    """Stored candidates after a new triage, with every field of it: figures, id lists, explanation and outline.

    New values replace old ones; ``created_at`` and the review state of a stored
    candidate stay, and candidates outside the new triage are untouched.
    """
    figures = [c for c in triaged.columns if c != "candidate_id" and c not in KEPT]
    old = stored.select("candidate_id", F.struct(*figures, *KEPT).alias("o"))
    new = triaged.select("candidate_id", F.struct(*figures).alias("n"))
    value = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return old.join(new, "candidate_id", "full_outer").select(
        "candidate_id",
        *[value(c).alias(c) for c in figures],
        F.coalesce("o.review_state", F.lit("unreviewed")).alias("review_state"),
        F.coalesce("o.created_at", now).alias("created_at"),
        F.when(F.col("n").isNotNull(), now).otherwise(F.col("o.updated_at")).alias("updated_at"),
    )


def no_candidates(triaged: DataFrame) -> DataFrame:
    """An empty table of stored candidates."""
    moment = F.lit(None).cast("timestamp")
    return triaged.where("false").withColumns({"review_state": F.lit(""), "created_at": moment, "updated_at": moment})


def mirror_reviews(stored: DataFrame, reviews: DataFrame) -> DataFrame:
    """Stored candidates that show the state of their reviews; a review that is gone leaves ``unreviewed``."""
    decided = reviews.select("candidate_id", F.col("decision").alias("_state"), F.col("updated_at").alias("_at"))
    state = F.coalesce("_state", F.lit("unreviewed"))
    return stored.join(decided, "candidate_id", "left").withColumns({
        "updated_at": F.when(state != F.col("review_state"), F.greatest("updated_at", "_at")).otherwise(F.col("updated_at")), "review_state": state,
    }).select(*stored.columns)
