"""Audits: provenance of candidates and constraints of stored tables.

Checks return violations, one row per broken rule; nothing is raised, so one job
reports everything that is wrong.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landshift.config import DECISIONS, OBSERVATION_STATES
from landshift.functions import geometry, text
from landshift.session import materialize
from landshift.sources.tables import aoi_verdict


def missing_references(rows: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no target."""
    known = target.select(F.col(key).alias(column)).distinct()
    return rows.where(F.col(column).isNotNull()).join(known, column, "left_anti")


def _violations(rows: DataFrame, rules: list) -> DataFrame:
    """(candidate_id, rule, detail) of every rule (name, whether it is broken, detail) from one pass over the rows."""
    told = [
        F.when(broken, F.struct(F.lit(rule).alias("rule"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail")))
        for rule, broken, detail in rules
    ]
    return rows.select("candidate_id", F.explode(F.array_compact(F.array(*told))).alias("_v")).select("candidate_id", "_v.rule", "_v.detail")


def audit_candidates(
    candidates: DataFrame,
    analyses: DataFrame,
    signals: DataFrame,
    acquisitions: DataFrame,
    aois: DataFrame,
    runs: DataFrame,
    located: DataFrame,
    boundary: DataFrame | None = None,
) -> DataFrame:
    """Violations of the provenance rules.

    ``located`` lists the candidates with a pixel inside their AOI. Id arrays of a
    candidate are as short as its track, so exploding them is safe. With a ``boundary`` (one row, rings) outlines
    have to be there and inside it, and so do the AOIs, whose rings are then longitudes and latitudes.
    """
    facts = signals.select(
        "analysis_id", "signal_id",
        F.col("detection_run_ids").alias("signal_runs"), F.col("acquisition_ids").alias("signal_acqs"),
    )
    flag = lambda rows, key, name: rows.select(key).distinct().withColumn(name, F.lit(True))
    own = (
        candidates.join(facts, ["analysis_id", "signal_id"], "left")
        .join(flag(analyses, "analysis_id", "_analysed"), "analysis_id", "left")
        .join(flag(located, "candidate_id", "_located"), "candidate_id", "left")
    )
    nothing = F.lit("")
    own_rules = [
        ("missing temporal analysis", F.col("analysis_id").isNotNull() & F.col("_analysed").isNull(), F.col("analysis_id")),
        ("missing temporal signal", F.col("signal_runs").isNull(), F.col("signal_id")),
        ("signal mismatch", (F.col("signal_runs") != F.col("detection_run_ids")) | (F.col("signal_acqs") != F.col("acquisition_ids")), F.col("signal_id")),
        ("no evidence", (F.size("detection_run_ids") == 0) | (F.size("acquisition_ids") == 0), nothing),
        ("outside AOI", F.col("_located").isNull(), nothing),
    ]
    homes_of = aois.select("aoi_id", "rings")
    verdict = F.lit("valid")
    if boundary is not None:
        domain = F.col("_domain")
        own = own.withColumn("_domain", boundary.scalar())
        missing = F.col("geometry").isNull() | (F.size("geometry") == 0)
        # A domain that is a box covers what its bounds do.
        box, bounds = geometry.bounds(domain), geometry.multi_bounds(F.col("geometry"))
        within = (bounds[0] >= box[0]) & (bounds[1] >= box[1]) & (bounds[2] <= box[2]) & (bounds[3] <= box[3])
        inside = within & (geometry.is_box(domain) | F.forall("geometry", lambda rings: geometry.covers(domain, rings)))
        own_rules += [("empty geometry", missing, nothing), ("outside domain", ~missing & ~inside, nothing)]
        homes_of, verdict = homes_of.withColumn("_domain", boundary.scalar()), aoi_verdict(F.col("rings"), domain)
    # One row per AOI, judged once.
    verdicts = materialize(homes_of.select("aoi_id", verdict.alias("verdict")).distinct(), "aoi-verdicts")
    acq_refs = candidates.select("candidate_id", F.explode("acquisition_ids").alias("acq_id")).join(
        acquisitions.select("acq_id", "aoi_id", F.lit(True).alias("_known")), "acq_id", "left"
    )
    homes = acq_refs.where("_known").select("candidate_id", "aoi_id").distinct().join(verdicts, "aoi_id", "left")
    run_refs = candidates.select("candidate_id", "acquisition_ids", F.explode("detection_run_ids").alias("run_id")).join(
        runs.select("run_id", "before_acq", "after_acq"), "run_id", "left"
    )
    foreign = ~F.array_contains("acquisition_ids", F.col("before_acq")) | ~F.array_contains("acquisition_ids", F.col("after_acq"))
    return reduce(DataFrame.unionByName, [
        _violations(own, own_rules),
        _violations(acq_refs, [("missing acquisition", F.col("_known").isNull(), F.col("acq_id"))]),
        _violations(homes, [("missing AOI", F.col("verdict").isNull(), F.col("aoi_id")), ("AOI not accepted", F.col("verdict") != "valid", F.col("verdict"))]),
        _violations(run_refs, [
            ("missing detection run", F.col("before_acq").isNull(), F.col("run_id")), ("foreign acquisition", foreign, F.col("run_id")),
            ("identical acquisitions", F.col("before_acq") == F.col("after_acq"), F.col("run_id")),
        ]),
    ])


def _rule(rows: DataFrame, name: str, key) -> DataFrame:
    return rows.select(F.lit(name).alias("rule"), key.cast("string").alias("key"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def check_constraints(
    acquisitions: DataFrame, runs: DataFrame, regions: DataFrame, reviews: DataFrame, candidates: DataFrame
) -> DataFrame:
    """Violations of keys, references, enumerations and value checks."""
    joined = lambda *columns: F.concat_ws("/", *[F.col(c).cast("string") for c in columns])
    checks = [
        _rule(duplicates(acquisitions, ["aoi_id", "item_id"]), "unique scene per AOI", joined("aoi_id", "item_id")),
        _rule(acquisitions.where(~F.col("state").isin(*OBSERVATION_STATES)), "observation state", F.col("acq_id")),
        _rule(runs.where("before_acq = after_acq"), "distinct acquisitions", F.col("run_id")),
        _rule(missing_references(runs, "before_acq", acquisitions, "acq_id"), "before acquisition exists", F.col("run_id")),
        _rule(missing_references(runs, "after_acq", acquisitions, "acq_id"), "after acquisition exists", F.col("run_id")),
        _rule(missing_references(regions, "run_id", runs, "run_id"), "run exists", F.col("region_id")),
        _rule(duplicates(candidates, ["analysis_id", "signal_id"]), "unique candidate per signal", joined("analysis_id", "signal_id")),
        _rule(missing_references(reviews, "candidate_id", candidates, "candidate_id"), "candidate exists", F.col("log_id")),
        _rule(reviews.where(~F.col("decision").isin(*DECISIONS, "unreviewed")), "review decision", F.col("log_id")),
        _rule(reviews.where(~text.note_fits(F.col("note"))), "note length", F.col("log_id")),
    ]
    return reduce(DataFrame.unionByName, checks)


def removable_aois(aois: DataFrame, acquisitions: DataFrame) -> DataFrame:
    """AOIs with a flag that says whether imagery still refers to them."""
    used = acquisitions.select("aoi_id").distinct().withColumn("in_use", F.lit(True))
    return aois.join(used, "aoi_id", "left").withColumn("in_use", F.coalesce("in_use", F.lit(False)))
