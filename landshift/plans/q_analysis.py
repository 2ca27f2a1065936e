"""Joins, aggregates, windows and column functions of the analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from landshift.config import SIGNAL_STATES
from landshift.functions import geometry, limits, scoring, spectral, text
from landshift.operators import (
    change, components, display, evidence, polygons, provenance, quality, regions, reuse, signals, tracks, triage,
)
from landshift.plans import fixtures
from landshift.plans.chain import TRACK_KEY, Chain
from landshift.plans.oracle_chain import INSIDE, INSIDE_OF, cte
from landshift.plans.q_sources import artifacts
from landshift.plans.registry import joined, query, r6, sql_list, sql_stamp, stamp
from landshift.sources import tables

double = lambda name: F.col(name).cast("double")


# --- joins ---------------------------------------------------------------------------


@query("join_before_after", """
SELECT aoi_id, k, "row", "col", valid, round(CASE WHEN valid THEN CAST(signal AS DOUBLE) ELSE 0 END, 6) AS signal FROM pairs""", "pairs")
def join_before_after(c):
    return change.pixel_pairs(c.pixels, c.sequence, c.policy).select(
        "aoi_id", "k", "row", "col", "valid", r6(double("signal")).alias("signal")
    )


@query("join_scl_pixels", """
SELECT acq_id, "row", "col", red, CASE WHEN scl = 0 THEN 0 ELSE scl END AS scl FROM px""", "px")
def join_scl_pixels(c):
    """Bands and classes stored apart; classes of nodata pixels are not stored."""
    bands = c.pixels.drop("scl")
    classes = c.pixels.where("scl <> 0").select("aoi_id", "acq_id", "row", "col", "scl")
    return quality.attach_classes(bands, classes).select("acq_id", "row", "col", "red", "scl")


@query("join_resample_nearest", """
SELECT p.acq_id, p."row", p."col", s.scl FROM px p JOIN (
  SELECT acq_id, "row" // 2 AS r2, "col" // 2 AS c2, min(scl) AS scl FROM px GROUP BY ALL) s
ON s.acq_id = p.acq_id AND s.r2 = p."row" // 2 AND s.c2 = p."col" // 2""", "px")
def join_resample_nearest(c):
    """A 20 m class band on the 10 m grid of the bands."""
    coarse = (
        c.pixels.select("aoi_id", "acq_id", F.floor(F.col("row") / 2).cast("int").alias("row"),
                        F.floor(F.col("col") / 2).cast("int").alias("col"), "scl")
        .groupBy("aoi_id", "acq_id", "row", "col").agg(F.min("scl").alias("scl"))
    )
    grids = c.scenes.select(
        "aoi_id", "acq_id", F.col("grid").alias("target_grid"),
        fixtures.grid(F.col("aoi_id"), fixtures.SIDE // 2, 20.0, 1).alias("source_grid"),
    )
    return quality.resample_nearest(c.pixels.select("aoi_id", "acq_id", "row", "col"), coarse, grids).drop("aoi_id")


@query("join_region_overlap", """
SELECT aoi_id, from_k, from_no, k, region_no, shared, round(iou, 6) AS iou FROM overlap_all""", "overlap_all")
def join_region_overlap(c):
    """All touching region pairs, without an IoU limit."""
    return tracks.region_overlap(c.region_pixels, c.policy, minimum=0.0).select(
        "aoi_id", "from_k", "from_no", "k", "region_no", "shared", r6("iou").alias("iou")
    )


@query("join_region_refs", """
SELECT e.aoi_id AS analysis_id, s.signal_id, e.region_id, e.pixel_count, round(e.area_m2::DOUBLE, 2) AS area_m2,
       round(e.mean_change_signal, 6) AS mean_change_signal, round(e.max_change_signal, 6) AS max_change_signal
FROM entries e JOIN signals s USING (aoi_id, birth_k, birth_no)""", "entries", "signals")
def join_region_refs(c):
    return triage.source_regions(c.signals, c.detection.regions).select(
        "analysis_id", "signal_id", "region_id", "pixel_count", F.round("area_m2", 2).alias("area_m2"),
        r6("mean_change_signal").alias("mean_change_signal"), r6("max_change_signal").alias("max_change_signal"),
    )


@query("join_run_acq_acq", """
SELECT u.run_id, b.item_id AS before_item, a.item_id AS after_item, b.aoi_id AS before_aoi, a.aoi_id AS after_aoi
FROM runs u JOIN acq b ON b.acq_id = u.before_acq JOIN acq a ON a.acq_id = u.after_acq""", "runs", "acq")
def join_run_acq_acq(c):
    ends = c.acquisitions.select("acq_id", "item_id", "aoi_id")
    side = lambda name: ends.select(
        F.col("acq_id").alias(f"{name}_acq"), F.col("item_id").alias(f"{name}_item"), F.col("aoi_id").alias(f"{name}_aoi")
    )
    return c.detection.runs.join(side("before"), "before_acq").join(side("after"), "after_acq").select(
        "run_id", "before_item", "after_item", "before_aoi", "after_aoi"
    )


@query("join_candidate_review", "SELECT candidate_id, review_state FROM reviewed", "reviewed")
def join_candidate_review(c):
    return c.reviewed.select("candidate_id", "review_state")


@query("join_acq_aoi", """
SELECT acq_id, item_id, x0::DOUBLE AS left_x, 1499800.0::DOUBLE AS bottom_y, (x0 + 200)::DOUBLE AS right_x, 1500000.0::DOUBLE AS top_y FROM scn""", "scn")
def join_acq_aoi(c):
    from landshift.functions.geometry import bounds

    box = bounds(F.col("rings"))
    return c.acquisitions.join(fixtures.aois(c.spark, c.sf_dir), "aoi_id").select(
        "acq_id", "item_id", box[0].alias("left_x"), box[1].alias("bottom_y"), box[2].alias("right_x"), box[3].alias("top_y")
    )


cte("located", f"""
SELECT DISTINCT c.candidate_id FROM candidates c JOIN entries e USING (aoi_id, birth_k, birth_no)
JOIN rpx ON rpx.aoi_id = e.aoi_id AND rpx.k = e.k AND rpx.region_no = e.region_no WHERE {INSIDE}""", "candidates", "entries", "rpx")


def located(c: Chain):
    """Candidates with at least one pixel centre inside their AOI."""
    pixels = c.track_pixels
    scene = c.scenes.groupBy("aoi_id").agg(F.min("acq_id").alias("acq_id"), F.any_value("grid").alias("grid"))
    inside = tables.clip_to_aoi(
        pixels.join(scene.select("aoi_id", "acq_id"), "aoi_id"), scene, fixtures.aois(c.spark, c.sf_dir)
    )
    tracks_inside = inside.select("aoi_id", "birth_k", "birth_no").distinct()
    return c.candidates.join(tracks_inside, ["aoi_id", "birth_k", "birth_no"], "left_semi").select("candidate_id")


@query("join_geom_intersects", "SELECT candidate_id FROM located", "located")
def join_geom_intersects(c):
    return located(c)


@query("anti_missing_refs", """
SELECT log_id, candidate_id FROM review_log l WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.candidate_id = l.candidate_id)""",
       "review_log", "candidates")
def anti_missing_refs(c):
    log = fixtures.review_log(c.spark, c.sf_dir)
    return provenance.missing_references(log, "candidate_id", c.candidates, "candidate_id").select("log_id", "candidate_id")


@query("semi_aoi_in_use", """
SELECT a.aoi_id, a.aoi_id IN (SELECT aoi_id FROM acq) AS in_use
FROM (SELECT DISTINCT c_custkey AS aoi_id FROM customer) a""", "acq")
def semi_aoi_in_use(c):
    known = fixtures.table(c.spark, c.sf_dir, "customer").select(F.col("c_custkey").alias("aoi_id")).distinct()
    return provenance.removable_aois(known, c.acquisitions)


@query("join_evidence", """
SELECT c.candidate_id, e.run_id, e.before_acq, e.after_acq, e.raw_changed_pixel_count, CAST(count(*) AS INTEGER) AS regions, CAST(sum(e.pixel_count) AS BIGINT) AS pixels
FROM candidates c JOIN entries e USING (aoi_id, birth_k, birth_no)
GROUP BY ALL""", "candidates", "entries")
def join_evidence(c):
    found = evidence.evidence_intervals(c.candidates, c.detection.runs, c.detection.regions)
    return found.select(
        "candidate_id", "run_id", "before_acq", "after_acq", "raw_changed_pixel_count", F.size("regions").alias("regions"),
        F.aggregate("regions", F.lit(0).cast("bigint"), lambda acc, r: acc + r["pixel_count"]).alias("pixels"),
    )


# --- aggregates ------------------------------------------------------------------------

QUALITY_COLUMNS = [
    "acq_id", "total_pixels", "invalid_pixels", "cloud_pixels", "shadow_pixels", "usable_pixels",
    "invalid_percentage", "cloud_percentage", "shadow_percentage", "usable_percentage",
]


@query("agg_scl_screen", f"SELECT {', '.join(QUALITY_COLUMNS)}, state = 'usable' AS passed, reason FROM screened", "screened")
def agg_scl_screen(c):
    return quality.screen_scenes(c.pixels, c.scenes, c.policy).select(*QUALITY_COLUMNS, "passed", "reason")


@query("agg_scene_quality", f"SELECT {', '.join(QUALITY_COLUMNS)}, state, reason FROM acq", "acq")
def agg_scene_quality(c):
    return quality.assess_scenes(c.pixels, c.scenes, c.policy).select(*QUALITY_COLUMNS, "state", "reason")


@query("agg_component_stats", """
SELECT aoi_id, k, CAST(region_key // 20 AS INTEGER) AS first_row, CAST(region_key % 20 AS INTEGER) AS first_col, pixel_count,
       round(mean_change_signal, 6) AS mean_change_signal, round(max_change_signal, 6) AS max_change_signal FROM all_regions""", "all_regions")
def agg_component_stats(c):
    """All components, before the size filter."""
    pixels = components.components(c.detection.tiles, c.policy).withColumn("area", F.lit(100.0))
    fragments = regions.fragment_stats(pixels.drop("label").withColumnRenamed("region_key", "label"))
    stats = regions.region_stats(fragments.withColumnRenamed("label", "region_key"))
    key = F.col("region_key")
    return stats.select(
        "aoi_id", "k", components.key_row(key).alias("first_row"), components.key_col(key).alias("first_col"),
        "pixel_count", r6("mean_change_signal").alias("mean_change_signal"), r6("max_change_signal").alias("max_change_signal"),
    )


RUN_AREAS = ["total_changed_area_m2", "largest_region_area_m2", "mean_region_area_m2", "median_region_area_m2"]


@query("agg_run_stats", f"""
SELECT run_id, region_count, filtered_changed_pixel_count, {', '.join(f'round({a}::DOUBLE, 2) AS {a}' for a in RUN_AREAS)},
       round(mean_change_signal, 6) AS mean_change_signal, round(max_change_signal, 6) AS max_change_signal FROM runs""", "runs")
def agg_run_stats(c):
    return c.detection.runs.select(
        "run_id", "region_count", "filtered_changed_pixel_count", *[F.round(a, 2).alias(a) for a in RUN_AREAS],
        r6("mean_change_signal").alias("mean_change_signal"), r6("max_change_signal").alias("max_change_signal"),
    )


EXCLUSIONS = ["quality_valid_pixel_count", "excluded_pixel_count", "excluded_cloud_pixel_count", "excluded_shadow_pixel_count"]


@query("agg_run_exclusions", f"SELECT run_id, {', '.join(EXCLUSIONS)} FROM runs", "runs")
def agg_run_exclusions(c):
    return c.detection.runs.select("run_id", *EXCLUSIONS)


@query("agg_changed_pct", "SELECT run_id, raw_changed_pixel_count, changed_pixel_percentage FROM runs", "runs")
def agg_changed_pct(c):
    return c.detection.runs.select("run_id", "raw_changed_pixel_count", "changed_pixel_percentage")


@query("agg_interval_totals", """
SELECT aoi_id, interval_count, round(total_quality, 6) AS total_quality, CAST(total_pixels AS BIGINT) AS total_pixels FROM totals""", "totals")
def agg_interval_totals(c):
    return signals.interval_totals(c.detection.runs).select(
        "aoi_id", "interval_count", r6("total_quality").alias("total_quality"), "total_pixels"
    )


TRACK_RATIOS = ["persistence_ratio", "temporal_consistency", "matched_region_coverage", "quality_support"]


@query("agg_track", f"""
SELECT analysis_id, signal_id, support_count, recurrence_count, transient_interval_count,
       {', '.join(f'round({r}, 6) AS {r}' for r in TRACK_RATIOS)}, {sql_list('source_region_ids')} AS source_region_ids,
       {sql_stamp('first_change_ts')} AS first_change_ts, {sql_stamp('last_supporting_ts')} AS last_supporting_ts
FROM signals""", "signals")
def agg_track(c):
    return c.signals.select(
        "analysis_id", "signal_id", "support_count", "recurrence_count", "transient_interval_count",
        *[r6(r).alias(r) for r in TRACK_RATIOS], joined("source_region_ids").alias("source_region_ids"),
        stamp("first_change_ts").alias("first_change_ts"), stamp("last_supporting_ts").alias("last_supporting_ts"),
    )


@query("agg_analysis", """
SELECT analysis_id, observation_count, detector_run_count, round(temporal_span_days, 6) AS temporal_span_days,
       round(quality_support, 6) AS quality_support, state, season FROM analyses""", "analyses")
def agg_analysis(c):
    return c.analyses.select(
        "analysis_id", "observation_count", "detector_run_count", r6("temporal_span_days").alias("temporal_span_days"),
        r6("quality_support").alias("quality_support"), "state", "season",
    )


@query("agg_id_sets", f"""
SELECT analysis_id, signal_id, {sql_list('detection_run_ids')} AS detection_run_ids, {sql_list('acquisition_ids')} AS acquisition_ids FROM signals""", "signals")
def agg_id_sets(c):
    return c.signals.select(
        "analysis_id", "signal_id", joined("detection_run_ids").alias("detection_run_ids"),
        joined("acquisition_ids").alias("acquisition_ids"),
    )


@query("agg_region_union", """
SELECT s.analysis_id, s.signal_id, union_pixels, union_pixels AS outline_pixels, corners, shells_less_holes,
       left_x::BIGINT AS left_x, top_y::BIGINT AS top_y, right_x::BIGINT AS right_x, bottom_y::BIGINT AS bottom_y
FROM signals s JOIN track_shape USING (aoi_id, birth_k, birth_no)""", "signals", "track_shape")
def agg_region_union(c):
    """The regions of a track dissolved: its pixels, and the outline around them."""
    sizes = c.track_pixels.groupBy(*TRACK_KEY).agg(F.count(F.lit(1)).alias("union_pixels"))
    outline = polygons.polygonize(c.track_pixels, TRACK_KEY, side=c.policy.tile)
    box = geometry.bounds(F.col("rings"))
    corners = F.aggregate("rings", F.lit(0), lambda n, ring: n + F.size(ring) - 1)
    figures = outline.groupBy(*TRACK_KEY).agg(
        F.round(F.sum(geometry.polygon_area(F.col("rings")))).cast("bigint").alias("outline_pixels"), F.sum(corners).alias("corners"),
        F.sum(2 - F.size("rings")).alias("shells_less_holes"), F.min(box[0]).cast("bigint").alias("left_x"), F.min(box[1]).cast("bigint").alias("top_y"),
        F.max(box[2]).cast("bigint").alias("right_x"), F.max(box[3]).cast("bigint").alias("bottom_y"),
    )
    return c.signals.join(sizes, TRACK_KEY).join(figures, TRACK_KEY).select("analysis_id", "signal_id", "union_pixels", *figures.columns[3:])


# The ladder of stand-ins: signals whose references or interval figures were removed.
LADDER = """CASE WHEN signal_id % 4 = 0 THEN {full} WHEN signal_id % 4 = 1 THEN {interval} WHEN signal_id % 4 = 2 THEN {run} ELSE {none} END"""
@query("agg_physical_metrics", f"""
SELECT analysis_id, signal_id,
  round({LADDER.format(full='area_m2', interval='runs_area', run='runs_area', none='0.0')}::DOUBLE, 2) AS area_m2,
  round({LADDER.format(full='mean_delta', interval='list_avg(interval_means)', run='CASE WHEN runs_mean > 0 THEN runs_mean ELSE 0.2 END', none='0.2')}, 6) AS mean_delta,
  round({LADDER.format(full='max_delta', interval='list_max(interval_maxima)', run='CASE WHEN runs_max > 0 THEN runs_max ELSE 0.2 END', none='0.2')}, 6) AS max_delta
FROM signals""", "signals")
def agg_physical_metrics(c):
    kind = F.pmod("signal_id", F.lit(4))
    nothing = lambda name, keep: F.when(keep, F.col(name)).otherwise(F.slice(name, 1, 0))
    stripped = c.signals.withColumns({
        "source_region_ids": nothing("source_region_ids", kind == 0),
        "interval_means": nothing("interval_means", kind <= 1),
        "interval_maxima": nothing("interval_maxima", kind <= 1),
        "detection_run_ids": nothing("detection_run_ids", kind <= 2),
    })
    measured = triage.physical_metrics(stripped, c.detection.regions, c.detection.runs)
    return measured.select(
        "analysis_id", "signal_id", F.round("area_m2", 2).alias("area_m2"), r6("mean_delta").alias("mean_delta"),
        r6("max_delta").alias("max_delta"),
    )


def _band_limits(band: str) -> str:
    accepted = f"{INSIDE} AND {band} > 0 AND scl IN (4, 5, 6)"
    low = f"quantile_cont({band}::DOUBLE, 0.02) FILTER ({accepted})"
    high = f"quantile_cont({band}::DOUBLE, 0.98) FILTER ({accepted})"
    return f"coalesce({low}, 0) AS {band}_low, coalesce(CASE WHEN {high} <= {low} THEN {low} + 1 ELSE {high} END, 3000) AS {band}_high"


BANDS = ("red", "green", "blue")
cte("limits", f"SELECT aoi_id, acq_id, {', '.join(_band_limits(b) for b in BANDS)} FROM px_all GROUP BY aoi_id, acq_id", "px_all")
LIMIT_COLUMNS = [f"{b}_{side}" for b in BANDS for side in ("low", "high")]


@query("agg_percentile_stretch", f"SELECT acq_id, {', '.join(f'round({n}, 6) AS {n}' for n in LIMIT_COLUMNS)} FROM limits", "limits")
def agg_percentile_stretch(c):
    return display.stretch_limits(c.located_pixels, F.col("inside")).select("acq_id", *[r6(n).alias(n) for n in LIMIT_COLUMNS])


@query("agg_distinct_checks", """
WITH req AS (SELECT DISTINCT o_custkey AS request_id, (o_orderkey // 1500 + 1) * 100 + o_orderkey % 8 AS acq_id FROM orders),
n AS (SELECT request_id, count(*) AS requested, count(a.aoi_id) AS found, count(DISTINCT a.ts) AS timestamps, count(DISTINCT a.aoi_id) AS aois
      FROM req LEFT JOIN (SELECT DISTINCT l_orderkey // 1500 + 1 AS aoi_id, (l_orderkey // 1500 + 1) * 100 + year(l_shipdate) - 1994 AS acq_id,
        make_date(year(l_shipdate), 1 + (l_orderkey // 1500 + 1) % 12, 15) AS ts FROM lineitem) a USING (acq_id) GROUP BY request_id)
SELECT request_id, requested, found, CASE WHEN found = 0 THEN 'no observations' WHEN found < requested THEN 'missing observations'
  WHEN timestamps < found THEN 'shared timestamp' WHEN aois > 1 THEN 'mixed AOIs' ELSE 'valid' END AS verdict FROM n""")
def agg_distinct_checks(c):
    """Requests made of the orders of a customer, checked against the observations."""
    requests = fixtures.table(c.spark, c.sf_dir, "orders").select(
        F.col("o_custkey").alias("request_id"),
        ((F.floor(F.col("o_orderkey") / fixtures.ORDERS_PER_AOI) + 1) * 100 + F.pmod("o_orderkey", F.lit(8))).alias("acq_id"),
    )
    return change.request_checks(requests, c.acquisitions).select("request_id", "requested", "found", "verdict")


@query("agg_state_counts", f"""
SELECT aoi_id AS analysis_id, {', '.join(f'{s} AS {s}_count' for s in SIGNAL_STATES)} FROM signal_states""", "signal_states")
def agg_state_counts(c):
    return signals.state_counts(c.signals)


@query("agg_observation_counts", """
SELECT aoi_id, count(*) FILTER (state = 'usable') AS usable, count(*) FILTER (state <> 'usable') AS excluded FROM acq GROUP BY aoi_id""", "acq")
def agg_observation_counts(c):
    return c.acquisitions.groupBy("aoi_id").agg(
        F.count_if(F.col("state") == "usable").alias("usable"), F.count_if(F.col("state") != "usable").alias("excluded")
    )


@query("agg_analysis_complete", """
SELECT analysis_id, detector_run_count, r.n - (analysis_id % 3 = 0)::INT AS relationship_count,
       CASE WHEN state = 'insufficient_history' THEN 'insufficient history' WHEN analysis_id % 3 = 0 THEN 'incomplete detection data'
            WHEN analysis_id % 3 = 1 THEN 'missing detection run' ELSE 'ok' END AS verdict
FROM analyses JOIN (SELECT aoi_id AS analysis_id, count(*) AS n FROM runs GROUP BY 1) r USING (analysis_id)""", "analyses", "runs")
def agg_analysis_complete(c):
    """Every third analysis lost a relationship, every other third a run."""
    kind = F.pmod("analysis_id", F.lit(3))
    kept = c.relationships.where(~((kind == 0) & (F.col("k") == 0)))
    runs = c.detection.runs.where(~((F.pmod("aoi_id", F.lit(3)) == 1) & (F.col("k") == 0)))
    return triage.triageable(c.analyses, kept, runs)


# --- windows ---------------------------------------------------------------------------


@query("win_sequence", "SELECT aoi_id, acq_id, seq FROM seqd", "seqd")
def win_sequence(c):
    return c.sequence.select("aoi_id", "acq_id", "seq")


@query("win_adjacent_pairs", "SELECT aoi_id, k, before_acq, after_acq, run_id FROM iv", "iv")
def win_adjacent_pairs(c):
    return change.intervals(c.sequence).select("aoi_id", "k", "before_acq", "after_acq", "run_id")


@query("win_elapsed_days", "SELECT run_id, round(elapsed_days, 6) AS elapsed_days FROM iv", "iv")
def win_elapsed_days(c):
    return change.intervals(c.sequence).select("run_id", r6("elapsed_days").alias("elapsed_days"))


@query("win_strict_increase", f"""
SELECT acq_id, {sql_stamp('ts')} AS ts FROM (
  SELECT *, lag(ts) OVER (PARTITION BY aoi_id ORDER BY ts, acq_id) AS previous_ts FROM (
    SELECT aoi_id, acq_id, make_timestamp(CAST(1994 + (acq_id % 100) // 2 * 2 AS BIGINT), 1, 1, 0, 0, 0.0) AS ts FROM seqd))
WHERE previous_ts >= ts""", "seqd")
def win_strict_increase(c):
    """Timestamps cut to every second year, so that some neighbours are equal."""
    half = F.floor(F.pmod("acq_id", F.lit(100)) / 2) * 2
    coarse = c.sequence.withColumn(
        "ts", F.make_timestamp((1994 + half).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("timestamp")
    )
    return change.order_violations(coarse).select("acq_id", stamp("ts").alias("ts"))


@query("win_interval_quality", "SELECT run_id, round(quality_support, 6) AS quality_support FROM iv", "iv")
def win_interval_quality(c):
    return change.intervals(c.sequence).select("run_id", r6("quality_support").alias("quality_support"))


@query("win_latest_run", """
SELECT before_acq, after_acq, max(run_id) AS run_id FROM stored_runs WHERE aware AND NOT legacy GROUP BY ALL""", "stored_runs")
def win_latest_run(c):
    runs = fixtures.stored_runs(c.spark, c.sf_dir, c.detection.intervals)
    return reuse.newest_runs(runs).select("before_acq", "after_acq", "run_id")


@query("win_region_number", "SELECT run_id, region_no, CAST(first_row AS INTEGER) AS first_row, CAST(first_col AS INTEGER) AS first_col, region_id FROM (SELECT *, (aoi_id << 12) + k AS run_id FROM regions)", "regions")
def win_region_number(c):
    return c.detection.regions.select("run_id", "region_no", "first_row", "first_col", "region_id")


@query("win_recurrence_gaps", "SELECT analysis_id, signal_id, recurrence_count FROM signals", "signals")
def win_recurrence_gaps(c):
    return c.signals.select("analysis_id", "signal_id", "recurrence_count")


@query("win_onset", f"""
SELECT analysis_id, signal_id, onset_before_acq, onset_after_acq, {sql_stamp('onset_start_ts')} AS onset_start,
       {sql_stamp('onset_end_ts')} AS onset_end, {sql_stamp('last_supporting_ts')} AS last_support FROM signals""", "signals")
def win_onset(c):
    return c.signals.select(
        "analysis_id", "signal_id", "onset_before_acq", "onset_after_acq", stamp("onset_start_ts").alias("onset_start"),
        stamp("onset_end_ts").alias("onset_end"), stamp("last_supporting_ts").alias("last_support"),
    )


# One matching step on its own: the regions of interval k against those of k - 1, as if
# each of those were the end of a track.
cte("step_links", "SELECT * FROM links WHERE from_k = k - 1", "links")
cte("step_best", """
SELECT * FROM step_links
QUALIFY row_number() OVER (PARTITION BY aoi_id, k, region_no ORDER BY iou DESC, from_k, from_no) = 1""", "step_links")


def step_matches(c: Chain):
    links = c.overlap.where("from_k = k - 1").select("aoi_id", "k", "region_no", "from_k", "from_no", "iou")
    ends = links.select("aoi_id", F.col("from_k").alias("k"), F.col("from_no").alias("region_no")).distinct()
    starts = tracks.with_births(ends, tracks.no_matches(links))
    return tracks.best_matches(tracks.open_links(links, starts))


STEP = "SELECT aoi_id, from_k, from_no, k, region_no, round(iou, 6) AS iou FROM {}"


@query("win_best_match", STEP.format("step_best"), "step_best")
def win_best_match(c):
    return step_matches(c).select("aoi_id", "from_k", "from_no", "k", "region_no", r6("iou").alias("iou"))


@query("win_track_winner", STEP.format("step_best QUALIFY row_number() OVER (PARTITION BY aoi_id, from_k, from_no ORDER BY region_no) = 1"), "step_best")
def win_track_winner(c):
    return tracks.track_winners(step_matches(c)).select(
        "aoi_id", "from_k", "from_no", "k", "region_no", r6("iou").alias("iou")
    )


@query("win_candidate_rank", "SELECT candidate_id, rank FROM candidates", "candidates")
def win_candidate_rank(c):
    return c.candidates.select("candidate_id", "rank")


@query("win_best_observation", """
SELECT aoi_id, acq_id, usable_percentage FROM acq WHERE state = 'usable'
QUALIFY row_number() OVER (PARTITION BY aoi_id ORDER BY usable_percentage DESC, cloud_percentage, shadow_percentage, ts, item_id) = 1""", "acq")
def win_best_observation(c):
    return quality.best_observation(c.acquisitions).select("aoi_id", "acq_id", "usable_percentage")


@query("sort_signals", f"""
SELECT analysis_id, signal_id, {sql_stamp('first_change_ts')} AS first_change_ts, source_region_ids[1] AS first_region
FROM signals ORDER BY analysis_id, first_change_ts, source_region_ids[1]""", "signals")
def sort_signals(c):
    return signals.sort_signals(c.signals).select(
        "analysis_id", "signal_id", stamp("first_change_ts").alias("first_change_ts"),
        F.col("source_region_ids")[0].alias("first_region"),
    )


@query("top5_candidates", "SELECT analysis_id, candidate_id, rank FROM candidates WHERE rank <= 5", "candidates")
def top5_candidates(c):
    return triage.top_candidates(c.candidates).select("analysis_id", "candidate_id", "rank")


@query("page_candidates", """
SELECT candidate_id, CAST(ceil(rank / 20) AS INTEGER) AS page, CAST(ceil(max(rank) OVER (PARTITION BY analysis_id) / 20) AS INTEGER) AS pages
FROM candidates""", "candidates")
def page_candidates(c):
    return triage.page_candidates(c.candidates).select("candidate_id", "page", "pages")


# --- column functions --------------------------------------------------------------------


@query("fn_ndvi", 'SELECT acq_id, "row", "col", round(CAST(CASE WHEN red + nir <> 0 THEN CAST((nir - red) / (nir + red) AS FLOAT) END AS DOUBLE), 6) AS ndvi FROM px', "px")
def fn_ndvi(c):
    value = spectral.ndvi(F.col("red"), F.col("nir")).cast("double")
    return c.pixels.select("acq_id", "row", "col", r6(value).alias("ndvi"))


@query("fn_abs_delta", 'SELECT aoi_id, k, sum(CAST(round(CASE WHEN valid THEN CAST(signal AS DOUBLE) ELSE 0 END * 1000000) AS BIGINT))::BIGINT AS micro_delta FROM pairs GROUP BY aoi_id, k', "pairs")
def fn_abs_delta(c):
    pairs = change.pixel_pairs(c.pixels, c.sequence, c.policy)
    return pairs.groupBy("aoi_id", "k").agg(
        F.sum(F.round(double("signal") * 1000000).cast("bigint")).alias("micro_delta")
    )


@query("fn_pixel_validity", 'SELECT aoi_id, k, "row", "col", valid, cloud, shadow FROM pairs', "pairs")
def fn_pixel_validity(c):
    return change.pixel_pairs(c.pixels, c.sequence, c.policy).select("aoi_id", "k", "row", "col", "valid", "cloud", "shadow")


@query("fn_scl_class", """
SELECT acq_id, "row", "col", CASE WHEN scl IN (4, 5, 6) THEN 'valid' WHEN scl IN (8, 9, 10) THEN 'cloud' WHEN scl = 3 THEN 'shadow' ELSE 'invalid' END AS class FROM px""", "px")
def fn_scl_class(c):
    return c.pixels.select("acq_id", "row", "col", spectral.scl_class(F.col("scl")).alias("class"))


@query("fn_pct6", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_linenumber / (l_partkey + 1) * 100, 6) AS pct FROM lineitem")
def fn_pct6(c):
    return fixtures.table(c.spark, c.sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        spectral.percentage6(F.col("l_linenumber"), F.col("l_partkey") + 1).alias("pct"),
    )


@query("fn_round4", "SELECT event_id, round(value / 7.0::DOUBLE, 4) AS rounded FROM events")
def fn_round4(c):
    return fixtures.table(c.spark, c.sf_dir, "events").select("event_id", scoring.round4(F.col("value") / 7.0).alias("rounded"))


@query("fn_clamp01", "SELECT event_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (value - 50) / 100.0::DOUBLE)), 6) AS clamped FROM events")
def fn_clamp01(c):
    return fixtures.table(c.spark, c.sf_dir, "events").select("event_id", r6(scoring.clamp01((F.col("value") - 50) / 100.0)).alias("clamped"))


PARTS = {"temporal_persistence": "pers", "temporal_consistency": "cons", "change_magnitude": "magnitude",
         "observation_quality": "qual", "matched_region_coverage": "cover"}


@query("fn_score", f"SELECT candidate_id, score, {', '.join(f'round(CAST({v} AS DECIMAL(20, 12)), 4)::DOUBLE AS {n}' for n, v in PARTS.items())} FROM candidates", "candidates")
def fn_score(c):
    return c.candidates.select("candidate_id", "score", *[F.col(f"parts.{n}").alias(n) for n in PARTS])


@query("fn_severity", "SELECT candidate_id, severity, round(norm_delta, 6) AS norm_delta, round(norm_area, 6) AS norm_area FROM candidates", "candidates")
def fn_severity(c):
    return c.candidates.select("candidate_id", "severity", r6("parts.norm_delta").alias("norm_delta"), r6("parts.norm_area").alias("norm_area"))


@query("fn_priority", "SELECT candidate_id, priority FROM candidates", "candidates")
def fn_priority(c):
    return c.candidates.select("candidate_id", "priority")


@query("fn_temporal_state", "SELECT analysis_id, signal_id, state FROM signals", "signals")
def fn_temporal_state(c):
    return c.signals.select("analysis_id", "signal_id", "state")


@query("fn_analysis_state", "SELECT analysis_id, state FROM analyses", "analyses")
def fn_analysis_state(c):
    return c.analyses.select("analysis_id", "state")


@query("fn_season", "SELECT analysis_id, signal_id, season FROM signals", "signals")
def fn_season(c):
    return c.signals.select("analysis_id", "signal_id", "season")


@query("fn_quality_state", "SELECT acq_id, state, reason FROM acq", "acq")
def fn_quality_state(c):
    return c.acquisitions.select("acq_id", "state", "reason")


cte("explained", """
SELECT candidate_id, severity, priority, state, score, area_m2, mean_delta, quality_support, round(magnitude, 4) AS change_magnitude,
  array_to_string(list_filter([
    CASE WHEN round(pers, 4) >= 0.7 THEN 'temporal_persistence ' || printf('%.4f', round(pers, 4)) END,
    CASE WHEN round(cons, 4) >= 0.7 THEN 'temporal_consistency ' || printf('%.4f', round(cons, 4)) END,
    CASE WHEN round(magnitude, 4) >= 0.4 THEN 'change_magnitude ' || printf('%.4f', round(magnitude, 4)) END,
    CASE WHEN quality_support >= 0.7 THEN 'quality_support ' || printf('%.4f', quality_support) END], lambda x: x IS NOT NULL), '|') AS raised_by,
  array_to_string(list_filter([
    CASE WHEN round(pers, 4) < 0.4 THEN 'temporal_persistence ' || printf('%.4f', round(pers, 4)) END,
    CASE WHEN round(cons, 4) < 0.4 THEN 'temporal_consistency ' || printf('%.4f', round(cons, 4)) END,
    CASE WHEN round(magnitude, 4) < 0.2 THEN 'change_magnitude ' || printf('%.4f', round(magnitude, 4)) END,
    CASE WHEN quality_support > 0 AND quality_support < 0.4 THEN 'quality_support ' || printf('%.4f', quality_support) END], lambda x: x IS NOT NULL), '|') AS lowered_by
FROM candidates""", "candidates")


@query("fn_explain", """
SELECT candidate_id, raised_by, lowered_by, severity, priority, state, round(score, 6) AS score, round(area_m2::DOUBLE, 2) AS area_m2,
       round(mean_delta, 6) AS mean_delta, round(quality_support, 6) AS quality_support, change_magnitude FROM explained""", "explained")
def fn_explain(c):
    e = F.col("explanation")
    told = lambda name: F.array_join(
        F.transform(e[name], lambda m: F.concat_ws(" ", m["measure"], F.format_string("%.4f", m["value"]))), "|"
    ).alias(name)
    basis, urgency = e["severity_basis"], e["priority_basis"]
    return c.candidates.select(
        "candidate_id", told("raised_by"), told("lowered_by"), basis["severity"].alias("severity"),
        urgency["priority"].alias("priority"), urgency["state"].alias("state"), r6(urgency["score"]).alias("score"),
        F.round(basis["area_m2"], 2).alias("area_m2"), r6(basis["mean_delta"]).alias("mean_delta"),
        r6(urgency["quality_support"]).alias("quality_support"), basis["change_magnitude"].alias("change_magnitude"),
    )


cte("observed", """
SELECT acq_id, item_id, reason, usable_percentage,
       CASE acq_id % 8 WHEN 1 THEN 'failed' WHEN 2 THEN 'legacy_unassessed' WHEN 3 THEN 'acquired' ELSE state END AS state,
       acq_id % 9 <> 4 AS has_mask, state = 'usable' AND acq_id % 9 NOT IN (6, 7) AS has_display FROM acq""", "acq")


@query("fn_quality_limits", """
SELECT acq_id, array_to_string(list_filter([
  CASE WHEN state = 'valid_unusable' THEN concat_ws(' ', acq_id, 'too_few_usable_pixels', reason) END,
  CASE WHEN state = 'legacy_unassessed' THEN concat_ws(' ', acq_id, 'never_assessed') END,
  CASE WHEN state = 'failed' THEN concat_ws(' ', acq_id, 'preparation_failed', reason) END,
  CASE WHEN state = 'acquired' THEN concat_ws(' ', acq_id, 'preparation_pending acquired') END,
  CASE WHEN state = 'usable' AND NOT has_mask THEN concat_ws(' ', acq_id, 'no_class_mask') END,
  CASE WHEN state = 'usable' AND NOT has_display THEN concat_ws(' ', acq_id, 'no_current_picture') END,
  CASE WHEN usable_percentage < 50 THEN concat_ws(' ', 'weak_quality_support', CAST(round(usable_percentage / 200, 2) AS VARCHAR)) END
  ], lambda x: x IS NOT NULL), '|') AS limits
FROM observed""", "observed")
def fn_quality_limits(c):
    kind = F.pmod("acq_id", F.lit(8))
    state = F.when(kind == 1, "failed").when(kind == 2, "legacy_unassessed").when(kind == 3, "acquired").otherwise(F.col("state"))
    seen = artifacts(c)
    shown = F.col("has_display") & (F.col("visualization_version") != "rgb-v1")
    texts = limits.observation_limits(
        F.col("acq_id"), state, F.col("reason"), F.col("processing_version"), F.col("has_mask"), shown
    )
    told = lambda found: F.array_join(
        F.transform(found, lambda m: F.concat_ws(" ", m["acq_id"].cast("string"), m["code"], m["fact"])), "|"
    )
    support = F.when(F.col("usable_percentage") < 50, F.col("usable_percentage") / 200).otherwise(1.0)
    return seen.select("acq_id", told(F.concat(texts, limits.signal_limits(support))).alias("limits"))


cte("display", f"""
SELECT s.acq_id, g."row", g."col",
       {', '.join(f"coalesce(CASE WHEN {INSIDE_OF.format('p.')} THEN CAST(floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, ({b}::DOUBLE - {b}_low) / ({b}_high - {b}_low) * 255.0::DOUBLE))) AS INTEGER) END, 0) AS {b}" for b in BANDS)},
       CASE WHEN {INSIDE_OF.format('p.')} THEN 255 ELSE 0 END AS alpha
FROM scn s JOIN limits USING (acq_id) CROSS JOIN (SELECT r::INTEGER AS "row", c::INTEGER AS "col" FROM range(20) a(r), range(20) b(c)) g
LEFT JOIN px_all p ON p.acq_id = s.acq_id AND p."row" = g."row" AND p."col" = g."col" """, "scn", "px_all", "limits")


def shown(c: Chain):
    """Display images over the crop rectangles of all scenes."""
    pixels, inside = c.located_pixels, F.col("inside")
    return display.display_pixels(pixels, display.stretch_limits(pixels, inside), inside, display.aoi_windows(c.scenes, c.aois))


@query("fn_stretch_u8", 'SELECT acq_id, "row", "col", red, green, blue FROM display', "display")
def fn_stretch_u8(c):
    return shown(c).select("acq_id", "row", "col", "red", "green", "blue")


@query("fn_alpha", 'SELECT acq_id, alpha, count(*) AS pixels FROM display GROUP BY acq_id, alpha', "display")
def fn_alpha(c):
    cells = display.alpha_pixels(c.located_pixels, F.col("inside"), display.aoi_windows(c.scenes, c.aois))
    return cells.groupBy("acq_id", "alpha").agg(F.count(F.lit(1)).alias("pixels"))


GRAY = "coalesce(CAST(floor((least(1.0::DOUBLE, greatest(-1.0::DOUBLE, {v})) + 1.0::DOUBLE) * 127.5::DOUBLE) AS INTEGER), 235)"


@query("fn_ndvi_gray", f'SELECT acq_id, "row", "col", {GRAY.format(v="CASE WHEN red + nir <> 0 THEN CAST(CAST((nir - red) / (nir + red) AS FLOAT) AS DOUBLE) END")} AS gray FROM px', "px")
def fn_ndvi_gray(c):
    return c.pixels.select("acq_id", "row", "col", spectral.ndvi_gray(spectral.ndvi(F.col("red"), F.col("nir"))).alias("gray"))


@query("fn_safe_id", r"""
SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') AS path_id, regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') AS file_id FROM pages""")
def fn_safe_id(c):
    return fixtures.table(c.spark, c.sf_dir, "pages").select(
        "page_id", text.safe_path_id(F.col("url")).alias("path_id"), text.safe_file_id(F.col("url")).alias("file_id")
    )


@query("fn_note_normalize", r"""
SELECT conv_id, turn, nullif(regexp_replace(n, '^\s+|\s+$', '', 'g'), '') AS note, length(regexp_replace(n, '^\s+|\s+$', '', 'g')) <= 2000 AS fits
FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN chr(10) || text || '  ' WHEN 1 THEN chr(9) || ' ' ELSE text END AS n FROM conversations)""")
def fn_note_normalize(c):
    kind = F.pmod("turn", F.lit(3))
    note = F.when(kind == 0, F.concat(F.lit("\n"), F.col("text"), F.lit("  "))).when(kind == 1, "\t ").otherwise(F.col("text"))
    return fixtures.table(c.spark, c.sf_dir, "conversations").select(
        "conv_id", "turn", text.normalize_note(note).alias("note"), text.note_fits(note).alias("fits")
    )


@query("fn_parse_ts", """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN strftime(date_trunc('second', ts) - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S')
  ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def fn_parse_ts(c):
    """Event times as text with Z, without offset, with +05:30, and broken."""
    kind = F.pmod("event_id", F.lit(4))
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    written = F.when(kind == 0, F.concat(plain, F.lit("Z"))).when(kind == 1, plain).when(kind == 2, F.concat(plain, F.lit("+05:30"))).otherwise("n/a")
    return fixtures.table(c.spark, c.sf_dir, "events").select("event_id", stamp(text.parse_iso(written)).alias("parsed"))


@query("fn_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50")
def fn_json_field(c):
    """Filter on a field of a JSON column, parsed once into a struct."""
    parsed = F.from_json("props", "struct<k:int>")
    return fixtures.table(c.spark, c.sf_dir, "events").select("event_id", parsed["k"].alias("k")).where("k >= 50")


@query("fn_candidate_id", "SELECT analysis_id, signal_id, candidate_id FROM candidates", "candidates")
def fn_candidate_id(c):
    return c.candidates.select("analysis_id", "signal_id", "candidate_id")
