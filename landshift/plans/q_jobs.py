"""Geometry, iterative operators, composite jobs and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from landshift.functions import geometry
from landshift.operators import components, display, polygons, provenance, regions, reuse, tracks
from landshift.operators.skew import spread_rows
from landshift.plans import fixtures, jobs
from landshift.plans.chain import Chain
from landshift.plans.oracle_chain import INSIDE, UTM, cte, sql_series
from landshift.plans.q_analysis import GRAY, located, shown
from landshift.plans.q_sources import (
    EXPORT_NEEDS, EXPORT_SQL, artifacts, assembled, discovered, export_fields, exported, items, raw_aois, reusable,
)
from landshift.plans.registry import query, r6, sql_stamp, stamp
from landshift.session import materialize, stage_path
from landshift.sources import tables
from landshift.streaming import jobs as streams

# --- geometry ------------------------------------------------------------------------

# An L-shaped polygon per customer, a point and a small square next to or in it.
cte("shapes", """
SELECT c_custkey AS id, 75.0::DOUBLE + (c_custkey % 24) * 0.125 AS l, 12.0::DOUBLE + c_nationkey * 0.125 AS b,
       (c_custkey % 10) * 0.05::DOUBLE + 0.025 AS px, (c_nationkey % 10) * 0.05::DOUBLE + 0.025 AS py,
       (c_custkey % 16) * 0.05::DOUBLE - 0.19 AS qx, (c_nationkey % 13) * 0.05::DOUBLE - 0.14 AS qy
FROM customer""")


def shapes(c: Chain):
    base = spread_rows(fixtures.table(c.spark, c.sf_dir, "customer")).select(
        F.col("c_custkey").alias("id"),
        (F.lit(75.0) + F.pmod("c_custkey", F.lit(24)) * 0.125).alias("l"),
        (F.lit(12.0) + F.col("c_nationkey") * 0.125).alias("b"),
        (F.pmod("c_custkey", F.lit(10)) * 0.05 + 0.025).alias("px"),
        (F.pmod("c_nationkey", F.lit(10)) * 0.05 + 0.025).alias("py"),
        (F.pmod("c_custkey", F.lit(16)) * 0.05 - 0.19).alias("qx"),
        (F.pmod("c_nationkey", F.lit(13)) * 0.05 - 0.14).alias("qy"),
    )
    l, b = F.col("l"), F.col("b")
    at = lambda dx, dy: F.struct((l + dx).alias("x"), (b + dy).alias("y"))
    ell = F.array(F.array(at(0, 0), at(0.5, 0), at(0.5, 0.25), at(0.25, 0.25), at(0.25, 0.5), at(0, 0.5), at(0, 0)))
    square = fixtures.box(l + F.col("qx"), b + F.col("qy"), l + F.col("qx") + 0.1, b + F.col("qy") + 0.1)
    return base.withColumns({"ell": ell, "square": square})


@query("geo_bounds", "SELECT item_id, fl AS left_x, fb AS bottom_y, fr AS right_x, ft AS top_y FROM items WHERE has_footprint", "items")
def geo_bounds(c):
    box = geometry.bounds(F.col("rings"))
    return items(c).where(F.col("rings").isNotNull()).select(
        "item_id", box[0].alias("left_x"), box[1].alias("bottom_y"), box[2].alias("right_x"), box[3].alias("top_y")
    )


@query("geo_centroid", "SELECT id, round(l + 0.625::DOUBLE / 3, 6) AS x, round(b + 0.625::DOUBLE / 3, 6) AS y, 0.1875::DOUBLE AS area FROM shapes", "shapes")
def geo_centroid(c):
    middle = geometry.centroid(F.col("ell"))
    return shapes(c).select(
        "id", r6(middle["x"]).alias("x"), r6(middle["y"]).alias("y"), r6(geometry.polygon_area(F.col("ell"))).alias("area")
    )


@query("geo_contains_point", "SELECT id, (px < 0.5 AND py < 0.25) OR (px < 0.25 AND py < 0.5) AS inside FROM shapes", "shapes")
def geo_contains_point(c):
    x, y = F.col("l") + F.col("px"), F.col("b") + F.col("py")
    return shapes(c).select("id", geometry.contains_point(F.col("ell"), x, y).alias("inside"))


@query("geo_covers", """
SELECT id, qx > 0 AND qy > 0 AND qx + 0.1 < 0.5 AND qy + 0.1 < 0.5 AND NOT (qx + 0.1 > 0.25 AND qy + 0.1 > 0.25) AS covered FROM shapes""", "shapes")
def geo_covers(c):
    return shapes(c).select("id", geometry.covers(F.col("ell"), F.col("square")).alias("covered"))


@query("geo_intersects", """
SELECT id, qx < 0.5 AND qx + 0.1 > 0 AND qy < 0.5 AND qy + 0.1 > 0 AND NOT (qx > 0.25 AND qy > 0.25) AS meets FROM shapes""", "shapes")
def geo_intersects(c):
    return shapes(c).select("id", geometry.intersects(F.col("ell"), F.col("square")).alias("meets"))


@query("geo_valid", "SELECT aoi_id, kind <> 3 AS valid FROM raw_aoi WHERE kind < 4", "raw_aoi")
def geo_valid(c):
    return tables.parse_aois(raw_aois(c)).where(F.col("rings").isNotNull()).select(
        "aoi_id", geometry.is_valid(F.col("rings")).alias("valid")
    )


G = geometry
cte("utm", f"""
SELECT id, lon, lat, 500000 + {UTM!r}::DOUBLE * (eta0 + {sql_series(G.ALPHA, 'cos({m} * xi0) * sinh({m} * eta0)')}) AS easting,
       {UTM!r}::DOUBLE * (xi0 + {sql_series(G.ALPHA, 'sin({m} * xi0) * cosh({m} * eta0)')}) AS northing
FROM (SELECT *, atan2(t, cos(lam)) AS xi0, atanh(sin(lam) / sqrt(1 + t * t)) AS eta0
  FROM (SELECT *, sinh(atanh(sin(radians(lat))) - {G.ECC!r}::DOUBLE * atanh({G.ECC!r}::DOUBLE * sin(radians(lat)))) AS t, radians(lon - 75) AS lam
    FROM (SELECT id, l AS lon, b AS lat FROM shapes)))""", "shapes")


@query("geo_project", """
SELECT id, round(easting, 3) AS easting, round(northing, 3) AS northing, round(lon, 6) AS lon, round(lat, 6) AS lat FROM utm""", "utm")
def geo_project(c):
    """Longitude/latitude to UTM zone 43 and back."""
    crs = F.lit("EPSG:32643")
    there = shapes(c).withColumn("u", geometry.to_utm(F.col("l"), F.col("b"), crs))
    back = there.withColumn("g", geometry.from_utm(F.col("u.x"), F.col("u.y"), crs))
    return back.select(
        "id", F.round("u.x", 3).alias("easting"), F.round("u.y", 3).alias("northing"),
        r6("g.x").alias("lon"), r6("g.y").alias("lat"),
    )


@query("agg_region_area", "SELECT aoi_id, k, region_no, round(area_m2, 2) AS area_m2 FROM regions", "regions")
def agg_region_area(c):
    return c.detection.region_areas().select("aoi_id", "k", "region_no", F.round("area_m2", 2).alias("area_m2"))


# --- iterative operators ----------------------------------------------------------------


@query("cc_regions", 'SELECT aoi_id, k, "row", "col", CAST(region_key // 20 AS INTEGER) AS first_row, CAST(region_key % 20 AS INTEGER) AS first_col FROM comp', "comp")
def cc_regions(c):
    labelled = components.components(c.detection.tiles, c.policy)
    key = F.col("region_key")
    return labelled.select(
        "aoi_id", "k", "row", "col", components.key_row(key).alias("first_row"), components.key_col(key).alias("first_col")
    )


@query("track_regions", "SELECT aoi_id, k, region_no, birth_k, birth_no, round(iou, 6) AS iou, from_k, from_no FROM tracks", "tracks")
def track_regions(c):
    found = tracks.track_regions(c.detection.regions, c.overlap)
    return found.select("aoi_id", "k", "region_no", "birth_k", "birth_no", r6("iou").alias("iou"), "from_k", "from_no")


# Figures of an outline from pixels alone: a grid corner with one or three region pixels around it
# is one vertex, one with two that face each other is two; polygons less holes are pixels less
# neighbour pairs plus full blocks of four.
cte("around", """
SELECT aoi_id, k, region_no, "row" + dy AS y, "col" + dx AS x, count(*) AS n, min((dx + dy) % 2) = max((dx + dy) % 2) AS facing
FROM rpx, range(2) a(dy), range(2) b(dx) GROUP BY ALL""", "rpx")
cte("beside", """
SELECT p.aoi_id, p.k, p.region_no, count(*) AS pairs FROM rpx p JOIN rpx q
  ON p.aoi_id = q.aoi_id AND p.k = q.k AND p.region_no = q.region_no
 AND ((q."row" = p."row" AND q."col" = p."col" + 1) OR (q."row" = p."row" + 1 AND q."col" = p."col"))
GROUP BY ALL""", "rpx")


@query("polygonize", """
SELECT r.aoi_id, r.k, r.region_no, r.pixel_count AS area_pixels, v.vertices, r.pixel_count - coalesce(b.pairs, 0) + v.blocks AS shells_less_holes,
       v.left_x, v.top_y, v.right_x, v.bottom_y
FROM regions r JOIN (
  SELECT aoi_id, k, region_no, CAST(sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND facing THEN 2 ELSE 0 END) AS BIGINT) AS vertices,
         count(*) FILTER (n = 4) AS blocks, CAST(min(x) AS DOUBLE) AS left_x, CAST(min(y) AS DOUBLE) AS top_y,
         CAST(max(x) AS DOUBLE) AS right_x, CAST(max(y) AS DOUBLE) AS bottom_y
  FROM around GROUP BY ALL) v USING (aoi_id, k, region_no)
LEFT JOIN beside b USING (aoi_id, k, region_no)""", "regions", "around", "beside")
def polygonize(c):
    """Outlines per region: area, vertices, shells less holes, and box."""
    box = geometry.bounds(F.col("rings"))
    corners = F.aggregate("rings", F.lit(0), lambda n, ring: n + F.size(ring) - 1)
    return polygons.polygonize(c.region_pixels, side=c.policy.tile).groupBy("aoi_id", "k", "region_no").agg(
        F.round(F.sum(geometry.polygon_area(F.col("rings")))).cast("bigint").alias("area_pixels"),
        F.sum(corners).alias("vertices"), F.sum(2 - F.size("rings")).alias("shells_less_holes"),
        F.min(box[0]).alias("left_x"), F.min(box[1]).alias("top_y"), F.max(box[2]).alias("right_x"), F.max(box[3]).alias("bottom_y"),
    )


# --- composite jobs ----------------------------------------------------------------------

cte("clipped_counts", f"""
SELECT s.acq_id, count(*) FILTER (red + nir <> 0 AND scl IN (4, 5, 6) AND {INSIDE}) AS usable
FROM scn s JOIN px_all p ON p.acq_id = s.acq_id GROUP BY s.acq_id""", "scn", "px_all")
cte("observations", """
SELECT a.aoi_id, a.acq_id, a.item_id, a.ts,
  CASE WHEN kept THEN 'available' WHEN s.state <> 'usable' THEN 'screened_unusable' ELSE 'completed' END AS origin,
  CASE WHEN kept THEN a.state WHEN s.state <> 'usable' THEN s.state WHEN c.usable >= 200 THEN 'usable' ELSE 'valid_unusable' END AS state,
  CASE WHEN kept THEN a.usable_percentage WHEN s.state <> 'usable' THEN s.usable_percentage ELSE round(c.usable / 400 * 100, 6) END AS usable_percentage
FROM (SELECT *, CASE WHEN state = 'usable' THEN acq_id % 9 NOT IN (4, 5, 6, 7) ELSE acq_id % 9 <> 4 END AS kept FROM acq) a
JOIN screened s USING (acq_id) JOIN clipped_counts c USING (acq_id)""", "acq", "screened", "clipped_counts")


@query("job_acquire", "SELECT aoi_id, acq_id, origin, state, usable_percentage FROM observations", "observations")
def job_acquire(c):
    found = jobs.acquire(c.raw_pixels, c.scenes, c.aois, artifacts(c), c.policy)
    return found.select("aoi_id", "acq_id", "origin", "state", "usable_percentage")


@query("job_detect", """
SELECT r.aoi_id, r.k, u.before_acq, u.after_acq, r.region_no, r.pixel_count, round(r.area_m2, 2) AS area_m2,
       round(r.mean_change_signal, 6) AS mean_change_signal, round(r.max_change_signal, 6) AS max_change_signal, u.changed_pixel_percentage
FROM regions r JOIN runs u USING (aoi_id, k)""", "regions", "runs")
def job_detect(c):
    found = c.detection
    figures = found.runs.select("aoi_id", "k", "before_acq", "after_acq", "changed_pixel_percentage")
    return found.regions.join(figures, ["aoi_id", "k"]).select(
        "aoi_id", "k", "before_acq", "after_acq", "region_no", "pixel_count", F.round("area_m2", 2).alias("area_m2"),
        r6("mean_change_signal").alias("mean_change_signal"), r6("max_change_signal").alias("max_change_signal"),
        "changed_pixel_percentage",
    )


OUTLINE_SQL = "corners, shells_less_holes, left_lon, bottom_lat, right_lon, top_lat"


def outline_figures():
    """Corners, polygons less holes, and box of a column ``geometry``."""
    box = geometry.multi_bounds(F.col("geometry"))
    names = ("left_lon", "bottom_lat", "right_lon", "top_lat")
    parts = F.aggregate("geometry", F.lit(0), lambda n, rings: n + 2 - F.size(rings))
    return [
        geometry.multi_corners(F.col("geometry")).cast("bigint").alias("corners"), parts.cast("bigint").alias("shells_less_holes"),
        *[r6(box[k]).alias(name) for k, name in enumerate(names)],
    ]


# The verdict of an analysis is looked up in a map: DuckDB does not end on this join with the recursive parts below it.
@query("job_temporal", f"""
SELECT s.analysis_id, s.signal_id, s.state, s.season, s.support_count, round(s.persistence_ratio, 6) AS persistence_ratio,
       v.states[s.aoi_id] AS analysis_state, {OUTLINE_SQL}
FROM (SELECT * FROM track_shape JOIN track_map USING (aoi_id, birth_k, birth_no)) o JOIN signals s USING (aoi_id, birth_k, birth_no),
     (SELECT map(list(analysis_id), list(state)) AS states FROM analyses) v""", "signals", "analyses", "track_shape", "track_map")
def job_temporal(c):
    return c.signals.join(c.analyses.select("analysis_id", F.col("state").alias("analysis_state")), "analysis_id").select(
        "analysis_id", "signal_id", "state", "season", "support_count", r6("persistence_ratio").alias("persistence_ratio"),
        "analysis_state", *outline_figures(),
    )


@query("job_triage", f"""
SELECT candidate_id, rank, priority, severity, score, round(area_m2::DOUBLE, 2) AS area_m2, round(mean_delta, 6) AS mean_delta, {OUTLINE_SQL}
FROM candidates JOIN track_shape USING (aoi_id, birth_k, birth_no) JOIN track_map USING (aoi_id, birth_k, birth_no)""",
       "candidates", "track_shape", "track_map")
def job_triage(c):
    return c.candidates.select(
        "candidate_id", "rank", "priority", "severity", "score", F.round("area_m2", 2).alias("area_m2"), r6("mean_delta").alias("mean_delta"),
        *outline_figures(),
    )


@query("job_orchestrate", """
SELECT e.aoi_id, e.eligible, coalesce(p.reused, 0) AS reused_detections, coalesce(p.n - p.reused, 0) AS generated_detections,
       coalesce(p.reused = p.n, FALSE) AS reused_analysis, CASE WHEN e.eligible < 2 THEN 'insufficient history' ELSE a.state END AS state,
       coalesce(t.n, 0) AS candidates
FROM (SELECT aoi_id, count(*) AS eligible FROM seqd GROUP BY aoi_id) e
LEFT JOIN (SELECT i.aoi_id, count(*) AS n, count(r.run_id) AS reused FROM iv i LEFT JOIN reusable_runs r USING (before_acq, after_acq) GROUP BY i.aoi_id) p USING (aoi_id)
LEFT JOIN (SELECT analysis_id AS aoi_id, state FROM analyses) a USING (aoi_id)
LEFT JOIN (SELECT aoi_id, count(*) AS n FROM candidates GROUP BY aoi_id) t USING (aoi_id)""",
       "seqd", "iv", "reusable_runs", "analyses", "candidates")
def job_orchestrate(c):
    """A whole analysis in which intervals with a reusable run are not detected again."""
    today = reusable(c)
    kept = regions.to_store(c.detection)
    known = today.select("aoi_id", "before_acq", "after_acq")
    held = lambda rows: rows.join(known, ["aoi_id", "before_acq", "after_acq"], "left_semi")
    store = regions.Store(held(kept.runs), held(kept.regions), materialize(held(kept.pixels), "stored-pixels"))
    found = regions.detect(c.pixels, c.acquisitions, c.policy, aois=c.aois, store=store)
    made = jobs.analyse(found, c.acquisitions, c.grids, c.policy)
    requested = found.intervals.select("aoi_id", F.col("k").alias("seq"), "before_acq", "after_acq")
    stored = reuse.plan_detections(found.intervals, today).select(
        F.col("aoi_id").alias("analysis_id"), F.col("k").alias("seq"), "before_acq", "after_acq",
        F.coalesce("reused_run", "run_id").alias("run_id"),
    )
    matching = reuse.matching_analyses(made["analyses"].select("analysis_id", "iou_threshold"), stored, requested, today, c.policy)
    return jobs.orchestrate(c.sequence, found.intervals, today, matching, made["analyses"], made["candidates"])


@query("job_evidence", """
SELECT c.candidate_id, c.support_count AS interval_rows, len(c.acquisition_ids)::INT AS observation_rows, TRUE AS is_spatially_aligned,
       CAST((SELECT count(*) FILTER (a % 9 = 4) + count(*) FILTER (a % 9 IN (6, 7)) FROM unnest(c.acquisition_ids) t(a)) AS INTEGER) AS limit_count,
       c.detection_run_ids[1] AS primary_run, c.onset_before_acq AS before_acq
FROM candidates c""", "candidates")
def job_evidence(c):
    e = assembled(c)
    return e.select(
        "candidate_id", F.size("intervals").alias("interval_rows"), F.size("observations").alias("observation_rows"),
        "is_spatially_aligned", F.size("quality_limits").alias("limit_count"),
        F.col("primary_run.run_id").alias("primary_run"), F.col("before.acq_id").alias("before_acq"),
    )


cte("audited", """
SELECT *, signal_id % 6 AS kind FROM candidates""", "candidates")


@query("job_provenance_audit", """
SELECT candidate_id, 'missing temporal analysis' AS rule, '-1' AS detail FROM audited WHERE kind = 1
UNION ALL SELECT candidate_id, 'missing temporal signal', signal_id::VARCHAR FROM audited WHERE kind = 1
UNION ALL SELECT candidate_id, 'signal mismatch', signal_id::VARCHAR FROM audited WHERE kind IN (2, 3, 4)
UNION ALL SELECT candidate_id, 'no evidence', '' FROM audited WHERE kind = 4
UNION ALL SELECT candidate_id, 'missing acquisition', '-7' FROM audited WHERE kind = 2
UNION ALL SELECT candidate_id, 'missing detection run', '-9' FROM audited WHERE kind = 3
UNION ALL SELECT candidate_id, 'outside AOI', '' FROM audited WHERE candidate_id NOT IN (SELECT candidate_id FROM located)
UNION ALL SELECT candidate_id, 'empty geometry', '' FROM audited WHERE kind = 5
UNION ALL SELECT candidate_id, 'outside domain', '' FROM audited WHERE signal_id % 12 = 6
UNION ALL SELECT DISTINCT candidate_id, 'AOI not accepted', 'invalid' FROM audited WHERE aoi_id % 4 = 1 AND kind <> 4
UNION ALL SELECT candidate_id, 'foreign acquisition', r::VARCHAR FROM (SELECT candidate_id, unnest(detection_run_ids) AS r FROM audited WHERE kind = 4)""",
       "audited", "located")
def job_provenance_audit(c):
    """Candidates audited after some of their references were broken."""
    kind = F.pmod("signal_id", F.lit(6))
    away = lambda p: F.struct((p["x"] + 40.0).alias("x"), p["y"].alias("y"))
    moved = F.transform("geometry", lambda rings: F.transform(rings, lambda q: F.transform(q, away)))
    broken = c.candidates.withColumns({
        "analysis_id": F.when(kind == 1, -1).otherwise(F.col("analysis_id")),
        "acquisition_ids": F.when(kind == 2, F.array_append("acquisition_ids", F.lit(-7)))
        .when(kind == 4, F.slice("acquisition_ids", 1, 0)).otherwise(F.col("acquisition_ids")),
        "detection_run_ids": F.when(kind == 3, F.array_append("detection_run_ids", F.lit(-9)))
        .otherwise(F.col("detection_run_ids")),
        "geometry": F.when(kind == 5, F.slice("geometry", 1, 0)).when(F.pmod("signal_id", F.lit(12)) == 6, moved).otherwise(F.col("geometry")),
    })
    d = c.detection
    placed = c.aois.join(c.grids, "aoi_id").select("aoi_id", geometry.unproject_rings(F.col("rings"), F.col("grid.crs")).alias("rings"))
    # Some AOIs cross themselves: two neighbouring corners change places.
    ring = F.col("rings")[0]
    crossed = F.array(F.concat(F.slice(ring, 1, 1), F.slice(ring, 3, 1), F.slice(ring, 2, 1), F.slice(ring, 4, F.size(ring))))
    aois = placed.withColumn("rings", F.when(F.pmod("aoi_id", F.lit(4)) == 1, crossed).otherwise(F.col("rings")))
    return provenance.audit_candidates(
        broken, c.analyses, c.signals, c.acquisitions, aois, d.runs, located(c), fixtures.boundary(c.spark)
    )


@query("job_export", EXPORT_SQL, *EXPORT_NEEDS)
def job_export(c):
    return export_fields(exported(c))


@query("job_constraints", """
SELECT 'candidate exists' AS rule, log_id::VARCHAR AS key FROM review_log WHERE candidate_id NOT IN (SELECT candidate_id FROM candidates)
UNION ALL SELECT 'review decision', log_id::VARCHAR FROM review_log WHERE decision = 'escalate'
UNION ALL SELECT 'observation state', acq_id::VARCHAR FROM acq WHERE acq_id % 10 = 3
UNION ALL SELECT 'run exists', region_id::VARCHAR FROM regions WHERE k = 1
UNION ALL SELECT 'distinct acquisitions', run_id::VARCHAR FROM runs WHERE k = 2
UNION ALL SELECT 'unique scene per AOI', aoi_id || '/' || item_id FROM acq WHERE state <> 'usable'""",
       "review_log", "candidates", "acq", "regions", "runs")
def job_constraints(c):
    """Constraints over tables with planted faults: unknown states, doubled scenes, lost and equal-ended runs."""
    faulty = c.acquisitions.unionByName(c.acquisitions.where("state <> 'usable'")).withColumn(
        "_copy", F.row_number().over(_copies())
    ).withColumn(
        "state", F.when((F.pmod("acq_id", F.lit(10)) == 3) & (F.col("_copy") == 1), "pending").otherwise(F.col("state"))
    ).drop("_copy")
    d = c.detection
    runs = d.runs.where("k <> 1").withColumn(
        "after_acq", F.when(F.col("k") == 2, F.col("before_acq")).otherwise(F.col("after_acq"))
    )
    return provenance.check_constraints(faulty, runs, d.regions, fixtures.review_log(c.spark, c.sf_dir), c.candidates)


def _copies():
    return Window.partitionBy("acq_id").orderBy("item_id")


@query("prj_display", 'SELECT acq_id, "row", "col", red, green, blue, alpha FROM display', "display")
def prj_display(c):
    return shown(c).select("acq_id", "row", "col", "red", "green", "blue", "alpha")


cte("preview", """
SELECT c.candidate_id, c.aoi_id, c.birth_k, c.birth_no, unnest(acquisition_ids) AS acq_id, left_x, top_y, right_x, bottom_y
FROM candidates c JOIN track_shape USING (aoi_id, birth_k, birth_no)""", "candidates", "track_shape")


@query("prj_ndvi_preview", f"""
SELECT v.candidate_id, v.acq_id, g."row", g."col",
       {GRAY.format(v="CASE WHEN red <> 0 AND nir <> 0 THEN CAST(CAST((nir - red) / (nir + red) AS FLOAT) AS DOUBLE) END")} AS gray
FROM preview v JOIN (SELECT r::INTEGER AS "row", c::INTEGER AS "col" FROM range(20) a(r), range(20) b(c)) g
  ON g."row" >= top_y AND g."row" < bottom_y AND g."col" >= left_x AND g."col" < right_x
LEFT JOIN tpx t ON t.aoi_id = v.aoi_id AND t.birth_k = v.birth_k AND t.birth_no = v.birth_no AND t."row" = g."row" AND t."col" = g."col"
LEFT JOIN px p ON p.acq_id = v.acq_id AND p."row" = t."row" AND p."col" = t."col" """, "preview", "tpx", "px")
def prj_ndvi_preview(c):
    key = ["aoi_id", "birth_k", "birth_no"]
    scenes = c.candidates.select(*key, "candidate_id", F.explode("acquisition_ids").alias("acq_id"))
    footprint = c.track_pixels.join(scenes, key).drop("birth_k", "birth_no")
    return display.preview_pixels(c.pixels, footprint).select("candidate_id", "acq_id", "row", "col", "gray")


# --- streams -------------------------------------------------------------------------------


ARRIVALS = 4  # files that arrive one after the other


FILE_ROWS = 10_000  # rows that are worth a file of their own


def _stream(c: Chain, table: str, ts: str):
    """Rows of a table as files that arrive in the order of time, each arrival a micro-batch.

    Arrivals of many rows are written by all tasks. Each then has the same number of files, none of them empty, so a batch
    still takes one arrival.
    """
    rows = fixtures.table(c.spark, c.sf_dir, table)
    when = F.unix_micros(F.col(ts).cast("timestamp"))
    span = rows.agg(F.min(when).alias("low"), F.max(when).alias("high")).first()
    part = F.floor((when - span.low) * ARRIVALS / (span.high - span.low + 1))
    sizes = rows.agg(*[F.count_if(part == k).alias(f"n{k}") for k in range(ARRIVALS)]).first()
    tasks = c.spark.sparkContext.defaultParallelism
    files = tasks if min(sizes) >= tasks * max(FILE_ROWS, rows.rdd.getNumPartitions()) else 1
    folder = stage_path(c.spark, f"arrivals-{table}")
    for k in range(ARRIVALS):
        arrived = rows.where(part == k)
        (arrived.repartition(files) if files > 1 else arrived.coalesce(1)).write.mode("append").parquet(folder)
    return streams.read_arrivals(c.spark, folder, rows.schema, files_per_batch=files)


def _scene_rows(events):
    """Three deliveries per scene, so that later ones update earlier ones."""
    return events.select(
        (F.pmod("event_id", F.lit(4)) + 1).cast("bigint").alias("aoi_id"),
        F.format_string("item-%d", F.floor(F.col("event_id") / 12)).alias("item_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("version"),
        F.col("event_type").alias("state"),
    )


@query("stream_scene_ingest", f"""
SELECT aoi_id, item_id, version, state FROM (
  SELECT event_id % 4 + 1 AS aoi_id, 'item-' || (event_id // 12) AS item_id, ts, event_id AS version, event_type AS state FROM events)
QUALIFY row_number() OVER (PARTITION BY aoi_id, item_id ORDER BY ts DESC, version DESC) = 1""")
def stream_scene_ingest(c):
    rows = _scene_rows(_stream(c, "events", "ts"))
    log = stage_path(c.spark, "scene-log")
    streams.ingest_scenes(rows, log, stage_path(c.spark, "checkpoint"), every=3).awaitTermination()
    return streams.current_scenes(c.spark, log, rows.schema).select("aoi_id", "item_id", "version", "state")


@query("stream_review_upsert", f"""
SELECT candidate_id, decision, note, {sql_stamp('created_at')} AS created_at, {sql_stamp('updated_at')} AS updated_at FROM reviews""", "reviews")
def stream_review_upsert(c):
    rows = fixtures.review_rows(_stream(c, "orders", "o_orderdate"))
    log = stage_path(c.spark, "review-log")
    streams.ingest_reviews(rows, log, stage_path(c.spark, "checkpoint"), every=3).awaitTermination()
    return streams.review_state(c.spark, log, rows.schema).select(
        "candidate_id", "decision", "note", stamp("created_at").alias("created_at"), stamp("updated_at").alias("updated_at")
    )


@query("stream_progress", "SELECT event_id % 4 + 1 AS aoi_id, event_type AS state, count(*) AS completed FROM events GROUP BY ALL")
def stream_progress(c):
    out = stage_path(c.spark, "progress")
    streams.count_progress(
        _scene_rows(_stream(c, "events", "ts")).select("aoi_id", "state"), out, stage_path(c.spark, "checkpoint")
    ).awaitTermination()
    return streams.current_progress(c.spark, out)


@query("progress_events", f"""
SELECT aoi_id, item_id, position, count(*) OVER (PARTITION BY aoi_id) AS total FROM discovered""", "discovered")
def progress_events(c):
    """Acquisition progress: one row per finished scene with running and total counts."""
    counted = reuse.progress(discovered(c).select("aoi_id", "item_id", "position"))
    return counted.select("aoi_id", "item_id", F.col("current").cast("bigint").alias("position"), "total")
