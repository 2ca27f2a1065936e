"""Scans, sources, sinks, filters and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from landshift.config import DISPLAY_VERSION, Policy
from landshift.functions import geometry, grids, history
from landshift.operators import change, evidence, reuse, tracks, triage
from landshift.plans import fixtures
from landshift.plans.chain import Chain
from landshift.plans.oracle_chain import BOUNDARY, CATALOG_FROM, CATALOG_TO, INSIDE, cte
from landshift.plans.registry import joined, query, r6, sql_list, sql_stamp, stamp
from landshift.session import materialize, stage_path
from landshift.sources import catalog, tables

LEFT, BOTTOM, RIGHT, TOP = BOUNDARY


def items(c: Chain):
    return fixtures.catalog_items(c.spark, c.sf_dir)


def found(c: Chain, source=None, policy: Policy = Policy()):
    return catalog.search(
        items(c) if source is None else source, fixtures.catalog_aois(c.spark, c.sf_dir), fixtures.CATALOG_COLLECTION,
        CATALOG_FROM, CATALOG_TO, policy,
    )


def discovered(c: Chain):
    return catalog.ranked(catalog.covering(found(c)))


# --- scans -------------------------------------------------------------------------


@query("src_catalog_items", "SELECT aoi_id, item_id, result_no FROM found WHERE result_no <= 25", "found")
def src_catalog_items(c):
    """The 25 newest items per AOI, from saved pages of search results; the limit is the search's own."""
    path = stage_path(c.spark, "catalog")
    fixtures.catalog_pages(c.spark, c.sf_dir).write.text(path)
    return found(c, catalog.read_catalog(c.spark, path), Policy(catalog_limit=25)).select("aoi_id", "item_id", F.col("result_no").cast("bigint").alias("result_no"))


@query("src_pixels", 'SELECT aoi_id, acq_id, "row", "col", red, nir, CAST(scl AS INTEGER) AS scl FROM px_all', "px_all")
def src_pixels(c):
    """All pixels as delivered, read back from the clustered table."""
    return c.raw_pixels.select("aoi_id", "acq_id", "row", "col", "red", "nir", "scl")


# AOI documents from customers: boxes inside, on and outside the boundary, a bow-tie, a
# point and broken text.
cte("raw_aoi", f"""
SELECT c_custkey AS aoi_id, c_custkey % 6 AS kind,
       CASE c_custkey % 6 WHEN 1 THEN {LEFT}::DOUBLE WHEN 2 THEN {RIGHT}::DOUBLE - 0.25 ELSE 75.0::DOUBLE + (c_custkey % 24) * 0.125 END AS l,
       12.0::DOUBLE + c_nationkey * 0.125 AS b
FROM customer""")


def raw_aois(c: Chain):
    customers = fixtures.table(c.spark, c.sf_dir, "customer")
    kind = F.pmod("c_custkey", F.lit(6))
    left = F.when(kind == 1, LEFT).when(kind == 2, RIGHT - 0.25).otherwise(
        F.lit(75.0) + F.pmod("c_custkey", F.lit(24)) * 0.125
    )
    bottom = F.lit(12.0) + F.col("c_nationkey") * 0.125
    point = lambda x, y: F.array(x, y)
    right, top = left + 0.5, bottom + 0.5
    square = F.array(point(left, bottom), point(right, bottom), point(right, top), point(left, top), point(left, bottom))
    bow = F.array(point(left, bottom), point(right, top), point(right, bottom), point(left, top), point(left, bottom))
    document = lambda name, ring: F.to_json(F.struct(F.lit(name).alias("type"), F.array(ring).alias("coordinates")))
    text = (
        F.when(kind == 3, document("Polygon", bow)).when(kind == 4, document("Point", square))
        .when(kind == 5, F.lit("{broken")).otherwise(document("Polygon", square))
    )
    return customers.select(F.col("c_custkey").alias("aoi_id"), text.alias("geometry_json"))


@query("src_aoi", "SELECT aoi_id, l AS left_x, b AS bottom_y FROM raw_aoi WHERE kind IN (0, 1)", "raw_aoi")
def src_aoi(c):
    box = geometry.bounds(F.col("rings"))
    return tables.valid_aois(raw_aois(c), fixtures.boundary(c.spark)).select(
        "aoi_id", box[0].alias("left_x"), box[1].alias("bottom_y")
    )


@query("flt_aoi_valid", """
SELECT aoi_id, CASE kind WHEN 0 THEN 'valid' WHEN 1 THEN 'valid' WHEN 2 THEN 'outside boundary'
  WHEN 3 THEN 'invalid' ELSE 'malformed' END AS verdict FROM raw_aoi""", "raw_aoi")
def flt_aoi_valid(c):
    return tables.parse_aois(raw_aois(c)).withColumn("boundary_rings", fixtures.boundary(c.spark).scalar()).select(
        "aoi_id", tables.aoi_verdict(F.col("rings"), F.col("boundary_rings")).alias("verdict")
    )


@query("src_boundary", f"""
SELECT item_id, fl >= {LEFT} AND fr <= {RIGHT} AND fb >= {BOTTOM} AND ft <= {TOP} AS inside,
       fl <= {RIGHT} AND fr >= {LEFT} AND fb <= {TOP} AND ft >= {BOTTOM} AS touches
FROM items WHERE has_footprint""", "items")
def src_boundary(c):
    outlined = items(c).where(F.col("rings").isNotNull()).withColumn("boundary_rings", fixtures.boundary(c.spark).scalar())
    return outlined.select(
        "item_id",
        geometry.covers(F.col("boundary_rings"), F.col("rings")).alias("inside"),
        geometry.intersects(F.col("boundary_rings"), F.col("rings")).alias("touches"),
    )


@query("scan_acquisitions", f"""
SELECT aoi_id, acq_id, item_id, {sql_stamp('ts')} AS ts, state, reason FROM acq ORDER BY ts, acq_id""", "acq")
def scan_acquisitions(c):
    return tables.scan_acquisitions(c.acquisitions).select(
        "aoi_id", "acq_id", "item_id", stamp("ts").alias("ts"), "state", "reason"
    )


@query("scan_latest", """
SELECT aoi_id, max(acq_id) AS acq_id, arg_max(item_id, acq_id) AS item_id FROM acq GROUP BY aoi_id""", "acq")
def scan_latest(c):
    return c.acquisitions.groupBy("aoi_id").agg(
        F.max("acq_id").alias("acq_id"), F.max_by("item_id", "acq_id").alias("item_id")
    )


@query("scan_analysis", """
SELECT a.analysis_id, a.state AS analysis_state, x.section, x.position, x.item, x.status FROM analyses a JOIN (
  SELECT aoi_id AS analysis_id, 'observation' AS section, CAST(seq AS BIGINT) AS position, acq_id AS item, state AS status FROM seqd
  UNION ALL SELECT aoi_id, 'relationship', k, run_id, 'usable' FROM runs
  UNION ALL SELECT analysis_id, 'signal', signal_id, source_region_ids[1], state FROM signals) x USING (analysis_id)""",
       "analyses", "seqd", "runs", "signals")
def scan_analysis(c):
    """Stored analysis with its children, one row per child."""
    part = lambda rows, section, position, item, status: rows.select(
        F.col("aoi_id").alias("analysis_id"), F.lit(section).alias("section"),
        F.col(position).cast("bigint").alias("position"), item.alias("item"), F.col(status).alias("status"),
    )
    children = (
        part(c.sequence, "observation", "seq", F.col("acq_id"), "state")
        .unionByName(part(c.relationships, "relationship", "k", F.col("detection_run_id"), "quality_state"))
        .unionByName(part(c.signals, "signal", "signal_id", F.col("source_region_ids")[0], "state"))
    )
    return c.analyses.select("analysis_id", F.col("state").alias("analysis_state")).join(children, "analysis_id")


# --- sinks -------------------------------------------------------------------------

STORED_BEFORE = "1998-01-01"


@query("sink_acquisitions", f"""
SELECT aoi_id, item_id, CASE WHEN acq_id % 5 = 0 THEN 'failed' ELSE state END AS state,
       CASE WHEN acq_id % 5 = 0 THEN 'asset unreadable' ELSE reason END AS reason,
       CASE WHEN acq_id % 5 = 0 AND ts < TIMESTAMP '{STORED_BEFORE}' THEN 0.0::DOUBLE ELSE usable_percentage END AS usable_percentage,
       CASE WHEN ts < TIMESTAMP '{STORED_BEFORE}' THEN '2020-01-01 00:00:00' ELSE '2020-02-01 00:00:00' END AS created_at
FROM acq""", "acq")
def sink_acquisitions(c):
    base = c.acquisitions.select("aoi_id", "acq_id", "item_id", "ts", "state", "reason", "usable_percentage")
    moment = lambda text: F.lit(text).cast("timestamp")
    stored = base.where(F.col("ts") < moment(STORED_BEFORE)).select(
        "aoi_id", "item_id", F.lit("acquired").alias("state"), F.lit("queued").alias("reason"),
        F.lit(0.0).alias("usable_percentage"), moment("2020-01-01").alias("created_at"),
    )
    failed = F.pmod("acq_id", F.lit(5)) == 0
    incoming = base.select(
        "aoi_id", "item_id", F.when(failed, "failed").otherwise(F.col("state")).alias("state"),
        F.when(failed, "asset unreadable").otherwise(F.col("reason")).alias("reason"),
        "usable_percentage", moment("2020-02-01").alias("created_at"),
    )
    path = stage_path(c.spark, "stored-acquisitions")
    columns = ["aoi_id", "item_id", "state", "reason", "usable_percentage", "created_at"]
    tables.put(stored.select(*columns), path, ["aoi_id", "item_id"])
    for _ in range(2):  # a repeated job leaves the same rows
        tables.put(incoming.select(*columns), path, ["aoi_id", "item_id"], merge=tables.merge_acquisitions)
    return tables.read_table(c.spark, path, stored.select(*columns).schema).select(
        "aoi_id", "item_id", "state", "reason", "usable_percentage", stamp("created_at").alias("created_at")
    )


@query("sink_detection", """
SELECT u.run_id, u.raw_changed_pixel_count, count(r.region_id) AS stored_regions, CAST(coalesce(sum(r.pixel_count), 0) AS BIGINT) AS stored_pixels
FROM runs u LEFT JOIN (SELECT *, (aoi_id << 12) + k AS run_id FROM regions) r USING (run_id) GROUP BY ALL""", "runs", "regions")
def sink_detection(c):
    """Runs and their regions, written twice under their run and read back."""
    d = c.detection
    run_path, region_path = stage_path(c.spark, "stored-runs"), stage_path(c.spark, "stored-regions")
    scope = d.runs.select("run_id")
    for _ in range(2):
        tables.put(d.runs, run_path, ["run_id"])
        tables.put(d.regions, region_path, ["run_id"], scope)
    runs = tables.read_table(c.spark, run_path, d.runs.schema)
    regions = tables.read_table(c.spark, region_path, d.regions.schema)
    counted = regions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("stored_regions"), F.sum("pixel_count").alias("stored_pixels")
    )
    return runs.join(counted, "run_id", "left").select(
        "run_id", "raw_changed_pixel_count",
        F.coalesce("stored_regions", F.lit(0)).cast("bigint").alias("stored_regions"),
        F.coalesce("stored_pixels", F.lit(0)).cast("bigint").alias("stored_pixels"),
    )


@query("sink_temporal", """
SELECT a.analysis_id, a.state, o.observations, r.relationships, coalesce(s.signals, 0) AS signals
FROM analyses a
JOIN (SELECT aoi_id AS analysis_id, count(*) AS observations FROM seqd GROUP BY 1) o USING (analysis_id)
JOIN (SELECT aoi_id AS analysis_id, count(*) AS relationships FROM runs GROUP BY 1) r USING (analysis_id)
LEFT JOIN (SELECT analysis_id, count(*) AS signals FROM signals GROUP BY 1) s USING (analysis_id)""",
       "analyses", "seqd", "runs", "signals")
def sink_temporal(c):
    """The four temporal tables, written twice under their analysis and read back."""
    stored = {}
    for name, rows in {
        "analyses": c.analyses,
        "observations": c.sequence.select(F.col("aoi_id").alias("analysis_id"), "acq_id", "seq"),
        "relationships": c.relationships,
        "signals": c.signals,
    }.items():
        path = stage_path(c.spark, f"stored-{name}")
        for _ in range(2):
            tables.put(rows, path, ["analysis_id"], c.analyses.select("analysis_id"))
        stored[name] = tables.read_table(c.spark, path, rows.schema)
    count = lambda name: stored[name].groupBy("analysis_id").agg(F.count(F.lit(1)).alias(name))
    return (
        stored["analyses"].select("analysis_id", "state")
        .join(count("observations"), "analysis_id").join(count("relationships"), "analysis_id")
        .join(count("signals"), "analysis_id", "left")
        .withColumn("signals", F.coalesce("signals", F.lit(0)).cast("bigint"))
    )


@query("sink_candidates", f"""
SELECT candidate_id, analysis_id, signal_id, score, rank, priority, severity, state, round(area_m2::DOUBLE, 2) AS area_m2, round(mean_delta, 6) AS mean_delta,
       {sql_list('source_region_ids')} AS regions, {sql_list('detection_run_ids')} AS runs, {sql_list('acquisition_ids')} AS acquisitions, corners,
       CASE WHEN first_change_ts < TIMESTAMP '{STORED_BEFORE}' THEN 'accepted' ELSE 'unreviewed' END AS review_state,
       CASE WHEN first_change_ts < TIMESTAMP '{STORED_BEFORE}' THEN '2020-01-01 00:00:00' ELSE '2020-02-01 00:00:00' END AS created_at,
       '2020-02-01 00:00:00' AS updated_at
FROM candidates JOIN track_shape USING (aoi_id, birth_k, birth_no)""", "candidates", "track_shape")
def sink_candidates(c):
    """All fields of the candidates, over a table in which the older ones stand accepted with other figures."""
    moment = lambda text: F.lit(text).cast("timestamp")
    path = stage_path(c.spark, "stored-candidates")
    none = triage.no_candidates(c.candidates)
    older = c.candidates.where(F.col("first_change_ts") < moment(STORED_BEFORE)).withColumns(
        {"score": F.lit(0.0), "priority": F.lit("low"), "geometry": F.slice("geometry", 1, 0)}
    )
    tables.put(triage.upsert_candidates(none, older, moment("2020-01-01")).withColumn("review_state", F.lit("accepted")), path, ["candidate_id"])
    shaped = triage.upsert_candidates(none, c.candidates, moment("2020-02-01"))
    merge = lambda before, new: triage.upsert_candidates(before, new, moment("2020-02-01"))
    for _ in range(2):
        tables.put(shaped, path, ["candidate_id"], merge=merge)
    return tables.read_table(c.spark, path, shaped.schema).select(
        "candidate_id", "analysis_id", "signal_id", "score", "rank", "priority", "severity", "state", F.round("area_m2", 2).alias("area_m2"),
        r6("mean_delta").alias("mean_delta"), joined("source_region_ids").alias("regions"), joined("detection_run_ids").alias("runs"),
        joined("acquisition_ids").alias("acquisitions"), geometry.multi_corners(F.col("geometry")).cast("bigint").alias("corners"), "review_state",
        stamp("created_at").alias("created_at"), stamp("updated_at").alias("updated_at"),
    )


@query("sink_review", f"""
SELECT r.candidate_id, decision, note, {sql_stamp('created_at')} AS created_at, {sql_stamp('updated_at')} AS updated_at,
       CASE WHEN c.candidate_id IS NOT NULL THEN decision END AS shown_state
FROM reviews r LEFT JOIN candidates c USING (candidate_id)""", "reviews", "candidates")
def sink_review(c):
    """Reviews written by key, and mirrored into the stored candidates."""
    path, shown = stage_path(c.spark, "stored-reviews"), stage_path(c.spark, "shown-candidates")
    stored = triage.upsert_candidates(triage.no_candidates(c.candidates), c.candidates, F.lit("1990-01-01").cast("timestamp"))
    tables.put(stored, shown, ["candidate_id"])
    for _ in range(2):
        tables.put(c.reviews, path, ["candidate_id"])
        reviews = tables.read_table(c.spark, path, c.reviews.schema)
        tables.put(triage.mirror_reviews(tables.read_table(c.spark, shown, stored.schema), reviews), shown, ["candidate_id"])
    mirrored = tables.read_table(c.spark, shown, stored.schema).select("candidate_id", F.col("review_state").alias("shown_state"))
    return tables.read_table(c.spark, path, c.reviews.schema).join(mirrored, "candidate_id", "left").select(
        "candidate_id", "decision", "note", stamp("created_at").alias("created_at"), stamp("updated_at").alias("updated_at"), "shown_state"
    )


def artifacts(c: Chain):
    """Acquisitions with artifact flags: masks everywhere, bands and displays not."""
    kind = F.pmod("acq_id", F.lit(9))
    return c.acquisitions.withColumns({
        "has_mask": kind != 4,
        "has_bands": kind != 5,
        "has_display": (F.col("state") == "usable") & (kind != 6),
        "visualization_version": F.when(kind == 7, "rgb-v1").otherwise(DISPLAY_VERSION),
        "evaluation_stage": F.when(F.col("state") == "valid_unusable", "scl_screening"),
    })


def assembled(c: Chain):
    d = c.detection
    intervals = evidence.evidence_intervals(c.candidates, d.runs, d.regions)
    observations = evidence.evidence_observations(c.candidates, artifacts(c))
    return evidence.assemble(c.candidates, intervals, observations)


def exported(c: Chain):
    centroids = evidence.pixel_centroids(c.track_pixels, c.grids)
    return evidence.snapshots(assembled(c), c.reviews, centroids)


# The whole snapshot, from the candidate, its runs, observations, review and outline.
cte("export_scenes", """
SELECT candidate_id, count(*) AS observations, round(sum(usable_percentage / 100), 6) AS usable_sum, round(sum(cloud_percentage / 100), 6) AS cloud_sum,
       sum((acq_id % 50) / 2.0::DOUBLE) AS cover_sum, min('43P' || 'GHKM'[(aoi_id % 4 + 1)::INTEGER]) AS tile,
       count(*) FILTER (acq_id % 9 = 4) + count(*) FILTER (acq_id % 9 IN (6, 7)) AS limits
FROM (SELECT candidate_id, unnest(acquisition_ids) AS acq_id FROM candidates) JOIN acq USING (acq_id) GROUP BY ALL""", "candidates", "acq")
EXPORT_SQL = f"""
SELECT c.candidate_id, c.analysis_id, c.aoi_id, c.signal_id, c.rank, c.priority, c.severity, c.score, c.review_state AS decision, r.note,
       {sql_stamp('r.created_at')} AS created_at, {sql_stamp('r.updated_at')} AS updated_at, {sql_list('c.detection_run_ids')} AS runs,
       {sql_list('c.acquisition_ids')} AS acquisitions, u.before_acq, u.after_acq, b.item_id AS before_item, a.item_id AS after_item,
       0.20::DOUBLE AS threshold, u.region_count, u.raw_changed_pixel_count, u.filtered_changed_pixel_count, u.quality_valid_pixel_count, u.excluded_pixel_count,
       u.changed_pixel_percentage, round(u.total_changed_area_m2::DOUBLE, 2) AS total_area, round(u.median_region_area_m2::DOUBLE, 2) AS median_area,
       round(u.mean_change_signal, 6) AS mean_change_signal, c.state, c.interval_count, c.support_count, c.recurrence_count,
       round(c.persistence_ratio, 6) AS persistence_ratio, round(c.temporal_consistency, 6) AS temporal_consistency,
       {sql_stamp('c.first_change_ts')} AS first_change, {sql_stamp('c.last_supporting_ts')} AS last_supporting,
       e.observations, e.usable_sum, e.cloud_sum, e.cover_sum, e.tile, 2 * e.observations AS band_names, e.limits, TRUE AS aligned,
       corners, shells_less_holes, left_lon, bottom_lat, right_lon, top_lat, lon, lat
FROM reviewed c JOIN runs u ON u.run_id = c.detection_run_ids[1] JOIN acq b ON b.acq_id = u.before_acq JOIN acq a ON a.acq_id = u.after_acq
JOIN export_scenes e USING (candidate_id) LEFT JOIN reviews r USING (candidate_id)
JOIN track_shape s ON s.aoi_id = c.aoi_id AND s.birth_k = c.birth_k AND s.birth_no = c.birth_no
JOIN track_map m ON m.aoi_id = c.aoi_id AND m.birth_k = c.birth_k AND m.birth_no = c.birth_no
JOIN track_middle t ON t.aoi_id = c.aoi_id AND t.birth_k = c.birth_k AND t.birth_no = c.birth_no"""
EXPORT_NEEDS = ("reviewed", "reviews", "runs", "acq", "export_scenes", "track_shape", "track_map", "track_middle")

_OBSERVATION = "struct<item_id:string,usable_pixel_fraction:double,cloud_fraction:double,cloud_cover:double,mgrs_tile:string,bands:array<string>>"
SNAPSHOT = (
    "candidate_id string, analysis_id bigint, aoi_id bigint, signal_id bigint, rank bigint, priority string, severity string, score double, "
    "analyst_review struct<decision:string,note:string,created_at:timestamp,updated_at:timestamp>, "
    "provenance struct<detection_run_ids:array<bigint>,acquisition_ids:array<bigint>,before_acquisition_id:bigint,after_acquisition_id:bigint,"
    "before_item_id:string,after_item_id:string>, "
    "detection_summary struct<threshold:double,region_count:bigint,raw_changed_pixel_count:bigint,filtered_changed_pixel_count:bigint,"
    "quality_valid_pixel_count:bigint,excluded_pixel_count:bigint,changed_pixel_percentage:double,total_changed_area_m2:double,"
    "median_region_area_m2:double,mean_change_signal:double>, "
    "temporal_evidence struct<state:string,interval_count:int,support_count:int,recurrence_count:int,persistence_ratio:double,"
    "temporal_consistency:double,first_change_datetime:timestamp,last_supporting_datetime:timestamp>, "
    f"all_observations array<{_OBSERVATION}>, before_observation {_OBSERVATION}, after_observation {_OBSERVATION}, "
    "observation_quality struct<quality_limits:array<struct<code:string>>,spatial_alignment:struct<aligned:boolean>>, "
    "geometry struct<type:string,coordinates:string>, centroid struct<longitude:double,latitude:double>"
)


def export_fields(documents):
    """What the snapshots say, read back from their text."""
    d = documents.select(F.from_json("json", SNAPSHOT).alias("d")).select("d.*")
    place = lambda c: F.transform(c, lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))
    text = F.col("geometry.coordinates")
    polygons = F.when(F.col("geometry.type") == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))).otherwise(
        F.from_json(text, "array<array<array<array<double>>>>")
    )
    d = d.withColumn("outline", place(polygons))
    total = lambda field: F.aggregate(F.col(f"all_observations.{field}"), F.lit(0.0), lambda acc, v: acc + v)
    box = geometry.multi_bounds(F.col("outline"))
    given = lambda part, *names: [F.col(f"{part}.{n}").alias(n) for n in names]
    parts = F.aggregate("outline", F.lit(0), lambda n, rings: n + 2 - F.size(rings))
    return d.select(
        "candidate_id", "analysis_id", "aoi_id", "signal_id", "rank", "priority", "severity", "score", *given("analyst_review", "decision", "note"),
        stamp("analyst_review.created_at").alias("created_at"), stamp("analyst_review.updated_at").alias("updated_at"),
        joined("provenance.detection_run_ids").alias("runs"), joined("provenance.acquisition_ids").alias("acquisitions"),
        F.col("provenance.before_acquisition_id").alias("before_acq"), F.col("provenance.after_acquisition_id").alias("after_acq"),
        F.col("before_observation.item_id").alias("before_item"), F.col("provenance.after_item_id").alias("after_item"),
        *given("detection_summary", "threshold", "region_count", "raw_changed_pixel_count", "filtered_changed_pixel_count", "quality_valid_pixel_count",
               "excluded_pixel_count", "changed_pixel_percentage"),
        F.round("detection_summary.total_changed_area_m2", 2).alias("total_area"), F.round("detection_summary.median_region_area_m2", 2).alias("median_area"),
        r6("detection_summary.mean_change_signal").alias("mean_change_signal"),
        *given("temporal_evidence", "state", "interval_count", "support_count", "recurrence_count"),
        r6("temporal_evidence.persistence_ratio").alias("persistence_ratio"), r6("temporal_evidence.temporal_consistency").alias("temporal_consistency"),
        stamp("temporal_evidence.first_change_datetime").alias("first_change"), stamp("temporal_evidence.last_supporting_datetime").alias("last_supporting"),
        F.size("all_observations").cast("bigint").alias("observations"), r6(total("usable_pixel_fraction")).alias("usable_sum"),
        r6(total("cloud_fraction")).alias("cloud_sum"), total("cloud_cover").alias("cover_sum"), F.array_min("all_observations.mgrs_tile").alias("tile"),
        F.size(F.flatten("all_observations.bands")).cast("bigint").alias("band_names"),
        F.size("observation_quality.quality_limits").cast("bigint").alias("limits"), F.col("observation_quality.spatial_alignment.aligned").alias("aligned"),
        geometry.multi_corners(F.col("outline")).cast("bigint").alias("corners"), parts.cast("bigint").alias("shells_less_holes"),
        *[r6(box[k]).alias(n) for k, n in enumerate(("left_lon", "bottom_lat", "right_lon", "top_lat"))],
        r6("centroid.longitude").alias("lon"), r6("centroid.latitude").alias("lat"),
    )


@query("sink_export_json", EXPORT_SQL, *EXPORT_NEEDS)
def sink_export_json(c):
    """Snapshots written as JSON lines, then read back."""
    path = stage_path(c.spark, "export")
    tables.write_json(exported(c), path)
    return export_fields(c.spark.read.text(path).withColumnRenamed("value", "json"))


# --- filters and checks ------------------------------------------------------------


@query("flt_required_assets", """
SELECT item_id, has_bands AND has_scl AS complete, has_scl, has_display FROM items""", "items")
def flt_required_assets(c):
    assets = F.col("assets")
    return items(c).select(
        "item_id",
        catalog.has_required_assets(assets).alias("complete"),
        catalog.has_asset(assets, "scl").alias("has_scl"),
        (catalog.has_asset(assets, "green") & catalog.has_asset(assets, "blue")).alias("has_display"),
    )


@query("flt_footprint_covers", "SELECT aoi_id, item_id FROM discovered", "discovered")
def flt_footprint_covers(c):
    return catalog.covering(found(c)).select("aoi_id", "item_id")


DOMAIN_EAST = 77.2


@query("flt_footprint_domain", f"""
SELECT aoi_id, item_id FROM found WHERE has_bands AND has_scl AND fl > {DOMAIN_EAST}""", "found")
def flt_footprint_domain(c):
    west = fixtures.boundary(c.spark).select(
        fixtures.box(*[F.lit(v) for v in (LEFT, BOTTOM, DOMAIN_EAST, TOP)]).alias("boundary_rings")
    )
    return catalog.domain_violations(found(c), west).select("aoi_id", "item_id")


def _with(grid, **fields):
    changed = grid
    for name, value in fields.items():
        changed = changed.withField(name, value)
    return changed


@query("flt_source_grid_valid", "SELECT acq_id, acq_id % 7 = 0 OR acq_id % 7 = 6 AS valid FROM scn", "scn")
def flt_source_grid_valid(c):
    kind = F.pmod("acq_id", F.lit(7))
    grid = _with(F.col("grid"), count=F.lit(1))
    zeros = F.array(F.lit(0.0), F.lit(0.0))
    identity = F.array(*[F.lit(v) for v in grids.IDENTITY])
    varied = (
        F.when(kind == 1, _with(grid, count=F.lit(2))).when(kind == 2, _with(grid, width=F.lit(0)))
        .when(kind == 3, _with(grid, crs=F.lit(None).cast("string"))).when(kind == 4, _with(grid, resolution=zeros))
        .when(kind == 5, _with(grid, transform=identity)).otherwise(grid)
    )
    return c.scenes.select("acq_id", grids.source_grid_valid(varied).alias("valid"))


@query("flt_grid_covers_aoi", "SELECT acq_id, acq_id % 4 < 2 AS covered FROM scn", "scn")
def flt_grid_covers_aoi(c):
    """Grids shifted by fractions of the tolerance against their AOI."""
    shift = F.pmod("acq_id", F.lit(4)) * 7e-7
    moved = F.transform("grid.bounds", lambda v: v + shift)
    joined_aoi = c.scenes.join(fixtures.aois(c.spark, c.sf_dir), "aoi_id")
    projected = geometry.project_rings(F.col("rings"), F.col("grid.crs"))
    return joined_aoi.select("acq_id", grids.covers_bounds(moved, geometry.bounds(projected)).alias("covered"))


def interval_grids(c: Chain):
    """Intervals with the grid headers of both observations, some of them altered."""
    d = c.detection
    header = c.scenes.select("acq_id", "grid")
    joined_grids = (
        d.intervals.join(header.select(F.col("acq_id").alias("before_acq"), F.col("grid").alias("before")), "before_acq")
        .join(header.select(F.col("acq_id").alias("after_acq"), F.col("grid").alias("g")), "after_acq")
    )
    kind, g = F.pmod(F.col("aoi_id") + F.col("k"), F.lit(10)), F.col("g")
    shifted = lambda by: F.transform(g["bounds"], lambda v: v + by)
    after = (
        F.when(kind == 1, _with(g, count=F.lit(3))).when(kind == 2, _with(g, dtype=F.lit("float32")))
        .when(kind == 3, _with(g, nodata=F.lit(-1.0))).when(kind == 4, _with(g, crs=F.lit("EPSG:32644")))
        .when(kind == 5, _with(g, width=F.lit(21)))
        .when(kind == 6, _with(g, resolution=F.array(F.lit(20.0), F.lit(20.0))))
        .when(kind == 7, _with(g, transform=F.array(*[F.lit(v) for v in grids.IDENTITY])))
        .when(kind == 8, _with(g, bounds=shifted(100.0))).when(kind == 9, _with(g, bounds=shifted(1.0)))
        .otherwise(g)
    )
    return joined_grids.withColumn("after", after)


KIND = "(aoi_id + k) % 10"


@query("chk_grid_compat", f"""
SELECT run_id, CASE {KIND} WHEN 1 THEN 'band count' WHEN 2 THEN 'dtype' WHEN 3 THEN 'nodata' WHEN 4 THEN 'crs'
  WHEN 5 THEN 'dimensions' WHEN 6 THEN 'resolution' WHEN 7 THEN 'transform' WHEN 8 THEN 'bounds' ELSE 'compatible' END AS verdict
FROM iv""", "iv")
def chk_grid_compat(c):
    return interval_grids(c).select("run_id", grids.compatibility(F.col("before"), F.col("after")).alias("verdict"))


@query("chk_grid_alignment", f"""
SELECT run_id, {KIND} NOT BETWEEN 4 AND 9 AS aligned,
  CASE WHEN {KIND} IN (4, 6) THEN 'reference' WHEN {KIND} IN (5, 7) THEN 'geometry' WHEN {KIND} IN (8, 9) THEN 'bounds' END AS differs
FROM iv""", "iv")
def chk_grid_alignment(c):
    found = grids.alignment(F.col("before"), F.col("after"))
    return interval_grids(c).select("run_id", found["aligned"].alias("aligned"), found["differs"].alias("differs"))


@query("chk_mask_alignment", """
SELECT acq_id, CASE acq_id % 5 WHEN 1 THEN 'band count' WHEN 2 THEN 'dimensions' WHEN 3 THEN 'crs' WHEN 4 THEN 'transform' ELSE 'aligned' END AS verdict
FROM scn""", "scn")
def chk_mask_alignment(c):
    kind, g = F.pmod("acq_id", F.lit(5)), _with(F.col("grid"), count=F.lit(1))
    mask = (
        F.when(kind == 1, _with(g, count=F.lit(2))).when(kind == 2, _with(g, height=F.lit(19)))
        .when(kind == 3, _with(g, crs=F.lit("EPSG:32644")))
        .when(kind == 4, _with(g, transform=F.array(*[F.lit(v) for v in grids.IDENTITY]))).otherwise(g)
    )
    return c.scenes.select("acq_id", grids.mask_alignment(mask, F.col("grid")).alias("verdict"))


# Octagon test in metres from the upper-left grid corner.


@query("flt_aoi_clip", f'SELECT aoi_id, acq_id, "row", "col", red FROM px_all WHERE {INSIDE}', "px_all")
def flt_aoi_clip(c):
    clipped = tables.clip_to_aoi(c.raw_pixels, c.scenes, c.aois)
    return clipped.select("aoi_id", "acq_id", "row", "col", "red")


ELIGIBLE_FROM, ELIGIBLE_TO = "1996-05-15", "2000-05-15"


@query("flt_eligible", f"""
SELECT aoi_id, acq_id, {sql_stamp('ts')} AS ts FROM acq
WHERE state = 'usable' AND usable_percentage > 0 AND ts >= TIMESTAMP '{ELIGIBLE_FROM}' AND ts <= TIMESTAMP '{ELIGIBLE_TO}'
ORDER BY ts, acq_id""", "acq")
def flt_eligible(c):
    chosen = change.eligible(c.acquisitions, ELIGIBLE_FROM, ELIGIBLE_TO)
    return tables.scan_acquisitions(chosen).select("aoi_id", "acq_id", stamp("ts").alias("ts"))


# Observations whose state and figures are partly missing, as in old stored rows.
cte("mixed_states", """
SELECT acq_id, CASE acq_id % 8 WHEN 1 THEN 'failed' WHEN 2 THEN 'legacy_unassessed' WHEN 3 THEN 'discovered' ELSE state END AS state,
       reason, CASE acq_id % 3 WHEN 0 THEN NULL ELSE usable_percentage END AS usable_percentage,
       usable_pixels, total_pixels FROM acq""", "acq")
FRACTION = """coalesce(usable_percentage / 100.0, CASE WHEN usable_pixels <= 0 THEN 0 WHEN total_pixels > 0 THEN usable_pixels / total_pixels END, 1.0)"""


@query("prj_ineligible_reason", f"""
SELECT acq_id, state, state = 'usable' AND {FRACTION} > 0 AS eligible,
       CASE WHEN state = 'valid_unusable' AND reason <> 'quality_policy_passed' THEN replace(reason, '_', ' ')
            WHEN state = 'valid_unusable' THEN 'valid but unusable quality'
            WHEN state = 'failed' THEN 'quality assessment failed' WHEN state = 'legacy_unassessed' THEN 'legacy unassessed quality'
            WHEN state <> 'usable' THEN replace(state, '_', ' ')
            WHEN {FRACTION} <= 0 THEN 'zero usable pixels' ELSE 'unavailable' END AS reason
FROM mixed_states""", "mixed_states")
def prj_ineligible_reason(c):
    kind = F.pmod("acq_id", F.lit(8))
    state = (
        F.when(kind == 1, "failed").when(kind == 2, "legacy_unassessed").when(kind == 3, "discovered")
        .otherwise(F.col("state"))
    )
    mixed = c.acquisitions.select(
        "acq_id", state.alias("state"), "reason", "usable_pixels", "total_pixels",
        F.when(F.pmod("acq_id", F.lit(3)) != 0, F.col("usable_percentage")).alias("usable_percentage"),
    )
    fraction = history.usable_fraction(
        F.col("usable_percentage"), F.lit(None).cast("double"), F.col("usable_pixels"), F.col("total_pixels")
    )
    return mixed.select(
        "acq_id", "state", ((F.col("state") == "usable") & (fraction > 0)).alias("eligible"),
        history.ineligible_reason(F.col("state"), F.col("reason"), fraction).alias("reason"),
    )


@query("flt_change_threshold", 'SELECT aoi_id, k, "row", "col", round(CAST(signal AS DOUBLE), 6) AS signal FROM changed', "changed")
def flt_change_threshold(c):
    pairs = change.pixel_pairs(c.pixels, c.sequence, c.policy)
    return pairs.where(change.is_changed(c.policy.threshold)).select(
        "aoi_id", "k", "row", "col", r6(F.col("signal").cast("double")).alias("signal")
    )


@query("flt_min_region", "SELECT aoi_id, k, CAST(first_row AS INTEGER) AS first_row, CAST(first_col AS INTEGER) AS first_col, pixel_count FROM regions", "regions")
def flt_min_region(c):
    return c.detection.regions.select("aoi_id", "k", "first_row", "first_col", "pixel_count")


@query("flt_candidates", """
SELECT candidate_id, priority, severity, review_state, score, state, rank FROM reviewed
WHERE severity = 'medium' AND review_state = 'unreviewed' AND state = 'transient' AND score >= 0.3 AND quality_support >= 0.4
ORDER BY rank, candidate_id""", "reviewed")
def flt_candidates(c):
    chosen = triage.filter_candidates(
        c.reviewed, severity="medium", review_state="unreviewed", temporal_state="transient",
        min_score=0.3, min_quality=0.4,
    )
    return chosen.select("candidate_id", "priority", "severity", "review_state", "score", "state", "rank").orderBy(
        "rank", "candidate_id"
    )


@query("flt_reusable_scene", """
SELECT acq_id, CASE WHEN state = 'usable' THEN acq_id % 9 NOT IN (4, 5, 6, 7) ELSE acq_id % 9 <> 4 END AS reusable FROM acq""", "acq")
def flt_reusable_scene(c):
    return reuse.reusable_scenes(artifacts(c)).select("acq_id", "reusable")


cte("stored_runs", """
SELECT i.aoi_id, i.before_acq, i.after_acq, i.k, o.o_orderkey AS run_id,
       CASE WHEN o_orderkey % 5 = 0 THEN 0.3 ELSE 0.2 END AS threshold,
       CASE WHEN o_orderkey % 7 = 0 THEN 8 ELSE 4 END AS min_region_pixels,
       o_orderkey % 3 > 0 AS aware, o_orderkey % 4 = 0 AS legacy
FROM orders o JOIN iv i ON i.aoi_id = o_orderkey // 1500 + 1 AND i.k = o_custkey % 7""", "iv")
cte("reusable_runs", """
SELECT * FROM (SELECT * FROM stored_runs WHERE aware AND NOT legacy
  QUALIFY row_number() OVER (PARTITION BY before_acq, after_acq ORDER BY run_id DESC) = 1)
WHERE threshold = 0.2 AND min_region_pixels = 4""", "stored_runs")


def reusable(c: Chain):
    runs = fixtures.stored_runs(c.spark, c.sf_dir, c.detection.intervals)
    return materialize(reuse.reusable_runs(runs, c.acquisitions, c.policy), "reusable-runs")


@query("flt_reusable_run", "SELECT aoi_id, before_acq, after_acq, run_id FROM reusable_runs", "reusable_runs")
def flt_reusable_run(c):
    return reusable(c)


# Stored analyses: version 1 of every AOI rests on today's runs; version 2 has another
# run in its last interval; version 3 another IoU threshold; version 4 lacks interval 0.
@query("flt_reusable_analysis", """
SELECT aoi_id, aoi_id * 10 + 1 AS analysis_id FROM iv LEFT JOIN reusable_runs u USING (before_acq, after_acq, aoi_id)
GROUP BY aoi_id HAVING count(u.run_id) = count(*)""", "reusable_runs", "iv")
def flt_reusable_analysis(c):
    """Analyses whose intervals all rest on the run that would be reused today."""
    intervals = c.detection.intervals
    today = reusable(c)
    planned = reuse.plan_detections(intervals, today).withColumn("run_id", F.coalesce("reused_run", "run_id"))
    last = intervals.groupBy("aoi_id").agg(F.max("k").alias("last_k"))
    versions = planned.join(last, "aoi_id").withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(4)))).where(
        ~((F.col("v") == 4) & (F.col("k") == 0))
    )
    run = F.when((F.col("v") == 2) & (F.col("k") == F.col("last_k")), -1).otherwise(F.col("run_id"))
    identity = (F.col("aoi_id") * 10 + F.col("v")).alias("analysis_id")
    relationships = versions.select(identity, F.col("k").alias("seq"), "before_acq", "after_acq", run.alias("run_id"))
    analyses = versions.select(
        identity, F.when(F.col("v") == 3, 0.5).otherwise(0.25).alias("iou_threshold")
    ).distinct()
    requested = intervals.select("aoi_id", F.col("k").alias("seq"), "before_acq", "after_acq")
    return reuse.matching_analyses(analyses, relationships, requested, today, c.policy).select("aoi_id", "analysis_id")


# --- sorts and sets ----------------------------------------------------------------


@query("sort_catalog", "SELECT aoi_id, item_id, position FROM discovered ORDER BY aoi_id, position", "discovered")
def sort_catalog(c):
    return discovered(c).select("aoi_id", "item_id", F.col("position").cast("bigint").alias("position")).orderBy(
        "aoi_id", "position"
    )


@query("top_catalog_item", "SELECT aoi_id, item_id FROM discovered WHERE position = 1", "discovered")
def top_catalog_item(c):
    return catalog.best(catalog.covering(found(c))).select("aoi_id", "item_id")


@query("set_reuse_split", """
SELECT aoi_id, item_id, CASE WHEN acq_id % 9 = 4 OR (state = 'usable' AND acq_id % 9 IN (5, 6, 7)) THEN 'process' ELSE 'reuse' END AS plan
FROM acq""", "acq")
def set_reuse_split(c):
    done, todo = reuse.split_reuse(c.scenes.select("aoi_id", "item_id"), artifacts(c))
    return done.withColumn("plan", F.lit("reuse")).unionByName(todo.withColumn("plan", F.lit("process")))


@query("set_union_results", f"""
SELECT aoi_id, acq_id, CASE WHEN ts < TIMESTAMP '{STORED_BEFORE}' THEN 'available' ELSE 'completed' END AS origin
FROM acq WHERE state = 'usable'""", "acq")
def set_union_results(c):
    """Reused and newly processed usable observations together."""
    usable = c.acquisitions.where("state = 'usable'").select("aoi_id", "acq_id", "ts")
    limit = F.lit(STORED_BEFORE).cast("timestamp")
    old = usable.where(F.col("ts") < limit).withColumn("origin", F.lit("available"))
    new = usable.where(F.col("ts") >= limit).withColumn("origin", F.lit("completed"))
    return old.unionByName(new).drop("ts")


@query("set_ids_equal", """
SELECT candidate_id, signal_id % 4 <> 1 AS same_runs, signal_id % 4 <> 2 AS same_acquisitions FROM candidates""", "candidates")
def set_ids_equal(c):
    """Id lists of candidates against those of their signals; some were altered."""
    kind = F.pmod("signal_id", F.lit(4))
    altered = c.candidates.select(
        "candidate_id", "analysis_id", "signal_id",
        F.when(kind == 1, F.array_append("detection_run_ids", F.lit(-1))).otherwise(F.col("detection_run_ids")).alias("runs"),
        F.when(kind == 2, F.slice("acquisition_ids", F.lit(2), F.size("acquisition_ids"))).otherwise(F.reverse("acquisition_ids")).alias("acqs"),
    )
    facts = c.signals.select("analysis_id", "signal_id", "detection_run_ids", "acquisition_ids")
    same_set = (F.size(F.array_except("acqs", "acquisition_ids")) == 0) & (F.size(F.array_except("acquisition_ids", "acqs")) == 0)
    return altered.join(facts, ["analysis_id", "signal_id"]).select(
        "candidate_id", (F.col("runs") == F.col("detection_run_ids")).alias("same_runs"), same_set.alias("same_acquisitions")
    )


@query("set_region_iou", "SELECT aoi_id, from_k, from_no, k, region_no, shared, round(iou, 6) AS iou FROM links", "links")
def set_region_iou(c):
    """All region pairs that overlap enough to be linked, whether a track links them or not."""
    return tracks.region_overlap(c.region_pixels, c.policy).select("aoi_id", "from_k", "from_no", "k", "region_no", "shared", r6("iou").alias("iou"))
