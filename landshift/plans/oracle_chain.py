"""SQL form of the fixtures and of the analysis chain, for DuckDB.

``with_chain(select, *names)`` puts the named common table expressions and everything
they need in front of a final SELECT. The SQL is written from the definitions, in
another way than the Spark jobs: self-joins instead of windows, a recursive query
instead of tiles, one unrolled step per interval instead of a loop.
"""

from __future__ import annotations

from landshift.functions import geometry as G
from landshift.plans.fixtures import BOUNDARY, CUT, ORDERS_PER_AOI, ORIGIN_Y, SIDE

AOI = f"(l_orderkey // {ORDERS_PER_AOI} + 1)"
# Intervals are numbered from 0; seven years of scenes give at most six of them.
MAX_INTERVALS = 6

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *needs: str, materialized: bool = True) -> None:
    hint = "MATERIALIZED " if materialized else ""
    CTES[name] = (f"{name} AS {hint}(\n{body.strip()}\n)", needs)


UTM = G.UTM_SCALE * G.RECTIFYING


def sql_series(terms, body: str) -> str:
    return " + ".join(f"({a!r}::DOUBLE) * {body.format(m=2 * j)}" for j, a in enumerate(terms, start=1))


def sql_inverse(x: str, y: str, source: str, keep: str) -> str:
    """Rows of ``source`` with lon (radians from the zone's meridian) and lat of (x, y)."""
    return f"""
SELECT {keep}, lam, chi + {sql_series(G.DELTA, 'sin({m} * chi)')} AS phi
FROM (SELECT {keep}, atan2(sinh(eta), cos(xi)) AS lam, asin(sin(xi) / cosh(eta)) AS chi
  FROM (SELECT {keep}, xi0 - ({sql_series(G.BETA, 'sin({m} * xi0) * cosh({m} * eta0)')}) AS xi,
               eta0 - ({sql_series(G.BETA, 'cos({m} * xi0) * sinh({m} * eta0)')}) AS eta
    FROM (SELECT {keep}, ({y}) / {UTM!r}::DOUBLE AS xi0, (({x}) - 500000) / {UTM!r}::DOUBLE AS eta0 FROM {source})))"""


def with_chain(select: str, *names: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][1]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return select
    return "WITH RECURSIVE " + ",\n".join(CTES[n][0] for n in ordered) + "\n" + select


cte("px_cells", f"""
SELECT {AOI} AS aoi_id, year(l_shipdate) - 1994 AS acq,
       CAST((l_suppkey * 7 + l_linenumber * 13 + l_orderkey) % {SIDE} AS INTEGER) AS "row",
       CAST(l_partkey % {SIDE} AS INTEGER) AS "col",
       max(l_quantity) AS q_max, max(l_extendedprice) AS p_max,
       min(l_quantity) AS q_min, min(l_extendedprice) AS p_min,
       min(l_partkey) AS part, min(l_partkey * 31 + l_orderkey) AS mix
FROM lineitem GROUP BY ALL""")

cte("px_all", """
SELECT aoi_id, aoi_id * 100 + acq AS acq_id, "row", "col",
       CAST(floor(q_max) * 20 AS FLOAT) AS red,
       CAST(floor(floor(p_max) / 20) AS FLOAT) AS nir,
       CASE WHEN (aoi_id + acq) % 6 = 0 AND part % 3 > 0 THEN 9
            WHEN mix % 12 = 0 THEN 8 WHEN mix % 12 = 1 THEN 3 WHEN mix % 12 = 2 THEN 0
            WHEN mix % 12 = 3 THEN 5 WHEN mix % 12 = 4 THEN 6 ELSE 4 END AS scl,
       CAST(floor(floor(p_min) / 25) AS FLOAT) AS green,
       CAST(floor(q_min) * 30 AS FLOAT) AS blue
FROM px_cells""", "px_cells")

# Pixel centres inside the octagonal AOI of the grid.
INSIDE_OF = """({0}"col" + {0}"row" + 1) * 10 > 45 AND (20 - {0}"col" + {0}"row") * 10 > 45
  AND ({0}"col" + 20 - {0}"row") * 10 > 45 AND (39 - {0}"col" - {0}"row") * 10 > 45"""
INSIDE = INSIDE_OF.format("")

cte("px", f"SELECT * FROM px_all WHERE {INSIDE}", "px_all")

cte("scn", f"""
SELECT DISTINCT aoi_id, aoi_id * 100 + acq AS acq_id,
       'scene/' || aoi_id || '.' || acq AS item_id,
       CAST(make_date(1994 + acq, 1 + aoi_id % 12, 15) AS TIMESTAMP) AS ts,
       600000 + (aoi_id % 1000) * 200.0 AS x0
FROM (SELECT {AOI} AS aoi_id, year(l_shipdate) - 1994 AS acq FROM lineitem)""")

SCENE_SIZE = SIDE * SIDE


def _quality(valid: str) -> str:
    return f"""
SELECT s.aoi_id, s.acq_id, s.item_id, s.ts, s.x0, CAST({SCENE_SIZE} AS BIGINT) AS total_pixels,
       count(*) FILTER ({valid} AND scl IN (8, 9, 10)) AS cloud_pixels,
       count(*) FILTER ({valid} AND scl = 3) AS shadow_pixels,
       count(*) FILTER ({valid} AND scl IN (4, 5, 6)) AS usable_pixels
FROM scn s JOIN px p ON p.acq_id = s.acq_id GROUP BY ALL"""


def _graded(source: str) -> str:
    return f"""
SELECT *, total_pixels - cloud_pixels - shadow_pixels - usable_pixels AS invalid_pixels,
       round((total_pixels - cloud_pixels - shadow_pixels - usable_pixels) / total_pixels * 100, 6) AS invalid_percentage,
       round(cloud_pixels / total_pixels * 100, 6) AS cloud_percentage,
       round(shadow_pixels / total_pixels * 100, 6) AS shadow_percentage,
       round(usable_pixels / total_pixels * 100, 6) AS usable_percentage,
       CASE WHEN usable_pixels > 0 AND usable_pixels / total_pixels >= 0.5 THEN 'usable' ELSE 'valid_unusable' END AS state,
       CASE WHEN usable_pixels = 0 THEN 'no_usable_pixels'
            WHEN usable_pixels / total_pixels < 0.5 THEN 'insufficient_usable_pixels'
            ELSE 'quality_policy_passed' END AS reason
FROM {source}"""


cte("screen_counts", _quality("TRUE"), "scn", "px")
cte("screened", _graded("screen_counts"), "screen_counts")
cte("quality_counts", _quality("red + nir <> 0"), "scn", "px")
cte("acq", _graded("quality_counts"), "quality_counts")

cte("seqd", """
SELECT *, CAST(row_number() OVER (PARTITION BY aoi_id ORDER BY ts, acq_id) - 1 AS INTEGER) AS seq
FROM acq WHERE state = 'usable' AND usable_percentage > 0""", "acq")

cte("iv", """
SELECT b.aoi_id, b.seq AS k, b.acq_id AS before_acq, a.acq_id AS after_acq, b.ts AS before_ts, a.ts AS after_ts,
       least(b.usable_percentage, a.usable_percentage) / 100.0 AS quality_support,
       (epoch(a.ts) - epoch(b.ts)) / 86400.0 AS elapsed_days,
       (b.aoi_id << 12) + b.seq AS run_id
FROM seqd b JOIN seqd a ON a.aoi_id = b.aoi_id AND a.seq = b.seq + 1""", "seqd")

cte("ndvi", """
SELECT *, CAST((nir - red) / (nir + red) AS FLOAT) AS v FROM px WHERE red + nir <> 0""", "px")

cte("pairs", """
SELECT i.aoi_id, i.k, b."row", b."col",
       (b.scl IN (8, 9, 10) OR a.scl IN (8, 9, 10)) AS cloud,
       (b.scl = 3 OR a.scl = 3) AND NOT (b.scl IN (8, 9, 10) OR a.scl IN (8, 9, 10)) AS shadow,
       (b.scl IN (4, 5, 6) AND a.scl IN (4, 5, 6)) AS valid,
       abs(a.v - b.v) AS signal
FROM iv i JOIN ndvi b ON b.acq_id = i.before_acq
JOIN ndvi a ON a.acq_id = i.after_acq AND a."row" = b."row" AND a."col" = b."col" """, "iv", "ndvi")

cte("changed", f"""
SELECT aoi_id, k, "row", "col", signal, "row" * {SIDE} + "col" AS idx
FROM pairs WHERE valid AND signal >= CAST(0.20 AS FLOAT)""", "pairs")

# Labels walk from each pixel to its larger neighbours; the smallest label that
# arrives is the first pixel of the component.
CTES["reach"] = ("""reach AS (
SELECT aoi_id, k, "row", "col", idx, idx AS label FROM changed
UNION
SELECT c.aoi_id, c.k, c."row", c."col", c.idx, r.label
FROM reach r JOIN changed c ON c.aoi_id = r.aoi_id AND c.k = r.k AND c.idx > r.label
 AND abs(c."row" - r."row") <= 1 AND abs(c."col" - r."col") <= 1
)""", ("changed",))

cte("comp", """
SELECT r.aoi_id, r.k, r."row", r."col", c.signal, min(r.label) AS region_key
FROM reach r JOIN changed c ON c.aoi_id = r.aoi_id AND c.k = r.k AND c.idx = r.idx
GROUP BY r.aoi_id, r.k, r."row", r."col", c.signal""", "reach", "changed")

# Equal-area size of every grid cell from its four projected corners.
cte("cell_corners", """
SELECT aoi_id, "row" AS r, "col" AS c, n, CAST(600000 + (aoi_id % 1000) * 200 + ("col" + dx) * 10 AS DOUBLE) AS x,
       CAST(1500000 - ("row" + dy) * 10 AS DOUBLE) AS y
FROM (SELECT DISTINCT aoi_id, "row", "col" FROM px), (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) v(n, dx, dy)""", "px")
_K0 = f"(cos(radians(30.0::DOUBLE)) / sqrt(1 - {G.ECC2!r}::DOUBLE * sin(radians(30.0::DOUBLE)) ** 2))"
cte("cell_flat", f"""
SELECT aoi_id, r, c, n, lam * {G.SEMI_MAJOR!r}::DOUBLE * {_K0} AS ex,
       {G.SEMI_MAJOR!r}::DOUBLE / (2 * {_K0}) * (1 - {G.ECC2!r}::DOUBLE) * (sin(phi) / (1 - {G.ECC2!r}::DOUBLE * sin(phi) ** 2) + atanh({G.ECC!r}::DOUBLE * sin(phi)) / {G.ECC!r}::DOUBLE) AS ey
FROM ({sql_inverse('x', 'y', 'cell_corners', 'aoi_id, r, c, n')})""", "cell_corners")
cte("cell_sizes", """
SELECT aoi_id, r AS "row", c AS "col",
       abs((max(ex) FILTER (n = 2) - max(ex) FILTER (n = 0)) * (max(ey) FILTER (n = 3) - max(ey) FILTER (n = 1))
         - (max(ey) FILTER (n = 2) - max(ey) FILTER (n = 0)) * (max(ex) FILTER (n = 3) - max(ex) FILTER (n = 1))) / 2 AS cell_m2
FROM cell_flat GROUP BY ALL""", "cell_flat")

cte("all_regions", """
SELECT aoi_id, k, region_key, count(*) AS pixel_count, sum(cell_m2) AS area_m2,
       sum(CAST(signal AS DOUBLE)) / count(*) AS mean_change_signal,
       max(CAST(signal AS DOUBLE)) AS max_change_signal
FROM comp JOIN cell_sizes USING (aoi_id, "row", "col") GROUP BY aoi_id, k, region_key""", "comp", "cell_sizes")

cte("regions", f"""
SELECT *, region_key // {SIDE} AS first_row, region_key % {SIDE} AS first_col,
       (((aoi_id << 12) + k) << 25) + region_no AS region_id
FROM (SELECT *, row_number() OVER (PARTITION BY aoi_id, k ORDER BY region_key) AS region_no
      FROM all_regions WHERE pixel_count >= 4)""", "all_regions")

cte("rpx", """
SELECT c.aoi_id, c.k, c."row", c."col", c.signal, r.region_no, r.pixel_count
FROM comp c JOIN regions r USING (aoi_id, k, region_key)""", "comp", "regions")

cte("counters", """
SELECT aoi_id, k, count(*) FILTER (valid) AS valid_pixels, count(*) FILTER (cloud) AS cloud_pixels,
       count(*) FILTER (shadow) AS shadow_pixels,
       count(*) FILTER (valid AND signal >= CAST(0.20 AS FLOAT)) AS raw_pixels,
       coalesce(avg(CAST(signal AS DOUBLE)) FILTER (valid AND signal >= CAST(0.20 AS FLOAT)), 0) AS mean_change_signal,
       coalesce(max(CAST(signal AS DOUBLE)) FILTER (valid AND signal >= CAST(0.20 AS FLOAT)), 0) AS max_change_signal
FROM pairs GROUP BY aoi_id, k""", "pairs")

cte("run_regions", """
SELECT aoi_id, k, count(*) AS region_count, sum(pixel_count) AS filtered_pixels, sum(area_m2) AS total_area,
       max(area_m2) AS largest_area, avg(area_m2) AS mean_area, median(area_m2) AS median_area
FROM regions GROUP BY aoi_id, k""", "regions")

cte("runs", f"""
SELECT i.*, coalesce(c.valid_pixels, 0) AS quality_valid_pixel_count,
       {SCENE_SIZE} - coalesce(c.valid_pixels, 0) AS excluded_pixel_count,
       coalesce(c.cloud_pixels, 0) AS excluded_cloud_pixel_count,
       coalesce(c.shadow_pixels, 0) AS excluded_shadow_pixel_count,
       coalesce(c.raw_pixels, 0) AS raw_changed_pixel_count,
       coalesce(round(c.raw_pixels / c.valid_pixels * 100, 6), 0) AS changed_pixel_percentage,
       coalesce(c.mean_change_signal, 0) AS mean_change_signal,
       coalesce(c.max_change_signal, 0) AS max_change_signal,
       coalesce(r.region_count, 0) AS region_count,
       CAST(coalesce(r.filtered_pixels, 0) AS BIGINT) AS filtered_changed_pixel_count,
       coalesce(r.total_area, 0.0) AS total_changed_area_m2,
       coalesce(r.largest_area, 0.0) AS largest_region_area_m2,
       coalesce(r.mean_area, 0.0) AS mean_region_area_m2,
       coalesce(r.median_area, 0.0) AS median_region_area_m2
FROM iv i LEFT JOIN counters c USING (aoi_id, k) LEFT JOIN run_regions r USING (aoi_id, k)""",
    "iv", "counters", "run_regions")

cte("overlap_all", """
SELECT *, shared / (from_pixels + to_pixels - shared) AS iou FROM (
  SELECT a.aoi_id, a.k AS from_k, a.region_no AS from_no, b.k, b.region_no,
         a.pixel_count AS from_pixels, b.pixel_count AS to_pixels, count(*) AS shared
  FROM rpx a JOIN rpx b ON b.aoi_id = a.aoi_id AND b."row" = a."row" AND b."col" = a."col" AND b.k > a.k
  GROUP BY ALL)""", "rpx")
cte("links", "SELECT * FROM overlap_all WHERE iou >= 0.25", "overlap_all")

# One step per interval: the last region of every open track, the best open track per
# region, the first claimant per track, new tracks for the rest.
cte("track_0", """
SELECT aoi_id, k, region_no, k AS birth_k, region_no AS birth_no, 1.0::DOUBLE AS iou,
       CAST(NULL AS INTEGER) AS from_k, CAST(NULL AS BIGINT) AS from_no
FROM regions WHERE k = 0""", "regions")
for _k in range(1, MAX_INTERVALS + 1):
    _prev = f"track_{_k - 1}"
    cte(f"claim_{_k}", f"""
SELECT l.aoi_id, l.k, l.region_no, t.birth_k, t.birth_no, l.iou, l.from_k, l.from_no
FROM links l
JOIN (SELECT * FROM {_prev}
      QUALIFY row_number() OVER (PARTITION BY aoi_id, birth_k, birth_no ORDER BY k DESC) = 1) t
  ON t.aoi_id = l.aoi_id AND t.k = l.from_k AND t.region_no = l.from_no
WHERE l.k = {_k}
QUALIFY row_number() OVER (PARTITION BY l.aoi_id, l.region_no ORDER BY l.iou DESC, t.birth_k, t.birth_no) = 1""",
        "links", _prev)
    cte(f"win_{_k}", f"""
SELECT * FROM claim_{_k}
QUALIFY row_number() OVER (PARTITION BY aoi_id, birth_k, birth_no ORDER BY region_no) = 1""", f"claim_{_k}")
    cte(f"track_{_k}", f"""
SELECT * FROM {_prev}
UNION ALL
SELECT r.aoi_id, r.k, r.region_no, coalesce(w.birth_k, r.k), coalesce(w.birth_no, r.region_no),
       coalesce(w.iou, 1.0), w.from_k, w.from_no
FROM regions r LEFT JOIN win_{_k} w ON w.aoi_id = r.aoi_id AND w.region_no = r.region_no
WHERE r.k = {_k}""", _prev, f"win_{_k}", "regions")
cte("tracks", f"SELECT * FROM track_{MAX_INTERVALS}", f"track_{MAX_INTERVALS}")

cte("entries", """
SELECT t.*, r.region_id, r.pixel_count, r.area_m2, r.mean_change_signal, r.max_change_signal,
       u.run_id, u.before_acq, u.after_acq, u.before_ts, u.after_ts, u.quality_support,
       u.mean_change_signal AS run_mean, u.max_change_signal AS run_max, u.total_changed_area_m2 AS run_area,
       u.raw_changed_pixel_count,
       CAST(dayofyear(make_timestamp((epoch_us(u.before_ts) + epoch_us(u.after_ts)) // 2)) AS INTEGER) AS mid_day,
       lag(t.k) OVER tr AS previous_k,
       first_value(dayofyear(make_timestamp((epoch_us(u.before_ts) + epoch_us(u.after_ts)) // 2))) OVER tr AS anchor_day
FROM tracks t JOIN regions r USING (aoi_id, k, region_no) JOIN runs u USING (aoi_id, k)
WINDOW tr AS (PARTITION BY t.aoi_id, birth_k, birth_no ORDER BY t.k)""", "tracks", "regions", "runs")

# Outlines of tracks from their pixels alone: a grid corner with one or three pixels around it is one
# vertex, one with two that face each other is two; polygons less holes are pixels less neighbour
# pairs plus full blocks of four.
cte("tpx", """
SELECT DISTINCT e.aoi_id, e.birth_k, e.birth_no, p."row", p."col"
FROM entries e JOIN rpx p ON p.aoi_id = e.aoi_id AND p.k = e.k AND p.region_no = e.region_no""", "entries", "rpx")
cte("track_around", """
SELECT aoi_id, birth_k, birth_no, "row" + dy AS y, "col" + dx AS x, count(*) AS n, min((dx + dy) % 2) = max((dx + dy) % 2) AS facing
FROM tpx, range(2) a(dy), range(2) b(dx) GROUP BY ALL""", "tpx")
cte("track_beside", """
SELECT p.aoi_id, p.birth_k, p.birth_no, count(*) AS pairs FROM tpx p JOIN tpx q
  ON p.aoi_id = q.aoi_id AND p.birth_k = q.birth_k AND p.birth_no = q.birth_no
 AND ((q."row" = p."row" AND q."col" = p."col" + 1) OR (q."row" = p."row" + 1 AND q."col" = p."col"))
GROUP BY ALL""", "tpx")
cte("track_shape", """
SELECT t.aoi_id, t.birth_k, t.birth_no, t.union_pixels, CAST(v.corners AS BIGINT) AS corners,
       t.union_pixels - coalesce(b.pairs, 0) + v.blocks AS shells_less_holes, v.left_x, v.top_y, v.right_x, v.bottom_y, t.mid_row, t.mid_col
FROM (SELECT aoi_id, birth_k, birth_no, count(*) AS union_pixels, avg("row" + 0.5) AS mid_row, avg("col" + 0.5) AS mid_col FROM tpx GROUP BY ALL) t
JOIN (SELECT aoi_id, birth_k, birth_no, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND facing THEN 2 ELSE 0 END) AS corners,
             count(*) FILTER (n = 4) AS blocks, min(x) AS left_x, min(y) AS top_y, max(x) AS right_x, max(y) AS bottom_y
      FROM track_around GROUP BY ALL) v USING (aoi_id, birth_k, birth_no)
LEFT JOIN track_beside b USING (aoi_id, birth_k, birth_no)""", "tpx", "track_around", "track_beside")

# Corners and middles of the outlines in longitude and latitude, from the grid of the scenes.
_PLACE = "CAST(600000 + (aoi_id % 1000) * 200 + {x} * 10 AS DOUBLE) AS gx, CAST(1500000 - {y} * 10 AS DOUBLE) AS gy"
_TRACK = "aoi_id, birth_k, birth_no"
cte("track_places", f"""
SELECT {_TRACK}, {_PLACE.format(x='x', y='y')} FROM track_around WHERE n IN (1, 3) OR (n = 2 AND facing)""", "track_around")
cte("track_map", f"""
SELECT {_TRACK}, round(min(75 + degrees(lam)), 6) AS left_lon, round(min(degrees(phi)), 6) AS bottom_lat,
       round(max(75 + degrees(lam)), 6) AS right_lon, round(max(degrees(phi)), 6) AS top_lat
FROM ({sql_inverse('gx', 'gy', 'track_places', _TRACK)}) GROUP BY ALL""", "track_places")
cte("track_spots", f"SELECT {_TRACK}, {_PLACE.format(x='mid_col', y='mid_row')} FROM track_shape", "track_shape")
cte("track_middle", f"""
SELECT {_TRACK}, round(75 + degrees(lam), 6) AS lon, round(degrees(phi), 6) AS lat FROM ({sql_inverse('gx', 'gy', 'track_spots', _TRACK)})""", "track_spots")

cte("totals", """
SELECT aoi_id, CAST(count(*) AS INTEGER) AS interval_count, sum(quality_support) AS total_quality,
       sum(filtered_changed_pixel_count) AS total_pixels
FROM runs GROUP BY aoi_id""", "runs")

cte("grouped", """
SELECT aoi_id, birth_k, birth_no, CAST(count(*) AS INTEGER) AS support_count,
       CAST(count(*) FILTER (k > previous_k + 1) AS INTEGER) AS recurrence_count,
       sum(quality_support ORDER BY k) AS quality, sum(iou ORDER BY k) AS iou_sum, sum(pixel_count) AS pixels,
       min(before_ts) AS first_change_ts, max(after_ts) AS last_supporting_ts,
       min_by(before_acq, k) AS onset_before_acq, min_by(after_acq, k) AS onset_after_acq,
       min_by(before_ts, k) AS onset_start_ts, min_by(after_ts, k) AS onset_end_ts,
       max(least(abs(mid_day - anchor_day), 366 - abs(mid_day - anchor_day))) AS season_distance,
       list(run_mean ORDER BY k) AS interval_means, list(run_max ORDER BY k) AS interval_maxima,
       list(region_id ORDER BY k) AS source_region_ids,
       list(DISTINCT run_id ORDER BY run_id) AS detection_run_ids,
       list_sort(list_distinct(list_concat(list(before_acq), list(after_acq)))) AS acquisition_ids,
       max(area_m2) AS area_m2, avg(mean_change_signal) AS mean_delta, max(max_change_signal) AS max_delta,
       max(run_area) AS runs_area, avg(run_mean) AS runs_mean, max(run_max) AS runs_max
FROM entries GROUP BY aoi_id, birth_k, birth_no""", "entries")

cte("signals", """
SELECT g.*, g.aoi_id AS analysis_id, t.interval_count,
       row_number() OVER (PARTITION BY g.aoi_id ORDER BY birth_k, birth_no) AS signal_id,
       CASE WHEN t.total_quality > 0 THEN g.quality / t.total_quality ELSE 0 END AS persistence_ratio,
       CASE WHEN support_count = 1 AND interval_count > 1 THEN 1 ELSE 0 END AS transient_interval_count,
       iou_sum / support_count AS temporal_consistency,
       pixels / greatest(1, total_pixels) AS matched_region_coverage,
       CASE WHEN support_count = interval_count AND interval_count > 1 THEN 'persistent'
            WHEN recurrence_count > 0 THEN 'recurrent'
            WHEN interval_count > 1 THEN 'transient' ELSE 'isolated' END AS state,
       quality / support_count AS quality_support,
       CASE WHEN interval_count + 1 < 4 THEN 'insufficient_temporal_evidence'
            WHEN support_count < 2 THEN 'less_seasonal_compatible'
            WHEN season_distance <= 60 THEN 'seasonal_compatible'
            ELSE 'less_seasonal_compatible' END AS season
FROM grouped g JOIN totals t USING (aoi_id)""", "grouped", "totals")

cte("signal_states", """
SELECT aoi_id, count(*) AS signals, count(*) FILTER (state = 'persistent') AS persistent,
       count(*) FILTER (state = 'recurrent') AS recurrent, count(*) FILTER (state = 'transient') AS transient,
       count(*) FILTER (state = 'isolated') AS isolated,
       count(*) FILTER (season = 'seasonal_compatible') AS seasonal
FROM signals GROUP BY aoi_id""", "signals")

cte("analyses", """
SELECT o.aoi_id AS analysis_id, o.observation_count, o.temporal_span_days,
       coalesce(r.n, 0) AS detector_run_count, coalesce(r.quality_support, 0) AS quality_support,
       CASE WHEN observation_count < 3 THEN 'insufficient_history'
            WHEN persistent > 0 THEN 'persistent' WHEN recurrent > 0 THEN 'recurrent'
            WHEN transient > 0 THEN 'transient' WHEN signals > 0 THEN 'isolated'
            ELSE 'no_temporal_signal' END AS state,
       CASE WHEN observation_count < 4 OR coalesce(signals, 0) = 0 THEN 'insufficient_temporal_evidence'
            WHEN seasonal > 0 THEN 'seasonal_compatible' ELSE 'less_seasonal_compatible' END AS season
FROM (SELECT aoi_id, count(*) AS observation_count, (epoch(max(ts)) - epoch(min(ts))) / 86400.0 AS temporal_span_days
      FROM seqd GROUP BY aoi_id) o
LEFT JOIN (SELECT aoi_id, count(*) AS n, avg(quality_support) AS quality_support FROM runs GROUP BY aoi_id) r USING (aoi_id)
LEFT JOIN signal_states s USING (aoi_id)""", "seqd", "runs", "signal_states")

cte("scored_1", """
SELECT s.*, greatest(0.0, least(1.0, persistence_ratio)) AS pers,
       greatest(0.0, least(1.0, temporal_consistency)) AS cons,
       greatest(0.0, least(1.0, quality_support)) AS qual,
       greatest(0.0, least(1.0, matched_region_coverage)) AS cover,
       greatest(0.0, least(1.0, (mean_delta - 0.20::DOUBLE) / 0.60::DOUBLE)) AS norm_delta,
       greatest(0.0, least(1.0, (area_m2 - 500.0) / 9500.0)) AS norm_area
FROM signals s WHERE analysis_id IN (SELECT analysis_id FROM analyses WHERE state <> 'insufficient_history')""", "signals", "analyses")

cte("scored_2", """
SELECT *, round(norm_delta * 0.6::DOUBLE + norm_area * 0.4::DOUBLE, 6) AS magnitude FROM scored_1""", "scored_1")

cte("scored_3", """
SELECT *, round(pers * 0.35::DOUBLE + cons * 0.25::DOUBLE + magnitude * 0.20::DOUBLE + qual * 0.20::DOUBLE, 4) AS score,
       CASE WHEN norm_area >= 0.50 OR norm_delta >= 0.50 OR magnitude >= 0.45 THEN 'high'
            WHEN norm_area >= 0.20 OR norm_delta >= 0.25 OR magnitude >= 0.20 THEN 'medium' ELSE 'low' END AS severity
FROM scored_2""", "scored_2")

cte("scored", """
SELECT *, 'analysis-' || analysis_id || '-signal-' || signal_id AS candidate_id,
       CASE WHEN NOT (quality_support > 0 AND quality_support < 0.40)
             AND ((severity = 'high' AND score >= 0.50) OR (severity = 'medium' AND state = 'persistent' AND score >= 0.55))
            THEN 'urgent'
            WHEN severity = 'high' OR (severity = 'medium' AND score >= 0.40) OR (state = 'persistent' AND score >= 0.45)
             OR (state = 'recurrent' AND severity = 'medium' AND quality_support >= 0.40) THEN 'high'
            ELSE 'normal' END AS priority
FROM scored_3""", "scored_3")

PRIORITY_WEIGHT = "CASE priority WHEN 'urgent' THEN 4 WHEN 'high' THEN 3 WHEN 'normal' THEN 2 ELSE 1 END"
SEVERITY_WEIGHT = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"

cte("candidates", f"""
SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY {PRIORITY_WEIGHT} DESC, score DESC,
  {SEVERITY_WEIGHT} DESC, quality_support DESC, area_m2 DESC, signal_id) AS rank
FROM scored""", "scored")

cte("review_log", f"""
SELECT 'analysis-' || (o_orderkey // {ORDERS_PER_AOI} + 1) || '-signal-' || (o_custkey % 40 + 1) AS candidate_id,
       CASE o_orderpriority[1] WHEN '1' THEN 'accepted' WHEN '2' THEN 'rejected' WHEN '3' THEN 'investigate'
            WHEN '4' THEN 'unreviewed' ELSE 'escalate' END AS decision,
       CASE o_orderkey % 4 WHEN 0 THEN 'status ' || o_orderstatus || ' checked' END AS note,
       o_orderdate AS ts, o_orderkey AS log_id
FROM orders""")

cte("reviews", """
SELECT candidate_id, max_by(decision, {'t': ts, 'i': log_id}) AS decision,
       arg_max_null(note, {'t': ts, 'i': log_id}) AS note, min(ts) AS created_at, max(ts) AS updated_at
FROM review_log l
WHERE decision IN ('accepted', 'rejected', 'investigate')
  AND NOT EXISTS (SELECT 1 FROM review_log r WHERE r.candidate_id = l.candidate_id AND r.decision = 'unreviewed'
                  AND (r.ts > l.ts OR (r.ts = l.ts AND r.log_id > l.log_id)))
GROUP BY candidate_id""", "review_log")

cte("reviewed", """
SELECT c.*, coalesce(r.decision, 'unreviewed') AS review_state
FROM candidates c LEFT JOIN reviews r USING (candidate_id)""", "candidates", "reviews")

# --- catalog ------------------------------------------------------------------------

cte("items", """
SELECT printf('item-%06d', event_id) AS item_id, event_id, event_type,
       CASE WHEN event_id % 11 = 0 THEN 'landsat-c2-l2' ELSE 'sentinel-2-l2a' END AS collection, ts,
       CASE WHEN event_type = 'error' THEN 'n/a' ELSE printf('%.4f', value / 5.0) END AS cloud_cover,
       CASE WHEN event_type = 'error' THEN NULL ELSE CAST(printf('%.4f', value / 5.0) AS DOUBLE) END AS cloud,
       event_type <> 'signup' AND TRUE AS has_bands, event_type <> 'view' AS has_scl, event_type <> 'click' AS has_display,
       event_id % 17 <> 0 AS has_footprint,
       76.0::DOUBLE + (event_id % 10) * 0.25 AS fl, 11.5::DOUBLE + (event_id % 10) * 0.125 AS fb,
       78.0::DOUBLE + (event_id % 10) * 0.25 AS fr, 13.5::DOUBLE + (event_id % 10) * 0.125 AS ft
FROM events""")

cte("catalog_aois", """
SELECT aoi_id, 77.0::DOUBLE + aoi_id * 0.25 AS al, 12.0::DOUBLE + aoi_id * 0.25 AS ab,
       77.25::DOUBLE + aoi_id * 0.25 AS ar, 12.25::DOUBLE + aoi_id * 0.25 AS atop
FROM (SELECT DISTINCT CAST(user_id % 4 + 1 AS BIGINT) AS aoi_id FROM events)""")

CATALOG_FROM, CATALOG_TO = "2024-01-03", "2024-01-25"

cte("found", f"""
SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY ts DESC, item_id) AS result_no
FROM items, catalog_aois
WHERE collection = 'sentinel-2-l2a' AND ts >= TIMESTAMP '{CATALOG_FROM}' AND ts <= TIMESTAMP '{CATALOG_TO}'
  AND has_footprint AND fl <= ar AND fr >= al AND fb <= atop AND ft >= ab""", "items", "catalog_aois")

cte("discovered", """
SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY cloud ASC NULLS LAST, ts, item_id) AS position
FROM found
WHERE has_bands AND has_scl AND fl <= al AND fr >= ar AND fb <= ab AND ft >= atop""", "found")

BOX = BOUNDARY
AOI_CUT, AOI_TOP = CUT, ORIGIN_Y
