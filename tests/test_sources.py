import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import broadcast_rows, pixel_rows, pixel_table, scene_table
from landshift import schemas
from landshift.config import Policy
from landshift.functions import geometry
from landshift.operators import change, skew
from landshift.plans import chain, fixtures
from landshift.plans.queries import QUERIES
from landshift.session import materialize, stage_path
from landshift.sources import catalog, pixel_store, tables


def box(left, bottom, right, top):
    return [[left, bottom], [right, bottom], [right, top], [left, top], [left, bottom]]


def item(name, cloud, ring, when="2024-03-01T10:00:00Z", assets=("red", "nir", "scl"), collection="c"):
    return {
        "id": name, "collection": collection, "geometry": {"type": "Polygon", "coordinates": [ring]} if ring else None,
        "properties": {"datetime": when, "eo:cloud_cover": cloud},
        "assets": {a: {"href": f"https://example.org/{name}/{a}"} for a in assets},
    }


def test_catalog_discovery(spark):
    wide, aside, partial = box(76, 12, 79, 14), box(10, 10, 11, 11), box(77, 12.5, 77.6, 14)
    features = [
        item("clear", 3.5, wide), item("cloudy", 60, wide), item("unknown", "n/a", wide), item("early", 3.5, wide, "2024-02-01T00:00:00"),
        item("late", 0, wide, "2025-01-01T00:00:00Z"), item("no-scl", 1, wide, assets=("red", "nir")), item("aside", 1, aside),
        item("partial", 1, partial), item("no-shape", 1, None), item("other", 1, wide, collection="d"),
    ]
    path = stage_path(spark, "catalog")
    page = spark.createDataFrame([(json.dumps({"type": "FeatureCollection", "features": features}),)], "value string")
    page.write.text(path)
    items = catalog.read_catalog(spark, path)
    aois = spark.createDataFrame([(1, [[tuple(p) for p in box(77.2, 12.8, 77.8, 13.2)]])], f"aoi_id bigint, rings {schemas.RINGS}")
    found = catalog.discover(items, aois, "c", "2024-01-01", "2024-12-31")
    assert [r.item_id for r in found.orderBy("position").collect()] == ["early", "clear", "cloudy", "unknown"]
    limited = catalog.search(items, aois, "c", "2024-01-01", "2024-12-31", Policy(catalog_limit=1))
    assert limited.count() == 1


def test_pixel_table_round_trip_and_pruning(spark):
    ones = [[1, 2], [3, 4]]
    pixels = pixel_table(spark, pixel_rows(1, ones, ones, ones), pixel_rows(2, ones, ones, ones, aoi=2))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    stored = pixel_store.write(pixels, side=2)
    read = stored.read(spark, aoi_id=2, window=(0, 0, 0, 1))
    assert sorted((r.acq_id, r.row, r.col, r.red) for r in read.collect()) == [(2, 0, 0, 1.0), (2, 0, 1, 2.0)]
    plan = read._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "EqualTo(aoi_id,2)" in pushed and "LessThanOrEqual(row,0)" in pushed and "LessThanOrEqual(tile_col,0)" in pushed
    wanted = spark.createDataFrame([(2, 2)], "aoi_id bigint, acq_id bigint")
    read = stored.read(spark, scenes=wanted)
    assert [r.acq_id for r in read.select("acq_id").distinct().collect()] == [2]
    assert "GreaterThanOrEqual(acq_id,2)" in read._jdf.queryExecution().executedPlan().toString()
    assert {(r.aoi_id, r.acq_id): r.pixels for r in stored.tiles.collect()} == {(1, 1): 4, (2, 2): 4}


def test_clustered_pixels_are_not_shuffled_for_differencing(spark):
    rng = np.random.default_rng(3)
    red, fours = np.full((9, 9), 2), np.full((9, 9), 4)
    pixels = pixel_table(spark, *[pixel_rows(a, red, rng.integers(1, 9, (9, 9)), fours) for a in (1, 2, 3)])
    policy = Policy(tile=4, min_usable_fraction=0.1)
    stored = pixel_store.write(pixels, side=4)
    sequenced = materialize(change.sequence(scene_table(spark, [1, 2, 3], 9, 9)), "sequence")
    clustered = change.pixel_pairs(stored.read(spark), sequenced, policy)
    plan = clustered._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
    plain = change.pixel_pairs(pixels, sequenced, policy)
    show = lambda frame: sorted(map(str, frame.collect()))
    assert show(clustered) == show(plain)
    with pytest.raises(Exception, match="tiles of another size"):
        change.pixel_pairs(stored.read(spark), sequenced, Policy(tile=8)).count()


def test_headers_meet_clustered_pixels_in_their_buckets_at_any_size(spark):
    rng = np.random.default_rng(5)
    red, fours = rng.integers(1, 9, (9, 9)), np.full((9, 9), 4)
    pixels = pixel_table(spark, *[pixel_rows(a, red, rng.integers(1, 9, (9, 9)), fours, aoi) for a in (1, 2, 3) for aoi in (1, 2)])
    headers = spark.createDataFrame([(aoi, a, 10 * aoi + a) for aoi in (1, 2) for a in (1, 3)] + [(2, 3, 99), (7, 1, 0), (1, None, 1)], "aoi_id bigint, acq_id bigint, fact int")
    plain = pixels.join(headers, ["aoi_id", "acq_id"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the headers were many
    try:
        stored = pixel_store.write(pixels, side=4).read(spark)
        joined = pixel_store.join_scenes(stored, headers)
        shuffled = [line for line in joined._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line and "red" in line]
        found = joined.select(*plain.columns)
        assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
        again = pixel_store.write(joined, side=4)
        moved = joined.repartition(again.buckets, *pixel_store.TILE)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not shuffled and moved.count("REPARTITION") == 0
    assert again.read(spark).select(*plain.columns).exceptAll(plain).isEmpty()


def test_tiles_follow_the_z_curve(spark):
    cells = spark.createDataFrame([(r, c) for r in range(4) for c in range(4)], "r int, c int")
    found = {(x.r, x.c): x.k for x in cells.select("r", "c", pixel_store.curve(F.col("r"), F.col("c")).alias("k")).collect()}
    want = {(r, c): sum(((r >> b & 1) << 2 * b + 1) | ((c >> b & 1) << 2 * b) for b in range(2)) for r in range(4) for c in range(4)}
    assert found == want


def test_clip_uses_pixel_centres_of_a_projected_aoi(spark):
    ones = [[1] * 4] * 4
    pixels = pixel_table(spark, pixel_rows(1, ones, ones, ones))
    scenes = scene_table(spark, [1], 4, 4)
    corners = [(600000.0, 5000000.0), (600021.0, 5000000.0), (600021.0, 4999984.0), (600000.0, 4999984.0), (600000.0, 5000000.0)]
    planar = spark.createDataFrame([(1, [corners])], f"aoi_id bigint, rings {schemas.RINGS}")
    lonlat = planar.select("aoi_id", geometry.unproject_rings(F.col("rings"), F.lit("EPSG:32632")).alias("rings"))
    expected = [(r, c) for r in (0, 1) for c in (0, 1)]
    for aois in (planar, lonlat):
        clipped = tables.clip_to_aoi(pixels, scenes, aois).collect()
        assert sorted((r.row, r.col) for r in clipped) == expected


def test_hot_key_helpers(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("key"), "id")
    plain = rows.groupBy("key").agg(F.min("id").alias("low"))
    for salts in (2, 8):
        attached = skew.attach_group_values(rows, ["key"], ["id"], {"low": (F.min, F.col("id"))}, salts)
        assert attached.count() == 2000
        assert attached.select("key", "low").distinct().exceptAll(plain).isEmpty()
    ranked = skew.rank_within(rows, ["key"], [F.col("id").desc()], "rank").where("key = 0").orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))
    assert [r["id"] for r in ranked] == sorted((r["id"] for r in ranked), reverse=True)
    newest = skew.latest_by(rows, ["key"], ["id"])
    assert newest.where("key = 0").first()["id"] == 1999 - 1999 % 3 + (1 if 1999 % 3 >= 1 else 0)


def test_a_broadcast_holds_no_copy_of_a_header_per_salt(spark):
    """Small files make the planner broadcast the headers, whatever the salts make of them."""
    headers = materialize(spark.range(500).select(F.col("id").alias("aoi_id"), F.lit(1).cast("bigint").alias("acq_id"), (F.col("id") * 2).alias("fact")), "headers")
    few = headers.select("aoi_id", "acq_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("row"), F.pmod("aoi_id", F.lit(40)).cast("int").alias("col"))
    hot = spark.range(1000).select(F.lit(7).cast("bigint").alias("aoi_id"), F.lit(1).cast("bigint").alias("acq_id"), (F.col("id") * 16 + 3).cast("int").alias("row"), F.lit(50).alias("col"))
    pixels = materialize(few.unionByName(hot), "pixels")
    joined = skew.join_headers(pixels, headers)
    plain = pixels.join(headers, ["aoi_id", "acq_id"]).select(*joined.columns)
    rows, sent = broadcast_rows(joined)
    assert sorted(rows) == sorted(plain.collect()) and len(rows) == 2500
    assert max(sent, default=0) <= 2500
    # The blocks of a large scene still are many join groups.
    assert "_salt" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_footprints_meet_areas_without_ids(spark):
    multi = item("multi", 2, None)
    multi["geometry"] = {"type": "MultiPolygon", "coordinates": [[box(10, 10, 11, 11)], [box(-0.5, -0.5, 2.5, 2.5)]]}
    point = item("point", 2, None)
    point["geometry"] = {"type": "Point", "coordinates": [1.0, 1.0]}
    features = [multi, point, item("touching", 5, box(1, 1, 4, 4)), item("far", 1, box(50, 50, 51, 51)), item("cells", 3, box(-7.5, -7.5, 7.5, 7.5))]
    path = stage_path(spark, "catalog")
    spark.createDataFrame([(json.dumps({"features": [f]}),) for f in features], "value string").write.text(path)
    items = catalog.read_catalog(spark, path)
    rings = lambda *b: [[tuple(map(float, p)) for p in box(*b)]]
    aois = spark.createDataFrame([(1, rings(0.25, 0.25, 1, 1)), (2, rings(10.5, 10.5, 10.75, 10.75))], f"aoi_id bigint, rings {schemas.RINGS}")
    found = catalog.search(items, aois, "c", "2024-01-01", "2024-12-31")
    assert sorted((r.aoi_id, r.item_id) for r in found.collect()) == [(1, "cells"), (1, "multi"), (1, "touching"), (2, "multi")]
    assert sorted((r.aoi_id, r.item_id) for r in catalog.covering(found).collect()) == [(1, "cells"), (1, "multi"), (2, "multi")]
    assert [(r.item_id, r.geometry_type) for r in catalog.unreadable_items(items).collect()] == [("point", "Point")]


def test_keyed_writes_repeat_and_empty(spark):
    path = stage_path(spark, "keyed")
    rows = lambda *r: spark.createDataFrame(list(r), "run_id bigint, n int")
    stored = lambda: sorted(tuple(r) for r in tables.read_table(spark, path, rows((0, 0)).schema).collect())
    assert stored() == []
    for _ in range(2):
        tables.put(rows((1, 1), (1, 2), (2, 1)), path, ["run_id"])
    assert stored() == [(1, 1), (1, 2), (2, 1)]
    tables.put(rows((1, 7)), path, ["run_id"])
    assert stored() == [(1, 7), (2, 1)]
    tables.put(rows((3, 3)), path, ["run_id"], scope=rows((1, 0), (3, 0)).select("run_id"))
    assert stored() == [(2, 1), (3, 3)]
    tables.put(rows((2, 5)), path, ["run_id"], merge=lambda old, new: old.unionByName(new))
    assert stored() == [(2, 1), (2, 5), (3, 3)]


def test_rows_with_null_keys_are_replaced_like_others(spark):
    path = stage_path(spark, "keyed")
    rows = lambda n: spark.createDataFrame([(1, None, n), (None, None, n), (None, "b", n), (2, "c", n)], "a bigint, b string, n int")
    for n in (1, 2, 2):
        tables.put(rows(n), path, ["a", "b"])
    tables.put(spark.createDataFrame([], "a bigint, b string, n int"), path, ["a", "b"], spark.createDataFrame([(None, "b")], "a bigint, b string"))
    stored = tables.read_table(spark, path, rows(0).schema)
    assert sorted(map(str, (tuple(r) for r in stored.collect()))) == sorted(map(str, [(1, None, 2), (None, None, 2), (2, "c", 2)]))


def test_src_pixels_tells_cells_outside_their_aoi_too(spark):
    data = "/root/testdata/sf0.001"
    wanted = fixtures.pixels(spark, data).select("acq_id", "row", "col").collect()
    assert sorted(QUERIES["src_pixels"](spark, data).select("acq_id", "row", "col").collect()) == sorted(wanted)


def test_aois_of_one_file_are_judged_by_all_tasks(spark):
    ring = lambda l, b, r, t: json.dumps({"type": "Polygon", "coordinates": [box(l, b, r, t)]})
    raw = spark.createDataFrame([(1, ring(0, 0, 1, 1)), (2, ring(3, 0, 5, 1)), (3, "{"), (4, ring(0, 0, 4, 4)), (5, ring(0, 0, 0, 1))], "aoi_id bigint, geometry_json string")
    assert tables.parse_aois(raw.coalesce(1)).rdd.getNumPartitions() > 1
    octagon = [[(1, 0), (3, 0), (4, 1), (4, 3), (3, 4), (1, 4), (0, 3), (0, 1), (1, 0)]]
    for rings, valid in (([box(0, 0, 4, 4)], [1, 4]), (octagon, [])):
        rings = [[(float(x), float(y)) for x, y in ring_] for ring_ in rings]
        domain = spark.createDataFrame([(rings,)], "boundary_rings array<array<struct<x:double,y:double>>>")
        assert sorted(r.aoi_id for r in tables.valid_aois(raw, domain).collect()) == valid


def test_few_aois_out_of_many_rows_do_not_move_the_items(spark):
    """All items lie in one cell; the AOIs come from a table that the planner takes for large."""
    made = spark.range(3_000_000).select((F.col("id") % 2).alias("aoi_id")).distinct()
    aois = made.select("aoi_id", F.array(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in box(0.1, 0.1, 0.9, 0.9)])).alias("rings"))
    items = aois.select(F.col("aoi_id").alias("item_id"), "rings")
    met = catalog.meeting(spark.createDataFrame(items.collect(), items.schema), aois)
    assert "SortMergeJoin" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.item_id, r.aoi_id) for r in met.collect()) == [(i, a) for i in (0, 1) for a in (0, 1)]


def test_located_pixels_are_shuffled_and_written_once(spark, monkeypatch):
    data = "/root/testdata/sf0.001"
    written = []
    write = pixel_store.write
    monkeypatch.setattr(pixel_store, "write", lambda pixels, *more: written.append(pixels) or write(pixels, *more))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the headers were many
    try:
        fresh = chain.Chain(spark, data)
        direct = fresh.located_pixels
        plan = written[0]._jdf.queryExecution().executedPlan().toString()
        kept = chain.Chain(spark, data)
        kept.pixel_table
        stored = kept.located_pixels.select(*direct.columns)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(written) == 3 and "pixel_table" not in fresh.__dict__
    assert plan.count("REPARTITION_BY_NUM") == 1 and not re.search(r"hashpartitioning\(aoi_id#\d+L, acq#", plan)
    assert direct.count() == fixtures.pixels(spark, data).count()
    assert direct.exceptAll(stored).isEmpty() and stored.exceptAll(direct).isEmpty()


def test_aoi_shapes_are_told_by_all_tasks(spark, monkeypatch):
    tasks = {}
    keep = tables.materialize
    monkeypatch.setattr(tables, "materialize", lambda frame, name: tasks.update({name: frame.rdd.getNumPartitions()}) or keep(frame, name))
    ones = [[1] * 4] * 4
    corners = [(600000.0, 5000000.0), (600021.0, 5000000.0), (600021.0, 4999984.0), (600000.0, 4999984.0), (600000.0, 5000000.0)]
    aois = spark.createDataFrame([(1, [corners])], f"aoi_id bigint, rings {schemas.RINGS}")
    tables.with_inside(pixel_table(spark, pixel_rows(1, ones, ones, ones)), scene_table(spark, [1], 4, 4), aois).count()
    assert tasks["aoi-boxes"] >= 8


def test_scenes_of_an_aoi_share_its_edges(spark, monkeypatch):
    ones = [[1] * 4] * 4
    pixels = pixel_table(spark, *[pixel_rows(a, ones, ones, ones, aoi) for a in (1, 2) for aoi in (1, 2, 3)])
    scenes = materialize(scene_table(spark, [1, 2], 4, 4).unionByName(scene_table(spark, [1], 4, 4, 2)).unionByName(scene_table(spark, [1], 4, 4, 3)), "scenes")
    # Scene 2 has another grid; AOI 2 has two shapes, AOI 3 none.
    zone = F.when(F.col("acq_id") == 2, "EPSG:32633").otherwise(F.col("grid.crs"))
    scenes = scenes.withColumn("grid", F.col("grid").withField("crs", zone))
    square = lambda side: [[(600000.0, 5000000.0), (600000.0 + side, 5000000.0), (600000.0 + side, 5000000.0 - side), (600000.0, 5000000.0 - side), (600000.0, 5000000.0)]]
    aois = spark.createDataFrame([(1, square(21.0)), (2, square(11.0)), (2, square(31.0))], f"aoi_id bigint, rings {schemas.RINGS}")
    stored = pixel_store.write(pixels, side=2).read(spark)
    schemas_of = {}
    keep = pixel_store.materialize
    monkeypatch.setattr(pixel_store, "materialize", lambda frame, name: schemas_of.update({name: frame.schema.simpleString()}) or keep(frame, name))
    found = tables.with_inside(stored, scenes, aois)
    plain = tables.with_inside(pixels, scenes, aois)
    show = lambda frame: sorted(map(str, frame.select(*plain.columns).collect()))
    assert show(found) == show(plain) and found.count() == 4 * 16
    assert {c for c in found.columns if c.startswith("_")} == set()
    assert "_t" in schemas_of["scenes-by-aoi"] and "_edges" not in schemas_of["scenes-by-aoi"]
