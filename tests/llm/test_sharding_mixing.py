"""Lookup-table placement and water-filling."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from landshift.llm import mixing, sharding
from tests.llm import cases

SHARDS = [f"s{k}" for k in range(7)]


def test_table_is_even_and_stable():
    table = sharding.fill_table(SHARDS, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(SHARDS[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.15 * 1009  # slots of shards that stay rarely move
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a"], 65_539)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_placement_by_hand(spark):
    rows = cases.clashing(cases.docs(spark, cases.odd_rows()))
    placed = sharding.place(rows, "doc_id", SHARDS, 1009)
    assert Counter(placed.columns)["shard"] == 1 and placed.count() == rows.count()
    table = sharding.fill_table(SHARDS, 1009)
    for row in placed.select("doc_id", "shard").collect():
        key = "" if row.doc_id is None else str(row.doc_id)
        assert row.shard == table[int(hashlib.md5(key.encode()).hexdigest()[:12], 16) % 1009]
    assert sharding.place(cases.empty(rows), "doc_id", SHARDS, 1009).count() == 0


def test_shards_are_written_as_folders(spark, tmp_path):
    placed = sharding.place(cases.docs(spark, {i: "t" for i in range(200)}), "doc_id", SHARDS, 1009)
    sharding.write_shards(placed, str(tmp_path / "out"))
    again = spark.read.parquet(str(tmp_path / "out"))
    assert again.count() == 200 and again.select("shard").distinct().count() == 7


def mixed(frame, **options):
    return {r.doc_id: r for r in mixing.mix(frame, **options).collect()}


def test_water_filling(spark):
    # Sizes: a 60 words, b 10, c 30, null 20. 1.5 x 120 = 180 words; weights 3, 1, 2, 3.
    rows = [(i, " ".join(["w"] * 10), s) for i, s in enumerate(["a"] * 6 + ["b"] + ["c"] * 3 + [None] * 2)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixed(frame)
    # Rate 20 fills b (20) and null (40); the rest 120 over weights 5: a 72, c 48.
    assert {r.source: round(r.target, 9) for r in got.values()} == {"a": 72.0, "b": 20.0, "c": 48.0, None: 40.0}
    for source, target in (("a", 72), ("b", 20), ("c", 48), (None, 40)):
        own = [r for r in got.values() if r.source == source]
        assert abs(sum(r.taken for r in own) - target) <= len(own)
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    assert got == mixed(frame) and got != mixed(frame, seed=8)


def test_mix_takes_odd_rows(spark):
    frame = cases.clashing(cases.docs(spark, cases.odd_rows()))
    rows = mixing.mix(frame).collect()
    assert len(rows) == frame.count()
    assert all(r["size"] == 0 and r.taken == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert mixing.mix(cases.empty(frame)).count() == 0
    repeated = mixing.repeat_rows(frame, lambda n, size: F.lit(1.0), 2.0, 2.0)
    assert repeated.columns == frame.columns
    counts = Counter(r.doc_id for r in repeated.select("doc_id").collect())
    assert counts[8] == 2 and counts[3] == counts[4] == 1
