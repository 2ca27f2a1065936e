from pyspark.sql import functions as F

from landshift.operators.triage import current_reviews
from landshift.session import stage_path
from landshift.streaming import jobs
from test_triage import review_log


def test_many_batches_equal_one(spark):
    """Reviews that arrive file by file end in the state of the whole log."""
    log = review_log(spark)
    folder = stage_path(spark, "arrivals")
    for i in range(1, 10, 2):
        log.where(F.col("log_id").isin(i, i + 1)).coalesce(1).write.mode("append").parquet(folder)
    stored, checkpoint = stage_path(spark, "reviews"), stage_path(spark, "checkpoint")
    stream = jobs.read_arrivals(spark, folder, log.schema, files_per_batch=1)
    jobs.ingest_reviews(stream, stored, checkpoint).awaitTermination()
    state = lambda rows: sorted(tuple(r) for r in rows.collect())
    assert state(jobs.review_state(spark, stored, log.schema)) == state(current_reviews(log))
    # A second run finds nothing new and changes nothing.
    jobs.ingest_reviews(stream, stored, checkpoint).awaitTermination()
    assert state(jobs.review_state(spark, stored, log.schema)) == state(current_reviews(log))


def test_progress_counts_over_batches(spark):
    folder = stage_path(spark, "steps")
    for state in ("completed", "failed", "completed"):
        spark.createDataFrame([(1, state), (2, "completed")], "aoi_id bigint, state string").coalesce(1).write.mode("append").parquet(folder)
    out = stage_path(spark, "progress")
    stream = jobs.read_arrivals(spark, folder, "aoi_id bigint, state string", files_per_batch=1)
    jobs.count_progress(stream, out, stage_path(spark, "checkpoint")).awaitTermination()
    found = {(r.aoi_id, r.state): r.completed for r in jobs.current_progress(spark, out).collect()}
    assert found == {(1, "completed"): 2, (1, "failed"): 1, (2, "completed"): 3}


def _arrive(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_late_and_repeated_reviews_and_compaction(spark):
    """Folding every second batch changes no state; repeats count once, rows behind the watermark not at all."""
    import datetime

    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    schema = "candidate_id string, decision string, note string, ts timestamp, log_id bigint"
    batches = [
        [("a", "accepted", None, day(0), 1), ("b", "rejected", "x", day(1), 2), ("a", "investigate", "y", day(2), 3), ("a", "rejected", None, day(1), 11)],
        [("a", "unreviewed", None, day(40), 4), ("a", "rejected", "z", day(41), 5), ("b", "rejected", "x", day(1), 2)],
        [("a", "accepted", "w", day(50), 6), ("b", "investigate", None, day(90), 7)],
        [("a", "unreviewed", None, day(45), 8), ("c", "accepted", None, day(91), 12)],
        [("a", "investigate", "v", day(95), 10), ("b", "investigate", None, day(90), 7), ("b", "accepted", "late", day(0), 9)],
    ]
    folder, log = stage_path(spark, "arrivals"), stage_path(spark, "reviews")
    for rows in batches:
        _arrive(spark, rows, schema, folder)
    stream = jobs.read_arrivals(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)
    jobs.ingest_reviews(stream, log, stage_path(spark, "checkpoint"), delay="60 days", every=2).awaitTermination()
    on_time = spark.createDataFrame([r for rows in batches for r in rows if r[4] != 9], schema).distinct()
    state = lambda rows: sorted(tuple(r) for r in rows.collect())
    assert state(jobs.review_state(spark, log, on_time.schema)) == state(current_reviews(on_time))
    bases, kept, _ = jobs._folders(spark, log)
    assert bases and min(kept) > 0  # the first batches are folded away
    # Of the settled rows of "a" only the ends are left; the reset of day 45 came within the watermark.
    left = {r.log_id for r in jobs.read_log(spark, log, on_time.schema).collect()}
    assert left == {r.log_id for r in on_time.collect()} - {11}


def test_scenes_are_kept_once(spark):
    import datetime

    schema = "aoi_id bigint, item_id string, ts timestamp, version bigint, state string"
    at = lambda n: datetime.datetime(2024, 5, 1, n)
    folder, log = stage_path(spark, "arrivals"), stage_path(spark, "scenes")
    for rows in (
        [(1, "s", at(1), 1, "queued"), (1, "t", at(1), 2, "queued")], [(1, "s", at(2), 3, "acquired"), (1, "s", at(1), 1, "queued")],
        [(2, "s", at(3), 4, "failed")], [(1, "t", at(4), 5, "acquired")],
    ):
        _arrive(spark, rows, schema, folder)
    stream = jobs.read_arrivals(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)
    jobs.ingest_scenes(stream, log, stage_path(spark, "checkpoint"), every=2).awaitTermination()
    found = {(r.aoi_id, r.item_id): r.state for r in jobs.current_scenes(spark, log, spark.createDataFrame([], schema).schema).collect()}
    assert found == {(1, "s"): "acquired", (1, "t"): "acquired", (2, "s"): "failed"}
    assert jobs.read_log(spark, log, spark.createDataFrame([], schema).schema).count() == 3


def test_large_arrivals_are_written_by_all_tasks_and_stay_one_batch(spark, monkeypatch):
    from landshift.plans import fixtures, q_jobs
    from landshift.plans.chain import chain

    monkeypatch.setattr(q_jobs, "FILE_ROWS", 10)
    c = chain(spark, "/root/testdata/sf0.001")
    orders = fixtures.table(spark, c.sf_dir, "orders")
    rows = fixtures.review_rows(q_jobs._stream(c, "orders", "o_orderdate"))
    log, read = stage_path(spark, "reviews"), {}
    jobs.ingest_reviews(rows, log, stage_path(spark, "checkpoint"), every=100).awaitTermination()
    for k in jobs._folders(spark, log)[1]:
        seen = spark.read.schema(rows.schema).parquet(f"{log}/batch_id={k}")
        read[k] = seen.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    ranges = sorted(tuple(r) for r in read.values() if r[2])
    assert len(ranges) == q_jobs.ARRIVALS and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    assert sum(r[2] for r in ranges) == orders.count()
    arrived = q_jobs._stream(c, "orders", "o_orderdate")._jdf.queryExecution().analyzed().toString()
    folder = arrived[arrived.index("FileSource[") + len("FileSource["):].split("]")[0]
    assert len(spark.read.parquet(folder).inputFiles()) == q_jobs.ARRIVALS * spark.sparkContext.defaultParallelism
