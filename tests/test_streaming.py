"""Streams over files: per-key state with expiry, idempotent batches, and windows equal to batch results."""

from pyspark.sql import functions as F

from foliograph.streaming import jobs


def write(spark, rows, path):
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def test_state_expires_after_its_time(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = write(spark, [(1, "2024-01-01 00:00:00", 7, "view", 1.0), (2, "2024-01-01 01:00:00", 7, "click", 3.0), (3, "2024-01-01 00:30:00", 8, "view", 2.0)], path)
    check, out = str(tmp_path / "c"), []

    def run():
        stream = jobs.job_states(jobs.read_events(spark, path, schema), "user_id", "ts", 3_600_000)
        query = stream.writeStream.outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(lambda d, _: out.extend(d.collect())).start()
        query.awaitTermination()

    run()
    assert {(r["user_id"], r["n"], r["high"], r["last_type"], r["status"]) for r in out} == {(7, 2, 3.0, "click", "active"), (8, 1, 2.0, "view", "active")}
    write(spark, [(4, "2024-01-03 00:00:00", 9, "view", 5.0)], path)
    run()
    write(spark, [(5, "2024-01-03 00:01:00", 9, "view", 4.0)], path)
    run()
    assert {r["user_id"] for r in out if r["status"] == "expired"} == {7, 8}
    assert [(r["n"], r["high"]) for r in out if r["user_id"] == 9][-1] == (2, 5.0)


def test_batches_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = write(spark, [(1, "2024-01-01 00:00:00", 7, "view", 1.0)], path)
    for _ in range(2):
        jobs.commit_batches(jobs.read_events(spark, path, schema), str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_sliding_windows(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = write(spark, [(1, "2024-01-01 00:10:00", 7, "view", 1.0), (2, "2024-01-01 01:10:00", 7, "view", 1.0)], path)
    write(spark, [(3, "2024-02-01 00:00:00", 8, "view", 1.0)], path)
    late = jobs.sliding(jobs.read_events(spark, path, schema, 1), "ts", "2 hours", "1 hour", "1 day", ["user_id"])
    got = jobs.run_once(late, str(tmp_path / "s"))
    assert sorted(r["n"] for r in got.filter("user_id = 7").collect()) == [1, 1, 2]
    write(spark, [(4, "2024-01-01 00:20:00", 7, "view", 1.0), (5, "2024-02-01 00:10:00", 8, "view", 1.0)], path)
    got = jobs.run_once(jobs.sliding(jobs.read_events(spark, path, schema, 1), "ts", "2 hours", "1 hour", "1 day", ["user_id"]), str(tmp_path / "s"))
    assert sorted(r["n"] for r in got.filter("user_id = 7").collect()) == [1, 1, 2]  # what comes behind the watermark is late
