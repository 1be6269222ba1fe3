import datetime as dt

from lodestrata.streaming import incremental

SCHEMA = "event_id long, ts timestamp, user_id long, value double"


def land(spark, path, *batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame([(i, dt.datetime(2024, 1, 1, h, m), u, v) for i, h, m, u, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def test_repeats_within_the_watermark_go(spark, tmp_path):
    land(spark, tmp_path, [(1, 0, 0, 7, 1.0), (2, 0, 1, 7, 2.0)], [(1, 0, 2, 7, 1.0), (3, 0, 3, 8, 3.0)])
    drained(incremental.deduplicated(incremental.landing(spark, f"{tmp_path}/in", SCHEMA), ["event_id"], "ts"), "once")
    assert sorted(r.event_id for r in spark.table("once").collect()) == [1, 2, 3]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    land(spark, tmp_path, [(1, 0, 5, 7, 1.0), (2, 0, 50, 7, 2.0), (3, 1, 5, 7, 4.0), (4, 9, 0, 7, 8.0)])
    drained(incremental.windowed_counts(incremental.landing(spark, f"{tmp_path}/in", SCHEMA), "ts", "user_id", "value"), "hours")
    assert sorted((r.window_start.hour, r.n, r.total) for r in spark.table("hours").collect()) == [(0, 2, 3.0), (1, 1, 4.0)]


def test_upserts_keep_the_last_row_of_each_key(spark, tmp_path):
    land(spark, tmp_path, [(1, 0, 5, 7, 1.0), (2, 0, 50, 8, 2.0)], [(3, 1, 5, 7, 4.0), (4, 1, 5, 7, 5.0)])
    stream = incremental.landing(spark, f"{tmp_path}/in", SCHEMA, files=1)
    log = (f"{tmp_path}/log", stream.schema, ["user_id"], "ts", "event_id")
    assert incremental.change_log(spark, *log) and incremental.state(spark, *log).count() == 0
    merge = incremental.change_log(spark, *log)
    incremental.upsert_stream(stream, merge, f"{tmp_path}/checkpoint").awaitTermination()
    now = lambda *at: sorted((r.user_id, r.event_id) for r in incremental.state(spark, *at).collect())
    assert now(*log) == [(7, 4), (8, 2)]
    merge(spark.read.parquet(f"{tmp_path}/in").where("event_id = 1"), 0)  # an epoch that comes again
    land(spark, tmp_path, [(5, 2, 0, 8, 1.0)])  # and a restart with a new driver's merge
    incremental.upsert_stream(incremental.landing(spark, f"{tmp_path}/in", SCHEMA, files=1), incremental.change_log(spark, *log), f"{tmp_path}/checkpoint").awaitTermination()
    assert now(*log) == [(7, 4), (8, 5)]
    incremental.compact(spark, log[0], f"{tmp_path}/new", *log[1:])
    assert now(f"{tmp_path}/new", *log[1:]) == [(7, 4), (8, 5)]
