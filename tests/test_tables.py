"""Tables that change in place, resumable backfills and versions as they arrive."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import windows
from lodestrata.sources import backfill, tables
from lodestrata.streaming import versions

SCHEMA = "k long, v string, n int"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    first = [(i, f"v{i}", i) for i in range(200)] + [(None, "none", 0), (5, "later", 9)]
    assert tables.create(spark.createDataFrame(first, SCHEMA), path, ["k"], 16, F.col("n")) == 0
    was, before = files(path), rows_of(tables.read(spark, path, SCHEMA))
    assert before == sorted([r for r in first if r != (5, "later", 9)], key=str)
    same = spark.createDataFrame(first[:50], SCHEMA)
    assert tables.merge(same, path, F.col("n")) == 0 and files(path) == was  # nothing changed, nothing written
    fresh = [(3, "new", 1), (3, "second", 2), (900, "added", 1), (None, "other", 1), (7, "v7", 7)]
    assert tables.merge(spark.createDataFrame(fresh, SCHEMA), path, F.col("n")) == 1
    want = {r[0]: r for r in before} | {r[0]: r for r in fresh if r[1] != "second"}
    assert rows_of(tables.read(spark, path, SCHEMA)) == sorted(want.values(), key=str)
    assert rows_of(tables.read(spark, path, SCHEMA, version=0)) == before  # the old version stays
    now = files(path)
    assert all(now[f] == t for f, t in was.items())
    old, new = ({r.bucket: r.folder for r in tables.manifest(spark, path, v).collect()} for v in (0, 1))
    touched = {r.b for r in spark.createDataFrame([(3,), (900,), (None,)], "k long").select(tables._bucket(["k"], 16).alias("b")).collect()}
    assert {b for b in new if new[b] != old.get(b)} == touched and len(touched) < 16


def test_merge_deletes_and_an_empty_table_stays_one(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.create(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA), path, ["k"], 4)
    gone = spark.createDataFrame([(1, None, None, True), (7, None, None, True)], SCHEMA + ", gone boolean")
    assert tables.merge(gone, path, deleted=F.col("gone")) == 1 and rows_of(tables.read(spark, path, SCHEMA)) == [(2, "b", 1)]
    assert tables.merge(spark.createDataFrame([(2, None, None, True)], SCHEMA + ", gone boolean"), path, deleted=F.col("gone")) == 2
    assert tables.read(spark, path, SCHEMA).count() == 0
    assert tables.merge(spark.createDataFrame([(4, "d", 1)], SCHEMA), path) == 3 and rows_of(tables.read(spark, path, SCHEMA)) == [(4, "d", 1)]
    tables.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), ["k"], 4)
    assert tables.read(spark, str(tmp_path / "none"), SCHEMA).count() == 0 and tables.merge(spark.createDataFrame([], SCHEMA), str(tmp_path / "none")) == 0


def test_a_failed_merge_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.create(spark.createDataFrame([(i, "a", 1) for i in range(20)], SCHEMA), path, ["k"], 4)
    bad = spark.range(10).select(F.col("id").alias("k"), F.lit("b").alias("v"), F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.lit("1")).cast("int").alias("n"))
    with pytest.raises(Exception, match="broken"):
        tables.merge(bad, path)
    assert tables.read(spark, path, SCHEMA).count() == 20 and tables.read(spark, path, SCHEMA).where("v = 'b'").count() == 0
    own = tables._commit

    def failing(*args):
        raise OSError("no manifest")

    tables._commit = failing  # rows are written, the manifest is not
    try:
        with pytest.raises(OSError):
            tables.merge(spark.createDataFrame([(1, "b", 1)], SCHEMA), path)
    finally:
        tables._commit = own
    assert tables.read(spark, path, SCHEMA).where("v = 'b'").count() == 0
    assert tables.merge(spark.createDataFrame([(1, "b", 1)], SCHEMA), path) == 1
    with pytest.raises(Exception, match="already exists"):  # a second writer of the same version
        tables._commit(spark, path, 1, [], 4, ["k"])


def test_backfill_goes_on_where_it_was(spark, tmp_path):
    rng = random.Random(1)
    keys = rng.sample(range(-500, 5000), 300)
    rows, path, asked = spark.createDataFrame([(k, k * 2) for k in keys] + [(None, 1)], "k long, v long"), str(tmp_path / "b"), []

    def work(bad):
        def of(part):
            asked.append(part)
            return part.select("k", F.when(F.col("k").between(*bad), F.raise_error(F.lit("broken"))).otherwise((F.col("v") + 1).cast("string")).cast("long").alias("w"))

        return of

    ranges = backfill.key_ranges(rows, "k", 6)
    assert ranges[0][0] == min(keys) and ranges[-1][1] == max(keys) and all(a[1] + 1 == b[0] for a, b in zip(ranges, ranges[1:], strict=False)) and len(ranges) == 6
    with pytest.raises(Exception, match="broken"):
        backfill.run(rows, "k", path, 6, work(ranges[3]))
    assert backfill.finished(rows, path) == ranges[:3]
    done, asked[:] = files(path + "/rows"), []
    out = backfill.run(rows, "k", path, 6, work((1, 0)))
    assert len(asked) == 4 and min(asked[0].agg(F.min("k")).first()) >= ranges[3][0]  # three ranges, and the schema
    assert all(files(path + "/rows")[f] == t for f, t in done.items())
    assert rows_of(out) == sorted(((k, 2 * k + 1) for k in keys), key=str)
    more = rows.unionByName(spark.createDataFrame([(9000, 1), (-900, 1)], "k long, v long"))
    assert rows_of(backfill.run(more, "k", path, 6, work((1, 0)))) == sorted([*((k, 2 * k + 1) for k in keys), (9000, 2), (-900, 2)], key=str)
    assert backfill.run(rows.where("false"), "k", str(tmp_path / "none"), 3, work((1, 0))).count() == 0


@pytest.mark.parametrize("cuts", [[], [20], [5, 6, 30, 55]])
def test_versions_as_they_arrive(spark, tmp_path, cuts):
    """However the rows are split, and over a restart, the log says what a window over all rows says."""
    rng = random.Random(len(cuts))
    rows = [(rng.randint(1, 6), 100 + i // 2, dt.datetime(2024, 1, rng.randint(1, 9))) for i in range(60)]
    rows += [rows[3], rows[10]]
    schema = "law long, version long, dated timestamp"
    edges = [0, *cuts, len(rows)]
    for half in (range(len(edges) // 2), range(len(edges) // 2, len(edges) - 1)):  # stopped and started again
        for i in half:
            spark.createDataFrame(rows[edges[i] : edges[i + 1]], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if not os.path.isdir(f"{tmp_path}/in"):
            continue
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        versions.keep(versions.changes(stream, "law", "dated", "version"), f"{tmp_path}/log", f"{tmp_path}/checkpoint").awaitTermination()
    whole = windows.current_version(spark.createDataFrame(sorted(set(rows)), schema), "law", "dated", "version")
    assert rows_of(versions.current(spark, f"{tmp_path}/log").select("key", "id", "at", "is_current")) == rows_of(whole.select("law", "version", "dated", "is_current"))


def test_versions_of_many_keys_are_compared_by_buckets(spark, tmp_path):
    """State and calls are those of buckets, not of keys; negative keys, repeats and hours that a clock shows twice count."""
    night = [dt.datetime(2024, 10, 27, 0, 30), dt.datetime(2024, 10, 27, 1, 30)]
    first = [(k, 10 * k + v, night[v]) for k in range(-1500, 1500) for v in range(2)] + [(None, 1, night[0]), (3, None, night[0]), (3, 2, None)]
    later = [(k, 10 * k + 1, night[1]) for k in range(0, 1500, 3)] + [(k, 10 * k + 2, night[1]) for k in range(-9, 9)] + [(k, 10 * k + 3, night[0]) for k in range(20)] + [(9000, 1, night[0])]
    schema = "law long, version long, dated timestamp"
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        for rows in (first, later):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            run = versions.keep(versions.changes(stream, "law", "dated", "version"), f"{tmp_path}/log", f"{tmp_path}/checkpoint")
            run.awaitTermination()
            assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) <= versions.BUCKETS
        whole = windows.current_version(spark.read.parquet(f"{tmp_path}/in").dropna().distinct(), "law", "dated", "version")
        found = versions.current(spark, f"{tmp_path}/log").select("key", "id", "at", "is_current")
        assert rows_of(found) == rows_of(whole.select("law", "version", "dated", "is_current")) and found.count() == 6000 + 18 + 20 + 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
