"""Windows of a stream close once, late rows count while their window is open, and a run goes on where the last one ended."""

import datetime as dt

from pyspark.sql import functions as F

from gaugeworks.streaming import moments

SCHEMA = "event_type string, ts timestamp, value double"


def day(d, h=0):
    return dt.datetime(2024, 3, d, h)


def write(spark, rows, folder, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/staged-{name}")
    (part,) = (folder / f"staged-{name}").glob("*.parquet")
    (folder / "in").mkdir(exist_ok=True)
    part.rename(folder / "in" / f"{name}.parquet")


def test_late_rows_and_restart(spark, tmp_path):
    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
        sums = moments.moments(moments.event_rows(stream), "1 day", "ts", "1 day")
        moments.closed(sums, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
        rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
        return sorted((r.param, r.window.start.day, r.n, r.a) for r in rows)

    write(spark, [("x", day(1, 1), 1.0), ("x", day(1, 5), 2.0), ("y", day(2, 3), 4.0), ("x", day(3, 12), 8.0)], tmp_path, "first")
    assert run() == [("x", 1, 2, 3.0)]  # the watermark is noon of the 2nd
    # One row is too late, one belongs to an open day before the last one, and the last closes two days.
    write(spark, [("x", day(1, 7), 100.0), ("x", day(2, 1), 16.0), ("y", day(2, 23), 32.0), ("x", day(5, 1), 64.0)], tmp_path, "second")
    closed = [("x", 1, 2, 3.0), ("x", 2, 1, 16.0), ("x", 3, 1, 8.0), ("y", 2, 2, 36.0)]
    assert run() == closed
    assert run() == closed  # nothing new: nothing is written twice
    write(spark, [("x", day(3, 1), 1000.0), ("z", day(4, 2), 5.0), ("z", day(9, 2), 7.0)], tmp_path, "third")
    assert run() == sorted([*closed, ("z", 4, 1, 5.0), ("x", 5, 1, 64.0)])


def test_states_for_all_time_keep_the_newest_of_each_group(spark, tmp_path):
    write(spark, [("x", day(1, 1), 1.0), ("y", day(1, 1), 2.0)], tmp_path, "first")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
        moments.latest(moments.moments(moments.event_rows(stream)), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
        return {r.param: (r.n, r.a) for r in moments.newest(spark, f"file://{tmp_path}/out").collect()}

    assert run() == {"x": (1, 1.0), "y": (1, 2.0)}
    write(spark, [("x", day(2, 1), 4.0)], tmp_path, "second")
    assert run() == {"x": (2, 5.0), "y": (1, 2.0)}
    changed = spark.read.parquet(f"file://{tmp_path}/out").where("batch > 0").select("param").distinct().collect()
    assert [r.param for r in changed] == ["x"]  # a batch writes what it changed


def test_windows_of_the_table(spark, sf):
    got = moments.by_window(spark, f"{sf}/events.parquet")
    last = spark.read.parquet(f"{sf}/events.parquet").agg(F.max("ts")).first()[0]
    assert got.count() > 0 and got.agg(F.max("start")).first()[0] + dt.timedelta(days=2) <= last
