"""Indices of runs that arrive as a stream: moments are sums, which a stateful grouping keeps exactly, for all time or by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import fresh_path


def moments(stream: DataFrame, late: str | None = None, time: str = "ts", window: str | None = None) -> DataFrame:
    """Running sums of pick-freeze rows ``(param, a, b, ab)``; with ``window``, by tumbling window under a watermark of ``late``."""
    if late:
        stream = stream.withWatermark(time, late)
    keys = ["param"] + ([F.window(time, window).alias("window")] if window else [])
    a, b, ab = map(F.col, ("a", "b", "ab"))
    sums = {"a": a, "b": b, "ab": ab, "aa": a * a, "bb": b * b, "a_b": a * b, "a_ab": a * ab, "b_ab": b * ab, "abab": ab * ab}
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()])


def indices(sums: DataFrame, keys: tuple[str, ...] = ("param",)) -> DataFrame:
    """``(*keys, n, s1, st, variance)`` from running sums."""
    n = F.col("n")
    m = (F.col("a") + F.col("b")) / (2 * n)
    v = (F.col("aa") + F.col("bb")) / (2 * n) - m * m
    s1 = F.try_divide((F.col("b_ab") - F.col("a_b")) / n, v)
    st = F.try_divide((F.col("aa") - 2 * F.col("a_ab") + F.col("abab")) / (2 * n), v)
    return sums.select(*keys, "n", s1.alias("s1"), st.alias("st"), v.alias("variance"))


def latest(sums: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream of sums until all that is there is read; each batch writes the groups that it changed, under its number.

    A batch that is run again after a failure replaces its own files.
    """

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    sums.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest(spark: SparkSession, path: str, keys: tuple[str, ...] = ("param",)) -> DataFrame:
    """The last state of each group from what ``latest`` has written."""
    kept = spark.read.parquet(path)
    values = [c for c in kept.columns if c not in (*keys, "batch")]
    last = kept.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_s"))
    return last.select(*keys, "_s.*")


def closed(sums: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream of windowed sums until all that is there is read; windows that the watermark has passed are appended at ``path``, once each.

    Their state goes with them: rows that come later than the watermark allows are left out. Run again with the same ``checkpoint``, it goes on
    with the files that are new and the windows that are open.
    """
    sums.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table of events as a stream of files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{folder}/{name[:-8]}*.parquet")


def event_rows(events: DataFrame) -> DataFrame:
    """``(ts, param, a, b, ab)``: each event as a pick-freeze row of its type."""
    hour = F.hour("ts")
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("param"), F.col("value").alias("a"), (F.col("value") * (hour + 1) / 24).alias("b"), (F.col("value") * (25 - hour) / 24).alias("ab"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Indices of events by type, read as a stream of files until all are read; state and sums lie in the shared folder."""
    out = fresh_path(spark, "moments")
    latest(moments(event_rows(event_stream(spark, path))), out, f"{out}-state")
    return indices(newest(spark, out))


def by_window(spark: SparkSession, path: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """``(param, start, n, s1, st, variance)`` of the windows that are closed: those that end before the last event by ``late`` or more."""
    out = fresh_path(spark, "windows")
    closed(moments(event_rows(event_stream(spark, path)), late, "ts", window), out, f"{out}-state")
    return indices(spark.read.parquet(out).withColumn("start", F.col("window.start").cast("timestamp_ntz")), ("param", "start"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
