"""Structured Streaming forms over the events table: windows, deduplication, and replays of stored events in their order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.session import new_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int | None = 1) -> DataFrame:
    """A file stream of events, some files a micro-batch or (None) all; event time is cast so that it can carry a watermark."""
    reader = spark.readStream.schema(EVENTS)
    raw = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
    return windows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str = "2 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", length, slide))
    return windows.agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    windows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return windows.agg(F.count("*").alias("n")).select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


def fresh(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def advance(stream: DataFrame, mode: str, path: str, place: str) -> int:
    """Run a stream over all input that is there, from where the checkpoint in `place` stands, and write its result to `path`.

    A complete result is overwritten by each micro-batch, rows of an append or update result are added; the last state of
    an update result is the newest batch's, so `batch` is kept with the rows, and a batch that is run again replaces its own.
    Returns how many rows came too late for the watermark.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/n={batch}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for p in run.recentProgress for op in p["stateOperators"])


@contextmanager
def shuffled_by(spark: SparkSession, most: int | None) -> Iterator[None]:
    """The session's shuffle partitions are at most so many; a stream takes its number when it first starts, and keeps it."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), most or int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def replayed(
    events: DataFrame, build: Callable[[DataFrame], DataFrame], mode: str, name: str, steps: int = 4, last: DataFrame | None = None, files: int = 4, stores: int | None = None
) -> tuple[DataFrame, int]:
    """The result of the stream build(source) over events in the order of their times, and the number of late rows.

    A file source orders files by when they were written, not by what they hold, so events are cut into `steps` ranges of
    time, and each is dropped and run before the next; within a range the watermark stands still, so its files, `files` or
    one for each core if there are more, may come in any order and no task has to hold a range. `last` is one more range.
    The state is parted as shuffles are, but into `stores` for each core at most, if that is given.
    """
    spark, path, place, source = events.sparkSession, *(new_path(events.sparkSession, f"{name}{x}") for x in ("", "-offsets", "-source"))
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = sorted(set(events.select(seconds.alias("t")).approxQuantile("t", [i / steps for i in range(1, steps)], 0.01))) if steps > 1 else []
    events.limit(0).write.parquet(source)
    late, stream = 0, build(read_events(spark, source, None))
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    spark.createDataFrame([], schema).write.parquet(path if mode == "complete" else f"{path}/n=none")
    ranges = [events.where((seconds > lo) & (seconds <= hi)) for lo, hi in zip([float("-inf"), *bounds], [*bounds, float("inf")], strict=True)]
    for part in [*ranges, *([last] if last is not None else [])]:
        part.repartition(max(files, spark.sparkContext.defaultParallelism)).write.mode("append").parquet(source)
        with shuffled_by(spark, stores and stores * spark.sparkContext.defaultParallelism):
            late += advance(stream, mode, path, place)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path), late


def one_event(events: DataFrame, days: int = 365) -> DataFrame:
    """An event of user -1 that follows all others, so that the watermark passes them."""
    end = (F.max("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts")
    named = {"event_id": F.lit(-1).cast("long"), "user_id": F.lit(-1).cast("long"), "event_type": F.lit("end"), "value": F.lit(0.0), "props": F.lit("{}")}
    return events.agg(end).withColumns(named).select(*events.columns)
