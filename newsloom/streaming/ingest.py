"""Continuous ingestion: idempotent appends and alert cooldowns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState


def append_new(spark: SparkSession, path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that adds rows whose key the table lacks; running a batch again adds nothing."""

    def sink(batch: DataFrame, number: int) -> None:
        first = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        try:
            stored = spark.read.parquet(path).select(key)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = None
        new = first.join(stored, key, "left_anti") if stored is not None else first
        new.write.mode("append").parquet(path)

    return sink


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str, at: str = "fetched_at", late: str = "6 hours") -> StreamingQuery:
    """Start an ingest query: repeats within the watermark go in the state store, older ones in the table join."""
    recent = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return recent.writeStream.foreachBatch(append_new(stream.sparkSession, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _fire(it: Iterator[pa.RecordBatch], micros: int) -> Iterator[pa.RecordBatch]:
    """Matches sorted by alert and time: those at least the cooldown after the last one that fired, with the matches each one covers."""
    alert, fired, n = None, 0, 0
    for batch in it:
        out: list[tuple] = []
        for key, ts, m in zip(batch.column("alert_id").to_pylist(), batch.column("ts").cast(pa.int64()).to_pylist(), batch.column("m").to_pylist(), strict=True):
            if key == alert and ts < fired + micros:
                n += m
                continue
            if n:
                out.append((alert, fired, n))
            alert, fired, n = key, ts, m
        yield _fired(out)
    yield _fired([(alert, fired, n)] if n else [])


def _fired(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
    at = pa.array(cols[1], pa.int64()).cast(pa.timestamp("us", "UTC"))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), at, pa.array(cols[2], pa.int64())], names=["alert_id", "fired_at", "matches"])


def cooled(matches: DataFrame, minutes: int) -> DataFrame:
    """(alert_id, fired_at, matches) of a table of matches (alert_id, ts).

    An alert fires at its first match and then at the first one at least
    ``minutes`` after the last time it fired; ``matches`` counts those it covers.
    Each alert is one pass over its sorted matches without holding them; equal
    times are counted before that.  Rows with a null id or time are ignored.
    """
    counted = matches.where("alert_id is not null and ts is not null").select(F.col("alert_id").cast("long").alias("alert_id"), F.col("ts").cast("timestamp").alias("ts")).groupBy("alert_id", "ts").agg(F.count(F.lit(1)).alias("m"))
    ordered = counted.repartition("alert_id").sortWithinPartitions("alert_id", "ts")
    return ordered.mapInArrow(lambda it: _fire(it, minutes * 60_000_000), "alert_id long, fired_at timestamp, matches long")


def cooled_stream(matches: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """The same over a stream: (alert_id, fired_at), with the time of the last firing as state of each alert."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = sorted(t for f in frames for t in f["ts"])
        out = []
        for t in times:
            if last is None or t >= last + pd.Timedelta(minutes=minutes):
                last = t.to_pydatetime()
                out.append(t)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"alert_id": [key[0]] * len(out), "fired_at": out})

    rows = matches.where("alert_id is not null and ts is not null").withWatermark("ts", late).select("alert_id", "ts")
    return rows.groupBy("alert_id").applyInPandasWithState(step, "alert_id long, fired_at timestamp", "last timestamp", "append", "NoTimeout")
