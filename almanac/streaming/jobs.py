"""Streaming jobs.

All jobs read landed files (JSON lines) with an explicit schema, reuse the batch
operators for the per-row work, and keep their checkpoints under the shared folder
named by ``spark.checkpoint.dir`` (``<dir>/streams/<name>``), so a restarted or
relocated driver resumes where it stopped and executor loss only replays tasks.

Event time: the data is wall-clock (TIMESTAMP_NTZ); ``withWatermark`` needs a
TIMESTAMP, so it is cast at the streaming edge only (session zone UTC).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from almanac.operators import alerts as AL
from almanac.operators import merge as MG
from almanac.operators import routing as RT
from almanac.operators.media import PLAY, STOP
from almanac.session import checkpoint_dir
from almanac.sources.ingest import ingest_telemetry

TELEMETRY_LANDING = "entity_id bigint, timestamp timestamp_ntz, raw_json string"
NOTIFICATION_LANDING = "event_id bigint, timestamp timestamp_ntz, payload string"
SERVICE_LOG_LANDING = "service string, timestamp timestamp_ntz, line string"
ACTIVITY_LANDING = "id bigint, event_type string, user_name string, item_name string, device string, timestamp timestamp_ntz"


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def _event_time(df: DataFrame, col: str = "timestamp") -> DataFrame:
    return df.withColumn("event_time", F.col(col).cast("timestamp"))


def read_landing(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(path)


# ---------------------------------------------------------------- ST1

def telemetry_stream(src: DataFrame, lateness: str = "1 day") -> DataFrame:
    """ST1 transformation: status docs -> telemetry rows, deduplicated on
    (entity_id, timestamp) within the watermark."""
    t = _event_time(ingest_telemetry(src)).withWatermark("event_time", lateness)
    t = t.dropDuplicatesWithinWatermark(["entity_id", "timestamp"])
    return t.drop("event_time").withColumn("month", F.date_format("date", "yyyy-MM"))


def stream_telemetry(spark: SparkSession, landing: str, sink: str, name: str = "telemetry") -> DataStreamWriter:
    """ST1: landed status JSON -> parquet table partitioned by month (append)."""
    q = telemetry_stream(read_landing(spark, landing, TELEMETRY_LANDING))
    return (q.writeStream.format("parquet").option("path", sink).option("checkpointLocation", stream_checkpoint(spark, name))
            .partitionBy("month").outputMode("append"))


# ---------------------------------------------------------------- ST2

def upsert_sink(target_path: str, keys: list[str], mode: str, part_col: str, seq: str = "_arrival",
                update_cols: list[str] | None = None):
    """ST2: a ``foreachBatch`` function merging each micro-batch into a partitioned
    parquet table (``mode`` = ignore | replace | upsert). The partitions of the batch's rows
    and of the stored rows with its keys are read and rewritten, so a key is held once in the
    whole table; the merged partitions go through a staging folder
    keyed by batch id, so a replayed batch rewrites the same result (idempotent)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if seq not in batch.columns:
            batch = batch.withColumn(seq, F.monotonically_increasing_id())
        parts = MG.touched_partitions(batch, part_col)
        if not parts:
            return
        try:
            stored = spark.read.parquet(target_path)
            held = stored.join(batch.select(*keys).distinct(), keys, "left_semi")
            parts = list({*parts, *MG.touched_partitions(held, part_col)})
            target = stored.filter(MG.in_partitions(part_col, parts))
        except AnalysisException as e:  # first batch: the table does not exist yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            target = spark.createDataFrame([], batch.drop(seq).schema)
        if mode == "ignore":
            merged = MG.insert_or_ignore(target, batch.select(*target.columns, seq), keys, seq)
        elif mode == "replace":
            merged = MG.insert_or_replace(target, batch.select(*target.columns, seq), keys, seq, refresh_col=None)
        elif mode == "upsert":
            merged = MG.upsert(target, batch.select(*target.columns, seq), keys, update_cols or [], seq)
        else:
            raise ValueError(mode)
        staging = f"{checkpoint_dir(spark).rstrip('/')}/staging/{zlib.crc32(target_path.encode()):08x}/{batch_id}"
        MG.write_partitions(merged, target_path, part_col, staging=staging, replaced=parts)

    return run


def stream_upsert(spark: SparkSession, src: DataFrame, target_path: str, keys: list[str], mode: str, part_col: str,
                  name: str, update_cols: list[str] | None = None) -> DataStreamWriter:
    return (src.writeStream.foreachBatch(upsert_sink(target_path, keys, mode, part_col, update_cols=update_cols))
            .option("checkpointLocation", stream_checkpoint(spark, name)))


# ---------------------------------------------------------------- ST3

def stream_route_events(spark: SparkSession, landing: str, routes: DataFrame, default_urls: list[str], sink: str,
                        name: str = "routes") -> DataStreamWriter:
    """ST3: webhook payload stream -> requester -> destinations -> outgoing message
    (stateless; a stream-static join against the route table)."""
    ev = read_landing(spark, landing, NOTIFICATION_LANDING)
    out = RT.outgoing_messages(ev, routes, default_urls)
    return (out.writeStream.format("json").option("path", sink).option("checkpointLocation", stream_checkpoint(spark, name))
            .outputMode("append"))


# ---------------------------------------------------------------- ST4

ALERT_OUT = "service string, alert_ms bigint"


class _Alerts(StatefulProcessor):
    """Per service: an error waits as an event-time timer at the end of its second and is judged when the watermark
    has passed it. Timers fire in order and equal ones are one, so no list of errors is held or sorted; the
    state is the latest alert."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "s bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for ms in {(r["s"] + 1) * 1000 for r in rows}:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        error = expiredTimerInfo.getExpiryTimeInMs() // 1000 - 1
        last = self.last.get()[0] if self.last.exists() else None
        new = AL.next_alert(last, error, AL.COOLDOWN_SEC, AL.WINDOW_SEC)
        if new != last:
            self.last.update((new,))
            yield Row(service=key[0], alert_ms=new * 1000)

    def close(self) -> None:
        pass


def alerts_stream(src: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """ST4 transformation: error lines -> restart alerts with a window and a cooldown per service, as
    ``alert_cooldown`` defines them. An alert at the end of a cooldown is written as soon as it is certain."""
    e = src.filter(F.col("line").rlike(AL.ERROR_PATTERNS)).select("service", "timestamp")
    e = _event_time(e).withWatermark("event_time", lateness).select("service", "event_time", F.unix_seconds("event_time").alias("s"))
    out = e.groupBy("service").transformWithState(_Alerts(), ALERT_OUT, "append", "eventTime")
    return out.select("service", F.timestamp_millis("alert_ms").cast("timestamp_ntz").alias("alert_ts"))


def stream_alerts(spark: SparkSession, landing: str, sink: str, name: str = "alerts") -> DataStreamWriter:
    q = alerts_stream(read_landing(spark, landing, SERVICE_LOG_LANDING))
    return (q.writeStream.format("parquet").option("path", sink).option("checkpointLocation", stream_checkpoint(spark, name))
            .outputMode("append"))


# ---------------------------------------------------------------- ST5

SESSION_OUT = "user_name string, item_name string, device string, start_us bigint, stop_us bigint, duration_minutes double"
#: A play without a stop is forgotten after this time; reports leave out sessions of ten hours and more.
SESSION_HOURS = 12


class _Sessions(StatefulProcessor):
    """Per (user, item): events wait in a map by millisecond, each with a timer, until the watermark has passed them, and
    are then taken in (time, stop-before-play) order: a play opens a session (dropping an unmatched earlier one), the first
    later stop closes it. An open play is forgotten ``SESSION_HOURS`` later, so a key without events holds no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "us bigint, device string")
        self.due = handle.getMapState("due", "ms bigint", "events array<struct<us: bigint, is_play: boolean, device: string>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[int, list] = {}
        for r in rows:
            new.setdefault(r["us"] // 1000, []).append((r["us"], r["is_play"], r["device"]))
        for ms, events in new.items():
            held = [tuple(e) for e in self.due.getValue((ms,))[0]] if self.due.containsKey((ms,)) else []
            self.due.updateValue((ms,), (held + events,))
            self.handle.registerTimer(ms + 1)
            if any(is_play for _, is_play, _ in events):  # here, as timers set while others fire wait for the next batch
                self.handle.registerTimer(ms + SESSION_HOURS * 3_600_000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ms = expiredTimerInfo.getExpiryTimeInMs() - 1
        events = []
        if self.due.containsKey((ms,)):
            events = sorted((tuple(e) for e in self.due.getValue((ms,))[0]), key=lambda e: (e[0], e[1], e[2] or ""))
            self.due.removeKey((ms,))
        play = self.open.get() if self.open.exists() else None
        for us, is_play, device in events:
            if is_play:
                play = (us, device)
            elif play is not None and us > play[0]:
                minutes = (us - play[0]) / 1e6 / 60.0
                yield Row(user_name=key[0], item_name=key[1], device=play[1], start_us=play[0], stop_us=us,
                          duration_minutes=math.floor(minutes * 10 + 0.5) / 10)  # half up, as in the batch form
                play = None
        if play is not None and play[0] // 1000 + SESSION_HOURS * 3_600_000 <= ms:
            play = None
        if play is not None:
            self.open.update(tuple(play))
        elif self.open.exists():
            self.open.clear()

    def close(self) -> None:
        pass


def sessions_stream(src: DataFrame, lateness: str = "12 hours") -> DataFrame:
    """ST5 transformation: play/stop events -> watch sessions of at most ``SESSION_HOURS``, emitted on stop."""
    e = src.filter(F.col("event_type").isin(PLAY, STOP) & F.col("user_name").isNotNull() & F.col("item_name").isNotNull())
    e = _event_time(e.select("user_name", "item_name", "device", "event_type", "timestamp")).withWatermark("event_time", lateness)
    e = e.select("user_name", "item_name", "device", "event_time", F.unix_micros("event_time").alias("us"), (F.col("event_type") == PLAY).alias("is_play"))
    out = e.groupBy("user_name", "item_name").transformWithState(_Sessions(), SESSION_OUT, "append", "eventTime")
    at = [F.timestamp_micros(c).cast("timestamp_ntz").alias(n) for c, n in (("start_us", "start_time"), ("stop_us", "stop_time"))]
    return out.select("user_name", "item_name", "device", *at, "duration_minutes")


def stream_sessions(spark: SparkSession, landing: str, sink: str, name: str = "sessions") -> DataStreamWriter:
    q = sessions_stream(read_landing(spark, landing, ACTIVITY_LANDING))
    return (q.writeStream.format("parquet").option("path", sink).option("checkpointLocation", stream_checkpoint(spark, name))
            .outputMode("append"))


# ---------------------------------------------------------------- ST6

def daily_summary_stream(telemetry: DataFrame, lateness: str = "1 day") -> DataFrame:
    """ST6: A3 incrementally: per entity and day window, emitted once the watermark
    passes the end of the day (append mode)."""
    t = _event_time(telemetry).withWatermark("event_time", lateness)
    g = t.groupBy("entity_id", F.window("event_time", "1 day")).agg(
        F.sum("battery_soc").alias("s"), F.count("battery_soc").alias("n"),
        F.min("battery_soc").alias("mn"), F.max("battery_soc").alias("mx"),
        F.min("odometer_km").alias("o0"), F.max("odometer_km").alias("o1"),
        F.sum(F.when(F.col("is_charging"), 1).otherwise(0)).cast("bigint").alias("charging_snapshots"),
        F.count(F.lit(1)).alias("snapshots"))
    avg = F.try_divide(F.col("s").cast("double"), F.col("n").cast("double"))
    return g.select(
        "entity_id", F.col("window.start").cast("timestamp_ntz").cast("date").alias("date"),
        (F.round(avg * 10.0, 0) / 10.0).alias("avg_soc"),
        F.round("mn", 1).cast("double").alias("min_soc"), F.round("mx", 1).cast("double").alias("max_soc"),
        (F.col("o1") - F.col("o0")).cast("double").alias("km"), "charging_snapshots", "snapshots")


def stream_daily_summary(spark: SparkSession, telemetry_path: str, schema, sink: str, name: str = "daily_summary",
                         mode: str = "append") -> DataStreamWriter:
    """ST6 sink. ``append``: each day is written once, after the watermark passes it.
    ``update``: every micro-batch's changed (entity, day) rows replace their previous
    version in a month-partitioned parquet table (idempotent merge per batch), so the
    table always holds the running figures of open days too."""
    src = spark.readStream.schema(schema).parquet(telemetry_path)
    q = daily_summary_stream(src)
    ck = stream_checkpoint(spark, name)
    if mode == "update":
        q = q.withColumn("month", F.date_format("date", "yyyy-MM"))
        return (q.writeStream.outputMode("update").option("checkpointLocation", ck)
                .foreachBatch(upsert_sink(sink, ["entity_id", "date"], "replace", "month")))
    return q.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck).outputMode("append")
