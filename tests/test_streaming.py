"""Streaming jobs against their batch twins on the same landed files."""

import glob
import os
import shutil
import tempfile
import time
import warnings

from pyspark.sql import functions as F

from almanac.operators import alerts as AL
from almanac.operators import media as M
from almanac.sources import fixtures as FX
from almanac.sources import landing as L
from almanac.sources.ingest import ingest_telemetry
from almanac.streaming import jobs as J
from tests.conftest import SF_SMALL

warnings.filterwarnings("ignore", category=FutureWarning)

RANGES = [("2024-01-01", "2024-01-08"), ("2024-01-08", "2024-01-15"), ("2024-01-15", "2024-01-22"), ("2024-01-22", "2024-02-01")]


def land_in_order(df, base, name, ts="timestamp"):
    """Write one JSON file per time range, oldest first (file sources replay in
    modification-time order)."""
    out = f"{base}/{name}"
    os.makedirs(out)
    for i, (a, b) in enumerate(RANGES):
        df.filter((F.col(ts) >= a) & (F.col(ts) < b)).coalesce(1).write.json(f"{base}/_{name}{i}")
        shutil.copy(glob.glob(f"{base}/_{name}{i}/*.json")[0], f"{out}/part{i}.json")
        time.sleep(1.1)
    return out


def run(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def watermark(q):
    wm = q.lastProgress["eventTime"].get("watermark")
    return F.lit(wm.replace("T", " ").replace("Z", "")).cast("timestamp_ntz")


def test_stream_telemetry_dedupes(spark):
    base = tempfile.mkdtemp(prefix="st1-", dir="/tmp")
    raw = FX.load(spark, SF_SMALL, "telemetry_raw")
    both = raw.unionByName(raw.filter(F.col("timestamp") >= "2024-01-10"))  # replayed rows
    land = land_in_order(both, base, "land")
    run(J.stream_telemetry(spark, land, f"{base}/sink", name=f"t1-{os.path.basename(base)}").option("maxFilesPerTrigger", 1))
    out = spark.read.parquet(f"{base}/sink").drop("month")
    exp = ingest_telemetry(spark.read.schema(J.TELEMETRY_LANDING).json(land)).dropDuplicates(["entity_id", "timestamp"])
    assert out.count() == exp.count() == raw.count()
    assert sorted(map(tuple, out.select(*exp.columns).collect())) == sorted(map(tuple, exp.collect()))


def test_stream_alerts_equal_batch_up_to_watermark(spark):
    base = tempfile.mkdtemp(prefix="st4-", dir="/tmp")
    land = land_in_order(L.service_log(spark, SF_SMALL), base, "land")
    src = J.read_landing(spark, land, J.SERVICE_LOG_LANDING, max_files=1)
    q = run(J.alerts_stream(src).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck"))
    cut = watermark(q)
    got = spark.read.parquet(f"{base}/out").filter(F.col("alert_ts") <= cut)
    exp = AL.alert_cooldown(spark.read.schema(J.SERVICE_LOG_LANDING).json(land)).filter(F.col("alert_ts") <= cut)
    assert got.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_stream_sessions_equal_batch_up_to_watermark(spark):
    base = tempfile.mkdtemp(prefix="st5-", dir="/tmp")
    act = FX.load(spark, SF_SMALL, "media_activity")
    land = land_in_order(act, base, "land")
    src = J.read_landing(spark, land, J.ACTIVITY_LANDING, max_files=1)
    q = run(J.sessions_stream(src, lateness="1 hour").writeStream.format("parquet").option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/ck"))
    cut = watermark(q)
    got = spark.read.parquet(f"{base}/out").filter(F.col("stop_time") <= cut)
    exp = M.watch_sessions(spark.read.schema(J.ACTIVITY_LANDING).json(land)).filter(F.col("stop_time") <= cut)
    # Plays are forgotten after SESSION_HOURS.
    exp = exp.filter(F.col("stop_time") <= F.col("start_time") + F.make_dt_interval(hours=F.lit(J.SESSION_HOURS)))
    assert got.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


def test_stream_daily_summary_equals_batch(spark):
    from almanac.operators.telemetry import telemetry_daily_summary

    base = tempfile.mkdtemp(prefix="st6-", dir="/tmp")
    t = FX.load(spark, SF_SMALL, "telemetry")
    t.write.parquet(f"{base}/tel")
    q = run(J.stream_daily_summary(spark, f"{base}/tel", t.schema, f"{base}/out", name=f"d-{os.path.basename(base)}"))
    got = spark.read.parquet(f"{base}/out")
    exp = telemetry_daily_summary(t).join(got.select("entity_id", "date"), ["entity_id", "date"])
    assert got.count() > 0
    assert sorted(map(tuple, got.select(*exp.columns).collect())) == sorted(map(tuple, exp.collect()))


def test_stream_routes_equal_batch(spark):
    from almanac.operators import routing as RT
    from almanac.plans.q_misc import DEFAULT_URLS, _routes

    base = tempfile.mkdtemp(prefix="st3-", dir="/tmp")
    ev = FX.load(spark, SF_SMALL, "notification_raw")
    ev.coalesce(2).write.json(f"{base}/land")
    routes = _routes(spark, SF_SMALL)
    run(J.stream_route_events(spark, f"{base}/land", routes, DEFAULT_URLS, f"{base}/out", name=f"r-{os.path.basename(base)}"))
    got = spark.read.json(f"{base}/out")
    exp = RT.outgoing_messages(spark.read.schema(J.NOTIFICATION_LANDING).json(f"{base}/land"), routes, DEFAULT_URLS)
    cols = ["event_id", "requester", "title", "body", "tag", "direct", "fallback"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, exp.select(*cols).collect()))


def test_stream_upsert_is_idempotent(spark):
    base = tempfile.mkdtemp(prefix="st2-", dir="/tmp")
    p = FX.load(spark, SF_SMALL, "media_playback").withColumn("month", F.date_format("date", "yyyy-MM"))
    p.filter(F.col("date") < "2024-01-20").write.json(f"{base}/land/a")
    p.filter(F.col("date") >= "2024-01-15").withColumn("minutes_watched", (F.col("minutes_watched") * 2).cast("int")).write.json(f"{base}/land/b")
    schema = "user_name string, date date, minutes_watched int, month string"
    for attempt in range(2):  # the same landed batches twice -> the same table
        for sub in ("a", "b"):
            src = spark.readStream.schema(schema).json(f"{base}/land/{sub}")
            run(J.stream_upsert(spark, src, f"{base}/table", ["user_name", "date"], "upsert", "month",
                                name=f"u-{os.path.basename(base)}-{attempt}-{sub}", update_cols=["minutes_watched"]))
        got = spark.read.parquet(f"{base}/table")
        assert got.count() == p.count()
        doubled = got.filter(F.col("date") >= "2024-01-15").join(p.select("user_name", "date", F.col("minutes_watched").alias("m0")), ["user_name", "date"])
        assert doubled.filter(F.col("minutes_watched") != F.col("m0") * 2).count() == 0


def test_upsert_sink_keeps_null_partitions_and_holds_a_key_once(spark):
    schema = "k string, v int, month string"
    for mode, moved in (("ignore", ("a", 1, "2024-01")), ("replace", ("a", 9, "2024-02"))):
        path = tempfile.mkdtemp(prefix="st2n-", dir="/tmp") + "/table"
        sink = J.upsert_sink(path, ["k"], mode, "month")
        sink(spark.createDataFrame([("a", 1, "2024-01"), ("b", 2, None), ("d", 4, None)], schema), 0)
        for _ in range(2):  # a replayed batch gives the same table
            sink(spark.createDataFrame([("a", 9, "2024-02"), ("c", 3, None)], schema), 1)
            got = {(r["k"], r["v"], r["month"]) for r in spark.read.parquet(path).collect()}
            assert got == {moved, ("b", 2, None), ("c", 3, None), ("d", 4, None)}
            assert spark.read.parquet(path).count() == 4


def test_stream_sessions_round_half_up_on_whole_seconds(spark):
    base = tempfile.mkdtemp(prefix="st5s-", dir="/tmp")
    os.makedirs(f"{base}/land")
    rows = [("u", "i", 0, M.PLAY), ("u", "i", 15, M.STOP), ("u", "j", 0, M.PLAY), ("u", "j", 45, M.STOP), ("z", "z", 59, M.PLAY)]
    df = spark.createDataFrame(rows, "user_name string, item_name string, s int, event_type string")
    stamp = F.format_string("2024-01-01 10:00:%02d", "s").cast("timestamp_ntz")
    df = df.select(F.lit(1).cast("bigint").alias("id"), "event_type", "user_name", "item_name", F.lit("d").alias("device"), stamp.alias("timestamp"))
    df.coalesce(1).write.json(f"{base}/_a")
    shutil.copy(glob.glob(f"{base}/_a/*.json")[0], f"{base}/land/a.json")
    src = J.read_landing(spark, f"{base}/land", J.ACTIVITY_LANDING)
    run(J.sessions_stream(src, lateness="0 seconds").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck"))
    got = {r["item_name"]: r["duration_minutes"] for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {r["item_name"]: r["duration_minutes"] for r in M.watch_sessions(df).collect()} == {"i": 0.3, "j": 0.8}


def test_stream_daily_summary_update_mode_covers_every_day(spark):
    from almanac.operators.telemetry import telemetry_daily_summary

    base = tempfile.mkdtemp(prefix="st6u-", dir="/tmp")
    t = FX.load(spark, SF_SMALL, "telemetry")
    for i, (a, b) in enumerate(RANGES):  # landed in three increments
        t.filter((F.col("timestamp") >= a) & (F.col("timestamp") < b)).write.mode("append").parquet(f"{base}/tel")
    run(J.stream_daily_summary(spark, f"{base}/tel", t.schema, f"{base}/out", name=f"du-{os.path.basename(base)}", mode="update"))
    got = spark.read.parquet(f"{base}/out").drop("month")
    exp = telemetry_daily_summary(t)
    assert got.count() == exp.count()
    assert sorted(map(tuple, got.select(*exp.columns).collect())) == sorted(map(tuple, exp.collect()))
