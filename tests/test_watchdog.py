"""Alerts with window and cooldown, and session state that ends."""

import datetime as dt
import os
import random
import shutil
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from almanac.operators import alerts as AL
from almanac.operators import media as M
from almanac.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def second_by_second(errors, cooldown, window):
    """The watchdog run every second: unanswered errors not older than the window, last restart long enough ago."""
    out, last = [], None
    for now in range(min(errors), max(errors) + cooldown + 1):
        if any((last is None or e > last) and 0 <= now - e <= window for e in errors) and (last is None or now - last >= cooldown):
            out.append(now)
            last = now
    return out


@pytest.mark.parametrize("cooldown,window", [(180, 300), (180, 60), (7, 3), (5, 100)])
def test_alerts_equal_the_watchdog_run_every_second(spark, cooldown, window):
    rng = random.Random(cooldown + window)
    want, rows = set(), []
    # Errors on both sides of midnight, a dense and a sparse service, one with a day without errors, one without a name.
    for name, n, span in (("dense", 900, 1500), ("sparse", 25, 4000), (None, 120, 3000), ("gap", 2, 3)):
        seconds = [86_400 - span // 2 + rng.randrange(span) for _ in range(n)] + ([3 * 86_400 + 5] if name == "gap" else [])
        want |= {(name, T0 + dt.timedelta(seconds=s)) for s in second_by_second(set(seconds), cooldown, window)}
        rows += [(name, T0 + dt.timedelta(seconds=s, microseconds=rng.randrange(10**6)), "tick timeout") for s in seconds]
    rows += [("dense", None, "tick timeout"), ("dense", T0, "all fine"), ("quiet", T0, None)]
    log = spark.createDataFrame(rows, "service string, timestamp timestamp_ntz, line string")
    got = [tuple(r) for r in AL.alert_cooldown(log, cooldown, window).collect()]
    assert len(got) == len(want) and set(got) == want
    assert AL.alert_cooldown(log.limit(0), cooldown, window).count() == 0


def test_error_inside_the_cooldown_alerts_at_its_end(spark):
    log = spark.createDataFrame([("s", T0 + dt.timedelta(seconds=s), "tick timeout") for s in (0, 30, 500)], "service string, timestamp timestamp_ntz, line string")
    seconds = lambda **k: sorted((r["alert_ts"] - T0).seconds for r in AL.alert_cooldown(log, **k).collect())
    assert seconds() == [0, 180, 500] and seconds(window_sec=100) == [0, 500]
    with pytest.raises(ValueError):
        AL.alert_cooldown(log, cooldown_sec=0)


def test_a_play_without_a_stop_leaves_no_state(spark):
    base = tempfile.mkdtemp(prefix="st5x-", dir="/tmp")
    os.makedirs(f"{base}/land")
    hours = [("u", "lost", 0, M.PLAY), ("u", "long", 0, M.PLAY), ("u", "seen", 0, M.PLAY), ("u", "seen", 2, M.STOP)], [("u", "long", 13, M.STOP), ("u", "later", 30, M.PLAY)], [("z", "end", 60, M.PLAY)]
    schema = "id bigint, event_type string, user_name string, item_name string, device string, timestamp timestamp_ntz"
    for k, rows in enumerate(hours):
        spark.createDataFrame([(1, e, u, i, "d", T0 + dt.timedelta(hours=h)) for u, i, h, e in rows], schema).coalesce(1).write.json(f"{base}/_{k}")
        name = next(f for f in os.listdir(f"{base}/_{k}") if f.endswith(".json"))
        shutil.copy(f"{base}/_{k}/{name}", f"{base}/land/{k}.json")
        time.sleep(1.1)
    src = J.read_landing(spark, f"{base}/land", J.ACTIVITY_LANDING, max_files=1)
    q = J.sessions_stream(src, lateness="1 hour").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck")
    q.trigger(availableNow=True).start().awaitTermination()
    got = [(r["item_name"], r["duration_minutes"]) for r in spark.read.parquet(f"{base}/out").collect()]
    assert got == [("seen", 120.0)]  # a stop after 13 hours closes nothing
    state = spark.read.format("statestore").option("path", f"{base}/ck")
    assert state.option("stateVarName", "open").load().count() == 0
    waiting = state.option("stateVarName", "due").load().select(F.col("key.*")).collect()
    assert [r["item_name"] for r in waiting] == ["end"]
