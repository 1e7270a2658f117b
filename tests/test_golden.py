"""Golden micro-tests (FIXTURES.md section 3): small hand-written inputs with NULLs,
blanks, duplicates, ties and empty input."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from almanac.functions.dates import DateRange, week_key
from almanac.functions.numeric import round_half_away
from almanac.functions.sensors import sensor_bool, sensor_double, sensor_fallback
from almanac.operators import alerts as AL
from almanac.operators import briefing as BR
from almanac.operators import media as M
from almanac.operators import merge as MG
from almanac.operators import routing as RT
from almanac.operators import subtitles as SB
from almanac.operators import transactions as X
from almanac.operators.common import threshold_band
from almanac.sources import ingest as I
from tests.conftest import rows

TS = dt.datetime


def items_df(spark, cases):
    schema = "case string, items array<struct<code: string, value: string>>"
    return spark.createDataFrame(cases, schema)


def test_sensor_double(spark):
    df = items_df(spark, [
        ("missing", [("1", "5")]), ("blank", [("c", "")]), ("na", [("c", "n/a")]), ("zero", [("c", "0")]),
        ("dup", [("c", "7.5"), ("c", "9")]), ("empty", []), ("null", None)])
    got = {r["case"]: r["v"] for r in rows(df.select("case", sensor_double(F.col("items"), "c").alias("v")))}
    assert got == {"missing": None, "blank": None, "na": None, "zero": 0.0, "dup": 7.5, "empty": None, "null": None}


def test_sensor_fallback(spark):
    df = spark.createDataFrame([("n", None, 5.0), ("z", 0.0, 6.0), ("both", None, None), ("ok", 3.0, 9.0)], "c string, a double, b double")
    got = {r["c"]: r["v"] for r in rows(df.select("c", sensor_fallback(F.col("a"), F.col("b")).alias("v")))}
    assert got == {"n": 5.0, "z": 6.0, "both": None, "ok": 3.0}


def test_sensor_bool(spark):
    df = items_df(spark, [("missing", [("x", "1")]), ("one", [("lock", "1")]), ("zero", [("lock", "0")])])
    got = {r["case"]: r["v"] for r in rows(df.select("case", sensor_bool(F.col("items"), "lock", "1").alias("v")))}
    assert got == {"missing": None, "one": True, "zero": False}
    ch = items_df(spark, [("c", [("chg", "5")]), ("n", [("chg", "1")])])
    got = {r["case"]: r["v"] for r in rows(ch.select("case", sensor_bool(F.col("items"), "chg", "5").alias("v")))}
    assert got == {"c": True, "n": False}


def test_ingest_telemetry_odometer_fallback(spark):
    doc = lambda odo: json.dumps({"latitude": 1.5, "longitude": 2.25, "items": [
        {"code": "2103010", "value": odo}, {"code": "2042082", "value": "777"}, {"code": "2013023", "value": "5"}]})
    raw = spark.createDataFrame([(1, TS(2024, 1, 1), doc("0")), (1, TS(2024, 1, 2), doc("123.4")), (2, TS(2024, 1, 3), doc(""))],
                                "entity_id long, timestamp timestamp_ntz, raw_json string")
    got = rows(I.ingest_telemetry(raw), ["timestamp"])
    assert [float(r["odometer_km"]) for r in got] == [777.0, 123.4, 777.0]
    assert all(r["is_charging"] is True and r["is_locked"] is None for r in got)


def test_ingest_transactions(spark):
    p1 = {"page": 1, "hasNextPage": True, "results": [
        {"id": "a", "date": "2024-01-02T10:11:12.000Z", "amount": 10.5, "category": "", "description": "", "merchant": {"name": "Shop"}},
        {"id": None, "date": "2024-01-02", "amount": 1, "category": "x", "description": "d"},
        {"id": "b", "date": None, "amount": 1, "category": "x", "description": "d"}]}
    p2 = {"page": 2, "hasNextPage": False, "results": [
        {"id": "c", "date": "2024-01-03T00:00:00Z", "category": "food", "description": "it's \"quoted\""}]}
    pages = spark.createDataFrame([(json.dumps(p1),), (json.dumps(p2),)], "page_json string")
    got = {r["id"]: r for r in rows(I.ingest_transactions(pages, "credit_card"))}
    assert set(got) == {"a", "c"}
    assert got["a"]["category"] == "Outros" and got["a"]["merchant"] == "Shop" and got["a"]["timestamp"] == TS(2024, 1, 2, 10, 11, 12)
    assert got["c"]["merchant"] == 'it\'s "quoted"' and float(got["c"]["amount"]) == 0.0
    assert got["c"]["account_type"] == "credit_card"


def test_ingest_activity(spark):
    items = [
        {"Id": 1, "Type": "VideoPlayback", "Name": "ana está reproduzindo Casa em Chamas em TV Sala", "UserId": "u", "Date": "2024-01-01T10:00:00.1234567Z"},
        {"Id": 2, "Type": "VideoPlaybackStopped", "Name": "ana parou de reproduzir Filme em tv", "Date": "2024-01-01T11:00:00Z"},
        {"Id": 3, "Type": "VideoPlayback", "Name": "garbled", "Date": "2024-01-01T12:00:00Z"},
        {"Id": 4, "Type": "AuthenticationSucceeded", "Name": "x", "Date": "2024-01-01T12:00:00Z"}]
    pages = spark.createDataFrame([(json.dumps({"Items": items}),)], "page_json string")
    got = {r["id"]: r for r in rows(I.ingest_activity(pages))}
    assert set(got) == {1, 2, 3}
    assert (got[1]["user_name"], got[1]["item_name"], got[1]["device"]) == ("ana", "Casa", "Chamas em TV Sala")
    assert (got[2]["user_name"], got[2]["item_name"], got[2]["device"]) == ("ana", "Filme", "tv")
    assert (got[3]["user_name"], got[3]["item_name"], got[3]["device"]) == (None, None, None)
    assert got[1]["timestamp"] == TS(2024, 1, 1, 10, 0, 0)


def test_ingest_media_library(spark):
    items = [
        {"Id": "1", "Name": "A", "RunTimeTicks": 0, "Genres": ["Drama", "Comedy"], "Studios": [{"Name": "S1"}, {"Name": "S2"}]},
        {"Id": "2", "Name": "B", "RunTimeTicks": 54000000000, "MediaSources": [{"Size": 2345678901, "Container": "mkv", "MediaStreams": [
            {"Type": "Video", "Codec": "h264", "Width": 1920, "Height": 1080}, {"Type": "Video", "Codec": "hevc", "Width": 3840, "Height": 2160},
            {"Type": "Audio", "Codec": "aac"}]}]},
        {"Id": "3", "Name": "C", "MediaSources": [{"Size": 1000, "MediaStreams": [{"Type": "Video", "Codec": "vp9", "Width": 0, "Height": 720}]}]}]
    pages = spark.createDataFrame([(json.dumps({"Items": items}),)], "page_json string")
    got = {r["id"]: r for r in rows(I.ingest_media_library(pages, "Movie"))}
    assert got["1"]["runtime_minutes"] is None and got["1"]["file_size_gb"] is None and got["1"]["genres"] == "Drama,Comedy"
    assert got["1"]["studios"] == "S1,S2"
    assert got["2"]["runtime_minutes"] == 90 and float(got["2"]["file_size_gb"]) == 2.35
    assert (got["2"]["video_codec"], got["2"]["resolution"], got["2"]["audio_codec"]) == ("h264", "1920x1080", "aac")
    assert got["3"]["resolution"] is None and got["3"]["video_codec"] == "vp9"


def test_ingest_playback(spark):
    doc = [{"user_name": "labels_user", "user_usage": {"2024-01-01": 3}},
           {"user_name": "ana", "user_usage": {"2024-01-01": 30, "2024-01-02": 0}}]
    got = rows(I.ingest_playback(spark.createDataFrame([(json.dumps(doc),)], "usage_json string")))
    assert got == [{"user_name": "ana", "date": dt.date(2024, 1, 1), "minutes_watched": 30}]


# ---------------------------------------------------------------- merges

TGT = "k string, v int"
BAT = "k string, v int, seq int"


def test_insert_or_ignore(spark):
    target = spark.createDataFrame([("a", 1)], TGT)
    batch = spark.createDataFrame([("a", 9, 1), ("b", 2, 1), ("b", 3, 2)], BAT)
    once = MG.insert_or_ignore(target, batch, ["k"], "seq")
    assert rows(once, ["k"]) == [{"k": "a", "v": 1}, {"k": "b", "v": 2}]
    twice = MG.insert_or_ignore(once, batch, ["k"], "seq")
    assert rows(twice, ["k"]) == rows(once, ["k"])
    empty = MG.insert_or_ignore(spark.createDataFrame([], TGT), batch, ["k"], "seq")
    assert rows(empty, ["k"]) == [{"k": "a", "v": 9}, {"k": "b", "v": 2}]


def test_insert_or_replace(spark):
    target = spark.createDataFrame([("a", 1), ("c", 5)], TGT)
    batch = spark.createDataFrame([("a", 9, 1), ("b", 2, 1), ("b", 3, 2)], BAT)
    once = MG.insert_or_replace(target, batch, ["k"], "seq", refresh_col=None)
    assert rows(once, ["k"]) == [{"k": "a", "v": 9}, {"k": "b", "v": 3}, {"k": "c", "v": 5}]
    assert rows(MG.insert_or_replace(once, batch, ["k"], "seq", refresh_col=None), ["k"]) == rows(once, ["k"])


def test_upsert_keeps_other_columns(spark):
    target = spark.createDataFrame([("u", "d1", 10, "old")], "user string, date string, minutes int, note string")
    batch = spark.createDataFrame([("u", "d1", 20, "new"), ("u", "d2", 5, "x")], "user string, date string, minutes int, note string")
    got = rows(MG.upsert(target, batch, ["user", "date"], ["minutes"]), ["date"])
    assert got == [{"user": "u", "date": "d1", "minutes": 20, "note": "old"}, {"user": "u", "date": "d2", "minutes": 5, "note": "x"}]
    again = MG.upsert(spark.createDataFrame(got, target.schema), batch, ["user", "date"], ["minutes"])
    assert rows(again, ["date"]) == got


def test_constraint_violations(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    got = rows(MG.constraint_violations(df, ["k"], ["k", "v"], "t"), ["constraint"])
    assert [(r["constraint"], r["rows"]) for r in got] == [("not_null", 1), ("primary_key", 2)]


# ---------------------------------------------------------------- watch sessions

ACT = "id long, event_type string, user_name string, item_name string, device string, timestamp timestamp_ntz"


def test_requester_at_any_depth(spark):
    cases = [
        ('{"requester":{"name":{"username":"bob"}}}', "bob"),
        ('{"requester":[["bob"]]}', "bob"),
        ('{"requester":[[], [{"email":" "}], 7, null, [[{"name":[{"displayName":"eve"}]}]], "late"]}', "eve"),
        ('{"requester":{"email":"last","username":{"name":[1, "first"]}}}', "first"),
        ('{"requester":{"other":{"username":"bob"}},"user":"flat"}', "flat"),
        ('{"request":{"requestedBy":{"username":[{"name":"deep"}]}}}', "deep"),
        ('{"requester":' + "[" * 30 + '"x"' + "]" * 30 + "}", "x"),
        ('{"requester":[],"username":{}}', None),
        ('{"requester":"{{user}}"}', None),
        ("no json", None), (None, None),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, payload string")
    routes = spark.createDataFrame([(1, "Bob", "b://old"), (3, "@bob", " , "), (2, " bob ", "b://new")], "place int, user string, urls string")
    got = {r["i"]: r for r in RT.route_events(df, routes, [], route_order="place").collect()}
    assert [got[i]["requester"] for i in range(len(cases))] == [want for _, want in cases]
    assert got[0]["urls"] == ["b://new"] and got[0]["direct"] and not got[2]["direct"]


def _ev(i, kind, minute, user="u", item="t", dev="d"):
    return (i, M.PLAY if kind == "p" else M.STOP, user, item, dev, TS(2024, 1, 1, 10, 0) + dt.timedelta(minutes=minute))


SESSION_CASES = [
    _ev(1, "p", 0), _ev(2, "s", 30),                                  # play-stop
    _ev(3, "p", 100, item="t2"), _ev(4, "p", 110, item="t2"), _ev(5, "s", 120, item="t2"),  # play-play-stop
    _ev(6, "s", 200, item="t3"), _ev(7, "p", 210, item="t3"),         # stop before play, no stop after
    _ev(8, "p", 300, item="t4"), _ev(9, "s", 300, item="t4"),         # stop at the play's own time
    _ev(10, "p", 400, item="t5"), _ev(11, "s", 450, item="t5"), _ev(12, "p", 450, item="t5"),  # stop at next play's time
    _ev(13, "p", 500, item="t6", dev="a"), _ev(14, "p", 500, item="t6", dev="a"), _ev(15, "s", 530, item="t6"),  # two plays at one time
    _ev(16, "p", 600, user=None), _ev(17, "s", 610, user=None),       # NULL user
]


def test_watch_sessions_cases(spark):
    got = rows(M.watch_sessions(spark.createDataFrame(SESSION_CASES, ACT)), ["item_name", "start_time"])
    summary = [(r["item_name"], r["start_time"].hour * 60 + r["start_time"].minute - 600, r["duration_minutes"]) for r in got]
    assert summary == [("t", 0, 30.0), ("t2", 110, 10.0), ("t5", 400, 50.0), ("t6", 500, 30.0)]


def _sessions_by_definition(activity):
    """Every play with the nearest later stop, unless another play lies between; row by row."""
    seen = {}
    for r in activity.collect():
        if r["user_name"] is not None and r["item_name"] is not None and r["timestamp"] is not None:
            seen.setdefault((r["user_name"], r["item_name"]), []).append(r)
    out = set()
    for key, events in seen.items():
        plays = [e for e in events if e["event_type"] == M.PLAY]
        for t in {p["timestamp"] for p in plays}:
            stop = min((e["timestamp"] for e in events if e["event_type"] == M.STOP and e["timestamp"] > t), default=None)
            if stop is not None and not any(t < p["timestamp"] < stop for p in plays):
                devices = [p["device"] for p in plays if p["timestamp"] == t]
                out.add((*key, None if None in devices else max(devices), t, stop))
    return out


@pytest.mark.parametrize("bucket", ["day", "hour", "minute"])
def test_watch_sessions_equal_definition(spark, bucket):
    from almanac.sources import fixtures as FX
    from tests.conftest import SF_SMALL

    for act in (FX.load(spark, SF_SMALL, "media_activity"), spark.createDataFrame(SESSION_CASES, ACT)):
        got = [tuple(r)[:5] for r in M.watch_sessions(act, bucket=bucket).collect()]
        assert got and len(got) == len(set(got)) and set(got) == _sessions_by_definition(act)


def test_sessions_do_not_overlap(spark):
    from almanac.sources import fixtures as FX
    from tests.conftest import SF_SMALL
    from pyspark.sql import Window

    s = M.watch_sessions(FX.load(spark, SF_SMALL, "media_activity"))
    w = Window.partitionBy("user_name", "item_name").orderBy("start_time")
    bad = s.withColumn("next_start", F.lead("start_time").over(w)).filter(F.col("stop_time") > F.col("next_start"))
    assert bad.count() == 0


def test_user_watch_stats_bounds(spark):
    s = spark.createDataFrame([("u", "a", "d", TS(2024, 1, 1), TS(2024, 1, 1), 0.0),
                               ("u", "b", "d", TS(2024, 1, 2), TS(2024, 1, 2), 599.9),
                               ("u", "c", "d", TS(2024, 1, 3), TS(2024, 1, 3), 600.0)], M.SESSION_COLS)
    got = rows(M.user_watch_stats(s))
    assert got == [{"user_name": "u", "titles": 1, "sessions": 1, "minutes": 600.0, "hours": 10.0, "last_session": TS(2024, 1, 2)}]


# ---------------------------------------------------------------- dates, numbers, bands

def test_week_key(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1),), (dt.date(2024, 1, 1),), (dt.date(2024, 1, 7),)], "d date")
    assert [r["w"] for r in rows(df.select(week_key("d").alias("w")))] == ["2023-W00", "2024-W01", "2024-W01"]


def test_week_key_matches_strftime(spark):
    df = spark.range(0, 4748).select(F.date_add(F.lit(dt.date(2018, 1, 1)), F.col("id").cast("int")).alias("d"))
    got = {r["d"]: r["w"] for r in df.select("d", week_key("d").alias("w")).collect()}
    assert all(got[d] == d.strftime("%Y-W%W") for d in got)


@pytest.mark.parametrize("mode,inside", [("half_open", False), ("closed_date", True), ("closed_midnight", False), ("end_of_day", True)])
def test_date_range_modes(spark, mode, inside):
    df = spark.createDataFrame([(TS(2024, 1, 31, 12, 0),)], "ts timestamp_ntz").withColumn("d", F.col("ts").cast("date"))
    r = DateRange.of("2024-01-01", "2024-01-31", mode)
    assert (df.filter(r.on_timestamp("ts")).count() == 1) == inside


def test_round_half_away(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (0.285,), (2.5,), (-2.5,)], "x double")
    got = [r["r"] for r in df.select(round_half_away(F.col("x"), 2).alias("r")).collect()]
    assert got[:3] == [1.0, 2.68, 0.28]
    assert [r["r"] for r in df.select(round_half_away(F.col("x"), 0).alias("r")).collect()][3:] == [3.0, -3.0]


def test_month_comparison_previous_zero(spark):
    tx = spark.createDataFrame([(dt.date(2024, 1, 5), dt.datetime(2024, 1, 5), 5.0), (dt.date(2024, 2, 5), dt.datetime(2024, 2, 5), -10.0)],
                               "date date, timestamp timestamp_ntz, amount double").withColumn("amount", F.col("amount").cast("decimal(12,2)"))
    got = rows(X.tx_month_comparison(tx), ["month"])
    assert got[1]["prev_expense"] == 0.0 and got[1]["change_pct"] is None


def test_threshold_band(spark):
    df = spark.createDataFrame([(19.99,), (20.0,), (50.0,), (80.0,), (None,)], "x double")
    got = [r["b"] for r in df.select(threshold_band(F.col("x"), [(None, "red"), (20, "orange"), (50, "yellow"), (80, "green")]).alias("b")).collect()]
    assert got == ["red", "orange", "yellow", "green", None]


# ---------------------------------------------------------------- subtitles

def test_translation_is_bad(spark):
    cases = [("hello", "", True), ("x" * 44, "y" * 181, True), ("abc", "z" * 321, True),
             ("s" * 100, '"' * 6 + "w" * 135, True), ("Subtitle translation by X", "ok", True), ("hello", "olá", False)]
    df = spark.createDataFrame(cases, "s string, t string, bad boolean")
    assert all(r["got"] == r["bad"] for r in df.select("bad", SB.translation_is_bad(F.col("s"), F.col("t")).alias("got")).collect())


def test_read_srt(spark):
    content = "1\r\n00:00:01,000 --> 00:00:02,000\r\nline one\r\nline two\r\n\r\nx\r\n00:00:03,000 --> 00:00:04,000\r\nbad index\r\n\r\n3\r\nonly two lines\r\n\r\n4\r\n00:00:05,000 --> 00:00:06,000\r\nlast\r\n"
    got = rows(SB.read_srt(spark.createDataFrame([("f.srt", content)], "file string, content string")), ["pos"])
    assert [(r["pos"], r["idx"], r["text"]) for r in got] == [(0, 1, "line one\nline two"), (1, 4, "last")]


def test_read_srt_by_pieces(spark, monkeypatch, tmp_path):
    """A conversation landed block by block gives the rows of its whole file, over many
    ranges, with odd texts, and in no group of the whole conversation."""
    from almanac.plans.q_misc import _blocks
    from almanac.sources import landing as L

    texts = ["hi", "", None, " a\r", "two\n\n77\nx --> y\nmore\nlines", "\n", "x\r\ny  \n "]
    data = [(c, n, "user", texts[(c + n) % 7]) for c in (3, 4) for n in (*range(40), 7)] + [(5, None, "user", "z")]
    spark.createDataFrame(data, "conv_id long, turn int, role string, text string").repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    whole = rows(SB.read_srt(L.srt_files(spark, str(tmp_path))), ["file", "pos"])
    monkeypatch.setattr(SB, "RANGE", 6)
    pieces = L.srt_blocks(spark, str(tmp_path))
    assert rows(SB.read_srt(pieces, order_col="turn"), ["file", "pos"]) == whole == rows(SB.read_srt(L.srt_files(spark, str(tmp_path))), ["file", "pos"])
    assert len(whole) > 50 and all(r["content"] is None or r["content"].count("-->") <= 2 for r in pieces.collect())
    plan = _blocks(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "collect_list" not in plan and rows(_blocks(spark, str(tmp_path)), ["file", "pos"]) == whole


def test_srt_round_trip(spark):
    content = "1\n00:00:01,000 --> 00:00:02,000\nhi\n\n2\n00:00:03,000 --> 00:00:04,000\nthere\n"
    b = SB.read_srt(spark.createDataFrame([("f", content)], "file string, content string"))
    out = SB.write_srt(b.withColumn("final_text", F.lit(None).cast("string")))
    assert out.collect()[0]["content"] == content


def test_resume_point(spark):
    blocks = spark.createDataFrame([("a", i, i + 1) for i in range(5)] + [("b", i, i + 1) for i in range(3)] + [("c", i, i + 1) for i in range(4)],
                                   "file string, pos int, idx int")
    partial = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 1), ("b", 2), ("b", 3), ("c", 1)], "file string, idx int")
    ckpt = spark.createDataFrame([("c", 3)], "file string, done int")
    got = {r["file"]: r["resume_from"] for r in SB.resume_point(blocks, partial, ckpt).collect()}
    assert got == {"a": 2, "b": 3, "c": 3}


def test_alert_cooldown_golden(spark):
    t0 = TS(2024, 1, 1)
    log = spark.createDataFrame([("svc", t0 + dt.timedelta(seconds=s), "gateway connect failed") for s in (0, 100, 179, 180, 400)]
                                + [("svc", t0 + dt.timedelta(seconds=50), "all fine")], "service string, timestamp timestamp_ntz, line string")
    got = sorted((r["alert_ts"] - t0).seconds for r in AL.alert_cooldown(log).collect())
    assert got == [0, 180, 400]


# ---------------------------------------------------------------- briefing

TEL = "entity_id long, timestamp timestamp_ntz, battery_soc decimal(5,2), battery_range_km decimal(6,2), is_charging boolean, is_locked boolean"


def _weather(spark, rain: bool):
    hourly = [{"time": "600", "chanceofrain": "70" if rain else "0"}, {"time": "900", "chanceofrain": "10"}]
    doc = {"current_condition": [{"temp_C": "20", "FeelsLikeC": "19", "humidity": "80", "lang_pt": [{"value": "Nublado"}]}],
           "weather": [{"maxtempC": "25", "mintempC": "15", "uvIndex": "3", "hourly": hourly}]}
    return I.ingest_weather(spark.createDataFrame([(dt.date(2024, 1, 30), json.dumps(doc))], "date date, forecast_json string"))


@pytest.mark.parametrize("soc,rain,expected", [
    (20, False, BR.BATTERY_CRITICAL), (40, True, BR.BATTERY_LOW_RAIN), (40, False, BR.BATTERY_LOW),
    (60, False, BR.BATTERY_OK), (61, False, BR.BATTERY_GOOD)])
def test_briefing_battery_rules(spark, soc, rain, expected):
    t = spark.createDataFrame([(1, TS(2024, 1, 30, 7), soc, 100, False, True)], "entity_id long, timestamp timestamp_ntz, battery_soc int, battery_range_km int, is_charging boolean, is_locked boolean")
    t = t.withColumn("battery_soc", F.col("battery_soc").cast("decimal(5,2)")).withColumn("battery_range_km", F.col("battery_range_km").cast("decimal(6,2)"))
    r = BR.daily_briefing(t, _weather(spark, rain), "2024-01-30", "EV").collect()[0]
    assert r["recommendations"][0] == expected
    assert (BR.UMBRELLA.format(6) in r["recommendations"]) == rain


def test_briefing_unlocked_without_weather(spark):
    t = spark.createDataFrame([(1, TS(2024, 1, 30, 7), 80, 240, True, False)], "entity_id long, timestamp timestamp_ntz, battery_soc int, battery_range_km int, is_charging boolean, is_locked boolean")
    t = t.withColumn("battery_soc", F.col("battery_soc").cast("decimal(5,2)")).withColumn("battery_range_km", F.col("battery_range_km").cast("decimal(6,2)"))
    r = BR.daily_briefing(t, None, "2024-01-30", "EV").collect()[0]
    assert r["recommendations"] == [BR.BATTERY_GOOD, BR.JUST_UNLOCKED]
    assert BR.UNLOCKED in r["text"] and BR.CHARGING in r["text"] and "Clima" not in r["text"]


def test_read_run_logs_and_report(spark, tmp_path):
    from almanac.operators import jobs as JB

    (tmp_path / "ingest").mkdir()
    (tmp_path / "ingest" / "r1.log").write_text("start\nError: boom\nmore\nFalha final\nend\n")
    (tmp_path / "ingest" / "r2.log").write_text("start\nall good\n")
    logs = JB.read_run_logs(spark, str(tmp_path / "*" / "*.log"))
    got = {r["run_id"]: r for r in JB.run_report(logs).collect()}
    assert got["r1"]["status"] == "failure" and got["r1"]["message"] == "Falha final" and got["r1"]["lines"] == 5
    assert got["r2"]["status"] == "success" and got["r2"]["message"] == "all good"
    assert {r["job"] for r in logs.collect()} == {"ingest"}


def test_route_events_csv_destinations(spark):
    ev = spark.createDataFrame([(1, '{"username": " @Ana "}'), (2, '{"title": "x"}'), (3, '{"user": [{"name": ""}, "bob"]}')],
                               "event_id long, payload string")
    routes = spark.createDataFrame([("ana", " a://1 , ,b://2"), ("BOB", "")], "user string, urls string")
    got = {r["event_id"]: r for r in RT.outgoing_messages(ev, routes, ["d://0"]).collect()}
    assert got[1]["requester"] == "@Ana" and got[1]["urls"] == ["a://1", "b://2"] and got[1]["direct"]
    assert got[1]["tag"] == "media,requester-ana"
    assert got[2]["requester"] is None and got[2]["urls"] == ["d://0"] and got[2]["fallback"] and got[2]["title"] == "x"
    assert got[3]["requester"] == "bob" and got[3]["urls"] == ["d://0"] and got[3]["fallback"]


def test_write_srt_files_equal_content(spark, tmp_path):
    from almanac.sources import landing as L
    from tests.conftest import SF_SMALL

    blocks = SB.translation_resolve(SB.chunk(L.srt_translations(SB.read_srt(L.srt_files(spark, SF_SMALL)))))
    expected = {r["file"]: r["content"] for r in SB.write_srt(blocks).collect()}
    SB.write_srt_files(blocks, str(tmp_path / "out"))
    got = {}
    for d in (tmp_path / "out").iterdir():
        if d.name.startswith("file="):
            got[d.name[5:]] = "".join(p.read_text() for p in sorted(d.glob("part-*")))
    assert got == expected


def test_text_helpers(spark):
    from almanac.functions.text import fmt_number, shorten_address, slug, truncate_bytes

    n = spark.createDataFrame([(1234.5,), (1234.0,), (None,), (1234567.891,)], "x double")
    assert [r[0] for r in n.select(fmt_number(F.col("x"))).collect()] == ["1.234,50", "1.234", "0", "1.234.567,89"]
    a = spark.createDataFrame([("Rua A, 10, Centro, City",), ("Rua A, City",), (None,), ("",)], "a string")
    assert [r[0] for r in a.select(shorten_address(F.col("a"))).collect()] == ["Rua A, Centro", "Rua A", "Local desconhecido", "Local desconhecido"]
    sl = spark.createDataFrame([(" @John Doe! ",), ("",), ("--",), ("Ana_B",)], "s string")
    assert [r[0] for r in sl.select(slug(F.col("s"))).collect()] == ["john-doe", "unknown", "unknown", "ana-b"]
    b = spark.createDataFrame([("ação",), ("a€b",), ("abc",)], "s string")
    assert [r[0] for r in b.select(truncate_bytes(F.col("s"), 4)).collect()] == ["aç", "a€", "abc"]
    assert [r[0] for r in b.select(truncate_bytes(F.col("s"), 3)).collect()] == ["aç", "a", "abc"]


def test_month_range():
    from almanac.functions.dates import month_range

    assert month_range(None, "2001-08-01") == (dt.date(2001, 7, 1), dt.date(2001, 8, 1), "Julho 2001")
    assert month_range("2023-12") == (dt.date(2023, 12, 1), dt.date(2024, 1, 1), "Dezembro 2023")
    assert month_range(None, "2024-01-15")[2] == "Dezembro 2023"


def test_extract_intent(spark):
    df = spark.createDataFrame([
        ('ok: {"action": "arr_search_movie", "query": "dune", "id": 0} done',),
        ('{"action": "format_disk"}',),
        ("no json here",),
        ('{"action": "help", broken',),
        ('{"query": "x", "id": 7}',),
    ], "t string")
    i = RT.extract_intent(F.col("t"))
    got = [tuple(r) for r in df.select(i["action"], i["query"], i["id"]).collect()]
    assert got == [("arr_search_movie", "dune", "0"), ("none", "", ""), ("none", "", ""), ("none", "", ""), ("none", "x", "7")]


def test_file_inventory_and_candidates(spark, tmp_path):
    import os

    from almanac.operators import jobs as JB
    from almanac.sources.files import file_inventory

    (tmp_path / "lib").mkdir()
    files = {"a.mkv": 3000, "b.MP4": 2500, "c.srt": 5000, ".hidden.mkv": 4000, "d.oc-tmp.mkv": 4000, "e.mkv.part": 4000, "small.avi": 10}
    for name, size in files.items():
        p = tmp_path / "lib" / name
        p.write_bytes(b"x" * size)
        os.utime(p, (1_700_000_000, 1_700_000_000))
    inv = file_inventory(spark, str(tmp_path), "2023-11-15 00:00:00")
    plan = inv._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]  # contents are not read
    got = sorted(os.path.basename(r["path"]) for r in JB.file_candidates(inv, 1000, 1).collect())
    assert got == ["a.mkv", "b.MP4"]


def test_view_catalogue_and_sql(spark):
    from almanac.sources import sinks as SK
    from tests.conftest import SF_SMALL

    names = SK.register_views(spark, SF_SMALL)
    listed = {t.name for t in spark.catalog.listTables()}
    assert set(names) <= listed
    n = SK.sql(spark, "select count(*) as n from telemetry where is_charging").collect()[0]["n"]
    assert n == spark.table("telemetry").filter("is_charging").count() > 0
    rows = SK.to_json_rows(SK.sql(spark, "select count(*) as n from transactions")).collect()
    assert rows[0]["json"].startswith('{"columns":[{"text":"n","type":"string"}],"rows":[[')


def test_unreadable_transactions_are_kept_apart(spark):
    from decimal import Decimal

    from almanac.sources import ingest as I

    page = ('{"page":1,"results":[{"id":"a","date":"2024-01-02","amount":99999999999.5},{"id":"b","date":"2024-13-45","amount":1},'
            '{"id":"c","date":"2024-01-03"},{"id":"d","date":"2024-01-04","amount":-12.34},{"id":"e","date":"2024-01-05","amount":"x"},'
            '{"id":"","date":"2024-01-05","amount":3},{"id":"f","amount":3}]}')
    pages = spark.createDataFrame([(page,)], "page_json string")
    got = {r["id"]: r["amount"] for r in I.ingest_transactions(pages, "checking_account").collect()}
    assert got == {"c": Decimal("0.00"), "d": Decimal("-12.34")}
    bad = {r["id"]: r["problem"] for r in I.unreadable_transactions(pages, "checking_account").collect()}
    assert bad == {"a": "amount", "b": "date", "e": "amount"}


def test_one_bad_value_does_not_stop_the_ingest(spark):
    from almanac.sources import ingest as I

    usage = '[{"user_name":"u","user_usage":{"2024-01-01":"30","2024-01-02":15,"2024-01-03":"x","2024-01-04":0}}]'
    rows = I.ingest_playback(spark.createDataFrame([(usage,)], "usage_json string")).collect()
    assert sorted((str(r["date"]), r["minutes_watched"]) for r in rows) == [("2024-01-01", 30), ("2024-01-02", 15)]
    forecast = '{"weather":[{"hourly":[{"time":"x","chanceofrain":"90"},{"time":"900","chanceofrain":"50"}]}]}'
    row = I.ingest_weather(spark.createDataFrame([(forecast,)], "forecast_json string")).collect()[0]
    assert row["first_rain_hour"] == 9
