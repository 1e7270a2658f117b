"""Run outcomes, unreadable usage entries, the view catalogue, checked inserts."""

import tempfile

from pyspark.sql import functions as F

from almanac.operators import crosssource as C
from almanac.operators import jobs as JB
from almanac.operators import subtitles as SB
from almanac.operators import telemetry as T
from almanac.operators.keyed import KeyedTable
from almanac.sources import fixtures as FX
from almanac.sources import ingest as I
from almanac.sources import sinks
from tests.conftest import SF_SMALL


def test_run_outcomes_decide_by_exit_code(spark, monkeypatch):
    lines = [
        "noise", "[2024-01-01T00:00:00Z] Starting: sync all", "0 errors found", "[2024-01-01T00:00:09Z] Exit: 0 (9s)", "error outside",
        "[2024-01-02T00:00:00Z] Starting: b", "Exception: one", "last line", "[2024-01-02T00:00:01Z] Exit: 137 (1s)",
        "[2024-01-03T00:00:00Z] Starting: c", "no pattern " + "é" * 150, "[2024-01-03T00:00:01Z] Exit: 1 (0s)",
        "[2024-01-04T00:00:00Z] Starting: d", "errno 5", "[2024-01-05T00:00:00Z] Starting: e", "[2024-01-05T00:00:01Z] Exit: 2 (1s)",
    ]
    want = [
        ("a", 1, "sync all", 0, 9, "success", None), ("a", 5, "b", 137, 1, "failure", "Exception: one"),
        ("a", 9, "c", 1, 0, "failure", "no pattern " + "é" * 94), ("a", 12, "d", None, None, "unfinished", None), ("a", 14, "e", 2, 1, "failure", None),
    ]
    df = spark.createDataFrame([("a", k, x) for k, x in enumerate(lines)], "log string, line_no long, line string").repartition(3)
    for size in (10_000, 3, 1):  # all lines in one range, few, one each
        monkeypatch.setattr(JB, "LINES", size)
        assert sorted(tuple(r) for r in JB.run_outcomes(df).collect()) == want


def test_playback_accepted_and_rejected_are_all_that_landed(spark):
    doc = '[{"user_name": "u", "user_usage": {"2024-01-01": "5", "2024-01-02": "x", "no day": "7", "2024-01-03": "0", "2024-13-01": "many"}}, {"user_name": "labels_user", "user_usage": {"a": "b"}}]'
    df = spark.createDataFrame([(doc,)], "usage_json string")
    assert [tuple(r) for r in I.ingest_playback(df).collect()][0][2] == 5 and I.ingest_playback(df).count() == 1
    got = sorted(tuple(r) for r in I.unreadable_playback(df).collect())
    assert got == [("u", "2024-01-02", "x", "minutes"), ("u", "2024-13-01", "many", "date"), ("u", "no day", "7", "date")]


def test_block_numbers_out_of_range_stop_nothing(spark):
    text = "1\n00:00 --> 00:01\na\n\n99999999999\n00:01 --> 00:02\nb\n\n2\n00:02 --> 00:03\nc"
    got = SB.read_srt(spark.createDataFrame([("f", text)], "file string, content string")).orderBy("pos").collect()
    assert [(r["idx"], r["text"]) for r in got] == [(1, "a"), (2, "c")]


def test_signature_of_the_inventory(spark):
    df = spark.sql("select timestamp_ntz '2024-01-01 00:00:01.5' as mtime, 7L as size")
    assert df.select(JB.signature(JB.mtime_seconds(F.col("mtime")), F.col("size")).alias("s")).first()["s"] == "1704067201:7"


def test_catalogue_answers_sql(spark):
    names = sinks.register_catalogue(spark, SF_SMALL, FX.AS_OF_EVENTS)
    t, tx, a = (FX.load(spark, SF_SMALL, n) for n in ("telemetry", "transactions", "media_activity"))
    same = lambda x, y: sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    assert same(spark.sql("select * from monthly_summary"), C.monthly_summary(t, tx, a))
    assert same(spark.sql("select * from source_summary"), C.source_summary(t, tx, a))
    assert same(spark.sql("select * from visited_locations"), T.locations(t))
    assert same(spark.sql("select * from monthly_km"), T.monthly_km(t))
    assert same(spark.sql("select * from telemetry_last_30d"), T.telemetry_last_30d(t, FX.AS_OF_EVENTS))
    assert spark.sql("select * from location_map").count() == t.where("latitude is not null and longitude is not null").count()
    want = tx.where("amount > 0 and date between '1996-01-01' and '1996-12-31'").groupBy("category").agg(F.sum("amount").alias("amount"), F.count("*").alias("items"))
    assert same(spark.sql("select * from spend_between(date '1996-01-01', date '1996-12-31')"), want) and want.count() > 0
    assert spark.sql("select * from snapshots_between(date '2024-01-02', date '2024-01-03')").count() == t.where("date between '2024-01-02' and '2024-01-03'").count() > 0
    assert spark.sql("select sum(stops) as n from watched_between(date '2024-01-01', date '2024-12-31')").first()["n"] > 0
    assert len(names) == len(set(names)) == 16


def test_checked_inserts_split_a_batch(spark):
    schema = "id string, v int, w string"
    table = KeyedTable(spark, tempfile.mkdtemp(prefix="keyed-", dir="/tmp") + "/t", spark.createDataFrame([], schema).schema, ["id"], 4)
    table.insert_checked(spark.createDataFrame([("a", 1, "x"), ("b", None, "x")], schema), ["v", "w"], batch_id="0")
    rows = [("a", 5, "y", 1), ("c", 6, "y", 2), ("c", 7, "y", 1), ("c", None, "y", 0), ("d", 1, None, 1), ("d", 2, "z", 3), (None, 1, "n", 1), (None, 2, "n", 2), ("e", 1, "s", 1), ("e", 1, "s", 1)]
    for _ in range(2):  # replayed: nothing changes
        table.insert_checked(spark.createDataFrame(rows, schema + ", o int").coalesce(1), ["v", "w"], ["o"], batch_id="1")
        assert sorted(map(str, (tuple(r) for r in table.read().collect()))) == sorted(map(str, [("a", 1, "x"), ("c", 7, "y"), ("d", 2, "z"), (None, 1, "n"), ("e", 1, "s")]))
        got = sorted(map(str, (tuple(r) for r in table.rejected().collect())))
        assert got == sorted(map(str, [
            (0, "b", None, "x", "not_null:v"), (1, "a", 5, "y", "primary_key"), (1, "c", 6, "y", "primary_key"), (1, "c", None, "y", "not_null:v"),
            (1, "d", 1, None, "not_null:w"), (1, None, 2, "n", "primary_key"), (1, "e", 1, "s", "primary_key")]))
    only_bad = spark.createDataFrame([("z", None, "q")], schema)
    assert table.insert_checked(only_bad, ["v"], batch_id="2") == 2 and table.rejected().where("commit = 2").count() == 1
    assert table.read().count() == 5 and table.insert_checked(only_bad.limit(0), ["v"]) is None
