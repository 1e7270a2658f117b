"""Python's rounding, documents that can't be read, progress carried on, totals of the library."""

import math
import random

import pytest
from pyspark.sql import functions as F

from almanac.functions.numeric import py_round
from almanac.operators import media as M
from almanac.operators import subtitles as SB
from almanac.sources import ingest as I


@pytest.mark.parametrize("n", [0, 1, 2, 5, 15])
def test_py_round_is_pythons(spark, n):
    rng = random.Random(n)
    ties = [k / 2 / 10**n for k in range(-200, 200)] + [2.675, 1.005, 0.5, 2.5, -2.5, -0.001, 0.0, 5e-324, 1e-7, 11008.5 / 12.0 * 6.2]
    large = [rng.uniform(-1, 1) * 2.0 ** rng.randrange(30, 70) for _ in range(2000)] + [1e300, -1.7e308]
    values = ties + large + [rng.uniform(-1000, 1000) for _ in range(10_000)] + [round(rng.uniform(0, 10**6), 3) for _ in range(10_000)]
    values += [math.nextafter(v, s) for v in ties for s in (-math.inf, math.inf)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (math.inf,)], "v double")
    for r in df.select("v", py_round("v", n).alias("r")).collect():
        v = r["v"]
        assert r["r"] == (v if v is None or math.isinf(v) else round(v, n)), v
    with pytest.raises(ValueError):
        py_round("v", 16)


def test_documents_are_read_or_rejected(spark):
    good = '{"latitude": 1.5, "longitude": 2, "items": [{"code": "2013021", "value": "50"}]}'
    docs = [good, '{"latitude": 1.5', '{"latitude": "far", "items": []}', "[]", "7", "", None, "{}", '{"items": null, "more": 1}']
    df = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "entity_id long, raw_json string").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp_ntz"))
    read = {r["entity_id"]: r["battery_soc"] for r in I.ingest_telemetry(df).collect()}
    left = I.unreadable_documents(df, "raw_json", I.TELEMETRY_DOC)
    assert left.columns == df.columns
    assert set(read) == {0, 7, 8} and read[0] == 50 and sorted(r["entity_id"] for r in left.collect()) == [1, 2, 3, 4, 5, 6]
    pages = spark.createDataFrame([('{"Items": [{"Id": 4, "Type": "VideoPlayback", "Name": "x"}]}',), ('{"Items": [{"Id": 4, "Type": "Video',)], "page_json string")
    assert [r["id"] for r in I.ingest_activity(pages).collect()] == [4] and I.unreadable_documents(pages, "page_json", I.ACTIVITY_PAGE).count() == 1
    for schema in (I.TELEMETRY_DOC, I.LIBRARY_PAGE, I.ACTIVITY_PAGE, I.FORECAST_DOC):
        assert I.unreadable_documents(df, "raw_json", schema).where("entity_id in (1, 3, 4, 5, 6)").count() == 5


def test_progress_carries_on(spark):
    blocks = spark.createDataFrame([("f", p) for p in range(7)] + [("g", 0)], "file string, pos int")
    schema = "file string, pos int, batch int, batch_text string, used_retry boolean, used_fallback boolean"
    row = lambda p, text, retry=False, fallback=False, f="f": (f, p, p // 2, text, retry, fallback)
    get = lambda df: {r["file"]: tuple(r)[1:] for r in df.collect()}
    # Batch 1 failed (both blocks by retry), batch 2 is missing, batch 3 ran ahead of the gap.
    first = SB.translation_checkpoint(blocks, spark.createDataFrame([row(0, "a"), row(0, "a"), row(1, "b"), row(2, None, True), row(3, None, True), row(6, None, False, True)], schema))
    assert get(first) == {"f": (4, 7, 1, 2, 0, None), "g": (0, 1, 0, 0, 0, None)}
    second = SB.translation_checkpoint(blocks, spark.createDataFrame([row(4, "c"), row(5, "", False, True), row(6, None, False, True), row(0, "a", f="g")], schema), first)
    assert get(second) == {"f": (7, 7, 2, 2, 2, "done"), "g": (1, 1, 0, 0, 0, "done")}
    idle = SB.translation_checkpoint(blocks, spark.createDataFrame([], schema), second)
    assert get(idle) == get(second)


def test_library_totals_by_type(spark):
    df = spark.createDataFrame([("Movie", "1.25"), ("Movie", None), (None, "2.00")], "item_type string, s string").withColumn("file_size_gb", F.col("s").cast("decimal(8,2)"))
    assert {tuple(r) for r in M.library_totals(df).collect()} == {("Movie", False, 2, 1.25), (None, False, 1, 2.0), (None, True, 3, 3.25)}
