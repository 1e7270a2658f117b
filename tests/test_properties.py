"""
up to the total, sessions never overlap (see test_golden)."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almanac.functions.dates import DateRange
from almanac.operators import merge as MG
from almanac.operators import transactions as X

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

rows_st = st.lists(st.tuples(st.sampled_from("abcdef"), st.integers(0, 9), st.integers(1, 3)), min_size=0, max_size=12)


@SETTINGS
@given(target=st.lists(st.tuples(st.sampled_from("abcdef"), st.integers(0, 9)), max_size=6, unique_by=lambda r: r[0]), batch=rows_st)
def test_merges_are_idempotent(spark, target, batch):
    t = spark.createDataFrame(target, "k string, v int")
    b = spark.createDataFrame(batch, "k string, v int, seq int")
    for merge in (lambda x: MG.insert_or_ignore(x, b, ["k"], "seq"),
                  lambda x: MG.insert_or_replace(x, b, ["k"], "seq", refresh_col=None)):
        once = sorted(map(tuple, merge(t).collect()))
        twice = sorted(map(tuple, merge(spark.createDataFrame(once, t.schema)).collect()))
        assert once == twice
        assert len({r[0] for r in once}) == len(once)  # keys stay unique


tx_st = st.lists(st.tuples(st.integers(0, 27), st.sampled_from(["food", "rent", "fun", None]),
                           st.integers(-50000, 50000)), min_size=1, max_size=25)


@SETTINGS
@given(rows=tx_st)
def test_category_spend_adds_up(spark, rows):
    base = dt.date(2024, 2, 1)
    data = [(str(i), base + dt.timedelta(days=d), dt.datetime.combine(base + dt.timedelta(days=d), dt.time()),
             Decimal(a).scaleb(-2), c) for i, (d, c, a) in enumerate(rows)]
    tx = spark.createDataFrame(data, "id string, date date, timestamp timestamp_ntz, amount decimal(12,2), category string")
    rng = DateRange.of("2024-02-01", "2024-03-01", "half_open")
    total = X.spend_total(tx, rng).collect()[0]["spend"]
    cats = X.spend_by_category(tx, rng, n=10).agg(F.coalesce(F.sum("amount"), F.lit(0.0))).collect()[0][0]
    assert abs(total - cats) < 1e-6
    days = X.spend_by_day(tx, rng).agg(F.coalesce(F.sum("total"), F.lit(0.0))).collect()[0][0]
    assert abs(total - days) < 1e-6
