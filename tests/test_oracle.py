"""Every registered query against its DuckDB oracle (rows, columns, values)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_ORACLE
from tools.oracle_check import compare, from_duck, from_spark

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_oracle(spark, duck, key):
    s = from_spark(QUERIES[key](spark, SF_ORACLE))
    d = from_duck(duck, ORACLE[key])
    status, msg = compare(s, d)
    assert status == "OK", f"{key}: {status} {msg}"


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLE)))
def test_non_sql_queries_run(spark, key):
    df = QUERIES[key](spark, SF_ORACLE)
    assert df.count() >= 0


def test_every_query_has_stable_schema(spark):
    for key, fn in QUERIES.items():
        a = fn(spark, SF_ORACLE).schema.simpleString()
        b = fn(spark, SF_ORACLE).schema.simpleString()
        assert a == b, key


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["month", "km", "places", "spend", "titles"]


TIME_SENSITIVE = ["battery_history", "snapshot_log", "telemetry_last_30d", "new_locations", "watched_list", "top_expenses",
                  "consumption_30d", "watch_sessions", "monthly_summary", "tx_weekly", "insert_or_replace"]


def test_results_do_not_depend_on_time_zones(spark, duck):
    """Wall-clock (NTZ) data: neither the session zone nor the Python process zone
    may shift a window bound."""
    import os
    import time

    old_tz, old_session = os.environ.get("TZ"), spark.conf.get("spark.sql.session.timeZone")
    os.environ["TZ"] = "America/Sao_Paulo"
    time.tzset()
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        for key in TIME_SENSITIVE:
            status, msg = compare(from_spark(QUERIES[key](spark, SF_ORACLE)), from_duck(duck, ORACLE[key]))
            assert status == "OK", f"{key}: {status} {msg}"
    finally:
        if old_tz is None:
            os.environ.pop("TZ", None)
        else:
            os.environ["TZ"] = old_tz
        time.tzset()
        spark.conf.set("spark.sql.session.timeZone", old_session)


DUCK_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
             "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_column_types_match_oracle(spark, duck, key):
    spark_types = {f.name: f.dataType.simpleString() for f in QUERIES[key](spark, SF_ORACLE).schema.fields}
    duck_types = {c[0]: str(c[1]) for c in duck.execute(f"describe {ORACLE[key]}").fetchall()}
    for col, t in spark_types.items():
        expected = t.upper() if t.startswith("decimal") else DUCK_TYPE.get(t, t)
        assert duck_types.get(col) == expected, f"{key}.{col}: spark {t} / oracle {duck_types.get(col)}"
