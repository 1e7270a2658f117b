"""Typed base tables derived from the raw parquet tables.

Each view is a projection (one join for ``transactions``, one aggregate for
``media_playback``) written once as SQL expressions; the Spark side evaluates them
with ``selectExpr`` and the DuckDB oracle inlines the same text as a CTE, so both
engines see the same rows. Two expressions differ by dialect (interval and date
arithmetic) and are overridden per dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.sources.tables import table

# as_of dates of the fixtures (max date in the data at every scale).
AS_OF_EVENTS = "2024-01-30"
AS_OF_LONG = "2001-08-01"

_GRID_LAT = "cast(cast(-280000+({k}%20)*100+{i}%7 as double)/10000 as decimal(10,7))"
_GRID_LON = "cast(cast(-490000+({k}%20)*100 as double)/10000 as decimal(10,7))"
_ADDRESS = "concat('Street ',cast({k}%20 as string),', Block, City ',cast({k}%5 as string))"

FIXTURES: dict[str, dict] = {
    "telemetry": {
        "from": "events",
        "exprs": [
            "user_id as entity_id", "ts as timestamp", "cast(ts as date) as date",
            "cast(cast((event_id*7919)%10001 as double)/100 as decimal(5,2)) as battery_soc",
            "cast(cast(((event_id*7919)%10001)*3 as double)/100 as decimal(6,2)) as battery_range_km",
            "cast(cast(10000+event_id*5 as double)/10 as decimal(10,2)) as odometer_km",
            f"case when event_id%13=0 then null else {_GRID_LAT.format(k='user_id', i='event_id')} end as latitude",
            f"case when event_id%13=0 then null else {_GRID_LON.format(k='user_id')} end as longitude",
            f"case when event_id%13=0 then null else {_ADDRESS.format(k='user_id')} end as address",
            "event_id%3<>0 as is_locked", "event_type='purchase' as is_charging", "event_id%5=0 as is_ac_on",
            "cast(190+event_id%90 as double) as tire_fl_pressure", "cast(190+event_id%91 as double) as tire_fr_pressure",
            "cast(190+event_id%92 as double) as tire_rl_pressure", "cast(190+event_id%93 as double) as tire_rr_pressure",
            "cast(event_id%50 as double) as tire_fl_temp", "cast(event_id%51 as double) as tire_fr_temp",
            "cast(event_id%52 as double) as tire_rl_temp", "cast(event_id%53 as double) as tire_rr_temp",
            "cast(event_id%240 as double) as charging_time_min",
        ],
    },
    "telemetry_long": {
        "from": "orders",
        "exprs": [
            "o_custkey%10 as entity_id",
            "o_orderdate + make_dt_interval(0,0,0,o_orderkey%86400) as timestamp",
            "cast(o_orderdate as date) as date",
            "cast(cast((o_orderkey*7919)%10001 as double)/100 as decimal(5,2)) as battery_soc",
            "cast(cast(((o_orderkey*7919)%10001)*3 as double)/100 as decimal(6,2)) as battery_range_km",
            "cast(cast(datediff(cast(o_orderdate as date), date '1995-01-01')*400 + o_orderkey%400 as double)/10 as decimal(10,2)) as odometer_km",
            f"case when o_orderkey%13=0 then null else {_GRID_LAT.format(k='o_custkey', i='o_orderkey')} end as latitude",
            f"case when o_orderkey%13=0 then null else {_GRID_LON.format(k='o_custkey')} end as longitude",
            f"case when o_orderkey%13=0 then null else {_ADDRESS.format(k='o_custkey')} end as address",
        ],
        "duckdb": {
            1: "o_orderdate + to_seconds(o_orderkey%86400) as timestamp",
            5: "cast(cast((cast(o_orderdate as date) - date '1995-01-01')*400 + o_orderkey%400 as double)/10 as decimal(10,2)) as odometer_km",
        },
    },
    "transactions": {
        "from": "orders join customer on o_custkey=c_custkey",
        "exprs": [
            "cast(o_orderkey as string) as id", "cast(o_orderdate as date) as date", "o_orderdate as timestamp",
            "cast(case when o_orderstatus='F' then -o_totalprice else o_totalprice end as decimal(12,2)) as amount",
            "o_orderpriority as category",
            "case when c_nationkey=0 then null when c_nationkey=1 then '' else c_name end as merchant",
            "concat('order ',cast(o_orderkey as string)) as description",
            "case when o_orderkey%2=0 then 'credit_card' else 'checking_account' end as account_type",
        ],
    },
    "media_activity": {
        "from": "events",
        "exprs": [
            "event_id as id",
            "case event_type when 'view' then 'VideoPlayback' when 'click' then 'VideoPlaybackStopped' else event_type end as event_type",
            "concat('user',cast(user_id as string)) as user_name",
            "concat('title',cast(event_id%3 as string)) as item_name",
            "concat('device',cast(user_id%4 as string)) as device", "ts as timestamp",
        ],
    },
    "media_activity_long": {
        "from": "events",
        "exprs": [
            "event_id as id",
            "case event_type when 'view' then 'VideoPlayback' when 'click' then 'VideoPlaybackStopped' else event_type end as event_type",
            "concat('user',cast(user_id as string)) as user_name",
            "concat('title',cast(event_id%3 as string)) as item_name",
            "concat('device',cast(user_id%4 as string)) as device",
            "cast(date_add(date '1995-01-01', cast((event_id*7919)%2400 as int)) as timestamp_ntz) as timestamp",
        ],
        "duckdb": {5: "cast(date '1995-01-01' + cast((event_id*7919)%2400 as int) as timestamp) as timestamp"},
    },
    "media_library": {
        "from": "part",
        "exprs": [
            "cast(p_partkey as string) as id", "concat('title',cast(p_partkey as string)) as name", "p_type as item_type",
            "1950+p_size as production_year",
            "cast(cast(p_partkey%101 as double)/10 as decimal(4,2)) as community_rating",
            "case when p_partkey%17=0 then '' when p_partkey%19=0 then null else replace(p_name,' ',',') end as genres",
            "p_size*3 as runtime_minutes",
            "cast(cast(p_partkey*37%5000 as double)/100 as decimal(8,2)) as file_size_gb",
        ],
    },
    "telemetry_raw": {
        "from": "events",
        "exprs": [
            "user_id as entity_id", "ts as timestamp",
            "concat('{\"latitude\":',cast(user_id%20 as string),'.5,\"longitude\":',cast(user_id%30 as string),'.25,\"items\":[',"
            "'{\"code\":\"2013021\",\"value\":\"',case when event_id%11=0 then '' when event_id%23=0 then 'n/a' else cast((event_id*7919)%101 as string) end,'\"},',"
            "'{\"code\":\"2103010\",\"value\":\"',case when event_id%7=0 then '0' else cast(1000+event_id as string) end,'\"},',"
            "'{\"code\":\"2042082\",\"value\":\"',cast(2000+event_id as string),'\"},',"
            "case when event_id%5=0 then '' else concat('{\"code\":\"2310001\",\"value\":\"',cast(event_id%2 as string),'\"},') end,"
            "'{\"code\":\"2013023\",\"value\":\"',case when event_type='purchase' then '5' else '0' end,'\"}]}') as raw_json",
        ],
    },
    "notification_raw": {
        "from": "events",
        "exprs": [
            "event_id", "ts as timestamp",
            "case event_id%6 "
            "when 0 then concat('{\"title\":\"t\",\"username\":\" @User',cast(user_id as string),' \",\"tag\":\"media\"}') "
            "when 1 then concat('{\"requester\":\"{{requester}}\",\"request\":{\"requestedBy\":{\"username\":\"user',cast(user_id as string),'\"}}}') "
            "when 2 then concat('{\"message\":\"Requested by @user',cast(user_id as string),' today\",\"event\":\"',event_type,'\"}') "
            "when 3 then concat('{\"user\":[{\"name\":\"\"},{\"displayName\":\"user',cast(user_id as string),'\"}]}') "
            "when 4 then '{\"subject\":\"no requester\",\"media_type\":\"movie\"}' "
            "else '{\"title\":\"{{notification_type}}\"}' end as payload",
        ],
    },
    "file_inventory": {
        "from": "part",
        "exprs": [
            "concat(case when p_partkey%29=0 then 'lib/.hidden' else 'lib/f' end, cast(p_partkey as string),"
            " case p_partkey%5 when 0 then '.mkv' when 1 then '.MP4' when 2 then '.srt' when 3 then '.avi' else '.oc-tmp.mkv' end) as path",
            "p_partkey*1000003 as size", "p_size as age_hours",
            "case when p_partkey%3=0 then 'hevc' else 'h264' end as codec",
        ],
    },
    "job_log": {
        "from": "events",
        "exprs": [
            "event_type as job", "user_id as run_id", "event_id as line_no",
            "case when event_id%9=0 then concat('Error: code ',cast(event_id%100 as string)) else concat('step ',cast(event_id as string)) end as line",
        ],
    },
}


def fixture_exprs(name: str, dialect: str = "spark") -> list[str]:
    spec = FIXTURES[name]
    exprs = list(spec["exprs"])
    for i, e in spec.get(dialect, {}).items():
        exprs[i] = e
    return exprs


def fixture_sql(name: str, dialect: str = "duckdb") -> str:
    """The view as a SELECT statement (used to inline it into oracle SQL)."""
    if name == "media_playback":
        day = "cast(ts as date)"
        return (
            f"select concat('user',cast(user_id as string)) as user_name, {day} as date, "
            f"cast(count(*)*15 as int) as minutes_watched from events group by user_id, {day}"
        )
    spec = FIXTURES[name]
    return f"select {', '.join(fixture_exprs(name, dialect))} from {spec['from']}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived view as a lazy DataFrame over the raw parquet tables."""
    if name == "media_playback":
        ev = table(spark, sf_dir, "events")
        return ev.groupBy(F.col("user_id"), F.col("ts").cast("date").alias("date")).agg(
            (F.count(F.lit(1)) * 15).cast("int").alias("minutes_watched")
        ).select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user_name"), "date", "minutes_watched")
    spec = FIXTURES[name]
    if name == "transactions":
        orders = table(spark, sf_dir, "orders")
        customer = table(spark, sf_dir, "customer")
        src = orders.join(customer, orders.o_custkey == customer.c_custkey)
    else:
        src = table(spark, sf_dir, spec["from"])
    return src.selectExpr(*fixture_exprs(name, "spark"))
