"""Sinks and catalogue helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from almanac.operators import crosssource as C
from almanac.operators import telemetry as T
from almanac.operators.media import STOP
from almanac.sources import fixtures as FX


def json_ready(df: DataFrame) -> DataFrame:
    """Decimals as double, dates and timestamps as ISO text (the API's encoder)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, TY.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, TY.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (TY.TimestampType, TY.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row; a one-column result uses the
    ``{columns, rows, type}`` table shape instead (per row, so nothing is gathered)."""
    d = json_ready(df)
    if len(d.columns) > 1:
        return d.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in d.columns])).alias("json"))
    c = d.columns[0]
    doc = F.struct(F.array(F.struct(F.lit(c).alias("text"), F.lit("string").alias("type"))).alias("columns"),
                   F.array(F.array(F.col(f"`{c}`").cast("string"))).alias("rows"), F.lit("table").alias("type"))
    return d.select(F.to_json(doc).alias("json"))


def register_views(spark: SparkSession, sf_dir: str, names=None) -> list[str]:
    """(re)create temp views for the base tables; S13 is then ``spark.sql``."""
    names = names or ["telemetry", "telemetry_long", "transactions", "media_activity", "media_activity_long",
                      "media_library", "media_playback"]
    for n in names:
        FX.load(spark, sf_dir, n).createOrReplaceTempView(n)
    return names


#: Queries over a period, as SQL table functions of two days (both included).
PERIOD_FUNCTIONS = {
    "snapshots_between": "select * from telemetry where date between first and last",
    "spend_between": "select category, sum(amount) as amount, count(*) as items from transactions where amount > 0 and date between first and last group by category",
    "watched_between": "select user_name, item_name, count(*) as stops from media_activity "
                       f"where event_type = '{STOP}' and cast(timestamp as date) between first and last group by user_name, item_name",
}


def register_catalogue(spark: SparkSession, sf_dir: str, as_of) -> list[str]:
    """The base tables, the stored reports and the period functions, so that ``spark.sql`` answers what the
    dashboards ask. Reports are views over the tables registered before them, and are computed when asked."""
    tables = register_views(spark, sf_dir)
    t, tx, activity = (spark.table(n) for n in ("telemetry", "transactions", "media_activity"))
    reports = {
        "telemetry_last_30d": T.telemetry_last_30d(t, as_of), "source_summary": C.source_summary(t, tx, activity), "visited_locations": T.locations(t),
        "monthly_km": T.monthly_km(t), "monthly_summary": C.monthly_summary(t, tx, activity),
        "location_map": t.where("latitude is not null and longitude is not null").select(
            "latitude", "longitude", "address", "timestamp", F.col("battery_soc").alias("battery"), F.col("battery_range_km").alias("range_km")),
    }
    for name, report in reports.items():
        report.createOrReplaceTempView(name)
    for name, body in PERIOD_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}(first date, last date) returns table return {body}")
    return [*tables, *reports, *PERIOD_FUNCTIONS]


def sql(spark: SparkSession, query: str) -> DataFrame:
    """Ad-hoc read-only SQL over the registered catalogue."""
    return spark.sql(query)
