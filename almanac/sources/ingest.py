"""Landed JSON -> typed rows (S1-S6). Explicit schemas, no inference; parsing is
``from_json`` + higher-order functions, so it runs in the JVM on every executor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.dates import recent_window
from almanac.functions.numeric import py_round, py_round0
from almanac.functions.sensors import sensor_bool, sensor_double, sensor_fallback

def _parsed(df: DataFrame, json_col: str, schema: str) -> DataFrame:
    """``_d``: the document under ``schema``; ``_bad``: it is missing, no JSON object, or a field has another type.
    One parse gives both."""
    d = F.from_json(F.col(json_col), schema[:-1] + ", _unread: string>", {"columnNameOfCorruptRecord": "_unread"})
    return df.withColumn("_d", d).withColumn("_bad", F.col("_d").isNull() | F.col("_d._unread").isNotNull())


def unreadable_documents(docs: DataFrame, json_col: str, schema: str) -> DataFrame:
    """The rows of ``docs`` that the ingest of ``schema`` (``TELEMETRY_DOC``, ``LIBRARY_PAGE``, ``ACTIVITY_PAGE``,
    ``FORECAST_DOC``) leaves out, as landed: what it reads and these are all that landed."""
    return _parsed(docs, json_col, schema).filter("_bad").drop("_d", "_bad")


TELEMETRY_DOC = "struct<latitude: double, longitude: double, items: array<struct<code: string, value: string>>>"

# Sensor codes of the status document (column -> code).
SENSOR_CODES = {
    "battery_soc": "2013021", "battery_range_km": "2011501",
    "odometer_primary": "2103010", "odometer_fallback": "2042082",
    "is_locked": "2310001", "is_charging": "2013023", "is_ac_on": "2078020",
    "tire_fl_pressure": "2101001", "tire_fr_pressure": "2101002", "tire_rl_pressure": "2101003", "tire_rr_pressure": "2101004",
    "tire_fl_temp": "2101005", "tire_fr_temp": "2101006", "tire_rl_temp": "2101007", "tire_rr_temp": "2101008",
    "charging_time_min": "2013022",
}
# The value that means "true" for boolean sensors.
BOOL_TRUE = {"is_locked": "1", "is_charging": "5", "is_ac_on": "1"}


def ingest_telemetry(raw: DataFrame, json_col: str = "raw_json") -> DataFrame:
    """Status documents -> telemetry rows (entity_id and landing timestamp kept). Documents that can't be
    read go to ``unreadable_documents``."""
    x = _parsed(raw, json_col, TELEMETRY_DOC).filter("not _bad")
    items = F.col("_d.items")
    odo = sensor_fallback(sensor_double(items, SENSOR_CODES["odometer_primary"]), sensor_double(items, SENSOR_CODES["odometer_fallback"]))
    cols = [
        F.col("entity_id"), F.col("timestamp"), F.col("timestamp").cast("date").alias("date"),
        sensor_double(items, SENSOR_CODES["battery_soc"]).try_cast("decimal(5,2)").alias("battery_soc"),
        sensor_double(items, SENSOR_CODES["battery_range_km"]).try_cast("decimal(6,2)").alias("battery_range_km"),
        odo.try_cast("decimal(10,2)").alias("odometer_km"),
        F.col("_d.latitude").try_cast("decimal(10,7)").alias("latitude"),
        F.col("_d.longitude").try_cast("decimal(10,7)").alias("longitude"),
        F.lit(None).cast("string").alias("address"),
    ]
    cols += [sensor_bool(items, SENSOR_CODES[c], BOOL_TRUE[c]).alias(c) for c in ("is_locked", "is_charging", "is_ac_on")]
    cols += [sensor_double(items, SENSOR_CODES[c]).alias(c) for c in (
        "tire_fl_pressure", "tire_fr_pressure", "tire_rl_pressure", "tire_rr_pressure",
        "tire_fl_temp", "tire_fr_temp", "tire_rl_temp", "tire_rr_temp", "charging_time_min")]
    cols += [F.col(json_col).alias("raw_json")]
    return x.select(*cols)


TX_PAGE = ("struct<page: int, hasNextPage: boolean, results: array<struct<id: string, date: string, amount: string, "
           "category: string, description: string, merchant: struct<name: string>>>>")
# Category label for uncategorised transactions.
DEFAULT_CATEGORY = "Outros"


def _iso_ts(s: Column) -> Column:
    """ISO text cut to 19 characters -> TIMESTAMP_NTZ (wall clock, as landed); NULL if unreadable."""
    return F.regexp_replace(F.substring(s, 1, 19), "T", " ").try_cast("timestamp_ntz")


def _iso_date(s: Column) -> Column:
    """The first 10 characters as a DATE; NULL if unreadable."""
    return F.substring(s, 1, 10).try_cast("date")


def _page_transactions(pages: DataFrame, json_col: str) -> DataFrame:
    """Records with an id and a date, with ``_problem``: what can't be read, else NULL."""
    r = pages.select(F.explode(F.from_json(F.col(json_col), TX_PAGE)["results"]).alias("r")).select("r.*")
    r = r.filter(F.col("id").isNotNull() & (F.col("id") != "") & F.col("date").isNotNull() & (F.col("date") != ""))
    fits = F.col("amount").try_cast("decimal(12,2)").isNotNull()
    return r.withColumn("_problem", F.when(_iso_date(F.col("date")).isNull(), F.lit("date"))
                        .when(F.col("amount").isNotNull() & ~fits, F.lit("amount")))


def unreadable_transactions(pages: DataFrame, account_type: str, json_col: str = "page_json") -> DataFrame:
    """The records that ``ingest_transactions`` leaves out because their date can't be read or their
    amount is no number or too large for the ledger: id, date and amount as landed, problem."""
    r = _page_transactions(pages, json_col).filter(F.col("_problem").isNotNull())
    return r.select("id", "date", "amount", F.col("_problem").alias("problem"), F.lit(account_type).alias("account_type"))


def ingest_transactions(pages: DataFrame, account_type: str, json_col: str = "page_json",
                        as_of=None, lookback_days: int | None = None) -> DataFrame:
    """Transaction pages -> rows. Missing id or date drops the row; blank category
    -> default label; merchant = description, else the nested merchant name; an absent amount
    is 0. Records that can't be read go to ``unreadable_transactions``. Optional look-back window
    relative to ``as_of``."""
    r = _page_transactions(pages, json_col).filter(F.col("_problem").isNull())
    out = r.select(
        F.col("id"), _iso_date(F.col("date")).alias("date"), _iso_ts(F.col("date")).alias("timestamp"),
        F.coalesce(F.col("amount").try_cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)")).alias("amount"),
        F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("merchant.name"), F.lit("")).alias("merchant"),
        F.coalesce(F.col("description"), F.lit("")).alias("description"),
        F.lit(account_type).alias("account_type"),
    )
    if lookback_days is not None:
        out = out.filter(recent_window("date", as_of, lookback_days))
    return out


def merge_feeds(*feeds: DataFrame) -> DataFrame:
    """U4: concatenate tagged feeds (same schema by name)."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f)
    return out


LIBRARY_PAGE = (
    "struct<Items: array<struct<Id: string, Name: string, ProductionYear: int, CommunityRating: double, OfficialRating: string, "
    "Genres: array<string>, RunTimeTicks: bigint, Studios: array<struct<Name: string>>, Overview: string, DateCreated: string, "
    "PremiereDate: string, SeriesName: string, SeasonName: string, IndexNumber: int, MediaSources: array<struct<Size: bigint, "
    "Container: string, MediaStreams: array<struct<Type: string, Codec: string, Width: int, Height: int>>>>>>>"
)
TICKS_PER_MINUTE = 600000000


def ingest_media_library(pages: DataFrame, item_type: str, json_col: str = "page_json") -> DataFrame:
    """S3: media item pages -> library rows (20 columns). Pages that can't be read go to ``unreadable_documents``."""
    it = _parsed(pages, json_col, LIBRARY_PAGE).filter("not _bad").select(F.explode("_d.Items").alias("i")).select("i.*")
    ms0 = F.get(F.col("MediaSources"), 0)
    streams = F.coalesce(ms0["MediaStreams"], F.array())
    vids = F.filter(streams, lambda s: s["Type"] == F.lit("Video"))
    good = F.filter(vids, lambda s: F.coalesce(s["Codec"], F.lit("")) != F.lit(""))
    vid = F.coalesce(F.get(good, 0), F.get(vids, F.size(vids) - 1))
    aud = F.get(F.filter(streams, lambda s: (s["Type"] == F.lit("Audio")) & (F.coalesce(s["Codec"], F.lit("")) != F.lit(""))), 0)
    w, h = F.coalesce(vid["Width"], F.lit(0)), F.coalesce(vid["Height"], F.lit(0))
    ticks = F.coalesce(F.col("RunTimeTicks"), F.lit(0))
    has_ms = F.size(F.coalesce(F.col("MediaSources"), F.array())) > 0
    return it.select(
        F.coalesce(F.col("Id"), F.lit("")).alias("id"), F.coalesce(F.col("Name"), F.lit("")).alias("name"),
        F.lit(item_type).alias("item_type"), F.col("ProductionYear").alias("production_year"),
        F.col("CommunityRating").try_cast("decimal(4,2)").alias("community_rating"), F.col("OfficialRating").alias("official_rating"),
        F.array_join(F.coalesce(F.col("Genres"), F.array()), ",").alias("genres"),
        F.when(ticks != 0, py_round0(ticks / F.lit(TICKS_PER_MINUTE)).cast("int")).alias("runtime_minutes"),
        F.array_join(F.transform(F.coalesce(F.col("Studios"), F.array()), lambda s: F.coalesce(s["Name"], F.lit(""))), ",").alias("studios"),
        F.coalesce(F.col("Overview"), F.lit("")).alias("overview"),
        F.when(F.coalesce(F.col("DateCreated"), F.lit("")) != "", _iso_ts(F.col("DateCreated"))).alias("date_created"),
        F.when(F.coalesce(F.col("PremiereDate"), F.lit("")) != "", _iso_date(F.col("PremiereDate"))).alias("premiere_date"),
        F.col("SeriesName").alias("series_name"), F.col("SeasonName").alias("season_name"), F.col("IndexNumber").alias("episode_index"),
        F.when(has_ms, py_round(F.coalesce(ms0["Size"], F.lit(0)).cast("double") / F.lit(1e9), 2).try_cast("decimal(8,2)")).alias("file_size_gb"),
        F.when(has_ms, ms0["Container"]).alias("container"),
        vid["Codec"].alias("video_codec"), aud["Codec"].alias("audio_codec"),
        F.when((w != 0) & (h != 0), F.concat(w.cast("string"), F.lit("x"), h.cast("string"))).alias("resolution"),
    )


PLAYBACK_DOC = "array<struct<user_name: string, user_usage: map<string, string>>>"
# Header pseudo-user of the usage report.
PLAYBACK_HEADER_USER = "labels_user"


def _usage_entries(docs: DataFrame, json_col: str) -> DataFrame:
    """(user_name, d, m, date, minutes, _problem) of each landed entry."""
    u = docs.select(F.explode(F.from_json(F.col(json_col), PLAYBACK_DOC)).alias("u")).select("u.*")
    u = u.filter(F.coalesce(F.col("user_name"), F.lit("")) != F.lit(PLAYBACK_HEADER_USER))
    e = u.select(F.coalesce(F.col("user_name"), F.lit("")).alias("user_name"), F.explode("user_usage").alias("d", "m"))
    e = e.withColumn("date", F.col("d").try_cast("date")).withColumn("minutes", F.col("m").try_cast("int"))
    return e.withColumn("_problem", F.when(F.col("date").isNull(), F.lit("date")).when(F.col("minutes").isNull(), F.lit("minutes")))


def unreadable_playback(docs: DataFrame, json_col: str = "usage_json") -> DataFrame:
    """The entries that ``ingest_playback`` leaves out because their day or their minutes can't be read:
    user_name, date and minutes as landed, problem."""
    e = _usage_entries(docs, json_col).filter(F.col("_problem").isNotNull())
    return e.select("user_name", F.col("d").alias("date"), F.col("m").alias("minutes"), F.col("_problem").alias("problem"))


def ingest_playback(docs: DataFrame, json_col: str = "usage_json") -> DataFrame:
    """Per-user {date: minutes} maps -> (user_name, date, minutes_watched), minutes > 0. Entries
    that can't be read go to ``unreadable_playback``."""
    e = _usage_entries(docs, json_col).filter(F.col("_problem").isNull() & (F.col("minutes") > 0))
    return e.select("user_name", "date", F.col("minutes").alias("minutes_watched"))


ACTIVITY_PAGE = "struct<Items: array<struct<Id: bigint, Type: string, Name: string, UserId: string, Date: string, Severity: string>>>"
# Activity name patterns (play, stop); lazy groups user / item / device.
PLAY_PATTERN = r"^(.+?) está reproduzindo (.+?) em (.+)$"
STOP_PATTERN = r"^(.+?) parou de reproduzir (.+?) em (.+)$"


def ingest_activity(pages: DataFrame, json_col: str = "page_json") -> DataFrame:
    """Activity log pages -> playback events with user / item / device parsed
    from the entry name (first matching pattern; no match -> NULLs). Pages that can't be read go to ``unreadable_documents``."""
    it = _parsed(pages, json_col, ACTIVITY_PAGE).filter("not _bad").select(F.explode("_d.Items").alias("i")).select("i.*")
    it = it.filter(F.col("Type").contains("Playback"))
    name = F.coalesce(F.col("Name"), F.lit(""))

    def part(g: int) -> Column:
        a = F.nullif(F.regexp_extract(name, PLAY_PATTERN, g), F.lit(""))
        b = F.nullif(F.regexp_extract(name, STOP_PATTERN, g), F.lit(""))
        return F.when(name.rlike(PLAY_PATTERN), a).otherwise(b)

    return it.select(
        F.coalesce(F.col("Id"), F.lit(0)).alias("id"), F.col("Type").alias("event_type"),
        part(1).alias("user_name"), F.coalesce(F.col("UserId"), F.lit("")).alias("user_id"),
        part(2).alias("item_name"), part(3).alias("device"),
        _iso_ts(F.col("Date")).alias("timestamp"), F.coalesce(F.col("Severity"), F.lit("")).alias("severity"),
        name.alias("raw_name"),
    )


FORECAST_DOC = (
    "struct<current_condition: array<struct<temp_C: string, FeelsLikeC: string, humidity: string, "
    "lang_pt: array<struct<value: string>>, weatherDesc: array<struct<value: string>>>>, "
    "weather: array<struct<maxtempC: string, mintempC: string, uvIndex: string, "
    "hourly: array<struct<time: string, chanceofrain: string>>>>>"
)
RAIN_CHANCE_MIN = 40
RAIN_HOURS = (6, 22)


def ingest_weather(docs: DataFrame, json_col: str = "forecast_json") -> DataFrame:
    """Forecast document -> current conditions (text, '?' when absent), today's
    extremes and rain hours: (hour = time // 100, chance) with chance >= 40 and
    6 <= hour <= 22, in forecast order. Documents that can't be read go to ``unreadable_documents``."""
    x = _parsed(docs, json_col, FORECAST_DOC).filter("not _bad").withColumnRenamed("_d", "_f")
    cur = F.get(F.col("_f.current_condition"), 0)
    today = F.get(F.col("_f.weather"), 0)
    hourly = F.coalesce(today["hourly"], F.array())
    pairs = F.transform(hourly, lambda h: F.struct(
        F.floor(F.coalesce(h["time"], F.lit("0")).try_cast("int") / 100).cast("int").alias("hour"),
        F.coalesce(h["chanceofrain"], F.lit("0")).try_cast("int").alias("chance")))
    rain = F.filter(pairs, lambda p: (p["chance"] >= RAIN_CHANCE_MIN) & (p["hour"] >= RAIN_HOURS[0]) & (p["hour"] <= RAIN_HOURS[1]))
    desc = F.coalesce(F.get(cur["lang_pt"], 0)["value"], F.get(cur["weatherDesc"], 0)["value"], F.lit("?"))

    def txt(c):
        return F.coalesce(c, F.lit("?"))

    keep = [c for c in docs.columns if c != json_col]
    return x.select(
        *keep, txt(cur["temp_C"]).alias("temp"), txt(cur["FeelsLikeC"]).alias("feels_like"), txt(cur["humidity"]).alias("humidity"),
        desc.alias("description"), txt(today["maxtempC"]).alias("max"), txt(today["mintempC"]).alias("min"),
        txt(today["uvIndex"]).alias("uv"), rain.alias("rain_hours"), F.get(rain, 0)["hour"].alias("first_rain_hour"))


def credit_utilisation(accounts: DataFrame, json_col: str = "account_json") -> DataFrame:
    """abs(balance) / limit * 100, 0 when the limit is 0."""
    a = accounts.withColumn("_a", F.from_json(F.col(json_col), "struct<balance: double, creditData: struct<limit: double>>"))
    lim = F.coalesce(F.col("_a.creditData.limit"), F.lit(0.0))
    used = F.abs(F.coalesce(F.col("_a.balance"), F.lit(0.0)))
    keep = [c for c in accounts.columns if c != json_col]
    return a.select(*keep, lim.alias("limit"), used.alias("used"),
                    F.when(lim != 0, used / lim * 100).otherwise(F.lit(0.0)).alias("utilisation_pct"))
