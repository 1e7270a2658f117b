"""Telemetry snapshots: current state, daily/weekly/monthly summaries, consumption,
location grids and cost estimates.

Every operator groups by ``entity_id`` as well: the reference tracks one vehicle,
so with one entity the results are identical, and with many the windows partition
by entity instead of collapsing into one task.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.dates import DateRange, as_date, month_key, ntz, recent_window, weekday_sun0
from almanac.functions.numeric import avg_exact, round_half_away
from almanac.operators.common import flag_to_int, latest_per, threshold_band, top_n_per, value_label_map

E = "entity_id"

# Energy and fuel constants of the cost estimate.
EV_KM_PER_KWH = 6.3
PRICE_PER_KWH = 0.80
FUEL_PRICE_PER_L = 6.20
FUEL_KM_PER_L = 12.0

# Weekday labels, Sunday first (weekday_no 0..6).
WEEKDAYS_PT = ["Domingo", "Segunda", "Terça", "Quarta", "Quinta", "Sexta", "Sábado"]

# Status texts and dashboard value mappings / threshold steps.
LOCKED_TEXT, UNLOCKED_TEXT = "🔒 Trancado", "🔓 Aberto"
CHARGING_TEXT, NOT_CHARGING_TEXT = "⚡ Carregando", "🔋 Normal"
LOCK_VALUE_MAP = {0: "🔓 Destravado", 1: "🔒 Travado"}
LOCK_COLOR_MAP = {0: "red", 1: "green"}
SOC_STEPS = [(None, "red"), (20, "orange"), (50, "yellow"), (80, "green")]
PRESSURE_STEPS = [(None, "red"), (200, "orange"), (220, "green"), (250, "orange"), (270, "red")]
TYRE_TEMP_STEPS = [(None, "blue"), (20, "green"), (35, "orange"), (45, "red")]
SNAPSHOT_LOCK_ICONS = ("🔒", "🔓")
SNAPSHOT_CHARGE_ICONS = ("⚡", "—")


def _dbl(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _km(col: str = "odometer_km") -> Column:
    return F.max(col) - F.min(col)


def _r_dec(c, n) -> Column:
    """ROUND on a DECIMAL (exact, half away from zero), as double."""
    return F.round(F.col(c) if isinstance(c, str) else c, n).cast("double")


# ---------------------------------------------------------------- current row

def telemetry_current(t: DataFrame) -> DataFrame:
    """Latest snapshot per entity (no global sort)."""
    return latest_per(t, [E], "timestamp")


def telemetry_status(t: DataFrame) -> DataFrame:
    """Current row as text."""
    c = telemetry_current(t.select(E, "timestamp", "battery_soc", "battery_range_km", "odometer_km", "is_locked", "is_charging"))
    return c.select(
        E, "timestamp",
        F.concat(F.col("battery_soc").cast("string"), F.lit("%")).alias("battery"),
        F.concat(F.col("battery_range_km").cast("string"), F.lit(" km")).alias("range"),
        F.concat(F.col("odometer_km").cast("string"), F.lit(" km")).alias("odometer"),
        F.when(F.col("is_locked"), F.lit(LOCKED_TEXT)).otherwise(F.lit(UNLOCKED_TEXT)).alias("lock_status"),
        F.when(F.col("is_charging"), F.lit(CHARGING_TEXT)).otherwise(F.lit(NOT_CHARGING_TEXT)).alias("charge_status"),
    )


def current_location_text(lat="latitude", lon="longitude") -> Column:
    """``ROUND(lat,4) || ', ' || ROUND(lon,4)`` (NULL-propagating)."""
    return F.concat(F.round(F.col(lat), 4).cast("string"), F.lit(", "), F.round(F.col(lon), 4).cast("string"))


def telemetry_gauges(t: DataFrame) -> DataFrame:
    """P3-P8 over the current row: gauge values, flags as 0/1, mapped labels and colour
    bands, location text, tyre pressures with their mean, tyre temperatures."""
    c = telemetry_current(t)
    press = ["tire_fl_pressure", "tire_fr_pressure", "tire_rl_pressure", "tire_rr_pressure"]
    temps = ["tire_fl_temp", "tire_fr_temp", "tire_rl_temp", "tire_rr_temp"]
    locked = flag_to_int("is_locked")
    return c.select(
        E,
        _dbl("battery_soc").alias("soc"),
        _dbl("battery_range_km").alias("range_km"),
        _dbl("odometer_km").alias("odometer_km"),
        locked.alias("locked"),
        flag_to_int("is_charging").alias("charging"),
        value_label_map(locked, LOCK_VALUE_MAP).alias("lock_label"),
        value_label_map(locked, LOCK_COLOR_MAP).alias("lock_color"),
        threshold_band(F.col("battery_soc"), SOC_STEPS).alias("soc_band"),
        current_location_text().alias("location"),
        *[F.col(p) for p in press],
        round_half_away((F.col(press[0]) + F.col(press[1]) + F.col(press[2]) + F.col(press[3])) / 4, 0).alias("pressure_avg"),
        threshold_band(F.least(*[F.col(p) for p in press]), PRESSURE_STEPS).alias("pressure_min_band"),
        *[F.col(x) for x in temps],
        threshold_band(F.greatest(*[F.col(x) for x in temps]), TYRE_TEMP_STEPS).alias("temp_max_band"),
    )


# ---------------------------------------------------------------- listings

def battery_history(t: DataFrame, rng: DateRange) -> DataFrame:
    """Minute-precision time text, SOC, range over a period."""
    return t.filter(rng.on_timestamp("timestamp")).select(
        E, "timestamp",
        F.substring(F.col("timestamp").cast("string"), 1, 16).alias("time"),
        _dbl("battery_soc").alias("soc"), _dbl("battery_range_km").alias("range_km"),
    )


def snapshot_log(t: DataFrame, rng: DateRange) -> DataFrame:
    """P10: wide snapshot listing (readers show it newest first; sorted by ``timestamp`` there)."""
    lock_i, unlock_i = SNAPSHOT_LOCK_ICONS
    chg_i, idle_i = SNAPSHOT_CHARGE_ICONS
    return t.filter(rng.on_timestamp("timestamp")).select(
        E, "timestamp",
        F.substring(F.col("timestamp").cast("string"), 1, 16).alias("time"),
        _dbl("battery_soc").alias("soc"), _dbl("battery_range_km").alias("range_km"),
        _dbl("odometer_km").alias("odometer_km"),
        "tire_fl_pressure", "tire_fr_pressure", "tire_rl_pressure", "tire_rr_pressure",
        F.when(F.col("is_locked"), F.lit(lock_i)).otherwise(F.lit(unlock_i)).alias("lock"),
        F.when(F.col("is_charging"), F.lit(chg_i)).otherwise(F.lit(idle_i)).alias("charge"),
        current_location_text().alias("location"),
    )


def battery_series(t: DataFrame, rng: DateRange) -> DataFrame:
    """(timestamp, soc) over a period."""
    return t.filter(rng.on_date("date", "timestamp")).select(E, "timestamp", _dbl("battery_soc").alias("soc"))


def location_points(t: DataFrame, rng: DateRange) -> DataFrame:
    """Located snapshots over a period, newest first."""
    return t.filter(rng.on_date("date", "timestamp") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        E, _dbl("latitude").alias("latitude"), _dbl("longitude").alias("longitude"), "address", "timestamp",
        _dbl("battery_soc").alias("battery"), _dbl("battery_range_km").alias("range_km"),
    )


# ---------------------------------------------------------------- daily aggregates

def telemetry_last_30d(t: DataFrame, as_of, days: int = 30) -> DataFrame:
    """A1: per day over the last ``days``: unrounded SOC stats, km, snapshots."""
    return t.filter(recent_window("date", as_of, days, "timestamp")).groupBy(E, "date").agg(
        avg_exact("battery_soc").alias("avg_soc"),
        _dbl(F.min("battery_soc")).alias("min_soc"), _dbl(F.max("battery_soc")).alias("max_soc"),
        _dbl(_km()).alias("km_driven"), F.count(F.lit(1)).alias("snapshots"),
    )


def battery_daily_30d(t: DataFrame, as_of, days: int = 30) -> DataFrame:
    """A2: per day: rounded SOC stats and mean range."""
    return t.filter(recent_window("date", as_of, days, "timestamp")).groupBy(E, "date").agg(
        round_half_away(avg_exact("battery_soc"), 1).alias("avg_soc"),
        _r_dec(F.min("battery_soc"), 1).alias("min_soc"), _r_dec(F.max("battery_soc"), 1).alias("max_soc"),
        round_half_away(avg_exact("battery_range_km"), 0).alias("avg_range"),
    )


def telemetry_daily_summary(t: DataFrame) -> DataFrame:
    """A3: per day: SOC stats, km driven, charging snapshots, snapshots."""
    return t.groupBy(E, "date").agg(
        round_half_away(avg_exact("battery_soc"), 1).alias("avg_soc"),
        _r_dec(F.min("battery_soc"), 1).alias("min_soc"), _r_dec(F.max("battery_soc"), 1).alias("max_soc"),
        _dbl(_km()).alias("km"),
        F.sum(flag_to_int("is_charging")).cast("bigint").alias("charging_snapshots"),
        F.count(F.lit(1)).alias("snapshots"),
    )


def soc_by_weekday(t: DataFrame, as_of, days: int = 90, labels: list[str] = WEEKDAYS_PT) -> DataFrame:
    """A4: mean SOC per weekday (Sunday = 0) over the last ``days``."""
    names = F.array(*[F.lit(x) for x in labels])
    return (
        t.filter(recent_window("date", as_of, days, "timestamp"))
        .groupBy(E, weekday_sun0("date").alias("weekday_no"))
        .agg(round_half_away(avg_exact("battery_soc"), 1).alias("avg_soc"), F.count(F.lit(1)).alias("snapshots"))
        .select(E, "weekday_no", F.element_at(names, F.col("weekday_no") + 1).alias("weekday"), "avg_soc", "snapshots")
    )


def grid3(c: str) -> Column:
    """Coordinate rounded to 3 decimals (~100 m cells)."""
    return F.round(F.col(c), 3)


def daily_activity(t: DataFrame) -> DataFrame:
    """A5: per day: SOC extremes and distinct grid cells (NULL coordinates do not count)."""
    return t.groupBy(E, "date").agg(
        _dbl(F.max("battery_soc")).alias("max_battery"), _dbl(F.min("battery_soc")).alias("min_battery"),
        F.count_distinct(grid3("latitude"), grid3("longitude")).alias("locations"),
    )


def charge_events(t: DataFrame, n: int = 30) -> DataFrame:
    """Charging snapshots and mean SOC while charging, latest ``n`` days per entity."""
    daily = t.filter(F.col("is_charging") == F.lit(True)).groupBy(E, "date").agg(
        F.count(F.lit(1)).alias("times_charging"), round_half_away(avg_exact("battery_soc"), 1).alias("avg_soc"))
    return top_n_per(daily, [E], [F.col("date").desc()], n)


def _with_prev(t: DataFrame, cols: list[str], since=None) -> DataFrame:
    """Rows (optionally only those dated >= ``since``) with the previous snapshot's
    ``cols`` per entity, as ``prev_<col>`` (and ``prev_timestamp``).

    Skew-safe: the ordered window runs per (entity, day), so a vehicle with a huge
    history is spread over its days. The first row of a day takes its predecessor
    from the day's carry -- the last row of the entity's previous day with data,
    found with a map-side-combined ``max(struct)`` per (entity, day) and a ``lag``
    over those per-day rows (a few thousand per entity). With ``since``, all older
    history collapses into one carry row per entity.
    """
    keep = [E, "timestamp", "date"] + [c for c in cols if c not in (E, "timestamp", "date")]
    base = t.select(*keep)
    last_of = F.max(F.struct(F.col("timestamp"), *[F.col(c) for c in cols])).alias("last")
    if since is not None:
        start = as_date(since)
        rows = base.filter(recent_window("date", start, 0, "timestamp") & F.col(E).isNotNull()).repartition(E, "date")
        days = rows.groupBy(E, "date").agg(last_of)
        older = base.filter((F.col("date") < F.lit(start)) & F.col(E).isNotNull()).groupBy(E).agg(last_of).withColumn(
            "date", F.lit(start - _dt.timedelta(days=1)))
        days = days.unionByName(older.select(E, "date", "last"))
    else:
        # One shuffle of the rows on (entity, day) feeds both the window and the per-day
        # carry (the identical exchange is reused), so telemetry is read once.
        rows = base.filter(F.col(E).isNotNull() & F.col("timestamp").isNotNull()).repartition(E, "date")
        days = rows.groupBy(E, "date").agg(last_of)
    carry = days.select(E, "date", F.lag("last").over(Window.partitionBy(E).orderBy("date")).alias("carry"))
    x = rows.join(carry, [E, "date"], "left")
    w = Window.partitionBy(E, "date").orderBy("timestamp")
    prev_ts = F.lag("timestamp").over(w)
    out = x.withColumn("_pt", prev_ts)
    first = F.col("_pt").isNull()
    for c in cols:
        out = out.withColumn(f"prev_{c}", F.when(first, F.col("carry")[c]).otherwise(F.lag(c).over(w)))
    return out.withColumn("prev_timestamp", F.coalesce(F.col("_pt"), F.col("carry.timestamp"))).drop("_pt", "carry")


def soc_delta(t: DataFrame) -> DataFrame:
    """Previous SOC and timestamp per entity."""
    return _with_prev(t, ["battery_soc"]).select(
        E, "timestamp", _dbl("battery_soc").alias("soc"), _dbl("prev_battery_soc").alias("prev_soc"), "prev_timestamp")


def consumption_30d(t: DataFrame, as_of, days: int = 30) -> DataFrame:
    """SOC drops between consecutive snapshots while not charging, per day."""
    since = as_date(as_of) - _dt.timedelta(days=days)
    x = _with_prev(t, ["battery_soc", "is_charging"], since)
    drop = F.col("prev_battery_soc") - F.col("battery_soc")
    x = x.filter((F.col("is_charging") == F.lit(False)) & F.col("prev_battery_soc").isNotNull()
                 & (F.col("prev_battery_soc") > F.col("battery_soc")))
    return x.groupBy(E, "date").agg(
        _r_dec(F.sum(drop), 1).alias("soc_used"),
        round_half_away(avg_exact(drop), 2).alias("avg_drop"),
        F.count(F.lit(1)).alias("drops"),
    )


def daily_consumption(t: DataFrame) -> DataFrame:
    """Daily SOC used (conditional sum, so days without drops stay)."""
    x = _with_prev(t, ["battery_soc", "is_charging"]).filter(F.col("prev_battery_soc").isNotNull())
    drop = F.when((F.col("prev_battery_soc") > F.col("battery_soc")) & (F.col("is_charging") == F.lit(False)),
                  F.col("prev_battery_soc") - F.col("battery_soc")).otherwise(F.lit(0))
    return x.groupBy(E, "date").agg(_r_dec(F.sum(drop), 1).alias("soc_used"), F.count(F.lit(1)).alias("snapshots"))


def daily_km(t: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Km per day from the day's max odometer minus the previous day's (first day dropped)."""
    daily = t.filter(recent_window("date", as_of, days, "timestamp")).groupBy(E, "date").agg(F.max("odometer_km").alias("odo"))
    prev = F.lag("odo").over(Window.partitionBy(E).orderBy("date"))
    return daily.withColumn("prev", prev).filter(F.col("prev").isNotNull()).select(
        E, "date", _r_dec(F.col("odo") - F.coalesce(F.col("prev"), F.col("odo")), 1).alias("km"), _dbl("odo").alias("odometer"))


def frequent_addresses(t: DataFrame, n: int = 10) -> DataFrame:
    """Visits and mean SOC per address, top ``n`` per entity."""
    g = t.filter(F.col("address").isNotNull()).groupBy(E, "address").agg(
        F.count(F.lit(1)).alias("visits"), round_half_away(avg_exact("battery_soc"), 1).alias("avg_soc"))
    return top_n_per(g, [E], [F.col("visits").desc(), F.col("address")], n)


# ---------------------------------------------------------------- location grids

def locations(t: DataFrame) -> DataFrame:
    """A10: per ~100 m cell: an address, visits, first/last visit, corner coordinates."""
    return t.filter(F.col("latitude").isNotNull()).groupBy(E, grid3("latitude").alias("lg"), grid3("longitude").alias("og")).agg(
        F.min("address").alias("address"), F.count(F.lit(1)).alias("visits"),
        F.min("timestamp").alias("first_visit"), F.max("timestamp").alias("last_visit"),
        _dbl(F.min("latitude")).alias("latitude"), _dbl(F.min("longitude")).alias("longitude"),
    ).select(E, _dbl("lg").alias("lat_group"), _dbl("og").alias("lon_group"), "address", "visits",
             "first_visit", "last_visit", "latitude", "longitude")


def top_locations(t: DataFrame, rng: DateRange, n: int = 5) -> DataFrame:
    """Most visited cells in a period, top ``n`` per entity."""
    g = t.filter(F.col("latitude").isNotNull() & rng.on_date("date", "timestamp")).groupBy(
        E, grid3("latitude").alias("lg"), grid3("longitude").alias("og")).agg(
        F.min("address").alias("address"), F.count(F.lit(1)).alias("visits"))
    g = g.select(E, _dbl("lg").alias("lat_group"), _dbl("og").alias("lon_group"), "address", "visits")
    return top_n_per(g, [E], [F.col("visits").desc(), F.col("lat_group"), F.col("lon_group")], n)


def new_locations(t: DataFrame, since, n: int = 10) -> DataFrame:
    """Cells first visited on/after ``since``, top ``n`` by visits per entity."""
    s = _dt.datetime.combine(as_date(since), _dt.time())
    g = locations(t).filter(F.col("first_visit") >= ntz(s))
    top = top_n_per(g, [E], [F.col("visits").desc(), F.col("lat_group"), F.col("lon_group")], n)
    return top.select(E, "lat_group", "lon_group", "address", "visits", "first_visit", "last_visit")


def distinct_places(t: DataFrame, rng: DateRange) -> DataFrame:
    """Number of distinct cells in a period."""
    return t.filter(F.col("latitude").isNotNull() & rng.on_date("date", "timestamp")).groupBy(E).agg(
        F.count_distinct(grid3("latitude"), grid3("longitude")).alias("places"))


# ---------------------------------------------------------------- monthly and cost

def monthly_km(t: DataFrame) -> DataFrame:
    """Km (odometer max - min) and snapshots per month."""
    return t.filter(F.col("odometer_km").isNotNull() & (F.col("odometer_km") > 0)).groupBy(E, month_key("date").alias("month")).agg(
        _dbl(_km()).alias("km"), F.count(F.lit(1)).alias("snapshots"))


def _energy(km: Column) -> Column:
    return km / F.lit(EV_KM_PER_KWH) * F.lit(PRICE_PER_KWH)


def _fuel(km: Column) -> Column:
    return km / F.lit(FUEL_KM_PER_L) * F.lit(FUEL_PRICE_PER_L)


def unit_cost_constants() -> dict[str, Column]:
    """Cost per km of the EV and of the fuel-equivalent car (double)."""
    return {"ev_cost_per_km": F.lit(PRICE_PER_KWH) / F.lit(EV_KM_PER_KWH),
            "fuel_cost_per_km": F.lit(FUEL_PRICE_PER_L) / F.lit(FUEL_KM_PER_L)}


def cost_estimate(t: DataFrame) -> DataFrame:
    """Monthly km, kWh, energy cost, cost/km, fuel-equivalent cost and saving; km > 0."""
    m = t.filter(F.col("odometer_km").isNotNull() & (F.col("odometer_km") > 0)).groupBy(E, month_key("date").alias("month")).agg(
        _dbl(_km()).alias("km")).filter(F.col("km") > 0)
    km = F.col("km")
    return m.select(
        E, "month", "km",
        round_half_away(km / F.lit(EV_KM_PER_KWH), 2).alias("kwh"),
        round_half_away(_energy(km), 2).alias("energy_cost"),
        round_half_away(unit_cost_constants()["ev_cost_per_km"], 4).alias("cost_per_km"),
        round_half_away(_fuel(km), 2).alias("fuel_cost"),
        round_half_away(_fuel(km) - _energy(km), 2).alias("saving"),
    )


def monthly_cost_chart(t: DataFrame) -> DataFrame:
    """Month, EV and fuel series."""
    return cost_estimate(t).select(E, "month", F.col("energy_cost").alias("ev"), F.col("fuel_cost").alias("fuel"))


def period_cost(t: DataFrame, rng: DateRange) -> DataFrame:
    """kWh, energy cost, fuel cost and saving over a period (dashboard form)."""
    g = t.filter((F.col("odometer_km") > 0) & rng.on_date("date", "timestamp")).groupBy(E).agg(_dbl(_km()).alias("km"))
    km = F.col("km")
    return g.select(
        E, round_half_away(km / F.lit(EV_KM_PER_KWH), 1).alias("kwh"),
        round_half_away(_energy(km), 2).alias("energy_cost"), round_half_away(_fuel(km), 2).alias("fuel_cost"),
        round_half_away(_fuel(km) - _energy(km), 2).alias("saving"),
    )


def telemetry_overview(t: DataFrame) -> DataFrame:
    """Overall statistics per entity."""
    return t.groupBy(E).agg(
        F.count(F.lit(1)).alias("snapshots"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        round_half_away(avg_exact("battery_soc"), 1).alias("avg_soc"),
        _r_dec(F.min("battery_soc"), 1).alias("min_soc"), _r_dec(F.max("battery_soc"), 1).alias("max_soc"),
        _r_dec(_km(), 1).alias("km"),
    )


def period_stats(t: DataFrame, rng: DateRange) -> DataFrame:
    """Km (0 when unknown), mean SOC and range, snapshots over a period."""
    return t.filter(F.col("battery_soc").isNotNull() & rng.on_date("date", "timestamp")).groupBy(E).agg(
        F.coalesce(_dbl(_km()), F.lit(0.0)).alias("km"),
        round_half_away(avg_exact("battery_soc"), 0).alias("avg_battery"),
        round_half_away(avg_exact("battery_range_km"), 0).alias("avg_range"),
        F.count(F.lit(1)).alias("snapshots"),
    )
