"""Registered telemetry queries and their oracle SQL."""

from __future__ import annotations

from almanac.functions.dates import DateRange
from almanac.operators import telemetry as T
from almanac.plans.registry import register, with_views
from almanac.sources import fixtures as FX

AS_OF = FX.AS_OF_EVENTS  # 2024-01-30
R_START, R_END = "2024-01-08", "2024-01-21"
W = with_views("telemetry")
WL = with_views("telemetry_long")


def tel(spark, sf):
    return FX.load(spark, sf, "telemetry")


def tel_long(spark, sf):
    return FX.load(spark, sf, "telemetry_long")


# Shared oracle fragments (DuckDB).
AVG = "cast(sum({c}) as double)/count({c})"
KM = "cast(max(odometer_km)-min(odometer_km) as double)"
LATEST = "select * exclude (rn) from (select *, row_number() over (partition by entity_id order by timestamp desc) rn from telemetry) where rn = 1"


def avg(c):
    return AVG.format(c=c)


@register("telemetry_daily_summary", W + f"""
select entity_id, date, round({avg('battery_soc')}, 1) as avg_soc,
  cast(round(min(battery_soc),1) as double) as min_soc, cast(round(max(battery_soc),1) as double) as max_soc,
  {KM} as km, cast(sum(case when is_charging then 1 else 0 end) as bigint) as charging_snapshots, count(*) as snapshots
from telemetry group by entity_id, date""", "telemetry")
def q_telemetry_daily_summary(spark, sf):
    return T.telemetry_daily_summary(tel(spark, sf))


@register("telemetry_current", W + LATEST, "telemetry")
def q_telemetry_current(spark, sf):
    return T.telemetry_current(tel(spark, sf))


@register("telemetry_status", W + f"""
select entity_id, timestamp, battery_soc || '%' as battery, battery_range_km || ' km' as range,
  odometer_km || ' km' as odometer,
  case when is_locked then '{T.LOCKED_TEXT}' else '{T.UNLOCKED_TEXT}' end as lock_status,
  case when is_charging then '{T.CHARGING_TEXT}' else '{T.NOT_CHARGING_TEXT}' end as charge_status
from ({LATEST})""", "telemetry")
def q_telemetry_status(spark, sf):
    return T.telemetry_status(tel(spark, sf))


def _band_sql(x, steps):
    parts = " ".join(f"when {x} >= {v} then '{lab}'" for v, lab in reversed(steps[1:]))
    return f"case when {x} is null then null {parts} else '{steps[0][1]}' end"


@register("telemetry_gauges", W + f"""
select entity_id, cast(battery_soc as double) as soc, cast(battery_range_km as double) as range_km,
  cast(odometer_km as double) as odometer_km,
  case when is_locked then 1 else 0 end as locked, case when is_charging then 1 else 0 end as charging,
  case when is_locked then '{T.LOCK_VALUE_MAP[1]}' else '{T.LOCK_VALUE_MAP[0]}' end as lock_label,
  case when is_locked then '{T.LOCK_COLOR_MAP[1]}' else '{T.LOCK_COLOR_MAP[0]}' end as lock_color,
  {_band_sql('battery_soc', T.SOC_STEPS)} as soc_band,
  round(latitude, 4) || ', ' || round(longitude, 4) as location,
  tire_fl_pressure, tire_fr_pressure, tire_rl_pressure, tire_rr_pressure,
  round((tire_fl_pressure + tire_fr_pressure + tire_rl_pressure + tire_rr_pressure) / 4, 0) as pressure_avg,
  {_band_sql('least(tire_fl_pressure, tire_fr_pressure, tire_rl_pressure, tire_rr_pressure)', T.PRESSURE_STEPS)} as pressure_min_band,
  tire_fl_temp, tire_fr_temp, tire_rl_temp, tire_rr_temp,
  {_band_sql('greatest(tire_fl_temp, tire_fr_temp, tire_rl_temp, tire_rr_temp)', T.TYRE_TEMP_STEPS)} as temp_max_band
from ({LATEST})""", "telemetry")
def q_telemetry_gauges(spark, sf):
    return T.telemetry_gauges(tel(spark, sf))


EOD = f"timestamp >= timestamp '{R_START} 00:00:00' and timestamp <= timestamp '{R_END} 23:59:59'"
CLOSED = f"date >= date '{R_START}' and date <= date '{R_END}'"


@register("battery_history", W + f"""
select entity_id, timestamp, cast(timestamp as varchar)[:16] as time, cast(battery_soc as double) as soc,
  cast(battery_range_km as double) as range_km
from telemetry where {EOD}""", "telemetry")
def q_battery_history(spark, sf):
    return T.battery_history(tel(spark, sf), DateRange.of(R_START, R_END, "end_of_day"))


@register("snapshot_log", W + f"""
select entity_id, timestamp, cast(timestamp as varchar)[:16] as time, cast(battery_soc as double) as soc,
  cast(battery_range_km as double) as range_km, cast(odometer_km as double) as odometer_km,
  tire_fl_pressure, tire_fr_pressure, tire_rl_pressure, tire_rr_pressure,
  case when is_locked then '{T.SNAPSHOT_LOCK_ICONS[0]}' else '{T.SNAPSHOT_LOCK_ICONS[1]}' end as lock,
  case when is_charging then '{T.SNAPSHOT_CHARGE_ICONS[0]}' else '{T.SNAPSHOT_CHARGE_ICONS[1]}' end as charge,
  round(latitude, 4) || ', ' || round(longitude, 4) as location
from telemetry where {EOD}""", "telemetry")
def q_snapshot_log(spark, sf):
    return T.snapshot_log(tel(spark, sf), DateRange.of(R_START, R_END, "end_of_day"))


@register("battery_series", W + f"""
select entity_id, timestamp, cast(battery_soc as double) as soc from telemetry where {CLOSED}""", "telemetry")
def q_battery_series(spark, sf):
    return T.battery_series(tel(spark, sf), DateRange.of(R_START, R_END, "closed_date"))


@register("location_points", W + f"""
select entity_id, cast(latitude as double) as latitude, cast(longitude as double) as longitude, address, timestamp,
  cast(battery_soc as double) as battery, cast(battery_range_km as double) as range_km
from telemetry where latitude is not null and longitude is not null and {CLOSED}""", "telemetry")
def q_location_points(spark, sf):
    return T.location_points(tel(spark, sf), DateRange.of(R_START, R_END, "closed_date"))


@register("telemetry_last_30d", W + f"""
select entity_id, date, {avg('battery_soc')} as avg_soc, cast(min(battery_soc) as double) as min_soc,
  cast(max(battery_soc) as double) as max_soc, {KM} as km_driven, count(*) as snapshots
from telemetry where date >= date '{AS_OF}' - interval 30 day group by entity_id, date""", "telemetry")
def q_telemetry_last_30d(spark, sf):
    return T.telemetry_last_30d(tel(spark, sf), AS_OF)


@register("battery_daily_30d", W + f"""
select entity_id, date, round({avg('battery_soc')}, 1) as avg_soc, cast(round(min(battery_soc),1) as double) as min_soc,
  cast(round(max(battery_soc),1) as double) as max_soc, round({avg('battery_range_km')}, 0) as avg_range
from telemetry where date >= date '{AS_OF}' - interval 30 day group by entity_id, date""", "telemetry")
def q_battery_daily_30d(spark, sf):
    return T.battery_daily_30d(tel(spark, sf), AS_OF)


@register("soc_by_weekday", W + f"""
select entity_id, cast(dayofweek(date) as integer) as weekday_no,
  {T.WEEKDAYS_PT!r}[dayofweek(date)+1] as weekday,
  round({avg('battery_soc')}, 1) as avg_soc, count(*) as snapshots
from telemetry where date >= date '{AS_OF}' - interval 90 day group by entity_id, dayofweek(date)""".replace("'Domingo', ", "'Domingo', ").replace('"', "'"), "telemetry")
def q_soc_by_weekday(spark, sf):
    return T.soc_by_weekday(tel(spark, sf), AS_OF)


@register("daily_activity", W + """
select entity_id, date, cast(max(battery_soc) as double) as max_battery, cast(min(battery_soc) as double) as min_battery,
  count(distinct cast(round(latitude, 3) as varchar) || ',' || cast(round(longitude, 3) as varchar)) as locations
from telemetry group by entity_id, date""", "telemetry")
def q_daily_activity(spark, sf):
    return T.daily_activity(tel(spark, sf))


@register("charge_events", W + f"""
select entity_id, date, times_charging, avg_soc from (
  select entity_id, date, count(*) as times_charging, round({avg('battery_soc')}, 1) as avg_soc,
    row_number() over (partition by entity_id order by date desc) as rn
  from telemetry where is_charging = true group by entity_id, date) where rn <= 30""", "telemetry")
def q_charge_events(spark, sf):
    return T.charge_events(tel(spark, sf))


PREV = """select *, lag(battery_soc) over (partition by entity_id order by timestamp) as prev_soc,
  lag(timestamp) over (partition by entity_id order by timestamp) as prev_timestamp from telemetry"""


@register("soc_delta", W + f"""
select entity_id, timestamp, cast(battery_soc as double) as soc, cast(prev_soc as double) as prev_soc, prev_timestamp
from ({PREV})""", "telemetry")
def q_soc_delta(spark, sf):
    return T.soc_delta(tel(spark, sf))


@register("consumption_30d", W + f"""
select entity_id, date, cast(round(sum(prev_soc - battery_soc), 1) as double) as soc_used,
  round(cast(sum(prev_soc - battery_soc) as double)/count(*), 2) as avg_drop, count(*) as drops
from ({PREV}) b
where is_charging = false and prev_soc is not null and prev_soc > battery_soc and date >= date '{AS_OF}' - interval 30 day
group by entity_id, date""", "telemetry")
def q_consumption_30d(spark, sf):
    return T.consumption_30d(tel(spark, sf), AS_OF)


@register("daily_consumption", W + f"""
select entity_id, date,
  cast(round(sum(case when prev_soc > battery_soc and is_charging = false then prev_soc - battery_soc else 0 end), 1) as double) as soc_used,
  count(*) as snapshots
from ({PREV}) b where prev_soc is not null group by entity_id, date""", "telemetry")
def q_daily_consumption(spark, sf):
    return T.daily_consumption(tel(spark, sf))


@register("daily_km", W + f"""
with d as (select entity_id, date, max(odometer_km) as odo,
  lag(max(odometer_km)) over (partition by entity_id order by date) as prev
  from telemetry where date >= date '{AS_OF}' - interval 30 day group by entity_id, date)
select entity_id, date, cast(round(odo - coalesce(prev, odo), 1) as double) as km, cast(odo as double) as odometer
from d where prev is not null""".replace("\nwith d as", ", d as"), "telemetry")
def q_daily_km(spark, sf):
    return T.daily_km(tel(spark, sf), AS_OF)


@register("frequent_addresses", W + f"""
select entity_id, address, visits, avg_soc from (
  select entity_id, address, count(*) as visits, round({avg('battery_soc')}, 1) as avg_soc,
    row_number() over (partition by entity_id order by count(*) desc, address) as rn
  from telemetry where address is not null group by entity_id, address) where rn <= 10""", "telemetry")
def q_frequent_addresses(spark, sf):
    return T.frequent_addresses(tel(spark, sf))


LOC = """select entity_id, cast(round(latitude, 3) as double) as lat_group, cast(round(longitude, 3) as double) as lon_group,
  min(address) as address, count(*) as visits, min(timestamp) as first_visit, max(timestamp) as last_visit,
  cast(min(latitude) as double) as latitude, cast(min(longitude) as double) as longitude
from telemetry where latitude is not null group by entity_id, round(latitude, 3), round(longitude, 3)"""


@register("locations", W + LOC, "telemetry")
def q_locations(spark, sf):
    return T.locations(tel(spark, sf))


@register("top_locations", W + f"""
select entity_id, lat_group, lon_group, address, visits from (
  select entity_id, cast(round(latitude, 3) as double) as lat_group, cast(round(longitude, 3) as double) as lon_group,
    min(address) as address, count(*) as visits,
    row_number() over (partition by entity_id order by count(*) desc, round(latitude, 3), round(longitude, 3)) as rn
  from telemetry where latitude is not null and date >= date '{R_START}' and date < date '{R_END}'
  group by entity_id, round(latitude, 3), round(longitude, 3)) where rn <= 5""", "telemetry")
def q_top_locations(spark, sf):
    return T.top_locations(tel(spark, sf), DateRange.of(R_START, R_END, "half_open"))


@register("new_locations", W + f"""
select entity_id, lat_group, lon_group, address, visits, first_visit, last_visit from (
  select *, row_number() over (partition by entity_id order by visits desc, lat_group, lon_group) as rn
  from ({LOC}) where first_visit >= timestamp '{R_START} 00:00:00') where rn <= 10""", "telemetry")
def q_new_locations(spark, sf):
    return T.new_locations(tel(spark, sf), R_START)


@register("distinct_places", W + f"""
select entity_id, count(distinct cast(round(latitude, 3) as varchar) || ',' || cast(round(longitude, 3) as varchar)) as places
from telemetry where latitude is not null and date >= date '{R_START}' and date < date '{R_END}' group by entity_id""", "telemetry")
def q_distinct_places(spark, sf):
    return T.distinct_places(tel(spark, sf), DateRange.of(R_START, R_END, "half_open"))


@register("telemetry_overview", W + f"""
select entity_id, count(*) as snapshots, min(date) as first_date, max(date) as last_date,
  round({avg('battery_soc')}, 1) as avg_soc, cast(round(min(battery_soc),1) as double) as min_soc,
  cast(round(max(battery_soc),1) as double) as max_soc, cast(round(max(odometer_km)-min(odometer_km), 1) as double) as km
from telemetry group by entity_id""", "telemetry")
def q_telemetry_overview(spark, sf):
    return T.telemetry_overview(tel(spark, sf))


@register("period_stats", W + f"""
select entity_id, coalesce({KM}, 0) as km, round({avg('battery_soc')}, 0) as avg_battery,
  round({avg('battery_range_km')}, 0) as avg_range, count(*) as snapshots
from telemetry where battery_soc is not null and date >= date '{R_START}' and date < date '{R_END}' group by entity_id""", "telemetry")
def q_period_stats(spark, sf):
    return T.period_stats(tel(spark, sf), DateRange.of(R_START, R_END, "half_open"))


# Monthly operators run on the multi-year telemetry.
L_START, L_END = "2001-01-01", "2001-06-30"
EN = "cast(km as double)/6.3*0.8"
FU = "cast(km as double)/12.0*6.2"


@register("monthly_km", WL + f"""
select entity_id, strftime(date, '%Y-%m') as month, {KM} as km, count(*) as snapshots
from telemetry_long where odometer_km is not null and odometer_km > 0 group by entity_id, strftime(date, '%Y-%m')""", "telemetry")
def q_monthly_km(spark, sf):
    return T.monthly_km(tel_long(spark, sf))


COST = f"""select entity_id, month, km, round(km/6.3, 2) as kwh, round({EN}, 2) as energy_cost,
  round(0.8/6.3, 4) as cost_per_km, round({FU}, 2) as fuel_cost, round({FU} - {EN}, 2) as saving
from (select entity_id, strftime(date, '%Y-%m') as month, {KM} as km from telemetry_long
      where odometer_km is not null and odometer_km > 0 group by entity_id, strftime(date, '%Y-%m')) m where km > 0"""


@register("cost_estimate", WL + COST, "telemetry")
def q_cost_estimate(spark, sf):
    return T.cost_estimate(tel_long(spark, sf))


@register("monthly_cost_chart", WL + f"select entity_id, month, energy_cost as ev, fuel_cost as fuel from ({COST})", "telemetry")
def q_monthly_cost_chart(spark, sf):
    return T.monthly_cost_chart(tel_long(spark, sf))


@register("period_cost", WL + f"""
select entity_id, round(km/6.3, 1) as kwh, round({EN}, 2) as energy_cost, round({FU}, 2) as fuel_cost,
  round({FU} - {EN}, 2) as saving
from (select entity_id, {KM} as km from telemetry_long
      where odometer_km > 0 and date >= date '{L_START}' and date <= date '{L_END}' group by entity_id)""", "telemetry")
def q_period_cost(spark, sf):
    return T.period_cost(tel_long(spark, sf), DateRange.of(L_START, L_END, "closed_date"))
