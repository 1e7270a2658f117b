"""Registered cross-source queries and their oracle SQL."""

from __future__ import annotations

from almanac.operators import crosssource as C
from almanac.plans.registry import register, with_views
from almanac.sources import fixtures as FX

W = with_views("telemetry_long", "transactions", "media_activity_long")
GRID = "cast(round(latitude, 3) as varchar) || ',' || cast(round(longitude, 3) as varchar)"

# One list of facts of all sources, grouped once. A figure without facts of its kind in a month is NULL;
# months are those with telemetry.
MONTHLY = f"""
, facts as (
  select 'snapshots' as kind, strftime(date, '%Y-%m') as month,
    max(odometer_km) filter (where odometer_km > 0) - min(odometer_km) filter (where odometer_km > 0) as km, null as label, null as amount
  from telemetry_long group by 2, entity_id
  union all select 'place', strftime(date, '%Y-%m'), null, {GRID}, null from telemetry_long where latitude is not null
  union all select 'ledger', strftime(date, '%Y-%m'), null, null, greatest(amount, 0) from transactions
  union all select 'title', strftime(timestamp, '%Y-%m'), null, item_name, null from media_activity_long
    where event_type = 'VideoPlaybackStopped')
select month, cast(sum(km) as double) as km,
  case when bool_or(kind = 'place') then count(distinct label) filter (where kind = 'place') end as places,
  case when bool_or(kind = 'ledger') then cast(coalesce(sum(amount), 0) as double) end as spend,
  case when bool_or(kind = 'title') then count(distinct label) filter (where kind = 'title') end as titles
from facts group by month having bool_or(kind = 'snapshots')"""


def _inputs(spark, sf):
    return (FX.load(spark, sf, "telemetry_long"), FX.load(spark, sf, "transactions"), FX.load(spark, sf, "media_activity_long"))


@register("monthly_summary", W + MONTHLY, "cross")
def q_monthly_summary(spark, sf):
    return C.monthly_summary(*_inputs(spark, sf))


# The same with a zero, but for the distance, where a month has no facts of a kind.
MONTHLY_ZERO = MONTHLY.replace("select month, cast(sum(km)", "select month, km, coalesce(places, 0) as places, coalesce(spend, 0) as spend, coalesce(titles, 0) as titles\nfrom (select month, cast(sum(km)") + ")"


@register("monthly_summary_zero", W + MONTHLY_ZERO, "cross")
def q_monthly_summary_zero(spark, sf):
    return C.monthly_summary(*_inputs(spark, sf), fill_zero=True)


@register("spend_vs_usage", with_views("telemetry_long", "transactions") + """
select o.entity_id, o.date, o.km, cast(coalesce(n.spend, 0) as double) as spend,
  round(cast(coalesce(n.spend, 0) as double) / nullif(o.km, 0), 2) as cost_per_km
from (select entity_id, date, cast(max(odometer_km) - min(odometer_km) as double) as km from telemetry_long group by 1, 2) o
left join (select date, sum(amount) as spend from transactions group by date) n on o.date = n.date
where o.km > 0""", "cross")
def q_spend_vs_usage(spark, sf):
    return C.spend_vs_usage(FX.load(spark, sf, "telemetry_long"), FX.load(spark, sf, "transactions"))


@register("source_summary", with_views("telemetry", "transactions", "media_activity") + f"""
select '{C.SOURCE_LABELS[0]}' as source, count(*) as records, min(date) as first_record, max(date) as last_record from telemetry
union all select '{C.SOURCE_LABELS[1]}', count(*), min(date), max(date) from transactions
union all select '{C.SOURCE_LABELS[2]}', count(*), cast(min(timestamp) as date), cast(max(timestamp) as date) from media_activity""", "cross")
def q_source_summary(spark, sf):
    return C.source_summary(FX.load(spark, sf, "telemetry"), FX.load(spark, sf, "transactions"), FX.load(spark, sf, "media_activity"))


@register("wrapped_report", None, "cross")
def q_wrapped_report(spark, sf):
    return C.wrapped_report(*_inputs(spark, sf))


FIGURES = ["month", "period", "km", "places", "spend", "titles", "avg_battery", "avg_range", "snapshots", "kwh_used", "ev_cost",
           "gas_equiv", "ev_saving", "avg_per_day", "spend_transactions", "fun_fact"]
MONTHS_PT = "['Janeiro','Fevereiro','Março','Abril','Maio','Junho','Julho','Agosto','Setembro','Outubro','Novembro','Dezembro']"


def _fmt(x):
    """DuckDB twin of functions.text.fmt_number."""
    return (f"case when {x} is null then '0' when {x} = floor({x}) then replace(format('{{:,d}}', cast({x} as bigint)), ',', '.') "
            f"else translate(format('{{:,.2f}}', {x}), ',.', '.,') end")


def _pyround(x, n):
    """Python's ``round``: the exact binary value printed with n digits."""
    return f"cast(format('{{:.{n}f}}', cast(({x}) as double)) as double)"


@register("wrapped_report_figures", W + f"""
, st as (select entity_id, strftime(date, '%Y-%m') as month, max(odometer_km) - min(odometer_km) as k,
           sum(battery_soc) as ss, count(battery_soc) as sn, sum(battery_range_km) as rs, count(battery_range_km) as rn, count(*) as n
         from telemetry_long where battery_soc is not null group by 1, 2),
stats as (select month, cast(coalesce(sum(k), 0) as double) as km, round(cast(sum(ss) as double) / sum(sn), 0) as avg_battery,
            round(cast(sum(rs) as double) / sum(rn), 0) as avg_range, cast(sum(n) as bigint) as snapshots from st group by month),
cells as (select strftime(date, '%Y-%m') as month, count(distinct (round(latitude, 3), round(longitude, 3))) as places
          from telemetry_long where latitude is not null group by 1),
daily as (select strftime(date, '%Y-%m') as month, date, sum(case when amount > 0 then amount else 0 end) as day_spend,
            count(case when amount > 0 then 1 end) as n_pos from transactions group by 1, 2),
fin as (select month, cast(coalesce(sum(day_spend), 0) as double) as spend, round(cast(sum(day_spend) as double) / count(*), 2) as avg_per_day,
          cast(sum(n_pos) as bigint) as spend_transactions from daily group by month),
cats as (select strftime(date, '%Y-%m') as month, category as name, cast(round(sum(abs(amount)), 2) as double) as amount
         from transactions where amount > 0 group by 1, 2),
topcat as (select month, arg_max(name, amount) as name, max(amount) as amount from (
             select *, row_number() over (partition by month order by amount desc, name nulls last) as rk from cats) where rk = 1 group by month),
w2 as (select month, count(*) as titles from (select distinct strftime(timestamp, '%Y-%m') as month, item_name, user_name, device
        from media_activity_long where event_type = 'VideoPlaybackStopped') group by month),
months as (select distinct strftime(date, '%Y-%m') as month from telemetry_long union select month from fin union select month from w2),
doc as (select m.month, coalesce(s.km, 0) as km, coalesce(c.places, 0) as places, coalesce(f.spend, 0) as spend,
          coalesce(w.titles, 0) as titles, s.avg_battery, s.avg_range, coalesce(s.snapshots, 0) as snapshots,
          f.avg_per_day, f.spend_transactions, t.name as top_name, t.amount as top_amount
        from months m left join stats s using (month) left join cells c using (month) left join fin f using (month)
        left join w2 w using (month) left join topcat t using (month))
select month, {MONTHS_PT}[cast(right(month, 2) as int)] || ' ' || left(month, 4) as period, km, places, spend, titles,
  avg_battery, avg_range, snapshots,
  case when km > 0 then {_pyround('km / 6.3', 1)} end as kwh_used,
  case when km > 0 then {_pyround('km / 6.3 * 0.8', 2)} end as ev_cost,
  case when km > 0 then {_pyround('km / 12.0 * 6.2', 2)} end as gas_equiv,
  case when km > 0 then {_pyround(_pyround('km / 12.0 * 6.2', 2) + ' - ' + _pyround('km / 6.3 * 0.8', 2), 2)} end as ev_saving,
  case when avg_per_day > 0 then avg_per_day end as avg_per_day,
  case when spend_transactions > 0 then spend_transactions end as spend_transactions,
  case when spend > 0 and top_name is not null then
         '<strong>' || cast(cast({_pyround('top_amount / spend * 100', 0)} as bigint) as varchar) || '%</strong> dos seus gastos foram em <strong>' || top_name || '</strong>.'
       when km > 0 then 'Você rodou <strong>' || {_fmt('km')} || ' km</strong> — equivalente a ' || {_fmt('km / 12500 * 100')} || '% da circunferência da Terra!'
       when titles > 0 then 'Você assistiu <strong>' || cast(titles as varchar) || ' títulos</strong> diferentes. Cinéfilo de carteirinha! 🎬'
       else '' end as fun_fact
from doc""".replace("\n, st as", ", st as", 1), "cross")
def q_wrapped_report_figures(spark, sf):
    return C.wrapped_report(*_inputs(spark, sf)).select(*FIGURES)
