"""Registered transaction queries and their oracle SQL."""

from __future__ import annotations

from almanac.functions.dates import DateRange, month_range
from almanac.operators import transactions as X
from almanac.plans.registry import register, with_views
from almanac.sources import fixtures as FX

AS_OF = FX.AS_OF_LONG  # 2001-08-01
M_START, M_END, _ = month_range(None, AS_OF)  # the report month: July 2001
RNG = DateRange(M_START, M_END, "half_open")
W = with_views("transactions")
EXP = "case when amount < 0 then abs(amount) else 0 end"
INC = "case when amount > 0 then amount else 0 end"
PER = f"date >= date '{M_START}' and date < date '{M_END}'"


def tx(spark, sf):
    return FX.load(spark, sf, "transactions")


def win(days):
    return f"date >= date '{AS_OF}' - interval {days} day"


@register("tx_monthly_summary", W + f"""
select strftime(date, '%Y-%m') as month, account_type, count(*) as transactions,
  cast(round(sum({EXP}), 2) as double) as expense, cast(round(sum({INC}), 2) as double) as income,
  cast(round(sum(amount), 2) as double) as balance
from transactions group by 1, 2""", "transactions")
def q_tx_monthly_summary(spark, sf):
    return X.tx_monthly_summary(tx(spark, sf))


@register("tx_monthly_summary_report_sign", W + f"""
select strftime(date, '%Y-%m') as month, account_type, count(*) as transactions,
  cast(round(sum({INC}), 2) as double) as expense, cast(round(sum({EXP}), 2) as double) as income,
  cast(round(sum(amount), 2) as double) as balance
from transactions group by 1, 2""", "transactions")
def q_tx_monthly_summary_pos(spark, sf):
    return X.tx_monthly_summary(tx(spark, sf), sign=1)


@register("tx_top_categories", W + f"""
select category, transactions, total, avg_ticket from (
  select category, count(*) as transactions, cast(round(sum(abs(amount)), 2) as double) as total,
    round(cast(sum(abs(amount)) as double)/count(*), 2) as avg_ticket,
    row_number() over (order by round(sum(abs(amount)), 2) desc, category nulls last) as rn
  from transactions where amount < 0 and {win(30)} group by category) where rn <= 10""", "transactions")
def q_tx_top_categories(spark, sf):
    return X.tx_top_categories(tx(spark, sf), AS_OF)


@register("tx_top_expenses", W + f"""
select id, date, merchant, category, cast(round(abs(amount), 2) as double) as amount, account_type
from transactions where amount < 0 and {win(30)} order by abs(amount) desc, id limit 20""", "transactions")
def q_tx_top_expenses(spark, sf):
    return X.tx_top_expenses(tx(spark, sf), AS_OF)


@register("top_expenses", W + f"""
select id, description[:40] as description, cast(round(abs(amount), 2) as double) as amount, category, date
from transactions where amount > 0 and {PER} order by abs(amount) desc, id limit 5""", "transactions")
def q_top_expenses(spark, sf):
    return X.top_expenses(tx(spark, sf), RNG)


@register("tx_category_trend", W + f"""
select strftime(date, '%Y-%m') as month, category, cast(round(sum(abs(amount)), 2) as double) as total
from transactions where amount < 0 and {win(180)} group by 1, 2""", "transactions")
def q_tx_category_trend(spark, sf):
    return X.tx_category_trend(tx(spark, sf), AS_OF)


@register("tx_daily", W + f"""
select date, count(*) as transactions, cast(round(sum({EXP}), 2) as double) as expense,
  cast(round(sum({INC}), 2) as double) as income
from transactions where {win(30)} group by date""", "transactions")
def q_tx_daily(spark, sf):
    return X.tx_daily(tx(spark, sf), AS_OF)


@register("tx_month_comparison", W + f"""
, monthly as (select strftime(date, '%Y-%m') as month, round(sum({EXP}), 2) as e, round(sum({INC}), 2) as i
  from transactions group by 1),
l as (select *, lag(e) over (order by month) as p from monthly)
select month, cast(e as double) as expense, cast(i as double) as income, cast(e - i as double) as deficit,
  cast(p as double) as prev_expense,
  round(cast(e - p as double) / nullif(cast(p as double), 0) * 100, 1) as change_pct
from l""".replace("\n, monthly", ", monthly", 1), "transactions")
def q_tx_month_comparison(spark, sf):
    return X.tx_month_comparison(tx(spark, sf))


@register("tx_top_merchants", W + """
select merchant, category, purchases, total, avg_ticket, first, last from (
  select merchant, category, count(*) as purchases, cast(round(sum(abs(amount)), 2) as double) as total,
    round(cast(sum(abs(amount)) as double)/count(*), 2) as avg_ticket, min(date) as first, max(date) as last,
    row_number() over (order by round(sum(abs(amount)), 2) desc, merchant, category nulls last) as rn
  from transactions where amount < 0 and merchant is not null and merchant != ''
  group by merchant, category having count(*) >= 2) where rn <= 30""", "transactions")
def q_tx_top_merchants(spark, sf):
    return X.tx_top_merchants(tx(spark, sf))


@register("tx_weekly", W + f"""
select strftime(date, '%Y-W%W') as week, cast(round(sum({EXP}), 2) as double) as expense,
  cast(round(sum({INC}), 2) as double) as income,
  count(case when amount < 0 then 1 end) as n_expense, count(case when amount > 0 then 1 end) as n_income
from transactions where {win(28)} group by 1""", "transactions")
def q_tx_weekly(spark, sf):
    return X.tx_weekly(tx(spark, sf), AS_OF)


L = X.OVERVIEW_LABELS


def _money(x: str) -> str:
    return f"'{X.CURRENCY}' || cast(cast(round({x}, 2) as decimal(38,2)) as varchar)"


# One aggregate over the ledger, its figures turned into rows.
OVERVIEW = f"""
, figures as (
  select count(*) as n, min(date) || '{X.PERIOD_SEP}' || max(date) as period, sum({EXP}) as expense, sum({INC}) as income,
    count(distinct coalesce(strftime(date, '%Y-%m'), '')) as months, nullif(count(*) filter (where amount < 0), 0) as n_expense
  from transactions)
select unnest({list(L)}) as metric, unnest([cast(n as varchar), period, {_money('expense')}, {_money('income')},
  {_money('cast(expense as double) / nullif(months, 0)')}, {_money('cast(expense as double) / n_expense')}]) as value
from figures"""


@register("tx_overview", W + OVERVIEW, "transactions")
def q_tx_overview(spark, sf):
    return X.tx_overview(tx(spark, sf))


@register("tx_by_weekday", W + """
select dayname(date) as weekday, cast(isodow(date) as int) as weekday_no, count(*) as transactions, cast(round(sum(abs(amount)), 2) as double) as total
from transactions where amount < 0 group by dayname(date), isodow(date)""", "transactions")
def q_tx_by_weekday(spark, sf):
    return X.tx_by_weekday(tx(spark, sf))


@register("tx_account_stats", W + """
select account_type, count(*) as transactions, min(date) as first, max(date) as last,
  cast(round(sum(case when amount < 0 then amount else 0 end), 2) as double) as expense,
  cast(round(sum(case when amount > 0 then amount else 0 end), 2) as double) as income
from transactions group by account_type""", "transactions")
def q_tx_account_stats(spark, sf):
    return X.tx_account_stats(tx(spark, sf))


@register("spend_total", W + f"""
select cast(coalesce(sum({INC}), 0) as double) as spend from transactions where {PER}""", "transactions")
def q_spend_total(spark, sf):
    return X.spend_total(tx(spark, sf), RNG)


@register("spend_by_category", W + f"""
select name, amount, cast(round_even(amount / coalesce(nullif(max(amount) over (), 0), 1) * 100, 0) as bigint) as pct_of_max
from (select category as name, cast(round(sum(abs(amount)), 2) as double) as amount from transactions
      where amount > 0 and {PER} group by category order by amount desc, name nulls last limit 8)""", "transactions")
def q_spend_by_category(spark, sf):
    return X.spend_by_category(tx(spark, sf), RNG)


@register("spend_by_day", W + f"""
select date, cast(round(sum({INC}), 2) as double) as total from transactions where {PER} group by date""", "transactions")
def q_spend_by_day(spark, sf):
    return X.spend_by_day(tx(spark, sf), RNG)


@register("peak_spend_day", W + f"""
select date, total from (select date, cast(round(sum({INC}), 2) as double) as total from transactions where {PER} group by date)
where total > 0 order by total desc, date limit 1""", "transactions")
def q_peak_spend_day(spark, sf):
    return X.peak_spend_day(tx(spark, sf), RNG)


@register("spend_avg_per_day", W + f"""
select round(cast(sum({INC}) as double) / count(distinct date), 2) as avg_per_day from transactions where {PER}""", "transactions")
def q_spend_avg_per_day(spark, sf):
    return X.spend_avg_per_day(tx(spark, sf), RNG)


@register("tx_count", W + f"""
select count(case when amount > 0 then 1 end) as transactions from transactions where {PER}""", "transactions")
def q_tx_count(spark, sf):
    return X.tx_count(tx(spark, sf), RNG)
