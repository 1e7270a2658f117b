"""Ledger transactions: monthly/daily/weekly summaries, top-k reports, trends.

``sign`` selects the expense convention. The analytics queries treat ``amount < 0``
as an expense (``sign=-1``); the monthly report treats ``amount > 0`` as spend
(``sign=+1``). Both conventions exist in the reference and are kept explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.dates import DateRange, month_key, recent_window, week_key
from almanac.functions.numeric import avg_exact, py_round0, round_half_away
from almanac.operators.common import top_n_per

# Metric labels of the overview and text around its values.
OVERVIEW_LABELS = [
    "Total de transações", "Período de dados", "Total gasto (histórico)",
    "Total recebido (histórico)", "Gasto médio mensal", "Transação média",
]
PERIOD_SEP = " até "
CURRENCY = "R$ "

def _amt() -> Column:
    return F.col("amount")


def is_expense(sign: int = -1) -> Column:
    return _amt() < 0 if sign < 0 else _amt() > 0


def is_income(sign: int = -1) -> Column:
    return _amt() > 0 if sign < 0 else _amt() < 0


def expense_value(sign: int = -1) -> Column:
    """Expense magnitude, 0 for other rows (``CASE WHEN expense THEN ABS(amount) ELSE 0``)."""
    return F.when(is_expense(sign), F.abs(_amt())).otherwise(F.lit(0))


def income_value(sign: int = -1) -> Column:
    return F.when(is_income(sign), F.abs(_amt())).otherwise(F.lit(0))


def _r2(c: Column) -> Column:
    """ROUND(decimal, 2) as double."""
    return F.round(c, 2).cast("double")


def _window(tx: DataFrame, as_of, days: int) -> DataFrame:
    return tx.filter(recent_window("date", as_of, days, "timestamp"))


def tx_monthly_summary(tx: DataFrame, sign: int = -1) -> DataFrame:
    """Per month and account: count, expense, income, balance."""
    return tx.groupBy(month_key("date").alias("month"), "account_type").agg(
        F.count(F.lit(1)).alias("transactions"),
        _r2(F.sum(expense_value(sign))).alias("expense"), _r2(F.sum(income_value(sign))).alias("income"),
        _r2(F.sum(_amt())).alias("balance"),
    )


def tx_top_categories(tx: DataFrame, as_of, days: int = 30, n: int = 10, sign: int = -1) -> DataFrame:
    """Expense per category over the last ``days``, top ``n``."""
    g = _window(tx, as_of, days).filter(is_expense(sign)).groupBy("category").agg(
        F.count(F.lit(1)).alias("transactions"), _r2(F.sum(F.abs(_amt()))).alias("total"),
        round_half_away(avg_exact(F.abs(_amt())), 2).alias("avg_ticket"))
    return top_n_per(g, [], [F.col("total").desc(), F.col("category").asc_nulls_last()], n)


def tx_top_expenses(tx: DataFrame, as_of, days: int = 30, n: int = 20, sign: int = -1) -> DataFrame:
    """The ``n`` largest expenses of the last ``days`` (TakeOrderedAndProject)."""
    return _window(tx, as_of, days).filter(is_expense(sign)).orderBy(F.abs(_amt()).desc(), F.col("id")).limit(n).select(
        "id", "date", "merchant", "category", _r2(F.abs(_amt())).alias("amount"), "account_type")


def top_expenses(tx: DataFrame, rng: DateRange, n: int = 5, sign: int = 1, desc_len: int = 40) -> DataFrame:
    """The ``n`` largest expenses of a period (report/dashboard form)."""
    return tx.filter(is_expense(sign) & rng.on_date("date", "timestamp")).orderBy(F.abs(_amt()).desc(), F.col("id")).limit(n).select(
        "id", F.substring("description", 1, desc_len).alias("description"), _r2(F.abs(_amt())).alias("amount"), "category", "date")


def tx_category_trend(tx: DataFrame, as_of, days: int = 180, sign: int = -1) -> DataFrame:
    """Expense per month and category over the last ``days``."""
    return _window(tx, as_of, days).filter(is_expense(sign)).groupBy(month_key("date").alias("month"), "category").agg(
        _r2(F.sum(F.abs(_amt()))).alias("total"))


def tx_daily(tx: DataFrame, as_of, days: int = 30, sign: int = -1) -> DataFrame:
    """Per day over the last ``days``: count, expense, income."""
    return _window(tx, as_of, days).groupBy("date").agg(
        F.count(F.lit(1)).alias("transactions"),
        _r2(F.sum(expense_value(sign))).alias("expense"), _r2(F.sum(income_value(sign))).alias("income"))


def tx_month_comparison(tx: DataFrame, sign: int = -1) -> DataFrame:
    """Monthly expense, income, deficit, previous month and % change.

    The window runs over the monthly result (one row per month, bounded by the
    calendar), so its single partition holds a few hundred rows at any scale.
    """
    m = tx.groupBy(month_key("date").alias("month")).agg(
        F.round(F.sum(expense_value(sign)), 2).alias("e"), F.round(F.sum(income_value(sign)), 2).alias("i"))
    prev = F.lag("e").over(Window.orderBy("month"))
    m = m.withColumn("p", prev)
    change = F.try_divide((F.col("e") - F.col("p")).cast("double"), F.nullif(F.col("p").cast("double"), F.lit(0.0))) * F.lit(100.0)
    return m.select(
        "month", F.col("e").cast("double").alias("expense"), F.col("i").cast("double").alias("income"),
        (F.col("e") - F.col("i")).cast("double").alias("deficit"), F.col("p").cast("double").alias("prev_expense"),
        round_half_away(change, 1).alias("change_pct"))


def tx_top_merchants(tx: DataFrame, n: int = 30, sign: int = -1) -> DataFrame:
    """Per merchant and category with >= 2 purchases: totals, first/last; top ``n``."""
    g = tx.filter(is_expense(sign) & F.col("merchant").isNotNull() & (F.col("merchant") != "")).groupBy("merchant", "category").agg(
        F.count(F.lit(1)).alias("purchases"), _r2(F.sum(F.abs(_amt()))).alias("total"),
        round_half_away(avg_exact(F.abs(_amt())), 2).alias("avg_ticket"),
        F.min("date").alias("first"), F.max("date").alias("last")).filter(F.col("purchases") >= 2)
    return top_n_per(g, [], [F.col("total").desc(), F.col("merchant"), F.col("category").asc_nulls_last()], n)


def tx_weekly(tx: DataFrame, as_of, days: int = 28, sign: int = -1) -> DataFrame:
    """Per ``%Y-W%W`` week over the last ``days``: sums and counts."""
    return _window(tx, as_of, days).groupBy(week_key("date").alias("week")).agg(
        _r2(F.sum(expense_value(sign))).alias("expense"), _r2(F.sum(income_value(sign))).alias("income"),
        F.count(F.when(is_expense(sign), F.lit(1))).alias("n_expense"),
        F.count(F.when(is_income(sign), F.lit(1))).alias("n_income"))


def _money_text(c: Column) -> Column:
    """Amount as text with 2 decimals (decimal text, so no exponent notation)."""
    return F.concat(F.lit(CURRENCY), F.round(c, 2).cast("decimal(38,2)").cast("string"))


def tx_overview(tx: DataFrame, sign: int = -1) -> DataFrame:
    """Six (metric, value) rows from one pass: a monthly partial aggregate,
    a global aggregate over it, then ``inline`` into rows (instead of six scans)."""
    m = tx.groupBy(month_key("date").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("d0"), F.max("date").alias("d1"),
        F.sum(expense_value(sign)).alias("out"), F.sum(income_value(sign)).alias("inc"),
        F.count(F.when(is_expense(sign), F.lit(1))).alias("n_out"))
    g = m.agg(
        F.sum("n").alias("n"), F.min("d0").alias("d0"), F.max("d1").alias("d1"),
        F.sum("out").alias("out"), F.sum("inc").alias("inc"),
        avg_exact("out").alias("monthly"), F.sum("n_out").alias("n_out"))
    mean_tx = F.try_divide(F.col("out").cast("double"), F.col("n_out").cast("double"))
    values = [
        F.col("n").cast("string"),
        F.concat(F.col("d0").cast("string"), F.lit(PERIOD_SEP), F.col("d1").cast("string")),
        _money_text(F.col("out")), _money_text(F.col("inc")),
        _money_text(round_half_away(F.col("monthly"), 2)), _money_text(round_half_away(mean_tx, 2)),
    ]
    rows = F.array(*[F.struct(F.lit(lab).alias("metric"), v.alias("value")) for lab, v in zip(OVERVIEW_LABELS, values)])
    return g.select(F.inline(rows))


def tx_by_weekday(tx: DataFrame, sign: int = -1) -> DataFrame:
    """Expense count and sum per weekday name; ``weekday_no`` (Monday is 1) is what readers sort by."""
    return tx.filter(is_expense(sign)).groupBy(F.date_format("date", "EEEE").alias("weekday"), (F.weekday("date") + 1).alias("weekday_no")).agg(
        F.count(F.lit(1)).alias("transactions"), _r2(F.sum(F.abs(_amt()))).alias("total"))


def tx_account_stats(tx: DataFrame) -> DataFrame:
    """Per account: count, first/last date, signed expense and income sums."""
    return tx.groupBy("account_type").agg(
        F.count(F.lit(1)).alias("transactions"), F.min("date").alias("first"), F.max("date").alias("last"),
        _r2(F.sum(F.when(_amt() < 0, _amt()).otherwise(F.lit(0)))).alias("expense"),
        _r2(F.sum(F.when(_amt() > 0, _amt()).otherwise(F.lit(0)))).alias("income"))


# ---------------------------------------------------------------- report family (sign = +1)

def _period(tx: DataFrame, rng: DateRange) -> DataFrame:
    return tx.filter(rng.on_date("date", "timestamp"))


def spend_total(tx: DataFrame, rng: DateRange, sign: int = 1) -> DataFrame:
    """Total spend of a period (0 when none)."""
    return _period(tx, rng).agg(F.coalesce(F.sum(expense_value(sign)), F.lit(0)).cast("double").alias("spend"))


def spend_by_category(tx: DataFrame, rng: DateRange, n: int = 8, sign: int = 1) -> DataFrame:
    """Top ``n`` categories and each one's share of the largest, in %.
    The ``max() over ()`` runs on at most ``n`` rows."""
    g = _period(tx, rng).filter(is_expense(sign)).groupBy(F.col("category").alias("name")).agg(
        _r2(F.sum(F.abs(_amt()))).alias("amount"))
    top = top_n_per(g, [], [F.col("amount").desc(), F.col("name").asc_nulls_last()], n)
    mx = F.max("amount").over(Window.partitionBy())
    pct = py_round0(F.col("amount") / F.coalesce(F.nullif(mx, F.lit(0.0)), F.lit(1.0)) * F.lit(100.0))
    return top.select("name", "amount", pct.cast("bigint").alias("pct_of_max"))


def spend_by_day(tx: DataFrame, rng: DateRange, sign: int = 1) -> DataFrame:
    """Spend per day of a period."""
    return _period(tx, rng).groupBy("date").agg(_r2(F.sum(expense_value(sign))).alias("total"))


def peak_spend_day(tx: DataFrame, rng: DateRange, sign: int = 1) -> DataFrame:
    """The day with the largest spend (earliest on ties); none when no spend."""
    d = spend_by_day(tx, rng, sign).filter(F.col("total") > 0)
    return d.orderBy(F.col("total").desc(), F.col("date")).limit(1)


def spend_avg_per_day(tx: DataFrame, rng: DateRange, sign: int = 1) -> DataFrame:
    """Spend divided by the number of distinct days with any transaction."""
    return _period(tx, rng).agg(round_half_away(
        F.try_divide(F.sum(expense_value(sign)).cast("double"), F.count_distinct("date").cast("double")), 2).alias("avg_per_day"))


def tx_count(tx: DataFrame, rng: DateRange, sign: int = 1) -> DataFrame:
    """Number of spend transactions in a period."""
    return _period(tx, rng).agg(F.count(F.when(is_expense(sign), F.lit(1))).alias("transactions"))
