"""Cross-source operators: monthly summary spine joins, spend vs usage, source
summary, and the monthly report document for all months in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.dates import month_key, month_label
from almanac.functions.numeric import py_round, py_round0, round_half_away
from almanac.functions.text import fmt_number, shorten_address
from almanac.operators import telemetry as T
from almanac.operators.common import assemble_by_key
from almanac.operators.media import STOP
from almanac.operators.transactions import expense_value, is_expense

# Source labels of the source summary.
SOURCE_LABELS = ("telemetry", "transactions", "media")

# Report constants and fun-fact templates ({} placeholders in order).
EARTH_KM = 12500
FUN_CATEGORY = "<strong>{}%</strong> dos seus gastos foram em <strong>{}</strong>."
FUN_KM = "Você rodou <strong>{} km</strong> — equivalente a {}% da circunferência da Terra!"
FUN_TITLES = "Você assistiu <strong>{} títulos</strong> diferentes. Cinéfilo de carteirinha! 🎬"


def fill(template: str, *cols: Column) -> Column:
    """Fill the ``{}`` slots of a fixed template with columns (NULL-propagating)."""
    parts = template.split("{}")
    out: list[Column] = [F.lit(parts[0])]
    for c, lit in zip(cols, parts[1:]):
        out += [c.cast("string"), F.lit(lit)]
    return F.concat(*out)


def _month_spend(tx: DataFrame, sign: int = 1) -> DataFrame:
    return tx.groupBy(month_key("date").alias("month")).agg(
        F.coalesce(F.sum(expense_value(sign)), F.lit(0)).cast("double").alias("spend"))


def _month_titles(activity: DataFrame) -> DataFrame:
    return activity.filter(F.col("event_type") == STOP).groupBy(month_key("timestamp").alias("month")).agg(
        F.count_distinct("item_name").alias("titles"))


def _telemetry_month_figures(t: DataFrame) -> DataFrame:
    """Per telemetry month: km (sum over entities of max - min positive odometer) and
    distinct ~100 m cells, from one scan.

    One aggregate with GROUPING SETS ((entity, month), (month, cell)) -- Spark expands
    each row once and aggregates both groupings in the same shuffle -- followed by a
    month-level aggregate that reads each grouping through ``grouping_id``."""
    odo = F.when(F.col("odometer_km") > 0, F.col("odometer_km"))
    x = t.select("entity_id", month_key("date").alias("month"), T.grid3("latitude").alias("lg"),
                 T.grid3("longitude").alias("og"), odo.alias("odo"))
    g = x.groupingSets([["entity_id", "month"], ["month", "lg", "og"]], "entity_id", "month", "lg", "og").agg(
        F.max("odo").alias("o1"), F.min("odo").alias("o0"), F.grouping_id().alias("gid"))
    per_entity = F.col("gid") == 3   # entity_id, month grouped; lg, og aggregated away
    per_cell = F.col("gid") == 8     # month, lg, og grouped; entity_id aggregated away
    return g.groupBy("month").agg(
        F.sum(F.when(per_entity, F.col("o1") - F.col("o0"))).cast("double").alias("km"),
        F.count(F.when(per_cell & F.col("lg").isNotNull(), F.lit(1))).alias("places"))


def monthly_summary(t: DataFrame, tx: DataFrame, activity: DataFrame, fill_zero: bool = False) -> DataFrame:
    """J1 (J2 with ``fill_zero``): distinct telemetry months LEFT JOIN monthly km,
    places, spend and titles.

    Telemetry is read once (``_telemetry_month_figures``); spend and titles are
    month-grain aggregates (one row per calendar month); the LEFT JOIN onto the
    telemetry months is one union + groupBy.
    """
    spine = _telemetry_month_figures(t).withColumn("_spine", F.lit(True))
    out = assemble_by_key([spine, _month_spend(tx), _month_titles(activity)], "month").filter(F.col("_spine"))
    if fill_zero:
        # The correlated form gives 0 for COUNT/COALESCE(SUM) on a missing month; km stays NULL.
        out = out.select("month", "km", F.coalesce("places", F.lit(0)).alias("places"),
                         F.coalesce("spend", F.lit(0.0)).alias("spend"), F.coalesce("titles", F.lit(0)).alias("titles"))
    return out.select("month", "km", "places", "spend", "titles")


def spend_vs_usage(t: DataFrame, tx: DataFrame) -> DataFrame:
    """Daily km per entity LEFT JOIN daily spend; cost per km; km > 0.
    Daily spend has one row per calendar day, so it is broadcast."""
    daily = t.groupBy("entity_id", "date").agg((F.max("odometer_km") - F.min("odometer_km")).cast("double").alias("km"))
    spend = tx.groupBy("date").agg(F.sum("amount").alias("spend"))
    j = daily.filter(F.col("km") > 0).join(F.broadcast(spend), "date", "left")
    s = F.coalesce(F.col("spend"), F.lit(0)).cast("double")
    return j.select("entity_id", "date", "km", s.alias("spend"),
                    round_half_away(F.try_divide(s, F.nullif(F.col("km"), F.lit(0.0))), 2).alias("cost_per_km"))


def source_summary(t: DataFrame, tx: DataFrame, activity: DataFrame) -> DataFrame:
    """(source, records, first, last) for the three sources, UNION ALL."""
    a = t.agg(F.lit(SOURCE_LABELS[0]).alias("source"), F.count(F.lit(1)).alias("records"),
              F.min("date").alias("first_record"), F.max("date").alias("last_record"))
    b = tx.agg(F.lit(SOURCE_LABELS[1]).alias("source"), F.count(F.lit(1)).alias("records"),
               F.min("date").alias("first_record"), F.max("date").alias("last_record"))
    c = activity.agg(F.lit(SOURCE_LABELS[2]).alias("source"), F.count(F.lit(1)).alias("records"),
                     F.min("timestamp").cast("date").alias("first_record"), F.max("timestamp").cast("date").alias("last_record"))
    return a.unionByName(b).unionByName(c)


def _ranked_list(df: DataFrame, key: str, order: list[Column], n: int, fields: list[Column], name: str) -> DataFrame:
    """Top ``n`` rows per ``key`` folded into one ordered array per key. The cut comes
    before the collect, so each array holds at most ``n`` elements."""
    w = Window.partitionBy(key).orderBy(*order)
    r = df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= n)
    packed = F.struct(F.col("_rk").alias("rk"), *fields)
    g = r.groupBy(key).agg(F.array_sort(F.collect_list(packed)).alias("_l"))
    return g.select(key, F.transform("_l", lambda e: e.dropFields("rk")).alias(name))


#: Shares that a month's rows are ranked in, so that no task sorts a whole month; a month's best
#: rows are among the best of its shares.
SHARES = 1024


def _share(*cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SHARES))


def _report_telemetry(t: DataFrame) -> DataFrame:
    """Per month from one telemetry scan: km (per vehicle, summed), mean SOC and range,
    snapshots, distinct cells and the top-5 cells.

    GROUPING SETS ((entity, month), (month, cell)) aggregates both grains in one
    shuffle; a window per (month, share of its rows) finds each share's top-5 cells; one
    month aggregate reads each grain through ``grouping_id`` and keeps the best five."""
    soc_ok = F.col("battery_soc").isNotNull()
    x = t.select("entity_id", month_key("date").alias("month"), T.grid3("latitude").alias("lg"), T.grid3("longitude").alias("og"),
                 F.when(soc_ok, F.col("odometer_km")).alias("odo"), "battery_soc",
                 F.when(soc_ok, F.col("battery_range_km")).alias("rng"), soc_ok.alias("ok"), "address")
    g = x.groupingSets([["entity_id", "month"], ["month", "lg", "og"]], "entity_id", "month", "lg", "og").agg(
        F.max("odo").alias("o1"), F.min("odo").alias("o0"), F.sum("battery_soc").alias("ss"), F.count("battery_soc").alias("sn"),
        F.sum("rng").alias("rs"), F.count("rng").alias("rn"), F.count_if("ok").alias("n"),
        F.min("address").alias("address"), F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("gid"))
    ent = F.col("gid") == 3
    cell = (F.col("gid") == 8) & F.col("lg").isNotNull()
    w = Window.partitionBy("month", _share("entity_id", "lg", "og")).orderBy(cell.desc(), F.col("rows").desc(), F.col("lg"), F.col("og"))
    r = g.withColumn("rk", F.row_number().over(w))

    def on(cond, c):
        return F.when(cond, c)

    top = on(cell & (F.col("rk") <= 5), F.struct((-F.col("rows")).alias("less"), "lg", "og", shorten_address("address").alias("name"), F.col("rows").alias("visits")))
    m = r.groupBy("month").agg(
        F.sum(on(ent, F.col("o1") - F.col("o0"))).alias("k"), F.sum(on(ent, F.col("ss"))).alias("ss"),
        F.sum(on(ent, F.col("sn"))).alias("sn"), F.sum(on(ent, F.col("rs"))).alias("rs"), F.sum(on(ent, F.col("rn"))).alias("rn"),
        F.sum(on(ent, F.col("n"))).alias("snapshots"), F.count(on(cell, F.lit(1))).alias("places"),
        F.array_sort(F.collect_list(top)).alias("_top"))
    return m.select(
        "month", F.coalesce(F.col("k"), F.lit(0)).cast("double").alias("km"),
        round_half_away(F.try_divide(F.col("ss").cast("double"), F.col("sn").cast("double")), 0).alias("avg_battery"),
        round_half_away(F.try_divide(F.col("rs").cast("double"), F.col("rn").cast("double")), 0).alias("avg_range"),
        "snapshots", "places", F.transform(F.slice("_top", 1, 5), lambda e: e.dropFields("less", "lg", "og")).alias("top_locations"))


def _report_finance(tx: DataFrame, sign: int) -> DataFrame:
    """Per month from one aggregate pass: spend, spend per active day, spend
    transactions, peak day and the top-8 categories with their share of the largest.
    GROUPING SETS ((month, date), (month, category)); one window per (month, grain)
    ranks days and categories; one month aggregate folds the cut lists."""
    d = tx.select(month_key("date").alias("month"), "date", "category", expense_value(sign).alias("ev"),
                  F.when(is_expense(sign), F.lit(1)).alias("pos"))
    g = d.groupingSets([["month", "date"], ["month", "category"]], "month", "date", "category").agg(
        F.sum("ev").alias("sp"), F.count("pos").alias("npos"), F.grouping_id().alias("gid"))
    day = F.col("gid") == 1
    cat = (F.col("gid") == 2) & (F.col("npos") > 0)
    amount = F.when(day, F.col("sp")).otherwise(F.round("sp", 2))
    tie = F.when(day, F.col("date").cast("string")).otherwise(F.col("category"))
    r = g.withColumn("rk", F.row_number().over(Window.partitionBy("month", "gid").orderBy(amount.desc(), tie.asc_nulls_last())))
    peak = F.when(day & (F.col("rk") == 1) & (F.col("sp") > 0),
                  F.struct(F.date_format("date", "dd/MM").alias("date"), F.round("sp", 2).cast("double").alias("amount")))
    top = F.when(cat & (F.col("rk") <= 8), F.struct(F.col("rk"), F.col("category").alias("name"),
                                                  F.round("sp", 2).cast("double").alias("amount")))
    m = r.groupBy("month").agg(
        F.sum(F.when(day, F.col("sp"))).alias("s"), F.count(F.when(day, F.lit(1))).alias("days"),
        F.sum(F.when(day, F.col("npos"))).alias("spend_transactions"), F.max(peak).alias("top_day"),
        F.array_sort(F.collect_list(top)).alias("_cats"))
    cats = F.transform("_cats", lambda e: e.dropFields("rk"))
    mx = F.coalesce(F.nullif(F.array_max(F.transform(cats, lambda c: c["amount"])), F.lit(0.0)), F.lit(1.0))
    return m.select(
        "month", F.coalesce(F.col("s"), F.lit(0)).cast("double").alias("spend"),
        round_half_away(F.try_divide(F.col("s").cast("double"), F.col("days").cast("double")), 2).alias("avg_per_day"),
        "spend_transactions", "top_day",
        F.transform(cats, lambda c: c.withField("pct", py_round0(c["amount"] / mx * 100).cast("bigint"))).alias("categories"))


def _report_media(activity: DataFrame) -> DataFrame:
    """Per month: distinct (title, user, device) stopped and the 8 most recent."""
    watched = activity.filter(F.col("event_type") == STOP).groupBy(
        month_key("timestamp").alias("month"), F.col("item_name").alias("title"), F.col("user_name").alias("user"), "device").agg(
        F.max("timestamp").alias("last"))
    w = Window.partitionBy("month", _share("title", "user", "device")).orderBy(F.col("last").desc(), F.col("title"), F.col("user"), F.col("device"))
    r = watched.withColumn("rk", F.row_number().over(w))
    age = F.expr("timestampdiff(MICROSECOND, last, TIMESTAMP_NTZ '1970-01-01 00:00:00')")
    top = F.when(F.col("rk") <= 8, F.struct(age.alias("age"), "title", "user", "device"))
    m = r.groupBy("month").agg(F.count(F.lit(1)).alias("titles"), F.array_sort(F.collect_list(top)).alias("_e"))
    return m.select("month", "titles", F.transform(F.slice("_e", 1, 8), lambda e: F.struct(
        F.substring(e["title"], 1, 35).alias("title"), e["user"].alias("user"), F.substring(e["device"], 1, 20).alias("device"))).alias("entertainment"))


def wrapped_report(t: DataFrame, tx: DataFrame, activity: DataFrame, sign: int = 1) -> DataFrame:
    """One nested document row per month with every figure of the monthly
    report (stats, places, spend, categories, top expenses, titles, EV cost,
    daily spend stats, fun fact) for all months in one job.

    One scan per source: telemetry and transactions go through a GROUPING SETS
    aggregate, a per-month ranking window and one month aggregate; the top
    expenses need rows and use a partial top-5 per month. Every list is cut to its
    top-k before it is collected. The month-grain pieces are combined with one
    union + groupBy.
    """
    exps = tx.filter(is_expense(sign)).select(month_key("date").alias("month"), "id", "description", "amount", "category")
    exp_list = _ranked_list(exps, "month", [F.abs("amount").desc(), F.col("id")], 5,
                            [F.substring("description", 1, 40).alias("desc"), F.round(F.abs("amount"), 2).cast("double").alias("amount"),
                             F.col("category")], "top_expenses")
    doc = assemble_by_key([_report_telemetry(t), _report_finance(tx, sign), exp_list, _report_media(activity)], "month")
    return _report_document(doc)


def _report_document(doc: DataFrame) -> DataFrame:
    """Derived figures of the report document: EV cost, fun fact, period label."""
    km = F.coalesce(F.col("km"), F.lit(0.0))
    ev = py_round(km / F.lit(T.EV_KM_PER_KWH) * F.lit(T.PRICE_PER_KWH), 2)
    gas = py_round(km / F.lit(T.FUEL_KM_PER_L) * F.lit(T.FUEL_PRICE_PER_L), 2)
    has_km = km > 0
    spend = F.coalesce(F.col("spend"), F.lit(0.0))
    top_cat = F.get(F.col("categories"), 0)
    fact_cat = F.when((spend > 0) & top_cat.isNotNull(), fill(
        FUN_CATEGORY, py_round0(top_cat["amount"] / spend * 100).cast("bigint").cast("string"), top_cat["name"]))
    fact_km = F.when(has_km, fill(FUN_KM, fmt_number(km), fmt_number(km / F.lit(EARTH_KM) * 100)))
    fact_titles = F.when(F.coalesce(F.col("titles"), F.lit(0)) > 0,
                         fill(FUN_TITLES, F.col("titles").cast("string")))
    dt = F.to_date(F.concat(F.col("month"), F.lit("-01")))
    return doc.select(
        "month", month_label(dt).alias("period"),
        km.alias("km"), F.coalesce("places", F.lit(0)).alias("places"), spend.alias("spend"),
        F.coalesce("titles", F.lit(0)).alias("titles"),
        F.col("avg_battery"), F.col("avg_range"), F.coalesce("snapshots", F.lit(0)).alias("snapshots"),
        F.coalesce("top_locations", F.array()).alias("top_locations"),
        F.coalesce("categories", F.array()).alias("categories"),
        F.coalesce("top_expenses", F.array()).alias("top_expenses"),
        F.coalesce("entertainment", F.array()).alias("entertainment"),
        F.when(has_km, py_round(km / F.lit(T.EV_KM_PER_KWH), 1)).alias("kwh_used"),
        F.when(has_km, ev).alias("ev_cost"), F.when(has_km, gas).alias("gas_equiv"),
        F.when(has_km, py_round(gas - ev, 2)).alias("ev_saving"),
        F.when(F.col("avg_per_day") > 0, F.col("avg_per_day")).alias("avg_per_day"),
        F.col("top_day"),
        F.when(F.col("spend_transactions") > 0, F.col("spend_transactions")).alias("spend_transactions"),
        F.coalesce(fact_cat, fact_km, fact_titles, F.lit("")).alias("fun_fact"),
    )
