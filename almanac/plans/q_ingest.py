"""Registered ingest queries (landed JSON -> typed rows) and their oracle SQL: the
expected typed rows computed straight from the raw tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.plans.registry import register, with_views
from almanac.sources import fixtures as FX
from almanac.sources import ingest as I
from almanac.sources import landing as L


@register("ingest_telemetry", """
select user_id as entity_id, ts as timestamp, cast(ts as date) as date,
  cast(case when event_id % 11 = 0 or event_id % 23 = 0 then null else (event_id*7919) % 101 end as decimal(5,2)) as battery_soc,
  cast(null as decimal(6,2)) as battery_range_km,
  cast(case when event_id % 7 = 0 then 2000 + event_id else 1000 + event_id end as decimal(10,2)) as odometer_km,
  cast(user_id % 20 + 0.5 as decimal(10,7)) as latitude, cast(user_id % 30 + 0.25 as decimal(10,7)) as longitude,
  cast(null as varchar) as address,
  case when event_id % 5 = 0 then null else event_id % 2 = 1 end as is_locked,
  event_type = 'purchase' as is_charging, cast(null as boolean) as is_ac_on,
  cast(null as double) as tire_fl_pressure, cast(null as double) as tire_fr_pressure,
  cast(null as double) as tire_rl_pressure, cast(null as double) as tire_rr_pressure,
  cast(null as double) as tire_fl_temp, cast(null as double) as tire_fr_temp,
  cast(null as double) as tire_rl_temp, cast(null as double) as tire_rr_temp, cast(null as double) as charging_time_min
from events""", "ingest")
def q_ingest_telemetry(spark, sf):
    return I.ingest_telemetry(FX.load(spark, sf, "telemetry_raw")).drop("raw_json")


@register("ingest_transactions", """
select cast(o_orderkey as varchar) as id, cast(o_orderdate as date) as date, cast(cast(o_orderdate as date) as timestamp) as timestamp,
  coalesce(case when o_orderkey % 83 = 0 then null else cast(case when o_orderstatus = 'F' then -o_totalprice else o_totalprice end as decimal(12,2)) end, 0) as amount,
  case when o_orderkey % 7 = 0 then 'Outros' else o_orderpriority end as category,
  case when o_orderkey % 5 = 0 then c_name else 'order ' || cast(o_orderkey as varchar) end as merchant,
  case when o_orderkey % 5 = 0 then '' else 'order ' || cast(o_orderkey as varchar) end as description,
  case when o_orderkey % 2 = 0 then 'credit_card' else 'checking_account' end as account_type
from orders join customer on o_custkey = c_custkey where o_orderkey % 97 <> 0 and o_orderkey % 89 <> 0""", "ingest")
def q_ingest_transactions(spark, sf):
    pages = L.transaction_pages(spark, sf)
    feeds = [I.ingest_transactions(pages.filter(F.col("account_type") == a), a) for a in ("checking_account", "credit_card")]
    return I.merge_feeds(*feeds)


@register("ingest_activity", """
with a as (select event_id, user_id, ts, event_type,
  case when event_id % 7 = 0 then 'title' || cast(event_id % 3 as varchar) || ' em casa' else 'title' || cast(event_id % 3 as varchar) end as item
  from events where event_type in ('view', 'click'))
select event_id as id, case event_type when 'view' then 'VideoPlayback' else 'VideoPlaybackStopped' end as event_type,
  case when event_id % 50 = 0 then null else 'user' || cast(user_id as varchar) end as user_name,
  'u' || cast(user_id as varchar) as user_id,
  case when event_id % 50 = 0 then null else 'title' || cast(event_id % 3 as varchar) end as item_name,
  case when event_id % 50 = 0 then null when event_id % 7 = 0 then 'casa em device' || cast(user_id % 4 as varchar)
       else 'device' || cast(user_id % 4 as varchar) end as device,
  date_trunc('second', ts) as timestamp, 'Information' as severity,
  case when event_id % 50 = 0 then 'entrada ilegível' else 'user' || cast(user_id as varchar)
    || case event_type when 'view' then ' está reproduzindo ' else ' parou de reproduzir ' end
    || item || ' em device' || cast(user_id % 4 as varchar) end as raw_name
from a""", "ingest")
def q_ingest_activity(spark, sf):
    return I.ingest_activity(L.activity_pages(spark, sf))


@register("ingest_playback", with_views("media_playback") + "select user_name, date, minutes_watched from media_playback", "ingest")
def q_ingest_playback(spark, sf):
    return I.ingest_playback(L.playback_docs(spark, sf))


@register("ingest_media_library", """
select cast(p_partkey as varchar) as id, 'title' || cast(p_partkey as varchar) as name, 'Movie' as item_type,
  1950 + p_size as production_year, cast((p_partkey % 101) / 10.0 as decimal(4,2)) as community_rating, 'PG' as official_rating,
  replace(p_name, ' ', ',') as genres,
  case when p_partkey % 11 = 0 then null else cast(round_even((cast(p_size as bigint) * 3 * 600000000 + p_partkey * 1000) / 600000000.0, 0) as int) end as runtime_minutes,
  p_brand as studios, p_type as overview, timestamp '2023-05-04 10:11:12' as date_created, date '2001-02-03' as premiere_date,
  cast(null as varchar) as series_name, cast(null as varchar) as season_name, cast(null as int) as episode_index,
  case when p_partkey % 13 = 0 then null else cast(round_even(p_partkey * 1000003 / 1e9, 2) as decimal(8,2)) end as file_size_gb,
  case when p_partkey % 13 = 0 then null else 'mkv' end as container,
  case when p_partkey % 13 = 0 then null when p_partkey % 5 = 0 then 'hevc' else 'h264' end as video_codec,
  case when p_partkey % 13 = 0 then null when p_partkey % 5 = 0 then 'aac' else 'ac3' end as audio_codec,
  case when p_partkey % 13 = 0 then null when p_partkey % 5 = 0 then '1920x1080' when p_partkey % 7 = 0 then null else '1280x720' end as resolution
from part""", "ingest")
def q_ingest_media_library(spark, sf):
    return I.ingest_media_library(L.library_pages(spark, sf), "Movie")


@register("unreadable_documents", """
with d as (select distinct event_id // 100 as k from events)
select 'activity' as feed, cast(k as varchar) as landed, case when k % 4 = 1 then 'rejected' else 'accepted' end as outcome, count(*) as n
from d where k % 4 = 1 group by all
union all
select 'activity', cast(event_id // 100 as varchar), 'accepted', count(*) from events
where event_type in ('view', 'click') and (event_id // 100) % 4 <> 1 group by all
union all
select 'library', cast(p_partkey // 100 as varchar), 'accepted', count(*) from part where (p_partkey // 100) % 3 <> 1 group by all
union all
select distinct 'library', cast(p_partkey // 100 as varchar), 'rejected', 1 from part where (p_partkey // 100) % 3 = 1
union all
select 'forecast', cast(cast(ts as date) as varchar), case when day(ts) % 5 = 2 then 'rejected' else 'accepted' end, count(distinct cast(ts as date)) from events group by all
union all
select 'telemetry', cast(user_id as varchar), case when user_id % 6 = 1 then 'rejected' else 'accepted' end, count(*) from events group by all""", "ingest")
def q_unreadable_documents(spark, sf):
    """Feeds with documents cut short, given a field of another type, or missing: what each ingest reads and leaves out."""
    def spoilt(df, col, when):
        doc = F.when(F.length(col) % 3 == 0, F.lit(None)).when(F.length(col) % 3 == 1, F.concat(F.lit("["), F.col(col), F.lit("]"))).otherwise(F.substring(col, 1, 20))
        return df.withColumn(col, F.when(when, doc).otherwise(F.col(col)))

    def counted(df, feed, outcome, landed):
        return df.groupBy(landed.cast("string").alias("landed")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(feed).alias("feed"), "landed", F.lit(outcome).alias("outcome"), "n")

    act = spoilt(L.activity_pages(spark, sf), "page_json", F.col("page_no") % 4 == 1)
    lib = spoilt(L.library_pages(spark, sf), "page_json", F.col("page_no") % 3 == 1)
    fore = spoilt(L.forecast_docs(spark, sf), "forecast_json", F.day("date") % 5 == 2)
    tel = spoilt(FX.load(spark, sf, "telemetry_raw"), "raw_json", F.col("entity_id") % 6 == 1)
    parts = [
        counted(I.ingest_activity(act), "activity", "accepted", F.floor(F.col("id") / 100)),
        counted(I.unreadable_documents(act, "page_json", I.ACTIVITY_PAGE), "activity", "rejected", F.col("page_no")),
        counted(I.ingest_media_library(lib, "Movie"), "library", "accepted", F.floor(F.col("id").cast("bigint") / 100)),
        counted(I.unreadable_documents(lib, "page_json", I.LIBRARY_PAGE), "library", "rejected", F.col("page_no")),
        counted(I.ingest_weather(fore), "forecast", "accepted", F.col("date")),
        counted(I.unreadable_documents(fore, "forecast_json", I.FORECAST_DOC), "forecast", "rejected", F.col("date")),
        counted(I.ingest_telemetry(tel), "telemetry", "accepted", F.col("entity_id")),
        counted(I.unreadable_documents(tel, "raw_json", I.TELEMETRY_DOC), "telemetry", "rejected", F.col("entity_id"))]
    return I.merge_feeds(*parts)


# ---------------------------------------------------------------- merges
from almanac.operators import merge as MG  # noqa: E402

TX_COLS = "id, date, timestamp, amount, category, merchant, description, account_type"


def _tx_pulls(spark, sf):
    """Two overlapping look-back pulls of the ledger (arrival order 1, 2), each with
    amounts that differ from the stored ones, so the merge rule is observable."""
    tx = FX.load(spark, sf, "transactions")
    p1 = tx.filter(F.col("date") >= F.lit("2000-10-03").cast("date")).withColumn(
        "amount", (F.col("amount") + 1).cast("decimal(12,2)")).withColumn("seq", F.lit(1))
    p2 = tx.filter(F.col("date") >= F.lit("2000-12-01").cast("date")).withColumn(
        "amount", (F.col("amount") + 2).cast("decimal(12,2)")).withColumn("seq", F.lit(2))
    return tx, p1.unionByName(p2)


@register("insert_or_ignore", with_views("transactions") + f"""
select {TX_COLS} from transactions where date < date '2001-01-01'
union all
select id, date, timestamp, cast(amount + 1 as decimal(12,2)) as amount, category, merchant, description, account_type
from transactions where date >= date '2001-01-01'""", "merge")
def q_insert_or_ignore(spark, sf):
    tx, batch = _tx_pulls(spark, sf)
    target = tx.filter(F.col("date") < F.lit("2001-01-01").cast("date"))
    return MG.insert_or_ignore(target, batch, ["id"], "seq")


@register("batch_constraints", with_views("transactions") + """
select 'transactions' as "table", 'primary_key' as "constraint", '{"id":"' || id || '"}' as detail, count(*) as rows
from (select id from transactions where date >= date '2000-10-03' union all select id from transactions where date >= date '2000-12-01')
group by id having count(*) > 1""", "merge")
def q_batch_constraints(spark, sf):
    _, batch = _tx_pulls(spark, sf)
    return MG.constraint_violations(batch, ["id"], ["id", "date"], "transactions")


@register("insert_or_replace", with_views("media_activity") + """
select id, event_type, user_name, item_name,
  case when timestamp >= timestamp '2024-01-25 00:00:00' then device || '-v3'
       when timestamp >= timestamp '2024-01-15 00:00:00' then device || '-v2' else device end as device, timestamp
from media_activity""", "merge")
def q_insert_or_replace(spark, sf):
    a = FX.load(spark, sf, "media_activity")
    ts = F.col("timestamp")
    target = a.filter(ts < F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    b1 = a.filter(ts >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).withColumn(
        "device", F.concat("device", F.lit("-v2"))).withColumn("seq", F.lit(1))
    b2 = a.filter(ts >= F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")).withColumn(
        "device", F.concat("device", F.lit("-v3"))).withColumn("seq", F.lit(2))
    return MG.insert_or_replace(target, b1.unionByName(b2), ["id"], "seq", refresh_col=None)


@register("upsert", with_views("media_playback") + """
select user_name, date, case when date >= date '2024-01-15' then minutes_watched * 2 else minutes_watched end as minutes_watched
from media_playback""", "merge")
def q_upsert(spark, sf):
    p = FX.load(spark, sf, "media_playback")
    target = p.filter(F.col("date") < F.lit("2024-01-20").cast("date"))
    batch = p.filter(F.col("date") >= F.lit("2024-01-15").cast("date")).withColumn(
        "minutes_watched", (F.col("minutes_watched") * 2).cast("int"))
    return MG.upsert(target, batch, ["user_name", "date"], ["minutes_watched"])


# ---------------------------------------------------------------- keyed tables (S8-S10 without rewriting the target)
from almanac.operators import keyed as KT  # noqa: E402
from almanac.session import checkpoint_dir  # noqa: E402


@register("keyed_merge", with_views("transactions") + f"""
, old as (select * from transactions where date < date '2001-01-01'),
ignored as (
  select {TX_COLS} from old
  union all
  select id, date, timestamp, cast(amount + 1 as decimal(12,2)) as amount, category, merchant, description, account_type
  from transactions where date >= date '2001-01-01'),
upserted as (
  select id, date, timestamp, case when account_type = 'credit_card' then cast(amount * 2 as decimal(12,2)) else amount end as amount,
         category, merchant, description, account_type from ignored),
replaced as (
  select id, date, timestamp, amount, category, case when date >= date '2001-06-01' then 'corrected' else merchant end as merchant,
         description, account_type from upserted)
select {TX_COLS} from replaced where category is null or category <> '5-LOW'""", "merge")
def q_keyed_merge(spark, sf):
    """The ledger as a keyed table in the shared folder: two overlapping pulls under insert-or-ignore, an
    upsert of amounts, corrected rows replaced, a category removed; compacted midway."""
    import uuid

    tx, pulls = _tx_pulls(spark, sf)
    table = KT.KeyedTable(spark, f"{checkpoint_dir(spark).rstrip('/')}/keyed/ledger-{uuid.uuid4().hex}", tx.schema, ["id"], 16)
    table.merge(tx.filter(F.col("date") < F.lit("2001-01-01").cast("date")), "replace")
    table.merge(pulls, "ignore", ["seq"])
    credit = table.read().filter(F.col("account_type") == "credit_card")
    table.merge(credit.select("id", (F.col("amount") * 2).cast("decimal(12,2)").alias("amount")), "upsert", update_cols=["amount"])
    table.compact()
    late = table.read().filter(F.col("date") >= F.lit("2001-06-01").cast("date"))
    table.merge(late.withColumn("merchant", F.lit("corrected")), "replace")
    table.merge(table.read().filter(F.col("category") == "5-LOW"), "delete")
    return table.read()


@register("constraints_enforced", with_views("transactions") + """
, landed as (
  select id, nullif(category, '5-LOW') as category, date < date '1998-01-01' as stored, 1 as seq from transactions
  union all
  select id, nullif(category, '5-LOW') as category, false as stored, 2 as seq from transactions where date >= date '2000-12-01')
select id, seq, case when category is null and not stored then 'not_null:category'
                     when seq = 2 or stored then 'primary_key' end as "constraint"
from landed where (not stored and (category is null or seq = 2)) or stored""", "merge")
def q_constraints_enforced(spark, sf):
    """The whole ledger inserted into a table that holds its first years, with one pull landed twice and a
    category blanked: the rows that the constraints keep out. Each row tells its pull by ``seq``."""
    import uuid

    tx = FX.load(spark, sf, "transactions")
    first = F.col("date") < F.lit("1998-01-01").cast("date")
    table = KT.KeyedTable(spark, f"{checkpoint_dir(spark).rstrip('/')}/keyed/checked-{uuid.uuid4().hex}", tx.withColumn("seq", F.lit(0)).schema, ["id"], 16)
    table.merge(tx.filter(first).withColumn("seq", F.lit(0)), "replace")
    blank = F.when(~first, F.nullif(F.col("category"), F.lit("5-LOW"))).otherwise(F.col("category"))
    one = tx.withColumn("category", blank).withColumn("seq", F.lit(1))
    two = one.filter(F.col("date") >= F.lit("2000-12-01").cast("date")).withColumn("seq", F.lit(2))
    table.insert_checked(one.unionByName(two), ["category", "date"], ["seq"])
    return table.rejected().select("id", "seq", "constraint")
