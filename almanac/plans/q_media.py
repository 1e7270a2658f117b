"""Registered media queries and their oracle SQL."""

from __future__ import annotations

from almanac.functions.dates import DateRange
from almanac.operators import media as M
from almanac.plans.registry import register, with_views
from almanac.sources import fixtures as FX

R_START, R_END = "2024-01-08", "2024-01-21"
W = with_views("media_activity")


def act(spark, sf):
    return FX.load(spark, sf, "media_activity")


def lib(spark, sf):
    return FX.load(spark, sf, "media_library")


# A session runs from a play to the nearest stop after it, if no other play of the same user and item
# lies between; of plays at one instant the one without a device, else the last device, counts.
SESSIONS = f"""plays as (
  select user_name, item_name, timestamp as start_time, case when bool_and(device is not null) then max(device) end as device
  from media_activity where event_type = '{M.PLAY}' group by user_name, item_name, timestamp),
ends as (select distinct user_name, item_name, timestamp as stop_time from media_activity where event_type = '{M.STOP}'),
sessions as (
  select p.user_name, p.item_name, p.device, p.start_time, e.stop_time,
    round(date_diff('microsecond', p.start_time, e.stop_time) / 1e6 / 60.0, 1) as duration_minutes
  from plays p
  asof join ends e on e.user_name = p.user_name and e.item_name = p.item_name and p.start_time < e.stop_time
  asof left join plays n on n.user_name = p.user_name and n.item_name = p.item_name and p.start_time < n.start_time
  where n.start_time is null or e.stop_time <= n.start_time)
"""


@register("watch_sessions", W + ", " + SESSIONS + "select * from sessions", "media")
def q_watch_sessions(spark, sf):
    return M.watch_sessions(act(spark, sf))


@register("user_watch_stats", W + ", " + SESSIONS + """
select user_name, count(distinct item_name) as titles, count(*) as sessions,
  cast(round(sum(cast(duration_minutes as decimal(18,1))), 0) as double) as minutes,
  round(cast(sum(cast(duration_minutes as decimal(18,1))) as double) / 60.0, 1) as hours,
  max(start_time) as last_session
from sessions where duration_minutes > 0 and duration_minutes < 600 group by user_name""", "media")
def q_user_watch_stats(spark, sf):
    return M.user_watch_stats(M.watch_sessions(act(spark, sf)))


STOPS_MID = f"event_type = '{M.STOP}' and timestamp >= timestamp '{R_START} 00:00:00' and timestamp <= timestamp '{R_END} 00:00:00'"


@register("watched_list", W + f"""
select item_name as title, user_name as user, device, timestamp as watched_at from media_activity where {STOPS_MID}""", "media")
def q_watched_list(spark, sf):
    return M.watched_list(act(spark, sf), DateRange.of(R_START, R_END, "closed_midnight"))


@register("watched_titles", W + f"""
select item_name as title, user_name as user, device, max(timestamp) as last_watched from media_activity
where {STOPS_MID} group by item_name, user_name, device""", "media")
def q_watched_titles(spark, sf):
    return M.watched_titles(act(spark, sf), DateRange.of(R_START, R_END, "closed_midnight"))


@register("watched_title_count", W + f"""
select count(distinct item_name) as titles from media_activity where {STOPS_MID}""", "media")
def q_watched_title_count(spark, sf):
    return M.watched_title_count(act(spark, sf), DateRange.of(R_START, R_END, "closed_midnight"))


WL = with_views("media_library")


@register("library_summary", WL + """
select item_type, count(*) as items, cast(round(sum(file_size_gb), 2) as double) as size_gb,
  round(cast(sum(community_rating) as double)/count(community_rating), 2) as avg_rating,
  round(cast(sum(runtime_minutes) as double)/count(runtime_minutes), 0) as avg_runtime
from media_library group by item_type""", "media")
def q_library_summary(spark, sf):
    return M.library_summary(lib(spark, sf))


@register("library_totals", WL + """
select item_type, false as is_total, count(*) as items, cast(round(sum(file_size_gb), 2) as double) as size_gb from media_library group by item_type
union all
select null, true, count(*), cast(round(sum(file_size_gb), 2) as double) from media_library""", "media")
def q_library_totals(spark, sf):
    return M.library_totals(lib(spark, sf))


GENRES = "select unnest(string_split(genres, ',')) as genre, community_rating, file_size_gb, name from media_library where genres is not null and genres != ''"


@register("genre_stats", WL + f"""
select genre, count(*) as count, round(cast(sum(community_rating) as double)/count(community_rating), 2) as avg_rating,
  cast(round(sum(file_size_gb), 2) as double) as size_gb
from ({GENRES}) group by genre""", "media")
def q_genre_stats(spark, sf):
    return M.genre_stats(lib(spark, sf))


@register("watched_genres", with_views("media_activity", "media_library") + f"""
select genre, total from (select g.genre, count(*) as total, row_number() over (order by count(*) desc, g.genre) as rn
  from media_activity a join ({GENRES}) g on g.name = a.item_name
  where a.{STOPS_MID.replace('timestamp >=', 'a.timestamp >=').replace('timestamp <=', 'a.timestamp <=')}
  group by g.genre) where rn <= 8""", "media")
def q_watched_genres(spark, sf):
    return M.watched_genres(act(spark, sf), lib(spark, sf), DateRange.of(R_START, R_END, "closed_midnight"))
