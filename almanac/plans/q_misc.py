"""Registered queries for job logs, file selection, routing, intents and subtitles."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import jobs as JB
from almanac.operators import routing as RT
from almanac.operators import subtitles as SB
from almanac.plans.registry import register, with_views
from almanac.sources import fixtures as FX
from almanac.sources import landing as L
from almanac.sources.tables import table

ERR = "regexp_matches(line, '(?i)error|falha|exception|errno')"


@register("run_report", with_views("job_log") + f"""
select job, run_id, count(*) as lines, count(*) filter (where {ERR}) as error_lines,
  case when count(*) filter (where {ERR}) > 0 then 'failure' else 'success' end as status,
  left(coalesce(arg_max(line, line_no) filter (where {ERR}), arg_max(line, line_no)), 200) as message
from job_log group by job, run_id""", "jobs")
def q_run_report(spark, sf):
    return JB.run_report(FX.load(spark, sf, "job_log"))


@register("run_outcomes", """
with r as (select event_id // 10 as run, min(event_id) as first, max(event_id) as last, max(case when event_id % 10 = 1 then event_id end) as start_line,
    list_sort(list(event_id) filter (where event_id % 10 between 2 and 8 or event_id % 10 = 9 and (event_id // 10) % 13 = 0)) as own
  from events group by event_id // 10),
t as (select *, run % 13 <> 0 and list_contains(list_value(last % 10), 9) as ended,
    list_filter(own, lambda x: (run % 3 = 0 and x % 10 = 4) or (run % 5 = 0 and x % 10 = 6)) as errors from r where start_line is not null),
m as (select *, coalesce(errors[-1], own[-1]) as line_no from t)
select 'log' || (run % 3) as log, start_line, 'job' || (run % 7) as job,
  case when ended then cast(greatest(run % 4 - 1, 0) as int) end as exit_code, case when ended then run % 600 end as seconds,
  case when not ended then 'unfinished' when run % 4 <= 1 then 'success' else 'failure' end as type,
  case when ended and run % 4 > 1 then
    case when run % 3 = 0 and line_no % 10 = 4 then '0 errors found in ' || line_no
         when run % 5 = 0 and line_no % 10 = 6 then 'ERRO: falha ' ||
           case when run % 120 > 94 then repeat('é', 94) else repeat('é', cast(run % 120 as int)) || ' ' || line_no end
         else 'rows ' || line_no end end as message
from m""", "jobs")
def q_run_outcomes(spark, sf):
    return JB.run_outcomes(L.raw_job_logs(spark, sf))


MIN_BYTES, MIN_AGE_H = 1500 * 1024 * 1024, 10
CAND_SQL = f"""select * from file_inventory
where lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '(\\.[^.]*)$', 1)) in ('.mkv','.mp4','.m4v','.avi','.mov','.ts','.wmv')
  and not starts_with(regexp_extract(path, '([^/]*)$', 1), '.') and not contains(path, '.oc-tmp') and not contains(path, '.oc-bak')
  and not ends_with(path, '.part') and size >= {MIN_BYTES} and age_hours >= {MIN_AGE_H}"""


def _candidates(spark, sf):
    c = JB.file_candidates(FX.load(spark, sf, "file_inventory"), MIN_BYTES, MIN_AGE_H)
    return c.withColumn("sig", JB.signature(F.col("age_hours"), F.col("size")))


def _state(spark, sf):
    """File state derived from the inventory, one record per file: done / error /
    done-with-an-old-signature / queued (not terminal)."""
    inv = FX.load(spark, sf, "file_inventory").withColumn("k", F.regexp_extract("path", r"([0-9]+)", 1).cast("bigint"))
    return inv.select(
        "path",
        F.when(F.col("k") % 4 == 2, JB.signature(F.col("age_hours"), F.col("size") + 1)).otherwise(
            JB.signature(F.col("age_hours"), F.col("size"))).alias("sig"),
        F.when(F.col("k") % 4 == 1, F.lit("error")).when(F.col("k") % 4 == 3, F.lit("queued")).otherwise(F.lit("done")).alias("status"))


@register("file_candidates", with_views("file_inventory") + CAND_SQL, "jobs")
def q_file_candidates(spark, sf):
    return JB.file_candidates(FX.load(spark, sf, "file_inventory"), MIN_BYTES, MIN_AGE_H)


PENDING_SQL = f"""select c.*, cast(c.age_hours as varchar) || ':' || cast(c.size as varchar) as sig from ({CAND_SQL}) c
where cast(regexp_extract(c.path, '([0-9]+)', 1) as bigint) % 4 <> 0"""


@register("pending_files", with_views("file_inventory") + PENDING_SQL, "jobs")
def q_pending_files(spark, sf):
    return JB.pending_files(_candidates(spark, sf), _state(spark, sf))


def _outcomes(spark, sf):
    p = JB.pending_files(_candidates(spark, sf), _state(spark, sf))
    k = F.regexp_extract("path", r"([0-9]+)", 1).cast("bigint")
    p = p.withColumn("new_bytes", F.floor(F.col("size") * (F.lit(5) + k % 7) / 10).cast("bigint")).withColumn(
        "error", F.when(k % 11 == 0, F.lit("transcode_failed")))
    o = JB.transcode_outcome(F.col("size"), F.col("new_bytes"), F.col("codec"), F.col("error"))
    return p.select("path", "sig", "codec", F.col("size").alias("old_bytes"), "new_bytes", o["status"].alias("status"),
                    o["saved_pct"].alias("saved_pct"))


OUTCOME_SQL = f"""select path, sig, codec, size as old_bytes, new_bytes,
  case when k % 11 = 0 then 'error' when lower(codec) in ('hevc', 'av1') then 'skip_codec'
       when new_bytes >= floor(size * 0.97) then 'skip_not_smaller' else 'done' end as status,
  case when k % 11 = 0 or lower(codec) in ('hevc', 'av1') or new_bytes >= floor(size * 0.97) then null
       else round((1.0 - new_bytes / size) * 100, 2) end as saved_pct
from (select *, cast(floor(size * (5 + k % 7) / 10) as bigint) as new_bytes
      from (select *, cast(regexp_extract(path, '([0-9]+)', 1) as bigint) as k from ({PENDING_SQL})))"""


@register("transcode_outcomes", with_views("file_inventory") + OUTCOME_SQL, "jobs")
def q_transcode_outcomes(spark, sf):
    return _outcomes(spark, sf)


@register("batch_summary", with_views("file_inventory") + f"""
select count(*) as processed, count(*) filter (where status = 'done') as transcoded,
  count(*) filter (where starts_with(status, 'skip')) as skipped, count(*) filter (where status = 'error') as errors
from ({OUTCOME_SQL})""", "jobs")
def q_batch_summary(spark, sf):
    return JB.batch_summary(_outcomes(spark, sf))


# ---------------------------------------------------------------- routing (J6, P24, ST3 batch twin)
DEFAULT_URLS = ["json://fallback.example/notify"]


def _routes(spark, sf):
    """Route table for every user seen in events; a third of them have destinations,
    the others an empty list (ignored by the router, as an empty map entry is)."""
    e = table(spark, sf, "events").select("user_id").distinct()
    dest = F.concat(F.lit("mailto://user"), F.col("user_id").cast("string"), F.lit("@example.org"))
    return e.select(F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("user"),
                    F.when(F.col("user_id") % 3 == 0, F.array(dest)).otherwise(F.array().cast("array<string>")).alias("urls"))


@register("route_notifications", with_views("notification_raw") + f"""
, e as (select event_id, timestamp, e2.user_id, e2.event_type, event_id % 6 as c from notification_raw n join events e2 using (event_id)),
r as (select *, case c when 0 then '@User' || user_id when 1 then 'user' || user_id when 2 then 'user' || user_id
                       when 3 then 'user' || user_id else null end as requester from e)
select event_id, timestamp, requester,
  case when requester is not null and user_id % 3 = 0 then ['mailto://user' || user_id || '@example.org'] else ['{DEFAULT_URLS[0]}'] end as urls,
  requester is not null and user_id % 3 = 0 as direct, not (requester is not null and user_id % 3 = 0) as fallback,
  case c when 0 then 't' when 2 then '{RT.APP_NAME} | ' || event_type else '{RT.APP_NAME}' end as title,
  case c when 2 then 'message: Requested by @user' || user_id || ' today | event: ' || event_type
         when 4 then 'subject: no requester | media_type: movie' else '{RT.DEFAULT_BODY}' end as body,
  'info' as type, 'text' as format,
  case when requester is null then 'media' else 'media,requester-user' || user_id end as tag
from r""".replace("\n, e as", ", e as", 1), "routing")
def q_route_notifications(spark, sf):
    return RT.outgoing_messages(FX.load(spark, sf, "notification_raw"), _routes(spark, sf), DEFAULT_URLS)


@register("extract_intent", """
with a as (select conv_id, turn, case (conv_id + turn) % 6 when 1 then text || ' {"action": "arr_search_movie", "query": "q' || conv_id || '"} ok'
    when 2 then '{"action": "fly", "id": ' || turn || '} ' || text when 3 then text || ' {"action": }'
    when 4 then 'x {"id": "i' || conv_id || '",' || chr(10) || ' "action": ""} y' when 5 then '{"action": "help", "query": null, "nested": {"a": ' || turn || '}}'
    else text end as text from conversations),
x as (select conv_id, turn, regexp_extract(text, '\\{[\\s\\S]*\\}', 0) as obj from a),
y as (select conv_id, turn, case when obj <> '' and json_valid(obj) and json_type(obj) = 'OBJECT' then obj end as j from x)
select conv_id, turn,
  case when j is not null and coalesce(nullif(j->>'action', ''), 'none') in ('""" + "','".join(RT.ACTIONS) + """')
       then coalesce(nullif(j->>'action', ''), 'none') else 'none' end as action,
  case when j is not null then coalesce(j->>'query', '') else '' end as query,
  case when j is not null then coalesce(j->>'id', '') else '' end as id
from y""", "routing")
def q_extract_intent(spark, sf):
    c = L.chat_answers(spark, sf)
    i = RT.extract_intent(F.col("text"))
    return c.select("conv_id", "turn", *[v.alias(k) for k, v in i.items()])


# ---------------------------------------------------------------- subtitles
SRT_BLOCKS = """select 'conv' || conv_id || '.en.srt' as file,
  conv_id, cast(row_number() over (partition by conv_id order by turn) - 1 as integer) as pos, cast(turn + 1 as int) as idx,
  '00:00:' || turn || ',000 --> 00:00:' || turn || ',900' as ts, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text
from conversations"""


def _blocks(spark, sf):
    return SB.read_srt(L.srt_blocks(spark, sf), order_col="turn")


@register("read_srt", f"select file, pos, idx, ts, text from ({SRT_BLOCKS})", "subtitles")
def q_read_srt(spark, sf):
    return _blocks(spark, sf)


def _bad(src, tr):
    s = f"regexp_replace(coalesce({src}, ''), '^\\s+|\\s+$', '', 'g')"
    t = f"regexp_replace(coalesce({tr}, ''), '^\\s+|\\s+$', '', 'g')"
    return (f"(length({t}) = 0 or contains({s}, '{SB.CREDIT_LINE}') or (length({s}) < 45 and length({t}) > 180)"
            f" or length({t}) > greatest(320, 5 * greatest(1, length({s})))"
            f" or (length({t}) - length(replace({t}, '\"', '')) >= 6 and length({t}) > 140))")


RESOLVED = f"""with b as ({SRT_BLOCKS}),
t as (select *, case when conv_id % 5 = 0 then null when pos % 4 = 0 then 'PT: ' || text when pos % 4 = 1 then ''
                     when pos % 4 = 2 then repeat('"x" ', 40) else 'BR: ' || text end as batch_text,
                case when pos % 3 = 0 then '[' || text || ']' else '' end as retry_text from b),
r as (select *, not {_bad('text', 'batch_text')} as b_ok, not {_bad('text', 'retry_text')} as r_ok from t),
f as (select *, case when b_ok then regexp_replace(batch_text, '^\\s+|\\s+$', '', 'g') when r_ok then retry_text else text end as final_text,
             (not b_ok) and r_ok as used_retry, (not b_ok) and (not r_ok) as used_fallback, cast(floor(pos / 20) as int) as batch from r)
"""


def _resolved(spark, sf):
    return SB.translation_resolve(SB.chunk(L.srt_translations(_blocks(spark, sf))))


@register("translation_resolve", RESOLVED + """
select file, pos, idx, ts, text, batch_text, retry_text, batch, final_text, used_retry, used_fallback from f""", "subtitles")
def q_translation_resolve(spark, sf):
    return _resolved(spark, sf).select("file", "pos", "idx", "ts", "text", "batch_text", "retry_text", "batch",
                                       "final_text", "used_retry", "used_fallback")


@register("translation_progress", RESOLVED + """
, pb as (select file, batch, count(*) as n, count(*) filter (where used_retry) as r, count(*) filter (where used_fallback) as fb,
   count(*) filter (where batch_text is not null) as got from f group by file, batch)
select file, cast(sum(n) as bigint) as done, cast(sum(n) as bigint) as total, cast(sum(r) as bigint) as retry,
  cast(sum(fb) as bigint) as fallback, count(*) filter (where got = 0) as errors
from pb group by file""".replace("\n, pb as", ", pb as", 1), "subtitles")
def q_translation_progress(spark, sf):
    return SB.translation_progress(_resolved(spark, sf))


@register("translation_checkpoint", RESOLVED + """
, n as (select file, any_value(conv_id) as conv_id, count(*) as total from f group by file),
d as (select file, total, case when conv_id % 7 = 0 and total > 6 then 6 else total end as done from n),
pb as (select file, floor(pos / 2) as b, count(*) filter (where used_retry) as r, count(*) filter (where used_fallback) as fb,
   count(*) filter (where batch_text is not null) as got from f join d using (file) where pos < done group by file, b)
select file, cast(done as bigint) as done, total, count(*) filter (where got = 0) as errors, cast(sum(r) as bigint) as retry,
  cast(sum(fb) as bigint) as fallback, case when done = total then 'done' end as status
from d join pb using (file) group by file, done, total""".replace("\n, n as", ", n as", 1), "subtitles")
def q_translation_checkpoint(spark, sf):
    """Two runs: the first ends after four blocks of a file, the second loses a batch of every seventh conversation."""
    blocks = _blocks(spark, sf)
    done = SB.translation_resolve(SB.chunk(L.srt_translations(blocks), 2))
    conv = F.regexp_extract(F.col("file"), r"conv([0-9]+)", 1).cast("bigint")
    first = SB.translation_checkpoint(blocks, done.filter(F.col("pos") < 4))
    return SB.translation_checkpoint(blocks, done.filter((F.col("pos") >= 4) & ~((conv % 7 == 0) & (F.col("batch") == 3))), first)


@register("write_srt", RESOLVED + """
select file, string_agg(cast(idx as varchar) || chr(10) || ts || chr(10) || final_text || chr(10), chr(10) order by pos) as content
from f group by file""", "subtitles")
def q_write_srt(spark, sf):
    return SB.write_srt(_resolved(spark, sf))


@register("resume_point", f"""
with b as ({SRT_BLOCKS}),
p as (select file, idx from b where pos < conv_id % 5 + 1 and not (conv_id % 6 = 0 and pos = 1)),
j as (select b.*, p.idx is not null as have from b left join p using (file, idx)),
g as (select file, any_value(conv_id) as conv_id, count(*) as total, coalesce(min(case when not have then pos end), count(*)) as prefix
      from j group by file)
select file, total, prefix, greatest(prefix, conv_id % 3) as resume_from from g""", "subtitles")
def q_resume_point(spark, sf):
    b = _blocks(spark, sf)
    conv = F.regexp_extract(F.col("file"), r"conv([0-9]+)", 1).cast("bigint")
    partial = b.filter((F.col("pos") < conv % 5 + 1) & ~((conv % 6 == 0) & (F.col("pos") == 1)))
    ckpt = b.select("file", (conv % 3).alias("done")).distinct()
    return SB.resume_point(b, partial, ckpt)


# ---------------------------------------------------------------- alerts (ST4 batch twin)
from almanac.operators import alerts as AL  # noqa: E402

SERVICE_LOG = """select 'svc' || cast(user_id % 5 as varchar) as service, ts as timestamp,
  case when value >= 45 then 'Gateway connect failed: ECONNREFUSED' when value >= 40 then 'tick timeout after 30s'
       when event_type = 'error' then 'warn: retrying' else 'ok' end as line from events"""


@register("alert_cooldown", f"""
with recursive e as (select distinct service, date_trunc('second', timestamp) as ts from ({SERVICE_LOG})
                     where regexp_matches(line, '(?i)tick timeout|device nonce required|gateway connect failed')),
a(service, ts) as (
  select service, min(ts) from e group by service
  union all
  select a.service, greatest((select min(e.ts) from e where e.service = a.service and e.ts > a.ts
                              and (e.ts >= a.ts + interval 180 second or e.ts >= a.ts + interval 180 second - interval 300 second)),
                             case when exists (select 1 from e where e.service = a.service and e.ts > a.ts) then a.ts + interval 180 second end)
  from a where a.ts is not null)
select service, ts as alert_ts from a where ts is not null""", "alerts")
def q_alert_cooldown(spark, sf):
    return AL.alert_cooldown(L.service_log(spark, sf))


# ---------------------------------------------------------------- briefing, weather, accounts, JSON rows
from almanac.operators import briefing as BR  # noqa: E402
from almanac.sources import ingest as ING  # noqa: E402
from almanac.sources import sinks as SK  # noqa: E402


@register("daily_briefing", None, "briefing")
def q_daily_briefing(spark, sf):
    w = ING.ingest_weather(L.forecast_docs(spark, sf))
    return BR.daily_briefing(FX.load(spark, sf, "telemetry"), w, FX.AS_OF_EVENTS, "EV")


@register("ingest_weather", """
with h as (select cast(ts as date) as date, cast(floor(hour(ts) / 3) * 300 as int) as time,
                  cast((count(*) * 7) % 100 as int) as chance from events group by 1, 2),
d as (select cast(ts as date) as date, cast(round(avg(value), 0) as int) as t, cast(floor(max(value)) as int) as mx,
             cast(floor(min(value)) as int) as mn, count(*) as n from events group by 1)
select d.date, cast(t as varchar) as temp, cast(t - 2 as varchar) as feels_like, cast(n % 100 as varchar) as humidity,
  case when n % 2 = 0 then 'Parcialmente nublado' else 'Chuva fraca' end as description,
  cast(mx as varchar) as max, cast(mn as varchar) as min, cast(n % 11 as varchar) as uv,
  (select count(*) from h where h.date = d.date and chance >= 40 and time // 100 between 6 and 22) as rain_slots,
  (select min(time // 100) from h where h.date = d.date and chance >= 40 and time // 100 between 6 and 22) as first_rain_hour
from d""", "briefing")
def q_ingest_weather(spark, sf):
    w = ING.ingest_weather(L.forecast_docs(spark, sf))
    return w.select("date", "temp", "feels_like", "humidity", "description", "max", "min", "uv",
                    F.size("rain_hours").cast("bigint").alias("rain_slots"), "first_rain_hour")


@register("credit_utilisation", """
select c_custkey as account_id, case when c_custkey % 10 = 0 then 0.0 else abs(c_acctbal) * 3 + 100 end as "limit",
  abs(c_acctbal) as used,
  case when c_custkey % 10 = 0 then 0.0 else abs(c_acctbal) / (abs(c_acctbal) * 3 + 100) * 100 end as utilisation_pct
from customer""", "briefing")
def q_credit_utilisation(spark, sf):
    return ING.credit_utilisation(L.account_docs(spark, sf))


@register("tx_monthly_json", None, "sinks")
def q_tx_monthly_json(spark, sf):
    from almanac.operators.transactions import tx_monthly_summary
    return SK.to_json_rows(tx_monthly_summary(FX.load(spark, sf, "transactions")))


@register("file_state_update", with_views("file_inventory") + f"""
, st as (select path, case when k % 4 = 2 then cast(age_hours as varchar) || ':' || cast(size + 1 as varchar)
                           else cast(age_hours as varchar) || ':' || cast(size as varchar) end as sig,
                case when k % 4 = 1 then 'error' when k % 4 = 3 then 'queued' else 'done' end as status
         from (select *, cast(regexp_extract(path, '([0-9]+)', 1) as bigint) as k from file_inventory)),
o as ({OUTCOME_SQL.replace("select path, sig, codec", "select path, sig, codec", 1)})
select path, sig, status from st where path not in (select path from o)
union all select path, sig, status from o""".replace("\n, st as", ", st as", 1), "jobs")
def q_file_state_update(spark, sf):
    res = _outcomes(spark, sf).select("path", "sig", "status", F.lit(1).alias("seq"))
    return JB.file_state_update(_state(spark, sf), res)
