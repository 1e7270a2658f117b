"""Landed JSON documents derived from the raw tables, shaped like the feeds the
ingest operators read (pages of <= 100 records, per-user usage maps, status docs).

Pages are keyed by ranges of a unique key (``key div 100``), so every group that is
folded into one document holds at most 100 records whatever the data skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.sources import fixtures as FX
from almanac.sources.tables import table

PAGE = 100


def transaction_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transaction pages per account feed: (account_type, page_no, page_json)."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    rec = F.expr("""named_struct(
        'id', case when o_orderkey % 97 = 0 then null else cast(o_orderkey as string) end,
        'date', case when o_orderkey % 89 = 0 then null else concat(cast(cast(o_orderdate as date) as string), 'T00:00:00.000Z') end,
        'amount', case when o_orderkey % 83 = 0 then null
                  else cast(case when o_orderstatus = 'F' then -o_totalprice else o_totalprice end as decimal(12,2)) end,
        'category', case when o_orderkey % 7 = 0 then '' else o_orderpriority end,
        'description', case when o_orderkey % 5 = 0 then '' else concat('order ', cast(o_orderkey as string)) end,
        'merchant', named_struct('name', c_name))""")
    acct = F.expr("case when o_orderkey % 2 = 0 then 'credit_card' else 'checking_account' end")
    g = j.select(acct.alias("account_type"), F.floor(F.col("o_orderkey") / PAGE).alias("page_no"), rec.alias("r")).groupBy(
        "account_type", "page_no").agg(F.collect_list("r").alias("results"))
    doc = F.to_json(F.struct(F.col("page_no").cast("int").alias("page"), F.lit(True).alias("hasNextPage"), F.col("results")))
    return g.select("account_type", "page_no", doc.alias("page_json"))


def activity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity log pages: (page_no, page_json)."""
    e = table(spark, sf_dir, "events")
    item = F.expr("case when event_id % 7 = 0 then concat('title', cast(event_id % 3 as string), ' em casa') "
                  "else concat('title', cast(event_id % 3 as string)) end")
    typ = F.expr("case event_type when 'view' then 'VideoPlayback' when 'click' then 'VideoPlaybackStopped' "
                 "when 'error' then 'AuthenticationFailed' else 'SessionStarted' end")
    verb = F.expr("case event_type when 'view' then ' está reproduzindo ' when 'click' then ' parou de reproduzir ' else ' abriu ' end")
    name = F.when(F.col("event_id") % 50 == 0, F.lit("entrada ilegível")).otherwise(F.concat(
        F.lit("user"), F.col("user_id").cast("string"), verb, item, F.lit(" em device"), (F.col("user_id") % 4).cast("string")))
    rec = F.struct(F.col("event_id").alias("Id"), typ.alias("Type"), name.alias("Name"),
                   F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("UserId"),
                   F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("Date"),
                   F.lit("Information").alias("Severity"))
    g = e.select(F.floor(F.col("event_id") / PAGE).alias("page_no"), rec.alias("r")).groupBy("page_no").agg(
        F.collect_list("r").alias("Items"))
    return g.select("page_no", F.to_json(F.struct("Items")).alias("page_json"))


def playback_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage reports per (user, month): ``[{user_name, user_usage: {date: minutes}}]`` plus
    the header pseudo-user; a month bounds each map to <= 31 entries."""
    p = FX.load(spark, sf_dir, "media_playback")
    g = p.groupBy("user_name", F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), F.col("minutes_watched")))).alias("user_usage"))
    header = F.struct(F.lit("labels_user").alias("user_name"), F.create_map(F.lit("date"), F.lit(1)).alias("user_usage"))
    doc = F.to_json(F.array(header, F.struct("user_name", "user_usage")))
    return g.select("user_name", "month", doc.alias("usage_json"))


def library_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media item pages built from ``part``: (page_no, page_json)."""
    p = table(spark, sf_dir, "part")
    streams = F.expr("""case when p_partkey % 13 = 0 then null else array(named_struct(
        'Size', p_partkey * 1000003, 'Container', 'mkv',
        'MediaStreams', case when p_partkey % 5 = 0 then array(
              named_struct('Type', 'Video', 'Codec', '', 'Width', 640, 'Height', 360),
              named_struct('Type', 'Video', 'Codec', 'hevc', 'Width', 1920, 'Height', 1080),
              named_struct('Type', 'Audio', 'Codec', 'aac', 'Width', cast(null as int), 'Height', cast(null as int)))
            else array(
              named_struct('Type', 'Video', 'Codec', 'h264', 'Width', case when p_partkey % 7 = 0 then 0 else 1280 end, 'Height', 720),
              named_struct('Type', 'Audio', 'Codec', 'ac3', 'Width', cast(null as int), 'Height', cast(null as int))) end)) end""")
    rec = F.struct(
        F.col("p_partkey").cast("string").alias("Id"), F.concat(F.lit("title"), F.col("p_partkey").cast("string")).alias("Name"),
        (F.lit(1950) + F.col("p_size")).alias("ProductionYear"), ((F.col("p_partkey") % 101) / 10.0).alias("CommunityRating"),
        F.lit("PG").alias("OfficialRating"), F.split("p_name", " ").alias("Genres"),
        F.expr("case when p_partkey % 11 = 0 then 0 else cast(p_size as bigint) * 3 * 600000000 + p_partkey * 1000 end").alias("RunTimeTicks"),
        F.array(F.struct(F.col("p_brand").alias("Name"))).alias("Studios"), F.col("p_type").alias("Overview"),
        F.lit("2023-05-04T10:11:12.1234567Z").alias("DateCreated"), F.lit("2001-02-03T00:00:00.0000000Z").alias("PremiereDate"),
        F.lit(None).cast("string").alias("SeriesName"), F.lit(None).cast("string").alias("SeasonName"),
        F.lit(None).cast("int").alias("IndexNumber"), streams.alias("MediaSources"))
    g = p.select(F.floor(F.col("p_partkey") / PAGE).alias("page_no"), rec.alias("r")).groupBy("page_no").agg(
        F.collect_list("r").alias("Items"))
    return g.select("page_no", F.to_json(F.struct("Items")).alias("page_json"))


def _srt_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subtitle block per turn (index turn+1, a time line, the turn text): (conv_id, file, turn, b)."""
    c = table(spark, sf_dir, "conversations")
    ts = F.concat(F.lit("00:00:"), F.col("turn").cast("string"), F.lit(",000 --> 00:00:"), F.col("turn").cast("string"), F.lit(",900"))
    blk = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n"), ts, F.lit("\n"), F.col("text"), F.lit("\n"))
    file = F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit(".en.srt"))
    return c.select("conv_id", file.alias("file"), "turn", blk.alias("b"))


def _srt_lines(body: Column) -> Column:
    """Even conversations use CRLF."""
    return F.when(F.col("conv_id") % 2 == 0, F.replace(body, F.lit("\n"), F.lit("\r\n"))).otherwise(body)


def srt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle files built from conversations, landed block by block: (file, turn,
    content). A file's contents in order of turn are its text, so no row and no group
    holds a conversation."""
    t = _srt_turns(spark, sf_dir)
    return t.select("file", "turn", _srt_lines(F.concat(F.col("b"), F.lit("\n"))).alias("content"))


def srt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files, each as one text value: a conversation is held whole. For small
    inputs; the registered queries read ``srt_blocks``."""
    g = _srt_turns(spark, sf_dir).groupBy("conv_id", "file").agg(F.array_sort(F.collect_list(F.struct("turn", "b"))).alias("_b"))
    body = F.array_join(F.transform("_b", lambda e: e["b"]), "\n")
    return g.select("file", _srt_lines(body).alias("content"))


def srt_translations(blocks: DataFrame) -> DataFrame:
    """Translation results for parsed blocks: a batch answer (missing for whole files
    whose batch call failed, blank or quote-flooded for some lines) and a single-line
    retry answer."""
    conv = F.regexp_extract(F.col("file"), r"conv([0-9]+)", 1).cast("bigint")
    pos = F.col("pos")
    batch = (F.when(conv % 5 == 0, F.lit(None).cast("string")).when(pos % 4 == 0, F.concat(F.lit("PT: "), F.col("text")))
             .when(pos % 4 == 1, F.lit("")).when(pos % 4 == 2, F.repeat(F.lit('"x" '), 40)).otherwise(F.concat(F.lit("BR: "), F.col("text"))))
    retry = F.when(pos % 3 == 0, F.concat(F.lit("["), F.col("text"), F.lit("]"))).otherwise(F.lit(""))
    return blocks.withColumn("batch_text", batch).withColumn("retry_text", retry)


def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a chat model, built from the turns: (conv_id, turn, text). Five of six hold something like a JSON
    object: in noise, with an unknown action, cut, with a blank action, with nested and null fields."""
    t = table(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 6
    text, conv, turn = F.col("text"), F.col("conv_id").cast("string"), F.col("turn").cast("string")
    return t.select("conv_id", "turn", F.when(kind == 1, F.concat(text, F.lit(' {"action": "arr_search_movie", "query": "q'), conv, F.lit('"} ok')))
                    .when(kind == 2, F.concat(F.lit('{"action": "fly", "id": '), turn, F.lit("} "), text))
                    .when(kind == 3, F.concat(text, F.lit(' {"action": }')))
                    .when(kind == 4, F.concat(F.lit('x {"id": "i'), conv, F.lit('",\n "action": ""} y')))
                    .when(kind == 5, F.concat(F.lit('{"action": "help", "query": null, "nested": {"a": '), turn, F.lit("}}")))
                    .otherwise(text).alias("text"))


def service_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service error log built from events: (service, timestamp, line)."""
    e = table(spark, sf_dir, "events")
    line = (F.when(F.col("value") >= 45, F.lit("Gateway connect failed: ECONNREFUSED"))
            .when(F.col("value") >= 40, F.lit("tick timeout after 30s"))
            .when(F.col("event_type") == "error", F.lit("warn: retrying"))
            .otherwise(F.lit("ok")))
    return e.select(F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("service"), F.col("ts").alias("timestamp"),
                    line.alias("line"))


def raw_job_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job logs as their files hold them: (log, line_no, line), ten events a run. Every thirteenth run has no
    exit line; a line before the first marker of a run is output outside of runs."""
    e = table(spark, sf_dir, "events")
    run, step = F.expr("event_id div 10"), F.col("event_id") % 10
    stamp = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z] "))
    line = (F.when(step == 0, F.lit("output outside of runs"))
            .when(step == 1, F.concat(stamp, F.lit("Starting: job"), (run % 7).cast("string")))
            .when((step == 9) & (run % 13 != 0), F.concat(stamp, F.lit("Exit: "), F.greatest(run % 4 - 1, F.lit(0)).cast("string"), F.lit(" ("), (run % 600).cast("string"), F.lit("s)")))
            .when((run % 3 == 0) & (step == 4), F.concat(F.lit("0 errors found in "), F.col("event_id").cast("string")))
            .when((run % 5 == 0) & (step == 6), F.concat(F.lit("ERRO: falha "), F.repeat(F.lit("é"), (run % 120).cast("int")), F.lit(" "), F.col("event_id").cast("string")))
            .otherwise(F.concat(F.lit("rows "), F.col("event_id").cast("string"))))
    return e.select(F.concat(F.lit("log"), (run % 3).cast("string")).alias("log"), F.col("event_id").alias("line_no"), line.alias("line"))


def forecast_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One forecast document per day, built from that day's events: current
    conditions from the first hours, eight 3-hourly rain chances from event counts."""
    e = table(spark, sf_dir, "events").withColumn("date", F.col("ts").cast("date"))
    slot = (F.floor(F.hour("ts") / 3) * 300).cast("int")
    hourly = e.groupBy("date", slot.alias("time")).agg(((F.count(F.lit(1)) * 7) % 100).cast("int").alias("chance"))
    h = hourly.groupBy("date").agg(F.array_sort(F.collect_list(F.struct(F.col("time"), F.col("chance")))).alias("_h"))
    day = e.groupBy("date").agg(F.round(F.avg("value"), 0).cast("int").alias("t"), F.floor(F.max("value")).cast("int").alias("mx"),
                                 F.floor(F.min("value")).cast("int").alias("mn"), F.count(F.lit(1)).alias("n"))
    j = day.join(h, "date")
    doc = F.struct(
        F.array(F.struct(F.col("t").cast("string").alias("temp_C"), (F.col("t") - 2).cast("string").alias("FeelsLikeC"),
                         (F.col("n") % 100).cast("string").alias("humidity"),
                         F.array(F.struct(F.when(F.col("n") % 2 == 0, F.lit("Parcialmente nublado")).otherwise(F.lit("Chuva fraca")).alias("value"))).alias("lang_pt"),
                         F.array(F.struct(F.lit("Partly cloudy").alias("value"))).alias("weatherDesc"))).alias("current_condition"),
        F.array(F.struct(F.col("mx").cast("string").alias("maxtempC"), F.col("mn").cast("string").alias("mintempC"),
                         (F.col("n") % 11).cast("string").alias("uvIndex"),
                         F.transform("_h", lambda x: F.struct(x["time"].cast("string").alias("time"), x["chance"].cast("string").alias("chanceofrain"))).alias("hourly"))).alias("weather"))
    return j.select("date", F.to_json(doc).alias("forecast_json"))


def account_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account documents (balance, credit limit) built from customers."""
    c = table(spark, sf_dir, "customer")
    lim = F.when(F.col("c_custkey") % 10 == 0, F.lit(0.0)).otherwise(F.abs(F.col("c_acctbal")) * 3 + 100)
    doc = F.to_json(F.struct(F.col("c_acctbal").alias("balance"), F.struct(lim.alias("limit")).alias("creditData")))
    return c.select(F.col("c_custkey").alias("account_id"), doc.alias("account_json"))
