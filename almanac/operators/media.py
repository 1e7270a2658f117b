"""Media library and playback activity: watch sessions, per-user stats, library and
genre summaries, watched lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.dates import DateRange
from almanac.functions.numeric import avg_exact, round_half_away
from almanac.operators.common import top_n_per

# Activity event types.
PLAY = "VideoPlayback"
STOP = "VideoPlaybackStopped"

SESSION_COLS = ["user_name", "item_name", "device", "start_time", "stop_time", "duration_minutes"]


def minutes_between(start: str, stop: str) -> Column:
    """Elapsed minutes (epoch seconds / 60, in double) between two timestamp columns;
    ``timestampdiff`` works on wall-clock (NTZ) values, independent of the session zone."""
    micros = F.expr(f"timestampdiff(MICROSECOND, {start}, {stop})")
    return micros.cast("double") / F.lit(1e6) / F.lit(60.0)


def watch_sessions(activity: DataFrame, bucket: str = "day") -> DataFrame:
    """Pair each play with the earliest stop after it that is not later than the
    next play of the same (user, item); unmatched plays are dropped.

    Linear rewrite of the range join: one ordered pass per (user, item, time bucket).
    Rows are ordered by (timestamp, stop before play); walking backwards with a
    running frame gives, for every row, the nearest following stop and play. The
    bucket splits a hot (user, item) across tasks; a per-bucket aggregate (first stop
    and first play of each bucket) carries the answer across bucket boundaries.
    """
    k = ["user_name", "item_name"]
    ev = activity.filter(F.col("event_type").isin(PLAY, STOP) & F.col("user_name").isNotNull() & F.col("item_name").isNotNull()
                         & F.col("timestamp").isNotNull())
    ev = ev.select(*k, "device", "timestamp",
                   (F.col("event_type") == F.lit(PLAY)).alias("is_play"),
                   F.date_trunc(bucket, F.col("timestamp")).alias("bkt"))
    # One shuffle on (user, item, bucket) feeds both the per-bucket carry and the
    # window (the identical exchange is reused): the events are read once.
    ev = ev.repartition(*k, "bkt")
    stop_ts = F.when(~F.col("is_play"), F.col("timestamp"))
    play_ts = F.when(F.col("is_play"), F.col("timestamp"))

    # First stop / play of every later bucket (per key): a small aggregate, then a
    # reverse running minimum over buckets.
    per_bucket = ev.groupBy(*k, "bkt").agg(F.min(stop_ts).alias("b_stop"), F.min(play_ts).alias("b_play"))
    later = Window.partitionBy(*k).orderBy(F.col("bkt").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(*k, "bkt", F.min("b_stop").over(later).alias("c_stop"), F.min("b_play").over(later).alias("c_play"))

    # Within a bucket: nearest following stop / play (reverse order, frame up to the
    # previous row, last non-null = nearest). Running frames are incremental.
    rev = Window.partitionBy(*k, "bkt").orderBy(
        F.col("timestamp").desc(), F.col("is_play").desc(), F.col("device").desc_nulls_first()
    ).rowsBetween(Window.unboundedPreceding, -1)
    plays = ev.select(
        "*",
        F.last(stop_ts, ignorenulls=True).over(rev).alias("n_stop"),
        F.last(play_ts, ignorenulls=True).over(rev).alias("n_play"),
    ).filter(F.col("is_play"))
    j = plays.join(carry, on=[*k, "bkt"], how="left")
    t1 = F.coalesce(F.col("n_stop"), F.col("c_stop"))
    nx = F.coalesce(F.col("n_play"), F.col("c_play"))
    s = j.select(*k, "device", F.col("timestamp").alias("start_time"), t1.alias("stop_time"), nx.alias("nx"))
    s = s.filter(F.col("stop_time").isNotNull() & (F.col("nx").isNull() | (F.col("stop_time") <= F.col("nx"))))
    s = s.dropDuplicates(["user_name", "item_name", "device", "start_time"])
    return s.select(*k, "device", "start_time", "stop_time",
                    round_half_away(minutes_between("start_time", "stop_time"), 1).alias("duration_minutes"))


def user_watch_stats(sessions: DataFrame, max_minutes: float = 600) -> DataFrame:
    """Per user over sessions with 0 < minutes < ``max_minutes``.
    Durations carry one decimal, so they are summed as DECIMAL (exact)."""
    d = F.col("duration_minutes").cast("decimal(18,1)")
    s = sessions.filter((F.col("duration_minutes") > 0) & (F.col("duration_minutes") < max_minutes))
    g = s.groupBy("user_name").agg(
        F.count_distinct("item_name").alias("titles"), F.count(F.lit(1)).alias("sessions"),
        F.sum(d).alias("m"), F.max("start_time").alias("last_session"))
    return g.select("user_name", "titles", "sessions", F.round(F.col("m"), 0).cast("double").alias("minutes"),
                    round_half_away(F.col("m").cast("double") / F.lit(60.0), 1).alias("hours"), "last_session")


def _stops(activity: DataFrame, rng: DateRange) -> DataFrame:
    return activity.filter((F.col("event_type") == STOP) & rng.on_timestamp("timestamp"))


def watched_list(activity: DataFrame, rng: DateRange) -> DataFrame:
    """Stop events of a period (title, user, device, when)."""
    return _stops(activity, rng).select(F.col("item_name").alias("title"), F.col("user_name").alias("user"), "device",
                                        F.col("timestamp").alias("watched_at"))


def watched_titles(activity: DataFrame, rng: DateRange) -> DataFrame:
    """Distinct (title, user, device) watched in a period with the latest time
    (a DISTINCT list ordered by time, expressed as a grouped max)."""
    return _stops(activity, rng).groupBy(F.col("item_name").alias("title"), F.col("user_name").alias("user"), "device").agg(
        F.max("timestamp").alias("last_watched"))


def watched_title_count(activity: DataFrame, rng: DateRange) -> DataFrame:
    """Number of distinct titles stopped in a period."""
    return _stops(activity, rng).agg(F.count_distinct("item_name").alias("titles"))


def library_summary(library: DataFrame) -> DataFrame:
    """Per item type: count, size, mean rating, mean runtime."""
    return library.groupBy("item_type").agg(
        F.count(F.lit(1)).alias("items"), F.round(F.sum("file_size_gb"), 2).cast("double").alias("size_gb"),
        round_half_away(avg_exact("community_rating"), 2).alias("avg_rating"),
        round_half_away(avg_exact("runtime_minutes"), 0).alias("avg_runtime"))


def library_totals(library: DataFrame) -> DataFrame:
    """Item count and size of each type and, with ``is_total``, of the whole library."""
    return library.rollup("item_type").agg(
        (F.grouping("item_type") == 1).alias("is_total"), F.count(F.lit(1)).alias("items"), F.round(F.sum("file_size_gb"), 2).cast("double").alias("size_gb"))


def explode_genres(library: DataFrame) -> DataFrame:
    """Genre CSV -> one row per genre (pieces untrimmed, as stored)."""
    return library.filter(F.col("genres").isNotNull() & (F.col("genres") != "")).withColumn(
        "genre", F.explode(F.split(F.col("genres"), ",")))


def genre_stats(library: DataFrame) -> DataFrame:
    """Per genre: count, mean rating, total size."""
    return explode_genres(library).groupBy("genre").agg(
        F.count(F.lit(1)).alias("count"), round_half_away(avg_exact("community_rating"), 2).alias("avg_rating"),
        F.round(F.sum("file_size_gb"), 2).cast("double").alias("size_gb"))


def watched_genres(activity: DataFrame, library: DataFrame, rng: DateRange, n: int = 8) -> DataFrame:
    """Genres of the items stopped in a period, top ``n`` by count.

    Stops are counted per item name first, so the join sees one row per watched
    item (a hot title costs one row, not its event count); genre counts are then
    the sums of those item counts.
    """
    per_item = _stops(activity, rng).groupBy("item_name").agg(F.count(F.lit(1)).alias("plays"))
    lib = explode_genres(library).select(F.col("name").alias("item_name"), "genre")
    g = per_item.join(lib, "item_name").groupBy("genre").agg(F.sum("plays").alias("total"))
    return top_n_per(g, [], [F.col("total").desc(), F.col("genre")], n)
