"""Job runs, file selection and file-state bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.numeric import py_round
from almanac.functions.text import truncate_bytes

# Lines that count as the error of a failed run; message cut in bytes.
ERROR_LINE = r"(?i)error|falha|exception|errno"
MESSAGE_BYTES = 200
# Eligible file extensions, codecs that are already compressed,
# terminal statuses and the "not smaller" ratio.
VIDEO_EXTS = [".mkv", ".mp4", ".m4v", ".avi", ".mov", ".ts", ".wmv"]
ALREADY_COMPRESSED = ["hevc", "av1"]
TERMINAL_STATUSES = ["done", "skip_codec", "skip_not_smaller"]
NOT_SMALLER_RATIO = 0.97


def run_report(log: DataFrame) -> DataFrame:
    """Per job run: lines, the last line matching the error pattern (else the
    last line) cut to 200 bytes, status, duration when start/end are present.
    ``max(struct(line_no, line))`` is a partial aggregate: a huge run never sits in
    one task."""
    err = F.col("line").rlike(ERROR_LINE)
    g = log.groupBy("job", "run_id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(err).alias("error_lines"),
        F.max(F.when(err, F.struct("line_no", "line"))).alias("_e"), F.max(F.struct("line_no", "line")).alias("_l"))
    msg = F.coalesce(F.col("_e.line"), F.col("_l.line"))
    return g.select("job", "run_id", "lines", "error_lines",
                    F.when(F.col("error_lines") > 0, F.lit("failure")).otherwise(F.lit("success")).alias("status"),
                    truncate_bytes(msg, MESSAGE_BYTES).alias("message"))


#: The lines around a run's output, with the job's name, exit code and seconds.
START_LINE = r"^\[[^\]]*\] Starting: (.*)$"
EXIT_LINE = r"^\[[^\]]*\] Exit: (\d+) \((\d+)s\)$"
#: Lines that one window orders.
LINES = 10_000


def run_outcomes(log: DataFrame) -> DataFrame:
    """A42 from raw logs: (log, line_no, line) -> one row a run: log, line_no of its start, job, exit_code,
    seconds, type, message. A run reaches from a ``Starting`` line to the next marker; what decides is the exit
    code (0 is ``success`` whatever the output says, other codes are ``failure``); a run without an ``Exit`` line before the
    next start or the end is ``unfinished``. The message of a failure is its last line that matches the error
    pattern, else its last line, cut to 200 bytes; lines outside of runs belong to none.

    Runs are islands: every line takes the marker before it, from a window over ``LINES`` lines and, where there
    is none, the last marker of the earlier ranges. No task orders a whole log."""
    l = log.select("log", "line_no", "line", F.floor(F.col("line_no") / LINES).alias("_r"))  # noqa: E741
    starts, ends = F.col("line").rlike(START_LINE), F.col("line").rlike(EXIT_LINE)
    l = l.withColumn("_m", F.when(starts | ends, F.struct("line_no", starts.alias("start"))))
    last = l.groupBy("log", "_r").agg(F.max("_m").alias("_last"))
    earlier = Window.partitionBy("log").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select("log", "_r", F.max("_last").over(earlier).alias("_carry"))
    before = Window.partitionBy("log", "_r").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    l = l.withColumn("_near", F.last("_m", ignorenulls=True).over(before)).join(carry, ["log", "_r"])
    at = F.coalesce("_near", "_carry")
    run = F.when(starts, F.col("line_no")).when(at["start"], at["line_no"])
    code = F.when(ends & ~starts, F.struct(F.regexp_extract("line", EXIT_LINE, 1).try_cast("int").alias("exit_code"), F.regexp_extract("line", EXIT_LINE, 2).try_cast("bigint").alias("seconds")))
    text = F.when(~starts & ~ends, F.struct("line_no", "line"))
    error = F.when(F.col("line").rlike(ERROR_LINE), text)
    g = l.withColumn("start_line", run).where("start_line is not null").groupBy("log", "start_line").agg(
        F.max(F.when(starts, F.regexp_extract("line", START_LINE, 1))).alias("job"), F.max(code).alias("_c"), F.max(error).alias("_e"), F.max(text).alias("_l"))
    kind = F.when(F.col("_c").isNull(), F.lit("unfinished")).when(F.col("_c.exit_code") == 0, F.lit("success")).otherwise(F.lit("failure"))
    message = F.when(kind == "failure", truncate_bytes(F.coalesce(F.col("_e.line"), F.col("_l.line")), MESSAGE_BYTES))
    return g.select("log", "start_line", "job", F.col("_c.exit_code").alias("exit_code"), F.col("_c.seconds").alias("seconds"), kind.alias("type"), message.alias("message"))


def _ext(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def file_candidates(inv: DataFrame, min_bytes: int, min_age_hours: float) -> DataFrame:
    """P20: video files big and old enough, not hidden/temporary/backup/partial."""
    name = F.regexp_extract(F.col("path"), r"([^/]*)$", 1)
    ok = (_ext(F.col("path")).isin(*VIDEO_EXTS) & ~name.startswith(".") & ~name.contains(".oc-tmp")
          & ~name.contains(".oc-bak") & ~name.endswith(".part") & (F.col("size") >= min_bytes) & (F.col("age_hours") >= min_age_hours))
    return inv.filter(ok)


def signature(mtime: Column, size: Column) -> Column:
    """``<mtime>:<size>`` state signature; ``mtime`` in whole seconds, as a number or as the text of a number."""
    return F.concat(mtime.cast("bigint").cast("string"), F.lit(":"), size.cast("string"))


def mtime_seconds(mtime: Column) -> Column:
    """Whole seconds since 1970 of a wall-clock time, as ``sources.files.file_inventory`` gives it."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), mtime)


def pending_files(candidates: DataFrame, state: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates minus those whose state has the same signature and a terminal
    status; oldest first, first ``limit``."""
    done = state.filter(F.col("status").isin(*TERMINAL_STATUSES)).select("path", "sig")
    p = candidates.join(done, ["path", "sig"], "left_anti")
    if limit is not None:
        p = p.orderBy(F.col("age_hours").desc(), F.col("path")).limit(limit)
    return p


def transcode_outcome(old_bytes: Column, new_bytes: Column, codec: Column, error: Column, dry_run: bool = False) -> dict[str, Column]:
    """Status and saved % of one processed file."""
    threshold = F.floor(old_bytes.cast("double") * F.lit(NOT_SMALLER_RATIO))
    status = (F.when(error.isNotNull(), F.lit("error"))
              .when(F.lower(codec).isin(*ALREADY_COMPRESSED), F.lit("skip_codec"))
              .when(F.lit(dry_run), F.lit("would_transcode"))
              .when(new_bytes >= threshold, F.lit("skip_not_smaller"))
              .otherwise(F.lit("done")))
    saved = F.when(status == "done", py_round((F.lit(1.0) - new_bytes.cast("double") / old_bytes.cast("double")) * 100, 2))
    return {"status": status, "saved_pct": saved}


def file_state_update(state: DataFrame, results: DataFrame) -> DataFrame:
    """Replace the state of processed paths with their latest result."""
    from almanac.operators.merge import insert_or_replace
    return insert_or_replace(state, results, ["path"], "seq", refresh_col=None)


def batch_summary(results: DataFrame) -> DataFrame:
    """Counters and the (bounded) item list of one worker batch."""
    return results.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(F.col("status") == "done").alias("transcoded"),
        F.count_if(F.col("status").startswith("skip")).alias("skipped"), F.count_if(F.col("status") == "error").alias("errors"))


def read_run_logs(spark, path: str) -> DataFrame:
    """Job output files ``<job>/<run_id>.log`` -> (job, run_id, line_no, line).
    Files are read line by line (``read.text``); line numbers come from the position in
    the file, so a long log is never held as one value."""
    df = spark.read.text(path).withColumn("_f", F.input_file_name()).withColumn("_i", F.monotonically_increasing_id())
    job = F.regexp_extract("_f", r"/([^/]+)/[^/]+$", 1)
    run = F.regexp_extract("_f", r"/([^/]+?)(\.log)?$", 1)
    w = Window.partitionBy("_f").orderBy("_i")
    return df.select(job.alias("job"), run.alias("run_id"), F.row_number().over(w).alias("line_no"), F.col("value").alias("line"))
