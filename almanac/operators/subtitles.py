"""Subtitle files: parse blocks, batch them, check translations, resume, write back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Translation quality rules and batch size.
CREDIT_LINE = "Subtitle translation by"
SHORT_SRC, LONG_TR = 45, 180
MIN_MAX_LEN, MAX_RATIO = 320, 5
MAX_QUOTES, QUOTED_LEN = 6, 140
BATCH_SIZE = 20
# Pieces of a file (or blocks of a piece) that are numbered in one window.
RANGE = 1000


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: leading/trailing whitespace including newlines."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def read_srt(files: DataFrame, file_col: str = "file", text_col: str = "content", order_col: str | None = None) -> DataFrame:
    """File text -> (file, pos, idx, ts, text). Blocks are separated by blank
    lines and need >= 3 lines, a whole number (of at most 2^31 - 1) as first line and '-->' in the second; CRLF is
    normalised. A row is a whole file or, with ``order_col`` (a whole number), a piece
    of one that ends with a blank line; equal numbers are ordered by their text.
    Pieces are parsed row by row; positions are block counts of the earlier ranges of
    ``RANGE`` numbers plus the position inside the range, so no task holds a file."""
    t = F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n"))
    order = F.lit(0) if order_col is None else F.col(order_col)
    # Equal pieces are told apart, so that each one's blocks stay together.
    b = files.select(F.col(file_col).alias("file"), order.cast("bigint").alias("_o"), F.when(F.lit(order_col is not None), t).alias("_t"),
                     F.monotonically_increasing_id().alias("_id"), F.posexplode(F.split(strip_ws(t), r"\n\s*\n")).alias("bpos", "block"))
    lines = F.split(F.col("block"), "\n")
    b = b.withColumn("_l", lines).filter(
        (F.size("_l") >= 3) & strip_ws(F.get("_l", 0)).rlike(r"^[0-9]+$") & strip_ws(F.get("_l", 0)).try_cast("int").isNotNull() & F.get("_l", 1).contains("-->"))
    b = b.select("file", F.floor(F.col("bpos" if order_col is None else "_o") / RANGE).alias("_r"), "_o", "_t", "_id", "bpos",
                 strip_ws(F.get("_l", 0)).try_cast("int").alias("idx"), strip_ws(F.get("_l", 1)).alias("ts"),
                 strip_ws(F.array_join(F.slice("_l", 3, F.size("_l")), "\n")).alias("text"))
    counts = b.groupBy("file", "_r").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_r")) - F.col("_n")
    counts = counts.select(F.col("file").alias("_f"), F.col("_r").alias("_fr"), before.alias("_before"))
    pos = F.row_number().over(Window.partitionBy("file", "_r").orderBy("_o", "_t", "_id", "bpos")) - 1
    same = F.col("file").eqNullSafe(F.col("_f")) & F.col("_r").eqNullSafe(F.col("_fr"))
    b = b.withColumn("_k", pos).join(counts, same)
    return b.select("file", (F.col("_before") + F.col("_k")).cast("int").alias("pos"), "idx", "ts", "text")


def chunk(blocks: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Ordered batches of ``size`` blocks per file (batch number from position)."""
    return blocks.withColumn("batch", F.floor(F.col("pos") / size).cast("int"))


def translation_is_bad(src: Column, tr: Column) -> Column:
    """Empty; credit line in the source; short source with long text; text longer
    than max(320, 5x source); many quotes in a long text."""
    s = strip_ws(F.coalesce(src, F.lit("")))
    t = strip_ws(F.coalesce(tr, F.lit("")))
    ls, lt = F.length(s), F.length(t)
    quotes = lt - F.length(F.replace(t, F.lit('"'), F.lit("")))
    return ((lt == 0) | s.contains(CREDIT_LINE) | ((ls < SHORT_SRC) & (lt > LONG_TR))
            | (lt > F.greatest(F.lit(MIN_MAX_LEN), F.lit(MAX_RATIO) * F.greatest(F.lit(1), ls)))
            | ((quotes >= MAX_QUOTES) & (lt > QUOTED_LEN)))


def translation_resolve(blocks: DataFrame, src: str = "text", batch_tr: str = "batch_text", retry_tr: str = "retry_text") -> DataFrame:
    """The batch translation when good, else the single retry when good, else the
    source; flags for the retry/fallback counters."""
    b_ok = ~translation_is_bad(F.col(src), F.col(batch_tr))
    r_ok = ~translation_is_bad(F.col(src), F.col(retry_tr))
    final = F.when(b_ok, strip_ws(F.col(batch_tr))).when(r_ok, F.col(retry_tr)).otherwise(F.col(src))
    return blocks.withColumn("final_text", final).withColumn("used_retry", ~b_ok & r_ok).withColumn("used_fallback", ~b_ok & ~r_ok)


def translation_progress(resolved: DataFrame) -> DataFrame:
    """Per file: blocks done, total, retries, fallbacks, failed batches (a batch
    fails when none of its blocks got a batch translation)."""
    per_batch = resolved.groupBy("file", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("used_retry")).alias("r"), F.count_if(F.col("used_fallback")).alias("f"),
        F.count_if(F.col("batch_text").isNotNull()).alias("got"))
    return per_batch.groupBy("file").agg(
        F.sum("n").alias("done"), F.sum("n").alias("total"), F.sum("r").alias("retry"), F.sum("f").alias("fallback"),
        F.count_if(F.col("got") == 0).alias("errors"))


def translation_checkpoint(blocks: DataFrame, resolved: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """A44 carried on from run to run: (file, done, total, errors, retry, fallback, status) of every file of ``blocks``.

    ``resolved`` holds the blocks of this run's finished batches, in any order; ``before`` is the stored result
    of the last run. ``done`` is the gap-free prefix: blocks behind the first missing one will be translated
    again, so they count neither here nor in the counters, which continue from ``before``. A batch is an error if
    none of its counted blocks got a batch translation. ``status`` is 'done' once ``done`` is ``total``, else null."""
    run = resolved.select("file", "pos", "batch", F.col("batch_text").isNotNull().alias("got"), "used_retry", "used_fallback").dropDuplicates(["file", "pos"])
    j = blocks.select("file", "pos").join(run, ["file", "pos"], "left")
    if before is None:
        j = j.withColumn("_done", F.lit(0))
    else:
        j = j.join(before.select("file", F.col("done").alias("_done")), "file", "left").withColumn("_done", F.coalesce("_done", F.lit(0)))
    missing = F.when(F.col("batch").isNull() & (F.col("pos") >= F.col("_done")), F.col("pos"))
    g = j.groupBy("file").agg(F.count(F.lit(1)).alias("total"), F.min(missing).alias("_gap"))
    g = g.select("file", "total", F.coalesce(F.col("_gap").cast("bigint"), F.col("total")).alias("done"))
    counted = j.where("batch is not null and pos >= _done").join(g.select("file", "done"), "file").where("pos < done")
    batches = counted.groupBy("file", "batch").agg(F.max("got").alias("got"), F.count_if("used_retry").alias("r"), F.count_if("used_fallback").alias("f"))
    new = batches.groupBy("file").agg(F.count_if(~F.col("got")).alias("errors"), F.sum("r").alias("retry"), F.sum("f").alias("fallback"))
    out = g.join(new, "file", "left")
    names = ["errors", "retry", "fallback"]
    held = {c: F.lit(0) for c in names}
    if before is not None:
        out = out.join(before.select("file", *[F.col(c).alias(f"_{c}") for c in names]), "file", "left")
        held = {c: F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in names}
    return out.select("file", "done", "total", *[(F.coalesce(F.col(c), F.lit(0)) + held[c]).cast("bigint").alias(c) for c in names],
                      F.when(F.col("done") == F.col("total"), F.lit("done")).alias("status"))


def resume_point(blocks: DataFrame, partial: DataFrame, checkpoint: DataFrame | None = None) -> DataFrame:
    """Resume index per file = length of the gap-free prefix of source blocks found
    in the partial output (by idx), at least the checkpoint's ``done``."""
    p = partial.select("file", "idx").distinct().withColumn("_have", F.lit(True))
    j = blocks.join(p, ["file", "idx"], "left")
    g = j.groupBy("file").agg(F.count(F.lit(1)).alias("total"), F.min(F.when(F.col("_have").isNull(), F.col("pos"))).alias("_gap"))
    r = g.select("file", "total", F.coalesce(F.col("_gap"), F.col("total")).alias("prefix"))
    if checkpoint is not None:
        r = r.join(checkpoint.select("file", F.col("done").alias("_ck")), "file", "left")
        r = r.withColumn("resume_from", F.greatest(F.col("prefix"), F.coalesce(F.col("_ck"), F.lit(0)))).drop("_ck")
    else:
        r = r.withColumn("resume_from", F.col("prefix"))
    return r


def write_srt(blocks: DataFrame, text_col: str = "final_text") -> DataFrame:
    """Blocks (with translated text, the source text when missing) -> file text.
    Blocks are collected per file (one subtitle file is one output unit)."""
    txt = F.coalesce(F.col(text_col), F.col("text"))
    entry = F.struct(F.col("pos"), F.concat(F.col("idx").cast("string"), F.lit("\n"), F.col("ts"), F.lit("\n"), txt, F.lit("\n")).alias("b"))
    g = blocks.groupBy("file").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    return g.select("file", F.array_join(F.transform("_e", lambda e: e["b"]), "\n").alias("content"))


def write_srt_files(blocks: DataFrame, path: str, text_col: str = "final_text") -> None:
    """S18 as files: one text file per subtitle file, blocks streamed in order by
    Spark's partitioned text writer (no file's content is gathered into one value).
    Output: ``<path>/file=<name>/part-*.txt``."""
    txt = F.coalesce(F.col(text_col), F.col("text"))
    # The writer ends every row with a newline; the last block of a file omits its own.
    last = F.col("pos") == F.max("pos").over(Window.partitionBy("file"))
    body = F.concat(F.col("idx").cast("string"), F.lit("\n"), F.col("ts"), F.lit("\n"), txt)
    lines = blocks.select("file", "pos", F.when(last, body).otherwise(F.concat(body, F.lit("\n"))).alias("value"))
    (lines.repartition("file").sortWithinPartitions("file", "pos").select("file", "value")
     .write.mode("overwrite").partitionBy("file").option("lineSep", "\n").text(path))
