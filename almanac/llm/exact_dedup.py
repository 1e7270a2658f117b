"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Rows are dealt into ``fan_in ** rounds`` runs by a hash of doc_id. A run has one entry for each
distinct text in it: a 64-bit digest, the SHA-256 and byte length that verify it, the identifier
that stays and the number of rows. In each round ``fan_in`` runs are merged into one (Spark's
shuffle brings a digest's entries together, sorted by digest, and the merge keeps one verified
identifier), so a text that fills a third of the table is one entry a run after the first round
and no task ever sees its rows together. The way back goes down the same tree: each level takes
the final identifier and size from the level above.

Defined results: null text counts as empty; rows that repeat both doc_id and text are one
document (same result for each of them, all counted in group_size); a null doc_id stays only if
its group has no other; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.llm.util import materialize

FAN_IN, ROUNDS = 16, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERIFIED = ["digest", "sha", "n_bytes"]


def normalised(text: Column) -> Column:
    """Null as empty; A-Z in lower case, all else unchanged."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id with digest, sha (binary) and n_bytes of the normalised text."""
    t = docs.select(F.col("doc_id").cast("long"), normalised(F.col("text")).alias("t"))
    return t.select("doc_id", F.xxhash64("t").alias("digest"), F.unhex(F.sha2("t", 256)).alias("sha"), F.octet_length("t").alias("n_bytes"))


def exact_groups(docs: DataFrame, keep: str = "max", fan_in: int = FAN_IN, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, keep_id (the smallest or largest identifier of its group, by
    ``keep``), group_size, kept, text_sha256."""
    pick = {"min": F.min, "max": F.max}[keep]
    leaf = materialize(digests(docs).withColumn("run0", F.pmod(F.xxhash64("doc_id"), F.lit(fan_in**rounds)).cast("int")), "digests")
    up = leaf.groupBy("run0", *VERIFIED).agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    levels = [materialize(up, "runs")]
    for k in range(rounds):
        merged = levels[-1].withColumn(f"run{k + 1}", F.floor(F.col(f"run{k}") / fan_in).cast("int"))
        up = merged.groupBy(f"run{k + 1}", *VERIFIED).agg(pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        levels.append(materialize(up, "runs") if k + 1 < rounds else up)
    best = levels[-1]
    for k in reversed(range(rounds)):
        down = levels[k].drop("keep_id", "group_size").withColumn(f"run{k + 1}", F.floor(F.col(f"run{k}") / fan_in).cast("int"))
        best = down.join(best, [f"run{k + 1}", *VERIFIED]).drop(f"run{k + 1}")
    out = leaf.join(best, ["run0", *VERIFIED])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "max", one_row: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, those of one doc_id for each text, with all their columns. Rows
    that repeat this doc_id (or null, if the text has no other) with the text stay too; with
    ``one_row`` one of them does, that with the smallest text as it is written."""
    found = exact_groups(docs, keep).select("doc_id", "text_sha256", "kept")
    found = materialize(found, "copies") if one_row else found
    gone = found.where(~F.col("kept"))
    keyed = docs.withColumn("__sha", F.sha2(normalised(F.col("text")), 256))
    same = keyed["doc_id"].cast("long").eqNullSafe(gone["doc_id"]) & (keyed["__sha"] == gone["text_sha256"])
    left = keyed.join(gone, same, "left_anti")
    if one_row:
        again = found.where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        again = materialize(again.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__key")), "repeated")
        if again.limit(1).count():
            left = one_of_repeated(left, again, docs.columns)
    return left.drop("__sha")


def one_of_repeated(rows: DataFrame, again: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` (with __sha) with one row for each doc_id and text in ``again`` (__id, __key). Each task, then
    each of 64 salts, has one row left of a key, so no task gets all of them."""
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__key"))
    row = F.struct(*[F.col(f"`{c}`") for c in names], "__sha")
    twice = rows.join(again, same, "left_semi").select("doc_id", "__sha", row.alias("__row"), F.pmod(F.spark_partition_id(), F.lit(64)).alias("__salt"))
    first = F.min_by("__row", F.struct("__row.text")).alias("__row")
    one = twice.groupBy("doc_id", "__sha", "__salt").agg(first).groupBy("doc_id", "__sha").agg(first)
    return rows.join(again, same, "left_anti").unionByName(one.select("__row.*"))
