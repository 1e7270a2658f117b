"""Idempotent merges without a table format.

Each merge is a pure function ``(target, batch) -> merged table``: one shuffle on the
key, then a ``row_number`` pick per key. ``write_partitions`` persists the result
with dynamic partition overwrite, so only the partitions the batch touches are
rewritten (the merge reads those partitions only, see ``touched_partitions``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.dates import ntz


def pick_per_key(df: DataFrame, keys: list[str], order: list[str], highest: bool) -> DataFrame:
    """One row per key: the one with the highest (or lowest) ``order`` columns, ties
    broken by the remaining columns. A ``max``/``min`` of a struct is a hash
    aggregate with map-side combine, so a key with many versions never piles up in
    one task (a ``row_number`` window would sort them all together)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order + rest])
    agg = (F.max(packed) if highest else F.min(packed)).alias("_p")
    return df.groupBy(*keys).agg(agg).select(*keys, *[F.col(f"_p.{c}").alias(c) for c in order + rest]).select(*df.columns)


def insert_or_ignore(target: DataFrame, batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Existing keys win; within the batch the first arrival (lowest ``seq``) wins.
    Returns the merged table (target rows + new rows)."""
    first = pick_per_key(batch, keys, [seq], highest=False).drop(seq)
    new = first.join(target.select(*keys), on=keys, how="left_anti")
    return target.unionByName(new.select(*target.columns))


def insert_or_replace(target: DataFrame, batch: DataFrame, keys: list[str], seq: str,
                      refresh_col: str | None = "ingested_at", now=None) -> DataFrame:
    """Last write wins and replaces the whole row; ``refresh_col`` is stamped.
    Target rows rank below every batch row; inside the batch the highest ``seq`` wins."""
    cols = target.columns
    b = batch
    if refresh_col and refresh_col in cols:
        stamp = F.localtimestamp() if now is None else ntz(now)
        b = b.withColumn(refresh_col, stamp)
    t = target.select(*cols, F.lit(0).alias("__merge_src"), F.lit(0).cast("long").alias("__merge_seq"))
    b = b.select(*cols, F.lit(1).alias("__merge_src"), F.col(seq).cast("long").alias("__merge_seq"))
    u = t.unionByName(b)
    return pick_per_key(u, keys, ["__merge_src", "__merge_seq"], highest=True).select(*cols)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], update_cols: list[str], seq: str | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (keys) DO UPDATE SET update_cols: new keys are
    inserted, existing keys take the batch's ``update_cols``, other columns keep the
    old value. Within a batch the last row (highest ``seq``) is applied."""
    b = batch if seq is None else pick_per_key(batch, keys, [seq], highest=True).drop(seq)
    cols = target.columns
    t = target.alias("t")
    n = b.withColumn("_present", F.lit(1)).alias("n")
    out = []
    for c in cols:
        if c in keys:
            out.append(F.col(c))
        elif c in update_cols:
            out.append(F.when(F.col("n._present").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            out.append(F.coalesce(F.col(f"t.{c}"), F.col(f"n.{c}")).alias(c) if c in b.columns else F.col(f"t.{c}").alias(c))
    return t.join(n, on=keys, how="full_outer").select(*out)


def constraint_violations(df: DataFrame, keys: list[str], not_null: list[str], table: str) -> DataFrame:
    """PRIMARY KEY / UNIQUE duplicates and NOT NULL violations as rows
    (table, constraint, detail, rows); empty when the table is clean."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1).select(
        F.lit(table).alias("table"), F.lit("primary_key").alias("constraint"),
        F.to_json(F.struct(*keys)).alias("detail"), F.col("rows"))
    nn = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in not_null])
    stacked = nn.select(F.inline(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("rows")) for c in not_null])))
    nulls = stacked.filter(F.col("rows") > 0).select(
        F.lit(table).alias("table"), F.lit("not_null").alias("constraint"), F.col("col").alias("detail"), F.col("rows"))
    return dup.unionByName(nulls)


def touched_partitions(batch: DataFrame, part_col: str) -> list:
    """Distinct partition values of a batch (one small aggregate; the values, not rows,
    reach the driver) -- used to read only those partitions of the target."""
    return [r[0] for r in batch.select(part_col).distinct().collect()]


def in_partitions(part_col: str, values: list) -> Column:
    """Rows of these partitions; None stands for the NULL partition."""
    known = F.col(part_col).isin([v for v in values if v is not None])
    return F.coalesce(known, F.lit(False)) | (F.col(part_col).isNull() if None in values else F.lit(False))


#: Characters written as %XX in the name of a partition's folder. Fixed values.
ESCAPED = "\"#%'*/:=?\\{[]^\x7f"


def partition_folder(part_col: str, value) -> str:
    text = "__HIVE_DEFAULT_PARTITION__" if value is None or value == "" else str(value)
    return f"{part_col}=" + "".join(f"%{ord(c):02X}" if c < " " or c in ESCAPED else c for c in text)


def write_partitions(df: DataFrame, path: str, part_col: str, staging: str | None = None, replaced: list | None = None) -> None:
    """Persist with dynamic partition overwrite: only partitions present in ``df`` are
    replaced, and those of ``replaced`` that have no rows any more are emptied. When ``df`` was
    computed from ``path`` itself, it is first written to a
    ``staging`` location (Spark cannot overwrite a path it is reading)."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    src = df
    if staging:
        df.write.mode("overwrite").partitionBy(part_col).parquet(staging)
        src = spark.read.parquet(staging)
    src.repartition(part_col).write.mode("overwrite").partitionBy(part_col).parquet(path)
    for value in set(replaced or []) - set(touched_partitions(src, part_col)) if replaced else ():
        src.drop(part_col).limit(0).write.mode("overwrite").parquet(f"{path}/{partition_folder(part_col, value)}")


def append(df: DataFrame, path: str, part_col: str | None = None) -> None:
    """Plain append of new rows."""
    w = df.write.mode("append")
    if part_col:
        w = w.partitionBy(part_col)
    w.parquet(path)
