"""Small shared building blocks for operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Top ``n`` rows per ``keys`` group (a top-k report, so the limit is the feature).

    ``row_number`` with a ``<= n`` filter becomes a WindowGroupLimit: each map task
    keeps only its local top n per group before the shuffle, so a hot group costs
    n rows per task, not its full size.
    """
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def latest_per(df: DataFrame, keys: list[str], order_col: str, tiebreak: list[str] | None = None) -> DataFrame:
    """Latest row per key without a sort: ``max(struct(order_col, ...))`` is an ordinary
    hash aggregate with map-side combine, so a hot key never gathers in one task.
    Ties on ``order_col`` resolve deterministically on the following struct fields."""
    rest = [c for c in df.columns if c not in keys and c != order_col]
    if tiebreak:
        rest = tiebreak + [c for c in rest if c not in tiebreak]
    packed = F.max(F.struct(F.col(order_col), *[F.col(c) for c in rest])).alias("_s")
    return df.groupBy(*keys).agg(packed).select(*keys, "_s.*").select(*df.columns)


def flag_to_int(col) -> Column:
    """``CASE WHEN flag THEN 1 ELSE 0 END`` (NULL -> 0)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c, F.lit(1)).otherwise(F.lit(0))


def value_label_map(col, mapping: dict) -> Column:
    """Look a value up in a small literal map (value -> label); misses give NULL."""
    c = F.col(col) if isinstance(col, str) else col
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*kv), c)


def threshold_band(col, steps: list[tuple[float | None, str]]) -> Column:
    """Step thresholds: the band of the last step whose value is <= x; the first step
    (value None) is the base band. NULL input gives NULL."""
    c = F.col(col) if isinstance(col, str) else col
    base = steps[0][1]
    expr = None
    for value, label in reversed(steps[1:]):
        cond = c >= F.lit(value)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    expr = F.lit(base) if expr is None else expr.otherwise(F.lit(base))
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(expr)


def assemble_by_key(parts: list[DataFrame], key: str) -> DataFrame:
    """Outer-combine several aggregates that share a key (each with one row per key)
    into one row per key: a union with missing columns NULL, then one ``groupBy``
    that keeps each column's non-null value. One shuffle instead of a chain of outer
    joins; keys present in any part appear once."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    cols = [c for c in u.columns if c != key]
    return u.groupBy(key).agg(*[F.any_value(F.col(c), ignoreNulls=True).alias(c) for c in cols])
