"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.session import checkpoint_dir

#: Rows of an Arrow batch sent to a Python worker; long documents make larger batches risky.
BATCH_ROWS = 500
#: Ids that may be broadcast as a filter (8 bytes each); a larger list is joined by a shuffle.
BROADCAST_IDS = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size so that a batch of long texts fits a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: computed once, and later
    stages survive lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def quoted(*names: str) -> list[Column]:
    """Columns by their names, whatever characters these hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def with_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], extra: str | None = None) -> DataFrame:
    """``df.mapInArrow`` for a ``run`` that returns rows as they came, with a long ``extra`` column last if
    named. Columns are numbered on the way, so their names don't matter; ``run`` finds them by place."""
    names = df.columns
    kinds = T.StructType([T.StructField(f"c{k}", f.dataType, True) for k, f in enumerate(df.schema.fields)])
    if extra is not None:
        kinds, names = kinds.add(f"c{len(names)}", "long"), [*names, extra]
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, kinds).toDF(*names)


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within BROADCAST_IDS."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def only_with(df: DataFrame, keys: DataFrame, on: list[str], n_keys: int | None = None) -> DataFrame:
    """Rows of ``df`` whose ``on`` columns occur in ``keys`` (distinct, non-null). The keys are
    broadcast when their counted number is within BROADCAST_IDS, else both sides are shuffled."""
    n = keys.count() if n_keys is None else n_keys
    return df.join(F.broadcast(keys) if n <= BROADCAST_IDS else keys, on, "left_semi")
