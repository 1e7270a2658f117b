"""Keyed tables: merges that write their batch, not their target (S8-S10, ST2).

A table is a folder of plain Parquet. Rows are dealt to buckets by a hash of their key. A merge writes one
*delta*: its batch, one row per key, in the batch's buckets, marked with the merge rule. Reading brings a
key's rows together again, one aggregate by key, and applies the rules in the order of the commits.
``compact`` folds the buckets with the most delta rows into a new *base* and leaves the others
as they are, so a row is rewritten only when the deltas of its bucket have grown to a share of it.

    path/data/commit=<n>/bucket=<b>/part-*.parquet     rows; for deltas with the rule in ``__rule``
    path/judged/commit=<n>/part-*.parquet              rows of a checked insert with the constraint they break
    path/log/part-*.json                               one record a commit, appended

A commit is its record in the log, which Spark's writer shows only when it is complete: readers see all of
a commit or nothing. The record names the batch, so a replayed batch (same ``batch_id``) changes
nothing, and a folder left by a failed commit is overwritten by the next one of its number. One writer
at a time; readers need no lock, as files of a commit never change.

Rules: ``ignore`` keeps a stored row and inserts new keys, ``replace`` replaces the whole row, ``upsert``
replaces the named columns and keeps the others, ``delete`` removes the key. Of several rows of a batch
with one key the first arrival counts for ``ignore``, the last for the others; ``order`` names the columns that tell
(``arrival`` and ``with_row`` make them for files). Null keys are a key like any other. Empty batches commit nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from almanac.operators.merge import pick_per_key

IGNORE, REPLACE, UPSERT, DELETE = RULES = ("ignore", "replace", "upsert", "delete")
LOG = "commit long, kind string, buckets array<int>, rows array<long>, update_cols array<string>, batch_id string"
RULE, COMMIT, BUCKET = "__rule", "commit", "bucket"


def arrival(files: DataFrame) -> DataFrame:
    """``files``, a stream or table read from files, with ``_arrival``: the file's time, its name and the place
    of the split in the file. With ``with_row`` it orders rows as they landed, however the reader packs
    splits into tasks."""
    at = F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return files.select("*", at.alias("_arrival"))


def with_row(batch: DataFrame) -> DataFrame:
    """``batch`` with ``_row``, which rises with the rows of a split. For batches before any shuffle."""
    return batch.withColumn("_row", F.monotonically_increasing_id())


@dataclass
class Live:
    """What a reader of the newest state reads: for each commit its buckets."""

    commits: dict[int, list[int]]
    bases: dict[int, int]
    update_cols: dict[int, list[str]]
    batches: set[str]
    last: int


class KeyedTable:
    """``schema`` are the table's columns, ``keys`` the ones that identify a row, ``buckets`` fixed for its life."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    # ------------------------------------------------------------------ log

    def log(self) -> DataFrame:
        """One row a commit; empty before the first."""
        try:
            return self.spark.read.schema(LOG).json(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LOG)

    def live(self) -> Live:
        """Commits number hundreds, not rows: compaction, not the table's size, bounds what is read here."""
        records = sorted(self.log().collect(), key=lambda r: r["commit"])
        bases: dict[int, int] = {}
        for r in records:
            if r["kind"] == "base":
                bases |= dict.fromkeys(r["buckets"], r["commit"])
        commits = {}
        for r in records:
            own = [b for b in r["buckets"] if bases.get(b, -1) <= r["commit"] and (r["kind"] != "base" or bases[b] == r["commit"])]
            if own:
                commits[r["commit"]] = own
        return Live(commits, bases, {r["commit"]: r["update_cols"] or [] for r in records}, {r["batch_id"] for r in records if r["batch_id"]}, records[-1]["commit"] if records else -1)

    def _commit(self, rows: DataFrame, kind: str, last: int, update_cols: list[str], batch_id: str | None, emptied: list[int] = (), always: bool = False) -> int | None:
        """Write ``rows`` (the table's columns and the rule) as the next commit. Its number; None, and no commit, without rows (unless ``always``)."""
        number = last + 1
        folder = f"{self.path}/data/{COMMIT}={number}"
        dealt = rows.withColumn(BUCKET, self.bucket_of())
        dealt.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(BUCKET).parquet(folder)
        stored = StructType(dealt.schema.fields)
        counts = dict(self.spark.read.schema(stored).parquet(folder).groupBy(BUCKET).count().collect())
        buckets = sorted({*counts, *emptied})
        if not buckets and not always:
            return None
        record = (number, kind, buckets, [counts.get(b, 0) for b in buckets], update_cols, batch_id)
        self.spark.createDataFrame([record], LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")
        return number

    # ------------------------------------------------------------------ merge

    def merge(self, batch: DataFrame, rule: str, order: list[str] | None = None, update_cols: list[str] | None = None, batch_id: str | None = None) -> int | None:
        """Commit ``batch`` under ``rule``; returns the commit, or None if there was nothing to do. Only the
        batch is read, shuffled and written."""
        if rule not in RULES:
            raise ValueError(f"rule {rule!r} is none of {', '.join(RULES)}")
        state = self.live()
        if batch_id is not None and batch_id in state.batches:
            return None
        keep = [c for c in self.columns if c in batch.columns]
        one = batch.select(*keep, *(order or []))
        one = pick_per_key(one, self.keys, order or [c for c in keep if c not in self.keys], highest=rule != IGNORE)
        rest = {c: F.lit(None).cast(self.schema[c].dataType) for c in self.columns if c not in keep}
        one = one.withColumns(rest).select(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.columns), F.lit(rule).alias(RULE))
        return self._commit(one, "delta", state.last, update_cols or [], batch_id)

    # ------------------------------------------------------------------ constraints

    def judge(self, batch: DataFrame, not_null: list[str], order: list[str]) -> DataFrame:
        """``batch`` with ``constraint``: the first rule a row breaks, else NULL. ``not_null:<column>``; ``primary_key``: its key
        is stored, or an earlier sound row of the batch has it. Of the table only the keys are read, and the
        batch is joined with one row a key: a key in many rows is never one group."""
        broken = F.coalesce(*(F.when(F.col(c).isNull(), F.lit(f"not_null:{c}")) for c in not_null), F.lit(None).cast("string"))
        rows = with_row(batch).withColumn("__null", broken)
        order = [*order, "_row"]
        first = rows.where("__null is null").groupBy(*self.keys).agg(F.min(F.struct(*order)).alias("__first"))
        stored = self.read().select(*self.keys).withColumn("__stored", F.lit(True))
        same = lambda right: reduce(lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in self.keys))
        known = first.alias("l").join(stored.alias("r"), same("r"), "left").select("l.*", "r.__stored")
        seen = rows.alias("l").join(known.alias("r"), same("r"), "left")
        taken = F.coalesce("r.__stored", F.lit(False)) | (F.struct(*(F.col(f"l.{c}") for c in order)) != F.col("r.__first"))
        verdict = F.coalesce(F.col("l.__null"), F.when(taken, F.lit("primary_key")))
        return seen.select(*(F.col(f"l.{c}") for c in batch.columns), verdict.alias("constraint"))

    def insert_checked(self, batch: DataFrame, not_null: list[str], order: list[str] | None = None, batch_id: str | None = None) -> int | None:
        """S11 enforced: a plain INSERT of the rows that keep every constraint; the others go to ``rejected``.
        The batch is judged once and written; both parts become visible with one record of the log."""
        state = self.live()
        if batch_id is not None and batch_id in state.batches:
            return None
        folder = f"{self.path}/judged/{COMMIT}={state.last + 1}"
        judged = self.judge(batch.select(*self.columns, *(order or [])), not_null, order or [])
        judged.select(*self.columns, "constraint").write.mode("overwrite").parquet(folder)
        judged = self.spark.read.schema(self._judged()).parquet(folder)
        sound = judged.where("constraint is null").select(*self.columns, F.lit(IGNORE).alias(RULE))
        return self._commit(sound, "checked", state.last, [], batch_id, always=judged.limit(1).count() > 0)

    def _judged(self) -> StructType:
        return StructType([*self.schema.fields]).add("constraint", "string")

    def rejected(self) -> DataFrame:
        """(commit, the table's columns, constraint) of all committed inserts."""
        found = self.spark.createDataFrame([], StructType().add(COMMIT, "long").add("__", self._judged())).select(COMMIT, "__.*")
        for r in self.log().where("kind = 'checked'").select(COMMIT).collect():
            own = self.spark.read.schema(self._judged()).parquet(f"{self.path}/judged/{COMMIT}={r[COMMIT]}").where("constraint is not null")
            found = found.unionByName(own.withColumn(COMMIT, F.lit(r[COMMIT]).cast("long")))
        return found

    # ------------------------------------------------------------------ read

    def _rows(self, state: Live, buckets: list[int] | None = None) -> DataFrame | None:
        """The live rows with their commit and rule."""
        stored = StructType([*self.schema.fields]).add(RULE, "string").add(BUCKET, "integer")
        found = None
        for commit, own in state.commits.items():
            own = own if buckets is None else sorted({*own} & {*buckets})
            if own:
                rows = self.spark.read.schema(stored).parquet(f"{self.path}/data/{COMMIT}={commit}")
                if len(own) < self.buckets:
                    rows = rows.where(F.col(BUCKET).isin(own))
                rows = rows.withColumn(COMMIT, F.lit(commit).cast("long")).withColumn("__set", F.lit(state.update_cols[commit]).cast("array<string>"))
                found = rows if found is None else found.unionByName(rows)
        return found

    def _folded(self, rows: DataFrame) -> DataFrame:
        """One row per key: the rules applied in the order of the commits. A key has at most one row a commit."""
        values = [c for c in self.columns if c not in self.keys]
        whole = F.struct(COMMIT, F.col(RULE).alias("rule"), *values)
        at = F.col(COMMIT)
        # The row that counts from: the last one that sets or removes a whole row, else the first one.
        fixed = rows.groupBy(*self.keys).agg(
            F.max(F.when(F.col(RULE).isin(REPLACE, DELETE), whole)).alias("last"),
            F.min(F.when(~F.col(RULE).isin(REPLACE, DELETE), whole)).alias("first"),
            F.array_sort(F.collect_list(F.when(F.col(RULE).isin(UPSERT, IGNORE), F.struct(at.alias(COMMIT), F.col(RULE).alias("rule"), F.col("__set").alias("set"), *values)))).alias("later"),
        )
        base = F.coalesce(F.col("last"), F.struct(*(F.col(f"first.{f}").alias(f) for f in (COMMIT, "rule", *values))))

        def step(held, row):
            after = (row[COMMIT] > held[COMMIT])
            gone = held["rule"] == DELETE
            inserted = after & gone
            changed = after & ~gone & (row["rule"] == UPSERT)
            own = [F.when(inserted | (changed & F.array_contains(row["set"], c)), row[c]).otherwise(held[c]).alias(c) for c in values]
            return F.struct(held[COMMIT].alias(COMMIT), F.when(inserted, F.lit(REPLACE)).otherwise(held["rule"]).alias("rule"), *own)

        done = fixed.withColumn("row", F.aggregate("later", base, step)).where(F.col("row.rule") != DELETE)
        return done.select(*(c if c in self.keys else F.col(f"row.{c}").alias(c) for c in self.columns))

    def read(self) -> DataFrame:
        """The merged table. Buckets without deltas are read as they lie; only the others are shuffled."""
        state = self.live()
        if not state.commits:
            return self.spark.createDataFrame([], self.schema)
        delta = sorted({b for commit, own in state.commits.items() for b in own if state.bases.get(b) != commit})
        plain = [b for b in range(self.buckets) if b not in delta]
        settled = self._rows(state, plain) if plain else None
        open_ = self._rows(state, delta) if delta else None
        parts = [d for d in (settled.select(*self.columns) if settled is not None else None, self._folded(open_) if open_ is not None else None) if d is not None]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    # ------------------------------------------------------------------ compaction

    def compact(self, share: float = 0.25, most: int | None = None) -> int | None:
        """Fold the buckets whose delta rows exceed ``share`` of their base rows (of those at most the
        ``most`` with the largest deltas) into a new base. Older files stay until ``vacuum``."""
        state = self.live()
        rows = {r["commit"]: dict(zip(r["buckets"], r["rows"], strict=True)) for r in self.log().collect()}
        weight = {}
        for commit, own in state.commits.items():
            for b in own:
                if state.bases.get(b) != commit:
                    weight[b] = weight.get(b, 0) + rows[commit][b]
        due = [b for b, n in weight.items() if n > share * (rows[state.bases[b]][b] if b in state.bases else 0)]
        due = sorted(due, key=lambda b: (-weight[b], b))[:most]
        if not due:
            return None
        folded = self._folded(self._rows(state, due)).withColumn(RULE, F.lit(REPLACE))
        return self._commit(folded, "base", state.last, [], None, emptied=due)

    def vacuum(self) -> list[int]:
        """Empty the folders of commits that no reader of the newest state needs; returns their numbers."""
        state = self.live()
        dead = [r["commit"] for r in self.log().select("commit").collect() if r["commit"] not in state.commits]
        nothing = self.spark.createDataFrame([], StructType([*self.schema.fields]).add(RULE, "string"))
        for commit in dead:
            nothing.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.path}/data/{COMMIT}={commit}")
        return sorted(dead)


def keyed_sink(table: KeyedTable, rule: str, order: list[str] | None = None, update_cols: list[str] | None = None, compact_every: int = 20):
    """ST2 without rewriting: a ``foreachBatch`` function that commits each micro-batch once, whatever is
    replayed, and compacts every ``compact_every`` batches. ``order`` is that of the rows' arrival if None."""

    def run(batch: DataFrame, batch_id: int) -> None:
        table.merge(with_row(batch), rule, order or ["_arrival", "_row"], update_cols, batch_id=f"stream-{batch_id}")
        if compact_every and (batch_id + 1) % compact_every == 0:
            table.compact()

    return run
