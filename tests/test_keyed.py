"""Keyed tables against the in-memory merges and a plain dictionary."""

import glob
import os
import random
import tempfile

from pyspark.sql import functions as F

from almanac.operators import keyed as K
from almanac.operators import merge as MG
from almanac.sources import fixtures as FX
from tests.conftest import SF_SMALL

SCHEMA = "id string, part int, v int, w string"


def new_table(spark, buckets=8, schema=SCHEMA, keys=("id", "part")):
    path = tempfile.mkdtemp(prefix="keyed-", dir="/tmp") + "/table"
    return K.KeyedTable(spark, path, spark.createDataFrame([], schema).schema, list(keys), buckets)


def bytes_in(path):
    return sum(os.path.getsize(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True))


def held(table):
    return sorted((tuple(r) for r in table.read().collect()), key=str)


def applied(state, rows, rule, cols=()):
    """A plain dictionary of key -> [v, w]; rows are (id, part, v, w, order)."""
    best = {}
    for r in rows:
        k, o = r[:2], r[4]
        if k not in best or (o < best[k][4] if rule == "ignore" else o > best[k][4]):
            best[k] = r
    for k, r in best.items():
        if rule == "delete":
            state.pop(k, None)
        elif rule == "replace" or k not in state:
            state[k] = [r[2], r[3]]
        elif rule == "upsert":
            state[k] = [r[2] if "v" in cols else state[k][0], r[3] if "w" in cols else state[k][1]]


def test_any_run_of_merges_and_compactions(spark):
    rnd = random.Random(7)
    table, state = new_table(spark), {}
    assert held(table) == [] and table.compact() is None
    for step in range(9):
        rule = ["replace", "ignore", "upsert", "delete"][step % 4 if step else 0]
        cols = rnd.choice([["v"], ["w"], ["v", "w"]])
        rows = [(rnd.choice(["a", "b", "c", None]), rnd.randrange(12), rnd.randrange(100), rnd.choice(["x", "y", None]), o) for o in range(40 if step else 60)]
        table.merge(spark.createDataFrame(rows, f"{SCHEMA}, o int"), rule, ["o"], cols, batch_id=str(step))
        applied(state, rows, rule, cols)
        want = sorted(((*k, *v) for k, v in state.items()), key=str)
        assert held(table) == want
        assert table.merge(spark.createDataFrame(rows, f"{SCHEMA}, o int"), rule, ["o"], cols, batch_id=str(step)) is None
        if step in (3, 6):
            assert table.compact(share=0.1, most=3 if step == 3 else None) is not None
            assert held(table) == want
            table.vacuum()
            assert held(table) == want
    assert table.merge(spark.createDataFrame([], SCHEMA), "replace") is None


def test_a_small_batch_writes_little(spark):
    table = new_table(spark, buckets=16, schema="id long, v string", keys=("id",))
    big = spark.range(100_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    table.merge(big, "replace")
    table.compact()
    table.vacuum()
    before = bytes_in(table.path)
    small = spark.range(0, 100_000, 100).select("id", F.sha2((F.col("id") + 1).cast("string"), 256).alias("v"))
    table.merge(small, "replace")
    wrote = bytes_in(table.path) - before
    assert wrote < 0.02 * before
    changed = table.read().join(small.withColumnRenamed("v", "new"), "id")
    assert changed.where("v = new").count() == 1000 and table.read().count() == 100_000
    assert table.compact() is None  # one row in a hundred is below the share
    assert bytes_in(table.path) - before == wrote


def test_equal_to_the_merges_of_whole_tables(spark):
    tx = FX.load(spark, SF_SMALL, "transactions")
    old = tx.where("date < '2001-01-01'")
    batch = tx.where("date >= '2000-10-03'").withColumn("amount", (F.col("amount") + 1).cast("decimal(12,2)")).withColumn("seq", F.lit(1))
    batch = batch.unionByName(batch.withColumn("amount", (F.col("amount") + 1).cast("decimal(12,2)")).withColumn("seq", F.lit(2)))
    want = {
        "ignore": MG.insert_or_ignore(old, batch, ["id"], "seq"),
        "replace": MG.insert_or_replace(old, batch, ["id"], "seq", refresh_col=None),
        "upsert": MG.upsert(old, batch, ["id"], ["amount", "category"], "seq"),
    }
    for rule, expected in want.items():
        path = tempfile.mkdtemp(prefix="keyed-", dir="/tmp") + "/table"
        table = K.KeyedTable(spark, path, old.schema, ["id"], 8)
        table.merge(old, "replace")
        table.compact()
        table.merge(batch, rule, ["seq"], ["amount", "category"])
        got = table.read()
        assert got.count() == expected.count() and got.exceptAll(expected.select(*got.columns)).count() == 0


def test_a_commit_without_its_record_is_not_seen(spark):
    table = new_table(spark)
    table.merge(spark.createDataFrame([("a", 1, 1, "x")], SCHEMA), "replace")
    lost = spark.createDataFrame([("b", 1, 1, "x", "replace", 0)], f"{SCHEMA}, __rule string, bucket int")
    lost.write.partitionBy("bucket").parquet(f"{table.path}/data/commit=1")
    assert held(table) == [("a", 1, 1, "x")]
    assert table.merge(spark.createDataFrame([("c", 1, 1, "x")], SCHEMA), "replace") == 1
    assert held(table) == [("a", 1, 1, "x"), ("c", 1, 1, "x")]


def test_stream_commits_each_batch_once_in_arrival_order(spark):
    base = tempfile.mkdtemp(prefix="keyed-", dir="/tmp")
    os.makedirs(f"{base}/land")
    for name, time_, v in (("z.json", 1_700_000_000, 1), ("b.json", 1_700_000_100, 2), ("a.json", 1_700_000_200, 3)):
        with open(f"{base}/land/{name}", "w") as f:
            f.writelines(f'{{"id": "k{k}", "part": 0, "v": {v * 1000 + j}, "w": "{name}"}}\n' for j, k in enumerate([*range(50), *range(50)]))
        os.utime(f"{base}/land/{name}", (time_, time_))
    for packing in ("64", "100000000"):  # bytes of a split: many small ones, or all files in one
        spark.conf.set("spark.sql.files.maxPartitionBytes", packing)
        try:
            for rule, v in (("replace", 3050), ("ignore", 1000)):
                table = new_table(spark, keys=("id",))
                src = K.arrival(spark.readStream.schema(SCHEMA).json(f"{base}/land"))
                for _ in range(2):  # started again after its end: nothing to do
                    q = src.writeStream.foreachBatch(K.keyed_sink(table, rule, compact_every=1)).option("checkpointLocation", f"{table.path}-ck").trigger(availableNow=True).start()
                    q.awaitTermination()
                assert sorted(r["v"] - int(r["id"][1:]) for r in table.read().collect()) == [v] * 50
                K.keyed_sink(table, rule, ["v"])(spark.createDataFrame([("k1", 0, 9, "again")], SCHEMA), 0)  # a replayed batch
                assert table.read().where("w = 'again'").count() == 0
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
