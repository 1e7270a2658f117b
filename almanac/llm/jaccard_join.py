"""Exact Jaccard self-join of word-shingle sets, and its connected components.

Jaccard distance is a metric. Random documents lie at distance 1 of nearly every other, so pivots
drawn from the corpus alone would replicate all documents into all Voronoi regions (any window of
twice the threshold covers them). The first division therefore has shingles as its centres: shingles
are put in one order, rare first (by a fixed-size count sketch of the whole corpus; the order decides
only the effort), and a document lies in the region of each of its first n - ceil(t n) + 1 shingles.
Documents within the threshold share one of these regions. Inside the regions:

* a shingle's place in a set bounds what the set shares with any other whose first common shingle
  it is: of a pair at places i and j the smaller remainder, min(n - i, m - j), must reach t / (1 + t) of n + m.
  A point is in a region only if that holds against the region's least set, a pair is looked at only
  if it holds for the two; so the shorter of two sets meets the longer by its very first shingles alone;
* equal sets are one point from the start;
* every point's home pivot is the one, among the centres of its regions, that it shares most regions
  with; the distance to it is computed exactly, and points within the threshold are linked;
* a region whose points are all in one component is done. In the others some points become pivots:
  they are compared with all points of other components and then leave the region. The first rounds
  take pivots from the region's largest component, later ones from the rest, four times as many each
  round, until no region is left: no link between different texts is lost;
* before a pair is computed it must pass bounds that no link can miss: the sizes; the triangle
  inequality, if both points have the same home pivot; and the distance of the two sets' images in a
  small space (how many of a set's shingles fall on each of 256 cells; sets with over 127 on a cell have none): the image's weighted Jaccard
  distance is a metric too and never above the sets' own.

Defined results: null text, or text without words, has an empty set and is linked with nothing;
fewer words than a shingle are one shingle; rows with a null doc_id have a null component and link
nothing; repeated rows have equal results; rows that share a doc_id with different texts are judged
each by its own text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.links import components
from almanac.llm.util import BROADCAST_IDS, bounded_batches, columns, materialize, only_with, quoted, small, with_batches
from almanac.llm.words import digest, groups, mix, sequences

SHINGLE, PERCENT = 4, 85
#: Counters of the sketch, a power of two, and the blocks that it is summed in.
COUNTERS, BLOCKS = 1 << 20, 64
#: Cells of a set's image.
CELLS = 256
#: Rounds that take pivots from the largest component of a region.
INNER_ROUNDS = 2


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit names."""
    for g in groups(texts, lower=True):
        names = sequences(g.names, size)
        for a, b in zip(g.starts[:-1], g.starts[1:], strict=True):
            if b - a >= size:
                yield np.unique(names[a : b - size + 1])
            elif b > a:
                yield sequences(g.names[a:b], int(b - a), salt=int(b - a) * 2 + 7)
            else:
                yield np.zeros(0, np.uint64)


def frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """The sketch: how many documents' shingles fall on each counter. Its size is fixed."""
    per = COUNTERS // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            own = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(batch.column(0).to_pylist(), size)])
            total += np.bincount((own & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        task = TaskContext.get().partitionId() % 64
        parts = [total[k * per : (k + 1) * per].astype("<u4").tobytes() for k in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([task] * BLOCKS, pa.int32()), pa.array(parts, pa.binary())], names=["block", "task", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(per, np.uint32)
        for part in table.column("counts").to_pylist():
            total += np.frombuffer(part, "<u4")
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "task": pa.array([table.column("task")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, task int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema).groupBy("block", "task").applyInArrow(add, schema)
    out = np.zeros(COUNTERS, np.uint32)
    for r in parts.groupBy("block").applyInArrow(add, schema).collect():  # BLOCKS rows of a fixed size
        out[r["block"] * per : (r["block"] + 1) * per] = np.frombuffer(r["counts"], "<u4")
    return out


def point(own: np.ndarray) -> int:
    """The 64-bit name of a set; equal sets are one point."""
    return int.from_bytes(digest(own)[:8], "little", signed=True)


def describe(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, the set's point, the shingles whose regions the document lies in, and the set's image."""
    order = docs.sparkSession.sparkContext.broadcast(frequencies(docs, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = columns(batch, "doc_id", "text")
            n, points, prefixes, images = [], [], [], []
            for own in shingle_sets(texts, size):
                k = len(own) - (percent * len(own) + 99) // 100 + 1 if len(own) else 0
                rank = order.value[(own & np.uint64(COUNTERS - 1)).astype(np.int64)]
                n.append(len(own))
                points.append(point(own))
                prefixes.append(own[np.lexsort((own, rank))[:k]].view(np.int64))
                cells = np.bincount((own >> np.uint64(32)).astype(np.int64) % CELLS, minlength=CELLS)
                images.append(cells.astype(np.int8) if cells.max() < 128 else None)
            arrays = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(points, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(images, pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "point", "prefix", "image"])

    return docs.mapInArrow(run, "doc_id long, n long, point long, prefix array<long>, image array<tinyint>")


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """(point, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(shingle_sets(batch.column(batch.schema.get_field_index("text")).to_pylist(), size))
            yield pa.RecordBatch.from_arrays([pa.array([point(s) for s in own], pa.int64()), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))], names=["point", "shingles"])

    return docs.mapInArrow(run, "point long, shingles array<long>")


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with their exact similarity as numbers of common and of all shingles. Only the
    sets that the pairs name are shuffled, when their list is short enough to be broadcast."""
    if 2 * pairs.count() <= BROADCAST_IDS:
        named = pairs.select(F.explode(F.array("a", "b")).alias("point")).distinct()
        sets = sets.join(F.broadcast(named), "point", "left_semi")
    one = pairs.join(sets.select(F.col("point").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(sets.select(F.col("point").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return two.select("a", "b", common.cast("long").alias("common"), (F.size("sa") + F.size("sb") - common).cast("long").alias("either"))


def ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def may_link(percent: int) -> Column:
    """Bounds on (n, image) and (pn, pimage) that every link meets."""
    sizes = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
    common = F.aggregate(F.zip_with("image", "pimage", lambda x, y: F.least(x, y)), F.lit(0).cast("int"), lambda s, x: s + x)
    return sizes & F.coalesce((100 + percent) * common >= percent * (F.col("n") + F.col("pn")), F.lit(True))


class Sets:
    """The shingles of points, read from the texts when they are first asked for."""

    def __init__(self, docs: DataFrame, owners: DataFrame, size: int):
        self.docs, self.owners, self.size = docs, owners, size
        self.table: DataFrame | None = None

    def of(self, pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("point")).unionByName(pairs.select(F.col("b").alias("point"))).distinct()
        if self.table is not None:
            wanted = wanted.join(self.table.select("point"), "point", "left_anti")
        wanted = materialize(wanted.join(self.owners, "point"), "wanted")
        n = wanted.count()
        if n or self.table is None:
            found = sets_of(only_with(self.docs, wanted.select(F.col("first").alias("doc_id")).distinct(), ["doc_id"], n), self.size)
            points = wanted.select("point")
            found = found.join(F.broadcast(points) if n <= BROADCAST_IDS else points, "point", "left_semi").dropDuplicates(["point"])
            found = materialize(found, "shingles")
            self.table = found if self.table is None else self.table.unionByName(found)
        return self.table


def judged(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """One row per document (doc_id, n, point), and one per point with its component: (point, label,
    component_id). Components of clashing ids may have one component_id, but never one label."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    about = materialize(describe(docs, size, percent), "sets")
    real = about.where("n > 0 and doc_id is not null")
    points = materialize(real.groupBy("point").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "points")
    single = real.join(small(points.where("copies > 1").select("point", "first")), "point", "left").where("first is null or first = doc_id")
    members = single.select(F.posexplode("prefix").alias("place", "token"), "point", "n")
    # Of a pair the shorter set can be met at this place, and any pair only against a set of this size.
    shorter = (100 + percent) * (F.col("n") - F.col("place")) >= 2 * percent * F.col("n")
    shared = members.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.max(shorter).alias("met"), F.min("n").alias("least")).where("k > 1 and met").select("token", "least")
    region = members.join(shared, "token").where((100 + percent) * (F.col("n") - F.col("place")) >= percent * (F.col("n") + F.col("least"))).drop("least")
    region = materialize(region.dropDuplicates(["token", "point"]), "regions")  # dealt by token already
    # Regions of the same points are one region, with the number of their shingles as its weight and
    # each point's first place in them.
    same = region.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("point").alias("pivot"), F.bit_xor(F.xxhash64("point")).alias("s1"), F.sum(F.pmod(F.xxhash64("point", F.lit(1)), F.lit(1 << 32))).alias("s2")).where("k > 1")
    region = region.join(same, "token").groupBy("k", "s1", "s2", "pivot", "point").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("weight"))
    region = materialize(region.select(F.xxhash64("k", "s1", "s2", "pivot").alias("token"), "pivot", "point", "place", "weight"), "regions")
    images = single.select("point", "n", "image").dropDuplicates(["point"])
    images = materialize(images.join(region.select("point").distinct(), "point", "left_semi"), "images")
    sets = Sets(docs, points.select("point", "first"), size)
    close = F.expr(f"100 * common >= {percent} * either")
    pivots_ = images.select(F.col("point").alias("pivot"), F.col("n").alias("pn"), F.col("image").alias("pimage"))

    pairs = region.where("point <> pivot").groupBy("point", "pivot").agg(F.sum("weight").alias("k"))
    pairs = pairs.join(images, "point").join(pivots_, "pivot").where(may_link(percent))
    homes = materialize(pairs.groupBy("point").agg(F.max(F.struct("k", "pivot")).alias("h")).select("point", F.col("h.pivot").alias("pivot")), "homes")
    first = materialize(homes.select(*ordered("point", "pivot")).distinct(), "pairs")
    known = materialize(distances(first, sets.of(first)), "pairs")
    links = known.where(close).select("a", "b")
    label = components(links)

    # Distance to the home pivot, for the triangle inequality.
    home = homes.select("point", F.col("pivot").alias("home"), *ordered("point", "pivot")).join(known, ["a", "b"])
    home = home.select("point", "home", (1 - F.col("common") / F.col("either")).alias("d"))
    images = materialize(images.join(home, "point", "left"), "images")
    theta = (100 - percent) / 100 + 1e-9
    apart = F.coalesce((F.col("home") == F.col("phome")) & (F.abs(F.col("d") - F.col("pd")) > theta), F.lit(False))
    remain = F.least(F.col("n") - F.col("place"), F.col("pn") - F.col("pplace"))
    may_start = (100 + percent) * remain >= percent * (F.col("n") + F.col("pn"))
    open_, take, turn = region.select("token", "point", "place"), 4, 1
    while True:
        named = open_.join(label.select(F.col("node").alias("point"), "label"), "point", "left").withColumn("label", F.coalesce("label", "point"))
        parts = named.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
        mixed = parts.groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("k", "label")).alias("most")).where("parts > 1").select("token", F.col("most.label").alias("largest"))
        open_ = materialize(named.join(mixed, "token"), "open")
        if not open_.limit(1).count():
            break
        inner = F.col("label") == F.col("largest")
        rank = F.row_number().over(Window.partitionBy("token").orderBy(inner.desc() if turn <= INNER_ROUNDS else inner, "point"))
        chosen = materialize(open_.select("token", "point", "place", "label", rank.alias("rank")).where(F.col("rank") <= take).drop("rank"), "pivots")
        full = images.select("point", "n", "image", "home", "d")
        left = open_.select("token", "point", "place", "label").join(full, "point")
        right = chosen.join(full, "point").toDF("pivot", "token", "pplace", "plabel", "pn", "pimage", "phome", "pd")
        pairs = left.join(right, (left["token"] == right["token"]) & (F.col("label") != F.col("plabel")) & may_start & may_link(percent) & ~apart)
        pairs = pairs.select(*ordered("point", "pivot")).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        new = materialize(distances(pairs, sets.of(pairs)), "pairs")
        known = known.unionByName(new)
        links = new.where(close).select("a", "b")
        if links.limit(1).count():
            # A component so far is a star around its label: its links need not be gone through again.
            label = components(links.unionByName(label.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))))
        open_ = open_.join(chosen.select("token", "point"), ["token", "point"], "left_anti").select("token", "point", "place")
        take, turn = 4 * take, turn + 1

    named = points.join(label.select(F.col("node").alias("point"), "label"), "point", "left").withColumn("label", F.coalesce("label", "point"))
    first = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return about.select("doc_id", "n", "point"), named.select("point", "label").join(first, "label").select("point", "label", "component_id")


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    about, of = judged(docs, size, percent)
    out = about.join(of.select("point", "component_id"), "point", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the smallest doc_id, with its smallest point if
    several of its texts are in the component. Of a doc_id with several texts each goes or stays by its
    own set; rows with a null doc_id, and rows that repeat a doc_id and set, stay together."""
    about, of = judged(docs, size, percent)
    about = about.where("doc_id is not null").select("doc_id", "n", "point")
    found = materialize(about.where("n > 0").join(of, "point").select("doc_id", "point", "label", "component_id"), "components")
    first = found.where("doc_id = component_id").select("doc_id", "point", "label").distinct()
    extra = first.join(first.groupBy("label").agg(F.min("point").alias("stays")), "label").where("point <> stays")
    gone = found.where("doc_id <> component_id").select("doc_id", "point").unionByName(extra.select("doc_id", "point"))
    gone = materialize(gone.distinct(), "near-copies")
    ids = materialize(gone.select("doc_id").distinct(), "near-copies")
    n = ids.count()
    # A doc_id goes whole, unless another text of it stays: the rows of such a doc_id go by their sets.
    stay = only_with(about, ids, ["doc_id"], n).join(gone, ["doc_id", "point"], "left_anti").select("doc_id").distinct()
    partly = materialize(gone.join(stay, "doc_id", "left_semi"), "near-copies")
    left = docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*quoted(*docs.columns))
    k = partly.count()
    return left.unionByName(other_sets(docs, partly, k, size)) if k else left


def other_sets(docs: DataFrame, gone: DataFrame, n: int, size: int) -> DataFrame:
    """The rows of ``docs`` with a doc_id of the ``n`` rows of ``gone`` (doc_id, point), but another point."""
    own = only_with(docs, gone.select("doc_id").distinct(), ["doc_id"], n).select(*quoted(*docs.columns))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [point(s) for s in shingle_sets(batch.column(at).to_pylist(), size)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(points, pa.int64())], names=[*batch.schema.names, f"c{len(batch.schema.names)}"])

    own, gone = with_batches(own, run, "__point"), gone.toDF("__id", "__gone")
    same = (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__point") == F.col("__gone"))
    return own.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, same, "left_anti").drop("__point")
