"""Spark helpers of the operators: shared folder, materialised tables, connected groups."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors share.

    Only where that is unset and Spark runs in this one process a temporary folder is set instead.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if at:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(at)
        return at
    if context.getCheckpointDir() is None:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="siftline-"))
    return context.getCheckpointDir()


#: Shuffle files of a written table's plan go as soon as it is written, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder, and read again; it is deleted at exit, if not before.

    The rows are computed once, and their lineage is cut.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/siftline-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    atexit.register(_delete, spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    made._siftline = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._siftline)


def partitions(df: DataFrame) -> int:
    """The partitions in which ``df`` is read."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


def releasing(made: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``made``, after which the worker gives the memory back that it has freed; it is kept for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from made(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)

    return run


#: Edges that a task contracts at a time.
CONTRACTED = 1 << 21


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``(u, v)`` that connect the same nodes: those of pieces of the input as stars around the least nodes."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        nodes, ends = np.unique(np.concatenate([t.column(0).to_numpy(), t.column(1).to_numpy()]), return_inverse=True)
        root = np.arange(len(nodes))
        a, b = ends[: len(t)], ends[len(t) :]
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root[root] != root).any():
                root = root[root]
            if (root == before).all():
                break
        leaf = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[leaf]), pa.array(nodes[root[leaf]])], ["u", "v"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= CONTRACTED:
            yield stars(held)
            held = []
    if held:
        yield stars(held)


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``(a, b)`` edges; root: the group's least node.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
    and Beyond"), each of which is a grouped minimum and a join; converges in O(log^2 n) rounds.
    Each task first contracts the edges that it holds to stars.  Null ends and loops count for nothing.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = written(e.distinct().mapInArrow(_contracted, "u bigint, v bigint"))
    for _ in range(rounds):
        if e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break  # every least node is a root: all groups are stars
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v")
        old, e = e, written(small.distinct().mapInArrow(_contracted, "u bigint, v bigint"))
        discard(old)
    else:
        raise RuntimeError(f"groups didn't settle in {rounds} rounds")
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
    return leaves.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Bits of the filter that marks what a second pass over the texts fetches: 16 MB at most.
FILTER_BITS = 1 << 27
#: Mixes the number of a part into the id of its row.
PART_FACTOR = 0x5851F42D


def free(docs: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as make it differ from the columns' names."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_id(docs: DataFrame, name: str = "_rid") -> DataFrame:
    """``docs`` and a hash of id and text, equal for repeats of a row and known for null ids."""
    return docs.withColumn(name, F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.col("text")))


def position_filter(wanted: DataFrame, bits: int | None = None) -> np.ndarray:
    """A bit table of the ``(rid, part)`` positions: all of them are in it, and some others by chance.

    It takes ``bits``, or 16 a position up to ``FILTER_BITS``; beyond, more others pass, none is lost.
    """
    bits = bits or _bits(wanted)
    at = F.col("rid").bitwiseXOR(F.col("part").cast("long") * PART_FACTOR).bitwiseAND(F.lit(bits - 1))
    made = wanted.select(F.shiftright(at, 6).cast("int").alias("w"), at.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    made = made.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[made.column("w").to_numpy()] = made.column("v").to_numpy()
    return table


def split(docs: DataFrame, rid: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose ``rid`` may be among those of ``wanted(rid)``, and the others, which aren't.

    They are told by a bit table, broadcast as rows of 64 bits; beyond ``FILTER_BITS`` more rows are in the first part.
    """
    bits = _bits(wanted)
    at = F.col(rid).bitwiseAND(F.lit(bits - 1))
    word, bit, table = free(docs, "_word"), free(docs, "_bit"), free(docs, "_set")
    made = wanted.select(F.col("rid").bitwiseAND(F.lit(bits - 1)).alias("at"))
    made = made.groupBy(F.shiftright("at", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias(table))
    marked = docs.withColumn(word, F.shiftright(at, 6)).withColumn(bit, at.bitwiseAND(F.lit(63)).cast("int"))
    marked = marked.join(F.broadcast(made), word, "left")
    hit = F.coalesce(F.expr(f"shiftrightunsigned(`{table}`, `{bit}`) & 1L"), F.lit(0)) == 1
    return marked.where(hit).select(docs.columns), marked.where(~hit).select(docs.columns)


def _bits(wanted: DataFrame) -> int:
    return table_bits(wanted.count())


def table_bits(count: int, each: int = 16) -> int:
    """The bits of a table of so many positions."""
    bits, most = 1 << 16, min(FILTER_BITS, each * count)
    while bits < most:
        bits *= 2
    return bits


def in_filter(table: np.ndarray, rid: np.ndarray, part: np.ndarray) -> np.ndarray:
    at = (rid ^ (part.astype(np.int64) * PART_FACTOR)) & np.int64(len(table) * 64 - 1)
    return ((table[at >> 6] >> (at & 63)) & 1).astype(np.bool_)


def grouped(keys: DataFrame, ratio: float, prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``(node, root)`` of the groups that verified pairs of ``keys(key, id, size)`` connect.

    Two ids are candidates if they share a key and the smaller size is ``ratio`` of the larger at
    least, and, where there is a column ``spot``, the key's places differ by no more than the sizes may.
    ``prepare(ids)`` gives the function that keeps the true ones of ``(a, b)`` pairs.

    Within one group no pair matters any more.  So each key's ids are first compared with its least
    id, and connected; then, of the keys whose ids aren't in one group yet, all pairs across groups
    are compared.  This gives the groups that comparing all pairs gives, without the pairs within
    large groups of copies.
    """
    w = Window.partitionBy("key")
    values = [c for c in ("size", "spot") if c in keys.columns]
    members = keys.repartition("key").groupBy("key", "id").agg(*(F.max(c).alias(c) if c == "size" else F.min(c).alias(c) for c in values))
    members = members.select("key", "id", *values, F.min(F.struct("id", *values)).over(w).alias("lead"), F.max("id").over(w).alias("last"))
    members = written(members.where("lead.id <> last").drop("last"))
    verify = prepare(members.select("id").distinct())

    def near(before: str, after: str) -> Column:
        sizes, spots = ([f"{before}{c}{after}", c] for c in ("size", "spot"))
        alike = F.least(*sizes) >= F.greatest(*sizes) * F.lit(ratio)
        if "spot" in values:
            alike &= F.abs(F.col(spots[0]) - F.col(spots[1])) <= F.greatest(*sizes) * F.lit(1 - ratio) + 1
        return alike

    first = members.where(F.col("id") != F.col("lead.id")).where(near("lead.", ""))
    edges = written(verify(first.select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct()))
    groups = connected(edges)
    placed = members.join(groups, members.id == groups.node, "left").select("key", "id", *values, F.coalesce("root", "id").alias("root"), (F.col("id") == F.col("lead.id")).alias("led"))
    mixed = placed.select("*", F.min("root").over(w).alias("low"), F.max("root").over(w).alias("high")).where("low <> high AND NOT led").select("key", "id", *values, "root")
    other = mixed.select("key", F.col("id").alias("id2"), *(F.col(c).alias(f"{c}2") for c in values), F.col("root").alias("root2"))
    across = mixed.join(other, "key").where("root < root2").where(near("", "2"))
    more = written(verify(across.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()))
    if more.isEmpty():
        return groups
    return connected(edges.select("a", "b").union(more.select("a", "b")))
