"""Connected components as joins: labels spread to neighbours and jump until none changes.

Joins of the operators carry the hint `merge`: Spark judges a side by the bytes of its files, before rows are exploded,
and would send millions of them through the driver to every executor.
"""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """`df` written below the checkpoint folder that the session names, as Parquet, which takes a tenth of a checkpoint's room, and read from there; in tests a temporary folder is set."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="masonry-"))
    path = posixpath.join(spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir(), f"cut-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def emptied(*tables: DataFrame) -> None:
    """Takes the rows of tables that `cut` gave and nothing reads any more off the disk."""
    for df in tables:
        files = df.inputFiles()
        if files:
            df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(posixpath.dirname(files[0]))


#: Edges of a task that are united together.
UNITED = 1 << 20


def _loose(kind: pa.DataType) -> pa.DataType:
    return pa.struct([pa.field(f.name, _loose(f.type)) for f in kind]) if pa.types.is_struct(kind) else kind


def _leaves(nodes: pa.Array) -> list[pa.Array]:
    if not pa.types.is_struct(nodes.type):
        return [nodes]
    return [leaf for part in nodes.flatten() for leaf in _leaves(part)]


def _numbered(nodes: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each node among the distinct ones, and these in ascending order."""
    key = np.zeros(len(nodes), np.int64)
    for leaf in _leaves(nodes):
        own = leaf.dictionary_encode("encode")
        key = pa.array(key * (len(own.dictionary) + 1) + own.indices.to_numpy(zero_copy_only=False)).dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.empty(int(key.max()) + 1, np.int64)
    first[key[::-1]] = np.arange(len(key))[::-1]
    one = nodes.take(pa.array(first))
    leaves = _leaves(one)
    order = pc.sort_indices(pa.table(leaves, [str(k) for k in range(len(leaves))]), sort_keys=[(str(k), "ascending") for k in range(len(leaves))], null_placement="at_start")
    rank = np.empty(len(first), np.int64)
    rank[order.to_numpy()] = np.arange(len(first))
    return rank[key], one.take(order)


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n numbers the least that edges (a, b) lead to."""
    label = np.arange(n)
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := label[label], label):
            label = further
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return label


def _united(most: int):
    """id, label, run of each node of a task's edges, up to `most` at a time: the least node that these edges lead to, and a number for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, held, size = TaskContext.get().partitionId() << 40, [], 0

        def rows() -> pa.RecordBatch:
            ends = [pa.concat_arrays([b.column(k).cast(_loose(b.column(k).type)) for b in held]) for k in (0, 1)]
            number, nodes = _numbered(pa.concat_arrays(ends))
            label = _least(len(nodes), number[: len(ends[0])], number[len(ends[0]) :])
            return pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label)), pa.array(label + given)], ["id", "label", "run"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= most:
                yield rows()
                given, held, size = given + 2 * size, [], 0
        if held:
            yield rows()

    return run


def components(edges: DataFrame, united: int = UNITED) -> DataFrame:
    """[A-11, A-17] id, label: for every node of an edge (a, b) the least node it can reach.

    A task unites the edges it has, `united` at a time, in NumPy; edges that come dealt by group are done then. Groups that have nodes
    in several of these runs are joined by their numbers in rounds. Edges with a null end join nothing.
    """
    node = edges.schema["a"].dataType.simpleString()
    whole = edges.select("a", "b").filter("a is not null and b is not null")
    found = cut(whole.mapInArrow(_united(united), f"id {node}, label {node}, run bigint"))
    shared = found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if shared.isEmpty():
        return found.select("id", "label")
    least = F.min("run").over(W.partitionBy("id"))
    links = found.select("run", least.alias("b")).filter("run <> b").select(F.col("run").alias("a"), "b")
    numbers = _rounds(links).withColumnsRenamed({"id": "run", "label": "group"})
    runs = found.groupBy("run").agg(F.min("label").alias("label")).join(numbers.hint("merge"), "run", "left").withColumn("group", F.coalesce("group", "run"))
    named = cut(runs.withColumn("label", F.min("label").over(W.partitionBy("group"))).select("run", "label"))
    joined = cut(found.select("id", "run").join(named.hint("merge"), "run").select("id", "label").distinct())
    emptied(found, named, numbers)
    return joined


def _rounds(edges: DataFrame) -> DataFrame:
    """`components` of edges of numbers, by joins in rounds."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        spread = labels.join(near.hint("merge"), "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        grown = cut(spread.join(jump.hint("merge"), "label").select("id", "old", F.least("label", "further").alias("label")))
        emptied(labels)
        labels = grown.select("id", "label")
        if grown.filter("label <> old").isEmpty():
            emptied(both)
            return labels


def rings(edges: DataFrame) -> DataFrame:
    """[A-28, G-16] head, pos, node of rings that directed edges (a, b) form: head is the ring's least node, pos counts from it along the edges.

    Edges and the nodes they leave get numbers, and only numbers are joined: they jump twice as far each round, so a ring of any length takes
    its logarithm of joins and no task holds a ring. Each node must have one edge out and one in; rings through others (pinched, open) are left out.
    """
    e = cut(edges.select("a", "b").withColumn("id", F.monotonically_increasing_id()))
    one, none = F.lit(1), F.lit(None).cast("long")
    ends = e.select(F.col("a").alias("node"), F.col("id").alias("own"), none.alias("before")).union(e.select(F.col("b").alias("node"), none.alias("own"), F.col("id").alias("before")))
    met = ends.groupBy("node").agg(F.count("own").alias("n"), F.count("before").alias("m"), F.min("own").alias("own"), F.min("before").alias("before"))
    nodes = cut(met.filter("n = 1 and m = 1").select("node", "own", "before"))
    # the least number among so many nodes ahead, and how far it is; a jump that ends at no such node is on no ring
    reach = cut(nodes.select(F.col("before").alias("id"), F.col("own").alias("to"), F.col("before").alias("low"), F.lit(0).cast("long").alias("d")))
    width = 1
    while True:
        further = reach.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("low").alias("lower"), F.col("d").alias("more"))
        nearer = F.col("low") <= F.col("lower")
        grown = reach.join(further.hint("merge"), "to", "left").select(
            "id", F.col("next").alias("to"), F.when(nearer, F.col("low")).otherwise(F.col("lower")).alias("low"), F.when(nearer, F.col("d")).otherwise(F.col("more") + width).alias("d"), F.coalesce(F.col("low") <= F.col("lower"), F.lit(False)).alias("same")
        )
        grown = cut(grown)
        emptied(reach)
        reach, width = grown.filter("to is not null").select("id", "to", "low", "d"), 2 * width
        if grown.filter("not same").isEmpty():
            break
    found = cut(reach.join(nodes.select(F.col("own").alias("id"), "node").hint("merge"), "id").select("low", "d", "node"))
    heads = found.groupBy("low").agg(F.count(one).alias("n"), F.min(F.struct("node", "d")).alias("h"))
    emptied(e)
    return found.join(heads.hint("merge"), "low").select(F.col("h.node").alias("head"), F.pmod(F.col("h.d") - F.col("d"), F.col("n")).alias("pos"), "node")
