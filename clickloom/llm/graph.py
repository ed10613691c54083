"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.session import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges, and the smallest node each one reaches by them: labels fall along edges until none does."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each batch replaced by one from every node to its smallest."""
    for batch in batches:
        nodes, low = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        off = nodes != low
        yield pa.record_batch([pa.array(nodes[off]), pa.array(low[off])], names=["u", "v"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie the neighbours of each node to the smallest of them: the larger ones, or the smaller ones and the node itself."""
    ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    if large:
        tied = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = ways.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tied = tied.unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that has an edge; ``edges``: two columns of longs.

    Alternates the two star operations until nothing changes, about log(n) rounds. Each is a
    pre-aggregated minimum and a join that can be split, so a node with very many edges is no
    bottleneck. Rounds are written, so a lost executor repeats one round at most. Loops are ignored.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v")
    edges = written(edges.mapInArrow(_local, "u long, v long").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        edges = written(_star(_star(edges, True), False))
