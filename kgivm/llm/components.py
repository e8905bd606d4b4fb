"""Connected components of an edge table by minimum labels and pointer jumping; every round ends in a shared table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgivm.llm import scratch


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every node of some edges to the smallest node of its component, itself left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    inner = label != np.arange(len(nodes))
    return nodes[label[inner]], nodes[inner]


def forest(edges: DataFrame, a: str, b: str) -> DataFrame:
    """a, b: fewer edges (of long nodes) with the same components. Those at a node ``a`` meet in one task, which leaves one edge for each of its nodes at most."""
    sent = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).repartition("a")

    def reduce(batches):
        have = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            have = spanning(*(np.concatenate([have[i], batch.column(i).to_numpy()]) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in have], ["a", "b"])

    return sent.mapInArrow(reduce, "a long, b long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its smallest node) for every node of an edge. Order, direction and repeats do not matter."""
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = scratch.saved(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("c")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
        lower = scratch.saved(labels.join(near, "a").select("a", F.col("c").alias("old"), F.least("c", "m").alias("c")))
        scratch.remove(spark, labels)
        jumped = scratch.saved(lower.join(lower.select(F.col("a").alias("c"), F.col("c").alias("up")), "c").select("a", "old", F.least("c", "up").alias("c")))
        scratch.remove(spark, lower)
        if jumped.where("c <> old").isEmpty():
            scratch.remove(spark, both)
            return jumped.select(F.col("a").alias("node"), F.col("c").alias("component"))
        labels = jumped.select("a", "c")
