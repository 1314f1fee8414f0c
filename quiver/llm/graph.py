"""Connected components of an edge table, in Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from quiver.session import materialize, ship_package

_CHUNK = 1 << 19


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of every node of the edges a-b."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches):
    """Edges of a task as stars of their local components, a bounded number of edges at a time."""
    held, size = [], 0

    def stars():
        nodes, low = local_components(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.RecordBatch.from_arrays([pa.array(low), pa.array(nodes)], ["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += len(batch)
        if size > _CHUNK:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node in ``edges``; component is the smallest node reachable.

    Tasks first contract their own edges to stars; then large-star and small-star rounds alternate
    (Kiveris et al., 2014) until only stars are left. A hub's edges are reduced by a map-side minimum and a
    join, not gathered. Every round is written to the shared checkpoint folder, so a lost executor costs one
    round; rounds grow with the logarithm of the largest component. Empty edges give no rows; self-edges give
    the node itself; edges with a null end are dropped.
    """
    ship_package(edges.sparkSession)
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    written = materialize(pairs.mapInArrow(_contract, "u long, v long").distinct())
    pairs = written.where("u < v")
    while True:
        # done when no node hangs on two others and no centre hangs on another
        hung = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("centre"))
        centres = pairs.select(F.col("u").alias("v"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("centre"))
        open_ends = hung.unionByName(centres).groupBy("v").agg(F.max("n").alias("n"), F.max("centre").alias("centre")).where("n > 1 OR (n = 1 AND centre = 1)")
        if open_ends.isEmpty():
            break
        # large star: the larger neighbours of u hang on the smallest of u and its neighbours
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v")
        # small star: v and its smaller neighbours hang on the smallest of them
        least = F.min("u").over(W.partitionBy("v"))
        small = large.withColumn("m", least).select(F.explode(F.array(F.struct(F.col("m").alias("u"), "v"), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e"))
        pairs = materialize(small.select("e.*").where("u < v").distinct())
    found = pairs.select(F.col("v").alias("node"), F.col("u").alias("component"))
    roots = written.where("u = v").select(F.col("u").alias("node"))
    roots = roots.join(found.select("node"), "node", "left_anti").distinct()
    return found.unionByName(roots.select("node", F.col("node").alias("component")))
