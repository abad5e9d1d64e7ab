"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

#: Edges that a task joins by itself, in some 100 bytes each.
TASK_EDGES = 1 << 20


def least_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, label): the nodes of an edge list and the smallest node of each one's component."""
    node, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(node))
    while True:
        lx, ly = label[x], label[y]
        far = lx != ly
        if not far.any():
            return node, node[label]
        x, y, lx, ly = x[far], y[far], lx[far], ly[far]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))  # a root gets a smaller root
        while (label[label] != label).any():
            label = label[label]


@c.giving_back
def _contract(batches):
    """The edges of a task as stars around the smallest nodes."""
    held, count = [], 0

    def done():
        node, label = least_of(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], ["node", "label"])

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        count += b.num_rows
        if count >= 2 * TASK_EDGES:
            yield done()
            held, count = [], 0
    if count:
        yield done()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component, from (a, b) rows of a written table.

    Edges are first made into stars by tasks of up to TASK_EDGES edges; where one task
    holds all of them, its stars are the components.  Otherwise labels spread along edges and then jump to their label's label, so that the
    rounds grow with the logarithm of a chain's length.  Each round is a table in
    the shared folder; nothing but a count of changes reaches the driver.  Only
    labels that have a smaller label themselves are looked up, and the rows of a
    label are dealt over several tasks, as one component may hold most nodes.
    """
    tasks = -(-max(1, edges.count()) // TASK_EDGES)
    stars = edges.select("a", "b").coalesce(tasks).mapInArrow(_contract, "node long, label long")
    if tasks == 1:
        return c.settle(stars)
    stars = stars.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    both = c.settle(stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = c.settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = c.lookup(both, labels.select(F.col("node").alias("b"), "label"), "b", "a").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        ahead = labels.where("label <> node").select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = c.settle(c.lookup(spread, ahead, "label", "node", "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")))
        c.drop(labels)
        if not moved.where("label <> was").limit(1).count():
            c.drop(both)
            return moved
        labels = moved
