"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import discard, materialize

#: Edges up to which, by count, one task takes them all (4 MB); rounds over so few cost many tasks for little.
ONE_TASK_EDGES = 1 << 18


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Return (node, label) for every node of ``edges`` (a long, b long).

    ``label`` is the smallest node of the component.  Up to ``ONE_TASK_EDGES`` edges
    are joined in one task.  Of more, large-star and small-star steps alternate until
    the edges stop changing; the table is written in the shared folder after each
    round.  No link reaches the driver.  Self-loops and repeated or reversed edges
    are allowed; an empty table gives none.
    """
    given = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    if given.count() <= ONE_TASK_EDGES:
        return given.coalesce(1).mapInArrow(_join_all, "node long, label long")
    now = materialize(given.distinct(), "edges")
    discard(given)
    mark = _fingerprint(now)
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        before, now = now, materialize(small.union(low2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before)
        new = _fingerprint(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.union(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Return the sorted nodes of edges and the smallest node that each one reaches."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return nodes, nodes[label]
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))  # the larger root goes below the smaller
        while not np.array_equal(up := label[label], label):
            label = up


def _join_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of a task."""
    parts = [(x.column("u").to_numpy(), x.column("v").to_numpy()) for x in batches]
    if parts:
        nodes, labels = smallest_reachable(*(np.concatenate(p) for p in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], names=["node", "label"])


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)
