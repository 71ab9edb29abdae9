"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise


def _fingerprint(edges: DataFrame) -> tuple:
    """What tells sets of distinct edges apart: their number and two exclusive ors of hashes, which no number overflows."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("a", "b", F.lit(1)))).first())


#: A key held by more rows than this, and by more than a HUBS-th of them all, is a hub: there are HUBS of them at most.
HUB, HUBS = 1024, 10_000


def join_named(rows: DataFrame, named: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with `named`, which has one row for each key and in `count` how many of the `total` rows hold it.

    Keys of many rows, of which there are at most HUBS, are broadcast, so that their rows stay where they are; only the
    rows of the others are shuffled. rows should be a written table, since it is read twice."""
    most = max(HUB, total // HUBS)
    hubs, rest = (named.filter(held).drop(count) for held in (F.col(count) > most, F.col(count) <= most))
    names = hubs.select(key, F.lit(True).alias("_hub"))
    others = rows.join(F.broadcast(names), key, "left").filter(F.col("_hub").isNull()).drop("_hub")
    return rows.join(F.broadcast(hubs), key).unionByName(others.join(rest, key))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); a component is named by its least node.

    Each round joins the edges with the least neighbour of each node, where the edges of a hub stay in the tasks that
    read them. Loops, repeated edges and null ends are ignored; no edges, no rows. The rounds needed grow with the
    logarithm of a component's diameter; each is written to the shared folder."""
    now = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(now, "edges")
    seen = _fingerprint(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_named(both, least, "a", "n", 2 * seen[0]).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = join_named(large, least, "a", "n", seen[0]).filter(F.col("b") != F.col("m")).select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = materialise(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        if (found := _fingerprint(now)) == seen:
            break
        seen = found
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def named_components(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(node, name) of every node of edges (a, b): the least name that a node of its component has in (node, name)."""
    found = materialise(connected_components(edges).join(names, "node"), "components")
    least = found.groupBy("component").agg(F.min("name").alias("least"), F.count(F.lit(1)).alias("n"))
    return join_named(found, least, "component", "n", found.count()).select("node", F.col("least").alias("name"))


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 of one task, the least node of each one's component under edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    while (label != label[label]).any():
        label = label[label]
    return label
