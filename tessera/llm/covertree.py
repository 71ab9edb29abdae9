"""Exact pairs of vectors above a cosine threshold by a dual traversal of cover trees."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.components import local_labels, named_components

#: The upper levels are built over at most so many vectors, those with the least hash; every vector is then placed.
SAMPLE = 2048
#: A node is split no further once its share of the sample stands for fewer vectors than this, and a leaf with more is
#: cut into units of this many, or of so many bytes.
UNIT, UNIT_BYTES = 8192, 8 << 20
#: At most so many leaves, since all pairs of leaves are looked at by the driver.
LEAVES = 512
#: Slack for single precision: pairs this close to the threshold are decided in double precision.
SLACK = 1e-4


@dataclass
class Node:
    """A ball of the cover tree: its centre (a row of the sample), the points it covers, and its children one level
    down, whose centres lie within half its radius of their own points. A child may keep its parent's centre."""

    center: int
    points: np.ndarray
    children: list[Node]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def _net(x: np.ndarray, points: np.ndarray, first: int, radius: float, most: int) -> tuple[list[int], np.ndarray] | None:
    """Greedy net of some points: centres farther than radius apart, `first` being one, and each point's nearest
    centre. None if it takes more than `most` centres."""
    centers, near = [first], _distances(x[points], x[[first]])[:, 0]
    owner = np.zeros(len(points), int)
    while (far := near > radius).any():
        if len(centers) == most:
            return None
        new = points[int(np.argmax(far))]  # the first uncovered one
        d = _distances(x[points], x[[new]])[:, 0]
        closer = d < near
        owner[closer], near = len(centers), np.minimum(d, near)
        centers.append(int(new))
    return centers, owner


def build(x: np.ndarray, points: np.ndarray, least: int, most: int) -> Node:
    """A cover tree with nested centres and radii 1, 1/2, 1/4, ... down to nodes of `least` points, of `most` leaves at
    the most: a level that would take more is left as it is."""
    root = Node(int(points[0]), points, [])
    level, leaves, radius = [root], 1, 1.0
    while level and radius > 1e-3:
        below = []
        for node in level:
            if len(node.points) <= least:
                continue
            needed = math.ceil(len(node.points) / least)
            found = _net(x, node.points, node.center, radius, min(most - leaves + 1, 2 * needed))
            if found is None:
                # far more balls of this radius than units to make: as many as are needed, farthest first
                found = _spread(x, node.points, node.center, min(most - leaves + 1, needed))
            centers, owner = found
            if len(centers) > 1:
                node.children = [Node(c, node.points[owner == k], []) for k, c in enumerate(centers) if (owner == k).any()]
                leaves += len(node.children) - 1
                below += node.children
            else:
                below.append(node)
        level, radius = below, radius / 2
    return root


def _spread(x: np.ndarray, points: np.ndarray, first: int, n: int) -> tuple[list[int], np.ndarray]:
    centers, near, owner = [first], _distances(x[points], x[[first]])[:, 0], np.zeros(len(points), int)
    while len(centers) < n and near.max() > 0:
        new = int(points[int(np.argmax(near))])
        d = _distances(x[points], x[[new]])[:, 0]
        owner[d < near], near = len(centers), np.minimum(d, near)
        centers.append(new)
    return centers, owner


def leaves(node: Node) -> list[Node]:
    return [x for c in node.children for x in leaves(c)] if node.children else [node]


def surviving_pairs(x: np.ndarray, root: Node, radii: dict[int, float], reach: float) -> list[tuple[int, int]]:
    """Pairs of leaf numbers that can hold vectors within `reach` of each other.

    Both sides of a pair of nodes are descended at once; a pair is dropped where the distance of the centres exceeds
    the two covering radii and the reach. A leaf's covering radius is measured over all vectors placed in it; an inner
    node's follows from its children by the triangle inequality."""
    number = {id(n): k for k, n in enumerate(leaves(root))}
    cover: dict[int, float] = {}

    def covering(node: Node) -> float:
        if not node.children:
            cover[id(node)] = radii.get(number[id(node)], -1.0)
        else:
            inner = [(c, covering(c)) for c in node.children]
            cover[id(node)] = max((float(_distances(x[[node.center]], x[[c.center]])[0, 0]) + r for c, r in inner if r >= 0), default=-1.0)
        return cover[id(node)]

    covering(root)
    out, stack = [], [(root, root)]
    while stack:
        a, b = stack.pop()
        if cover[id(a)] < 0 or cover[id(b)] < 0:
            continue
        if a is not b and float(_distances(x[[a.center]], x[[b.center]])[0, 0]) > cover[id(a)] + cover[id(b)] + reach + 1e-6:
            continue
        if not a.children and not b.children:
            out.append(tuple(sorted((number[id(a)], number[id(b)]))))
        elif a is b:
            stack += [(c, d) for i, c in enumerate(a.children) for d in a.children[i:]]
        elif not b.children or (a.children and cover[id(a)] >= cover[id(b)]):
            stack += [(c, b) for c in a.children]
        else:
            stack += [(a, c) for c in b.children]
    return sorted(set(out))


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _balls(x: np.ndarray, most: int = 64) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The levels of a unit below its leaf, down to `most` balls: (centres, covering radii, members)."""
    points, found = np.arange(len(x)), ([0], np.zeros(len(x), int))
    radius = 1.0
    while radius > 0.05 and (finer := _net(x, points, 0, radius, most)) is not None:
        found, radius = finer, radius / 2
    centers, owner = found
    members = [np.flatnonzero(owner == k) for k in range(len(centers))]
    kept = [(c, m) for c, m in zip(centers, members, strict=True) if len(m)]
    return x[[c for c, _ in kept]], np.array([_distances(x[m], x[[c]]).max() for c, m in kept]), [m for _, m in kept]


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool):
    """Index pairs (i, j) with cosine of at least threshold between rows of x and y, in blocks; i < j if same."""
    reach = math.sqrt(2 - 2 * threshold)
    cx, rx, mx = _balls(x)
    cy, ry, my = (cx, rx, mx) if same else _balls(y)
    near = _distances(cx, cy) <= rx[:, None] + ry[None, :] + reach + 1e-6
    x32, y32 = x.astype(np.float32), y.astype(np.float32)
    for k, rows in enumerate(mx):
        others = [my[j] for j in np.flatnonzero(near[k])]
        if not others:
            continue
        columns = np.concatenate(others)
        for a in range(0, len(rows), 512):
            some = rows[a : a + 512]
            for b in range(0, len(columns), 4096):
                there = columns[b : b + 4096]
                i, j = np.nonzero(x32[some] @ y32[there].T >= threshold - SLACK)
                i, j = some[i], there[j]
                if same:
                    i, j = i[i < j], j[i < j]
                for c in range(0, len(i), 1 << 16):
                    p, q = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                    sure = np.einsum("ij,ij->i", x[p], y[q]) >= threshold
                    if sure.any():
                        yield p[sure], q[sure]


def usable(vector):
    """Whether a vector can link: not null or empty, all components there and finite, not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row: how many others have cosine >= threshold, the least id reachable
    by such links, and whether that is the row itself.

    Equal vectors are one class and are compared once, with their number as weight. Classes are placed in the leaves of
    a cover tree over a bounded sample; leaves are cut into units, and each pair of units that the dual traversal
    cannot rule out is one small task. Null, zero and non-finite vectors and rows without an id link with nothing, nor
    do vectors of different lengths; such rows are kept. Rows that share an id are vectors of their own, each with the
    links of its own. Other columns are not looked at; an empty table gives no rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = usable(F.col("v")) & F.col("id").isNotNull()
    # classes have numbers of their own, since several may have the same least id; they are settled once written
    equal = rows.filter(sound).groupBy("v").agg(F.min("id").cast("long").alias("least_id"), F.count(F.lit(1)).alias("size"))
    classes = materialise(equal.withColumn("class_id", F.monotonically_increasing_id()), "vector-classes")
    lengths = [r["n"] for r in classes.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]
    found = None
    for n in lengths:  # one, unless vectors of several lengths are mixed
        stored = "<f4" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
        part = _links(classes.filter(F.size("v") == n), n, threshold, stored)
        found = part if found is None else found.unionByName(part)
    if found is None:
        links = spark.createDataFrame([], "class_id bigint, others bigint, component_id bigint")
    else:
        found = materialise(found, "vector-links")
        links = found.groupBy("class_id").agg(F.sum("links").cast("long").alias("others"))
        parts = named_components(found.select(F.col("class_id").alias("a"), F.col("label").alias("b")), classes.select(F.col("class_id").alias("node"), F.col("least_id").alias("name")))
        links = links.join(parts.select(F.col("node").alias("class_id"), F.col("name").alias("component_id")), "class_id", "left")
    by_class = classes.join(links, "class_id", "left").select(F.col("v").alias("w"), (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    out = rows.join(by_class, sound & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _links(classes: DataFrame, n: int, threshold: float, stored: str) -> DataFrame:
    """(class_id, links, label) per class and pair of units in which it has links; blocks hold numbers as `stored`."""
    spark = classes.sparkSession
    total = classes.count()
    unit = max(16, min(UNIT, UNIT_BYTES // (8 * n)))
    sample = classes.select("class_id", "v").orderBy(F.xxhash64("class_id", F.lit(7)), "class_id").limit(SAMPLE).collect()
    x = _unit(np.array([r["v"] for r in sample]))
    root = build(x, np.arange(len(x)), max(1, len(x) * unit // max(total, 1)), LEAVES)
    centers = x[[leaf.center for leaf in leaves(root)]]

    @F.arrow_udf("struct<leaf:int,far:double>")
    def place(column: pa.Array) -> pa.Array:
        values = np.asarray(column.flatten()).reshape(len(column), n)
        leaf, far = np.zeros(len(values), np.int32), np.zeros(len(values))
        for a in range(0, len(values), 4096):
            d = _distances(_unit(values[a : a + 4096]), centers)
            leaf[a : a + 4096], far[a : a + 4096] = d.argmin(1), d.min(1)
        return pa.StructArray.from_arrays([pa.array(leaf), pa.array(far)], names=["leaf", "far"])

    placed = materialise(classes.withColumn("_at", place("v")).select("class_id", "size", "v", F.col("_at")["leaf"].alias("leaf"), F.col("_at")["far"].alias("far")), "vector-leaves")
    held = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # a row a leaf
    cuts = {r["leaf"]: max(1, math.ceil(r["n"] / unit)) for r in held}
    pairs = surviving_pairs(x, root, {r["leaf"]: r["far"] for r in held}, math.sqrt(2 - 2 * threshold))
    sizes = F.broadcast(spark.createDataFrame(sorted(cuts.items()), "leaf int, cuts int"))
    cut = placed.join(sizes, "leaf").withColumn("cut", F.pmod(F.xxhash64("class_id"), F.col("cuts")).cast("int"))

    def block(key, rows):
        values = np.asarray(pa.concat_arrays([c.flatten() for c in rows.column("v").chunks])).astype(stored)
        return pa.table({"leaf": key[0:1], "cut": key[1:2]} | {"ids": [rows.column("class_id").to_numpy().astype("<i8").tobytes()], "sizes": [rows.column("size").to_numpy().astype("<i8").tobytes()], "vs": [values.tobytes()]}, schema=pa.schema([("leaf", pa.int32()), ("cut", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("vs", pa.binary())]))

    blocks = materialise(cut.groupBy("leaf", "cut").applyInArrow(block, "leaf int, cut int, ids binary, sizes binary, vs binary"), "vector-blocks")
    listed = spark.createDataFrame([(a, b, cuts[a], cuts[b]) for a, b in pairs], "leaf_a int, leaf_b int, cuts_a int, cuts_b int")
    units = listed.withColumn("cut_a", F.explode(F.sequence(F.lit(0), F.col("cuts_a") - 1))).withColumn("cut_b", F.explode(F.sequence(F.lit(0), F.col("cuts_b") - 1)))
    units = units.filter((F.col("leaf_a") != F.col("leaf_b")) | (F.col("cut_a") <= F.col("cut_b"))).select("leaf_a", "cut_a", "leaf_b", "cut_b")
    left, right = (blocks.select(*[F.col(c).alias(f"{c}_{side}") for c in blocks.columns]) for side in "ab")
    joined = units.join(left, ["leaf_a", "cut_a"]).join(right, ["leaf_b", "cut_b"])

    def compare(rows):
        return pa.Table.from_batches(list(_compared(rows.to_pylist(), n, threshold, stored)), schema=pa.schema([("class_id", pa.int64()), ("links", pa.int64()), ("label", pa.int64())]))

    return joined.groupBy("leaf_a", "cut_a", "leaf_b", "cut_b").applyInArrow(compare, "class_id bigint, links bigint, label bigint")


def _compared(rows: list[dict], n: int, threshold: float, stored: str):
    for r in rows:
        same = (r["leaf_a"], r["cut_a"]) == (r["leaf_b"], r["cut_b"])
        ids_a, ids_b = (np.frombuffer(r[f"ids_{s}"], "<i8") for s in "ab")
        size_a, size_b = (np.frombuffer(r[f"sizes_{s}"], "<i8") for s in "ab")
        x, y = (_unit(np.frombuffer(r[f"vs_{s}"], stored).reshape(-1, n)) for s in "ab")
        ids = ids_a if same else np.concatenate([ids_a, ids_b])
        shift = 0 if same else len(ids_a)
        links = np.zeros(len(ids), np.int64)
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        label = np.arange(len(ids))  # by rank
        for i, j in close_pairs(x, y, threshold, same):
            np.add.at(links, i, size_b[j])
            np.add.at(links, j + shift, size_a[i])
            a, b = label[rank[i]], label[rank[j + shift]]
            label = local_labels(len(ids), a, b)[label]
        at = np.flatnonzero(links)
        if len(at):
            yield pa.record_batch([pa.array(ids[at]), pa.array(links[at]), pa.array(ids[order[label[rank[at]]]])], names=["class_id", "links", "label"])
