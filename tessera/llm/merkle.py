"""A Merkle manifest of a dataset: levels built bottom up and persisted, proofs pushed down from the root."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.sharding import number_rows

#: What a leaf is the digest of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: So many consecutive nodes become one.
WIDTH = 16
#: Up to this many trees their sizes are broadcast (some MB); above, they are joined by shuffle.
BROADCAST_TREES = 50_000


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row: each field as its length in UTF-8 bytes, a colon and its value, a null field as a dash."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


@dataclass
class Forest:
    """Trees over numbered nodes, of any number and height.

    `levels[k]` holds a row for each run of consecutive nodes of level k: (tree, size, run, nodes), size being how many
    nodes of the tree the level has and nodes an array of at most `width` structs in order. `tops` holds a row for each
    tree: (tree, height, digest, and for trees of one leaf what that leaf carries)."""

    levels: list[DataFrame]
    tops: DataFrame


def grow(leaves: DataFrame, width: int = WIDTH) -> Forest:
    """The levels above leaves of (tree, size, at, digest, held): `at` numbers the leaves of a tree from 0, `size` is
    how many there are and `held` is any struct that stays with the leaf.

    Runs are keyed by tree and number, so a tree that holds most leaves is dealt out as evenly as many small ones; every
    level is a sixteenth of the one below and is written before the next is made."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    single = F.col("size") == 1
    tops = leaves.filter(single).select("tree", F.lit(0).alias("height"), "digest", "held")
    empty = F.lit(None).cast(leaves.schema["held"].dataType)
    nodes, levels = leaves.select("tree", "size", "at", F.struct("at", "digest", "held").alias("node")), []
    while most > 1:
        run = F.floor(F.col("at") / width).cast("long")
        level = nodes.filter(~single).groupBy("tree", "size", run.alias("run")).agg(F.sort_array(F.collect_list("node")).alias("nodes"))
        levels.append(materialise(level, f"merkle-level-{len(levels)}"))
        joined = digest(F.array_join(F.transform("nodes", lambda x: x["digest"]), ""))
        above = levels[-1].select("tree", F.ceil(F.col("size") / width).cast("long").alias("size"), F.col("run").alias("at"), joined.alias("digest"))
        tops = tops.unionByName(above.filter(single).select("tree", F.lit(len(levels)).alias("height"), "digest", empty.alias("held")))
        nodes = above.select("tree", "size", "at", F.struct("at", "digest").alias("node"))
        most = math.ceil(most / width)
    return Forest(levels, materialise(tops, "merkle-tops"))


def push(forest: Forest, rooted: DataFrame) -> DataFrame:
    """(tree, kept, proof, digest, held) of every leaf, from (tree, kept, proof) of every tree: the proof of its top, to
    which the siblings met on the way down are prepended, and any value that all its leaves are to get.

    A proof is an array of (before, after) from the leaf upwards, the digests of the siblings to the left and right of
    the node in its run. Each level joins its runs to the node that the run became; only proofs of inner nodes, a
    sixteenth of all at most, are shuffled."""
    rooted = rooted.select(F.col("tree").alias("of"), "kept", "proof")
    tops = forest.tops.join(rooted, F.col("tree").eqNullSafe(F.col("of"))).drop("of")
    above = None
    for height in range(len(forest.levels), -1, -1):
        here = tops.filter(F.col("height") == height)
        if height == 0:
            lone = here.select("tree", "kept", "proof", "digest", "held")
            return lone if above is None else above.select(*lone.columns).unionByName(lone)
        parents = here.select(F.col("tree").alias("of"), F.lit(0).cast("long").alias("at"), "kept", "proof")
        if above is not None:
            parents = parents.unionByName(above.select(F.col("tree").alias("of"), "at", "kept", "proof"))
        found = forest.levels[height - 1].join(parents, F.col("tree").eqNullSafe(F.col("of")) & (F.col("run") == F.col("at")))
        found = found.select("tree", "kept", "proof", F.transform("nodes", lambda x: x["digest"]).alias("row"), F.posexplode("nodes").alias("k", "node"))
        count, k = F.size("row"), F.col("k")
        siblings = F.struct(F.array_join(F.slice("row", F.lit(1), k), "").alias("before"), F.array_join(F.slice("row", k + 2, count - k - 1), "").alias("after"))
        names = ["at", "digest", *(["held"] if height == 1 else [])]
        above = found.select("tree", "kept", F.concat(F.array(siblings), F.col("proof")).alias("proof"), *[F.col("node")[n].alias(n) for n in names])


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda h, s: digest(s["before"], h, s["after"]))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, level by level from the leaf, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""))


def manifest(docs: DataFrame, altered: Column | None = None, width: int = WIDTH) -> DataFrame:
    """(doc_id, source, leaf, altered, subroot, root, proof) of every row of docs.

    Each source is a tree whose leaves ascend by doc_id, nulls first and then by digest; the sources' tops, the null
    source first and the others bytewise, are the leaves of the tree that ends in the root. `altered` is the digest of
    the row in another state, by default of no other. Null fields have their own mark, so null and empty texts differ;
    repeated rows are leaves of their own with equal digests, whichever comes first; a source of one row is its own top;
    an empty table has no rows. Only the columns in FIELDS are read, whatever others are called."""
    whole = leaf([docs[c] for c in FIELDS])
    other = F.lit(None).cast("string") if altered is None else altered
    # written before it is ranged, else the sampling of ranges would hash every text once more
    hashed = materialise(docs.select("doc_id", "source", whole.alias("leaf"), other.alias("altered")), "merkle-leaves")
    numbered = number_rows(hashed, "source", "doc_id", "leaf")
    trees = materialise(numbered.groupBy(F.col("content.source").alias("tree")).agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("size")), "merkle-trees")
    if trees.count() <= BROADCAST_TREES:
        trees = F.broadcast(trees)
    held = F.struct("content.doc_id", "content.altered")
    leaves = numbered.join(trees, F.col("content.source").eqNullSafe(F.col("tree"))).select("tree", "size", (F.col("number") - F.col("start")).alias("at"), F.col("content.leaf").alias("digest"), held.alias("held"))
    sources = grow(materialise(leaves, "merkle-numbered"), width)
    ordered = number_rows(sources.tops.select("tree", "digest"), "tree")
    n = ordered.count()
    upper = ordered.select(F.lit(0).alias("tree"), F.lit(n).cast("long").alias("size"), F.col("number").alias("at"), F.col("content.digest").alias("digest"), F.struct("content.tree").alias("held"))
    crown = grow(materialise(upper, "merkle-subroots"), width)
    proofs = crown.tops.select("tree", F.col("digest").alias("kept"), F.array().cast("array<struct<before:string,after:string>>").alias("proof"))
    rooted = push(crown, proofs).select(F.col("held.tree").alias("tree"), F.struct(F.col("digest").alias("subroot"), F.col("kept").alias("root")).alias("kept"), "proof")
    found = push(sources, materialise(rooted, "merkle-crown"))
    return found.select("held.doc_id", F.col("tree").alias("source"), F.col("digest").alias("leaf"), "held.altered", "kept.subroot", "kept.root", "proof")


def verified(entries: DataFrame) -> DataFrame:
    """Rows of `manifest` with folded_root, from the altered digest where there is one, and whether it is the root."""
    folded = entries.withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("proof")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


UPPER, LOWER = (functools.reduce(str.__add__, map(chr, range(ord(a), ord(a) + 26))) for a in "Aa")


def lower_cased(docs: DataFrame) -> Column:
    """Digest of a row whose text has a to z for A to Z, for the rows that the check of tampering picks (every fifth
    checksum of doc_id); null for the others."""
    fields = [F.translate(docs[c], UPPER, LOWER) if c == "text" else docs[c] for c in FIELDS]
    picked = F.pmod(F.crc32(docs["doc_id"].cast("string").cast("binary")), F.lit(5)) == 0
    return F.when(picked, leaf(fields))
