"""Reproducible shuffling and sharding by a Feistel permutation of global row numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, mix, partitions

ROUNDS = 6


def _halves(n: int) -> tuple[int, int]:
    """Sides a and b of a rectangle that holds 0..n-1 with fewer than a places to spare."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _step(x: np.ndarray, a: int, b: int, seed: int, rounds: range, back: bool) -> np.ndarray:
    """One pass of an unbalanced Feistel network over Z_a x Z_b (x = left * b + right)."""
    left, right = x // b, x % b
    for k in rounds:
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + (k + 1) * 0xD1B54A32D192ED03) % (1 << 64))
        if k % 2 == 0:
            f = (mix(right.astype(np.uint64) ^ key) % np.uint64(a)).astype(np.int64)
            left = (left - f) % a if back else (left + f) % a
        else:
            f = (mix(left.astype(np.uint64) ^ key) % np.uint64(b)).astype(np.int64)
            right = (right - f) % b if back else (right + f) % b
    return left * b + right


def permute(rows: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Where each of `rows` in 0..n-1 goes under the permutation (or, inverse, where it came from).

    The network permutes a rectangle slightly larger than n; what lands outside walks on along its cycle until it
    is inside, which it must be, since the cycle returns to its start."""
    a, b = _halves(n)
    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    out = _step(np.asarray(rows, np.int64), a, b, seed, rounds, inverse)
    while (outside := out >= n).any():
        out[outside] = _step(out[outside], a, b, seed, rounds, inverse)
    return out


def shard_and_slot(rows: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Computable for any row number without looking at the data: counts of shards differ by one at most."""
    place = permute(rows, n, seed)
    return place % shards, place // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The global row number that a shard holds at a slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def number_rows(df: DataFrame, *keys: Column | str) -> DataFrame:
    """(content, number) of every row: a struct of all its columns, whatever their names, and dense numbers from 0 in
    the order of the keys, without a single-task window.

    Rows are range partitioned and sorted; a row's number is its place in its partition plus the rows of the
    partitions before, of which there are as many as shuffle partitions. Ties in all keys may swap among themselves."""
    spark = df.sparkSession
    n = partitions(spark)
    keyed = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("content"), *[(df[f"`{k}`"] if isinstance(k, str) else k).alias(f"key_{i}") for i, k in enumerate(keys)])
    names = [f"key_{i}" for i in range(len(keys))]
    sorted_ = keyed.repartitionByRange(n, *names).sortWithinPartitions(*names)
    placed = materialise(sorted_.select("content", F.monotonically_increasing_id().alias("at")), "numbered").select("content", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    counts = [(r["part"], r["count"]) for r in placed.groupBy("part").count().orderBy("part").collect()]  # a row a partition
    starts, total = [], 0
    for part, count in counts:
        starts.append((part, total))
        total += count
    offsets = F.broadcast(spark.createDataFrame(starts, "part long, start long"))
    return placed.join(offsets, "part").select("content", (F.col("start") + F.col("place")).alias("number"))


def size(text: Column) -> Column:
    """Bytes of a text and one more; null has none."""
    return (F.octet_length(F.coalesce(text, F.lit("")).cast("binary")) + 1).cast("long")


def checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def shard(docs: DataFrame, *keys: Column | str, shards: int = 16, seed: int = 23) -> DataFrame:
    """docs with `row`, `shard` and `slot`; earlier columns of these names are replaced, all others stay.

    Row numbers follow the keys, by default doc_id (nulls first), then the text's checksum and size, so they depend on
    the rows only; null texts have no bytes; repeated rows are rows of their own; an empty table gives an empty result."""
    docs = docs.drop("row", "shard", "slot")
    numbered = number_rows(docs, *(keys or ("doc_id", checksum(docs["text"]), size(docs["text"]))))
    n = numbered.count()

    @F.pandas_udf("long")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    placed = numbered.select("content", "number", place("number").alias("place"))
    return placed.select("content.*", F.col("number").alias("row"), F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))
