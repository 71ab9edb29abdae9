"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialise

#: Up to this many sources the table of targets is broadcast (under 10 MB); above, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of each source from (source, size).

    Sources in code-point order, null last, take the weights in turn. `share` times the sum of all sizes is divided
    by weight; no target goes above `most` times its source's size and what is cut off goes to the others by weight.
    That is water filling: sorted by cap / weight, sources are full up to the first whose cap lies above the level."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    level = W.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    filled = (
        totals.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("cap").over(level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(everything))
        .withColumn("lift", (F.lit(float(share)) * F.col("all") - F.col("before")) / F.col("left"))
        .withColumn("rank", F.row_number().over(level))
        .withColumn("open", F.when(F.col("ratio") > F.col("lift"), F.struct("rank", "lift")))
        .withColumn("water", F.min("open").over(everything)["lift"])
    )
    target = F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), F.col("cap")).otherwise(F.col("water") * F.col("weight"))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def seeded_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the key and the seed alone."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def plan_mix(docs: DataFrame, seed: int = 17, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(row, size, source_size, target, rate, copies) of every row of docs, of which `row` holds all columns, whatever
    their names.

    A source's repetition rate is target / size; a document is taken floor(rate) times and once more with the
    remaining fraction as probability, decided by a hash of its id and the seed. Null text has size 0; a null source
    is a source of its own; a source without words has rate 0; equal ids are decided alike; an empty table stays empty."""
    sized = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), word_count(docs["text"]).alias("size"))
    targets = materialise(source_targets(sized.select(F.col("row.source").alias("source"), "size"), weights, share, most), "mix-targets")
    targets = targets.select("source", "source_size", "target")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (seeded_uniform(F.col("row.doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("int")
    found = sized.join(targets, F.col("row.source").eqNullSafe(F.col("source"))).drop("source")
    return found.withColumn("rate", rate).withColumn("copies", F.floor("rate").cast("int") + extra)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as `plan_mix` takes it, with the columns it came with."""
    planned = plan_mix(docs, **options).filter("copies > 0")
    return planned.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
