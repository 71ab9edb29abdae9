"""Choices with memory: weighted draws, pools without what came last, round-robin queues and sparse cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RECENCY = 0.4


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from key and seed."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def weighted(rows: DataFrame, key: str, weight: str, seed: int, most: int = 1, by: str | None = None) -> DataFrame:
    """`most` rows (in each group) drawn without replacement with chances as their weights: the greatest of
    log(u) / weight. Rows without a positive weight are never drawn."""
    scored = rows.filter(F.col(weight) > 0).withColumn("_score", F.log(uniform(F.col(key), seed)) / F.col(weight))
    if by is None:
        return scored.orderBy(F.col("_score").desc(), key).limit(most).drop("_score")
    at = F.row_number().over(W.partitionBy(by).orderBy(F.col("_score").desc(), key))
    return scored.withColumn("_at", at).filter(F.col("_at") <= most).drop("_score", "_at")


def recency_weight(recent: Column, value: Column) -> Column:
    """Less weight for what was drawn often of late."""
    return 1 / (1 + RECENCY * F.size(F.filter(recent, lambda r: r == value)))


def pool(allowed: Sequence[str], recent: Column, most_in_a_row: int) -> Column:
    """The allowed values without those that have stood at the end too often, nor the last one, nor the last two, as
    far as something is left."""
    everything = F.array(*[F.lit(a) for a in allowed])
    size = F.size(recent)

    def run(v: Column) -> Column:
        tail = F.reverse(recent)
        broken = F.array_position(F.transform(tail, lambda r: (r != v).cast("int")), 1)
        return F.when(broken == 0, size).otherwise(broken - 1)

    def or_else(few: Column, many: Column) -> Column:
        return F.when(F.size(few) > 0, few).otherwise(many)

    calm = or_else(F.filter(everything, lambda v: run(v) < most_in_a_row), everything)
    last = F.try_element_at(recent, F.lit(-1))
    fresh = F.when(last.isNotNull(), or_else(F.filter(calm, lambda v: v != last), calm)).otherwise(calm)
    two = F.slice(recent, F.greatest(size - 1, F.lit(1)), F.lit(2))
    fresher = F.when((size >= 2) & (F.size(fresh) > 1), or_else(F.filter(fresh, lambda v: ~F.array_contains(two, v)), fresh))
    return F.coalesce(fresher, fresh)


def interleaved(models: DataFrame, priority: str | None = None, one_each: bool = False) -> DataFrame:
    """(position, provider, model) of attempts: first models of all providers in turn, then the second ones, ...; or all
    of a provider with priority first and the others provider by provider. Providers that are out are left out.

    models: (provider, provider_order, model, model_order, is_open)."""
    rows = models.filter(~F.coalesce("is_open", F.lit(False)))
    turn = F.row_number().over(W.partitionBy("provider").orderBy("model_order"))
    rows = rows.withColumn("_turn", turn)
    if one_each:
        rows = rows.filter("_turn = 1")
    known = rows.filter(F.col("provider") == priority).limit(1).count() if priority else 0
    order = [(F.col("provider") != priority).cast("int"), F.col("provider_order"), F.col("_turn")] if known else [F.col("_turn"), F.col("provider_order")]
    if priority and not known:
        order = [F.col("provider_order"), F.col("_turn")]
    return rows.withColumn("position", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order))).select("position", "provider", "model")


def sparse_cell(coverage: DataFrame, seed: int, last_age: str | None = None, balance: bool = False) -> DataFrame:
    """The cell with the fewest items; with balance the age is drawn first, not the last one if there are others."""
    if balance:
        ages = coverage.select("age").distinct()
        others = ages.filter(F.col("age") != last_age) if last_age else ages
        drawn = (others if not others.isEmpty() else ages).orderBy(F.xxhash64("age", F.lit(seed))).limit(1)
        coverage = coverage.join(drawn, "age", "left_semi")
    return coverage.orderBy("count", F.xxhash64("category", "age", F.lit(seed))).limit(1)


def least_used_position(history: Column, size: int, seed: Column) -> Column:
    """The place at which answers stood least often, by the seed among equals."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: F.struct(F.size(F.filter(history, lambda h: h == p)).alias("n"), F.xxhash64(p, seed).alias("r"), p.alias("p")))
    return F.array_min(counts)["p"]


def shuffled(values: Column, key: Column, seed: int) -> Column:
    """An array in an order that depends on key, seed and values alone."""
    return F.transform(F.array_sort(F.transform(values, lambda v, i: F.struct(F.xxhash64(key, v, i, F.lit(seed)).alias("r"), i.alias("i"), v.alias("v")))), lambda x: x["v"])


def assemble_options(answer: Column, distractors: Column, key: Column, seed: int) -> Column:
    """The answer and the first three distractors that differ from it, shuffled; null if there are fewer."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    wrong = F.slice(F.filter(F.transform(distractors, lambda d: F.trim(d)), lambda d: (d != "") & (F.lower(d) != F.lower(a))), 1, 3)
    return F.when(F.size(wrong) == 3, shuffled(F.concat(F.array(a), wrong), key, seed))


def difficulty(age_band: Column, last: Column, key: Column, seed: int) -> Column:
    """A level within the range of the age band, at random but not the last one."""
    from tessera.operators.items import difficulty_range

    low, high = difficulty_range(age_band)
    levels = F.filter(F.sequence(low, high), lambda d: ~d.eqNullSafe(last))
    return F.element_at(levels, (F.pmod(F.xxhash64(key, F.lit(seed)), F.size(levels)) + 1).cast("int"))
