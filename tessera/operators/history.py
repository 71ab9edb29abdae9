"""Play histories: reading stored forms, look-back snapshots, recent slices, runs and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import question_hash
from tessera.operators.games import ANSWER

ANTI_REUSE_DAYS, KEPT_ENTRIES = 30, 400


def entries_by_age(store: DataFrame, column: str) -> DataFrame:
    """(age_band, position, q, a, ts, ...) of a map from age band to a list of entries."""
    return store.select(F.explode(column).alias("age_band", "entries")).select("age_band", F.posexplode("entries").alias("position", "e")).select("age_band", "position", "e.*")


def entries_from_parallel(store: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row for each place of parallel arrays, under the names that `columns` gives them."""
    kept = [c for c in store.columns if c not in columns]
    zipped = F.posexplode(F.arrays_zip(*[F.col(c).alias(name) for c, name in columns.items()])).alias("position", "e")
    return store.select(*kept, zipped).select(*kept, "position", *[F.col(f"e.{name}") for name in columns.values()])


def single_answers(rounds: DataFrame) -> DataFrame:
    """Rounds of an older form, whose one answer stands in the round, with an array of answers."""
    own = F.struct(F.coalesce("playerId", F.lit("local")).alias("playerId"), F.coalesce("nickname", F.lit("Jogador")).alias("nickname"), F.col("selectedAnswer"), F.coalesce("correct", F.lit(False)).alias("correct"), F.col("responseMs").cast("double").alias("responseMs"), F.col("answeredAt"))
    none = F.array().cast(f"array<{ANSWER}>")
    return rounds.withColumn("answers", F.when(F.size("answers") > 0, F.col("answers")).when(F.col("selectedAnswer").isNotNull(), F.array(own)).otherwise(none))


def snapshot(entries: DataFrame, as_of: str, days: int = ANTI_REUSE_DAYS) -> DataFrame:
    """The latest entry of each question within the look-back; a missing hash is made from question and answer."""
    hashed = entries.withColumn("question_hash", F.coalesce(F.when(F.trim("question_hash") != "", F.trim("question_hash")), question_hash(F.col("q"), F.col("a"), tags=False)))
    since = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days))
    latest = F.row_number().over(W.partitionBy("question_hash").orderBy(F.col("ts").desc(), "position"))
    return hashed.filter(F.col("ts") >= since).withColumn("_at", latest).filter("_at = 1").drop("_at")


def recent_slice(entries: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The last `most` rows of each group."""
    return entries.withColumn("_at", F.row_number().over(W.partitionBy(by).orderBy(F.col(order).desc()))).filter(F.col("_at") <= most).drop("_at")


def trailing_run(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, value, run): how often the last value of each group stands at its end without a break."""
    at = W.partitionBy(by).orderBy(F.col(order).desc())
    last = F.first(value).over(at.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    marked = rows.withColumn("_last", last).withColumn("_broken", F.sum((~F.col(value).eqNullSafe(F.col("_last"))).cast("int")).over(at.rowsBetween(W.unboundedPreceding, 0)))
    return marked.filter("_broken = 0").groupBy(by).agg(F.first("_last").alias(value), F.count(F.lit(1)).alias("run"))


def prepend(latest: Column, runs: Column, most: int = 30) -> Column:
    """A list of runs with the latest in front, cut to its length."""
    return F.slice(F.concat(F.array(latest), F.coalesce(runs, F.array().cast("array<string>"))), 1, most)


def over_limit(requests: DataFrame, client: str, ts: str, most: int, seconds: int = 60) -> DataFrame:
    """requests with `allowed`: whether fewer than `most` of the same client came in the seconds before."""
    recent = W.partitionBy(client).orderBy(F.unix_seconds(ts)).rangeBetween(-seconds + 1, 0)
    return requests.withColumn("allowed", F.count(F.lit(1)).over(recent) <= most)


def newest_matches(matches: DataFrame, most: int, *details: tuple[DataFrame, str]) -> list[DataFrame]:
    """The newest matches and, of each detail table, the rows that belong to them by a key."""
    kept = matches.orderBy(F.col("started_at").desc(), "id").limit(most)
    return [kept, *[d.join(kept.select(F.col("id").alias(key)), key, "left_semi") for d, key in details]]
