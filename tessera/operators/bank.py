"""The item bank: eligibility, picks, coverage and statistics, quarantine, and mutations as merges.

A bank row is (question_hash, category_n, category_ns, age_band, age_bands, question, correct_answer, options, format,
knowledge_id, source, difficulty, estimated_difficulty, difficulty_by_age_band, is_reported, created_at).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.numbers import count_where
from tessera.functions.text import normalize, strip_tags

# Formats and answers with two options, the age bands, the number of categories, the formats of category 20
# whose items need a fact, and the days for which what was played rests.
TWO_OPTION_FORMATS = ("VERDADEIRO_FALSO", "CURIOSIDADE")
TWO_ANSWERS = ("verdadeiro", "falso")
AGE_BANDS = ("6-9", "10-15", "15+")
CATEGORIES = 20
FACT_FORMATS = ("CURIOSIDADE", "VERDADEIRO_FALSO", "ADIVINHA")
QUARANTINE_DAYS = 30


def _plain(x: Column) -> Column:
    return F.lower(F.trim(strip_tags(F.coalesce(x, F.lit("")))))


def valid_options(options: Column, format_: Column, answer: Column) -> Column:
    """Two options with both labels for true-or-false items, four for the others."""
    a = _plain(answer)
    two = F.coalesce(format_, F.lit("")).isin(*TWO_OPTION_FORMATS) | a.isin(*TWO_ANSWERS)
    has = lambda label: F.exists(options, lambda o: _plain(o) == label)
    held = F.when(two, a.isin(*TWO_ANSWERS) & (F.size(options) == 2) & has(TWO_ANSWERS[0]) & has(TWO_ANSWERS[1])).otherwise(F.size(options) == 4)
    return F.coalesce(options.isNotNull() & held, F.lit(False))


def valid_options_strict(options: Column, format_: Column, answer: Column) -> Column:
    """As `valid_options`, and the options differ and hold the answer."""
    keys = F.transform(options, normalize)
    return valid_options(options, format_, answer) & (F.size(F.array_distinct(keys)) == F.size(keys)) & F.array_contains(keys, normalize(answer))


def category_matches(category: int) -> Column:
    return F.when(F.size("category_ns") > 0, F.array_contains("category_ns", category)).otherwise(F.col("category_n") == category)


def age_matches(age_band: str) -> Column:
    return F.when(F.size("age_bands") > 0, F.array_contains("age_bands", age_band)).otherwise(F.col("age_band") == age_band)


def effective_difficulty(age_band: Column) -> Column:
    return F.coalesce(F.try_element_at("difficulty_by_age_band", age_band), F.col("difficulty"), F.col("estimated_difficulty"))


def valid_difficulty_map(m: Column) -> Column:
    return F.forall(F.map_entries(m), lambda e: e["key"].isin(*AGE_BANDS) & e["value"].between(1, 5))


def needs_fact(category: Column, format_: Column) -> Column:
    return (category == CATEGORIES) & format_.isin(*FACT_FORMATS)


def taxonomy(df: DataFrame) -> DataFrame:
    """One row for each category and age band of an item; the arrays count where they are filled, else the scalars."""
    cats = F.when(F.size("category_ns") > 0, F.col("category_ns")).otherwise(F.array(F.col("category_n").cast("int")))
    ages = F.when(F.size("age_bands") > 0, F.col("age_bands")).otherwise(F.array("age_band"))
    each = df.withColumn("category", F.explode(F.array_distinct(cats))).withColumn("age", F.explode(F.array_distinct(ages)))
    return each.filter(F.col("category").between(1, CATEGORIES) & F.col("age").isin(*AGE_BANDS))


def normalize_taxonomy(categories: Column, category: Column, ages: Column, age: Column) -> tuple[Column, Column]:
    """(sorted distinct categories, distinct ages in their order), from arrays or else from scalars."""
    cats = F.filter(F.coalesce(categories, F.array().cast("array<int>")), lambda c: c.between(1, CATEGORIES))
    bands = F.filter(F.coalesce(ages, F.array().cast("array<string>")), lambda a: a.isin(*AGE_BANDS))
    one = F.filter(F.array(category.cast("int")), lambda c: c.between(1, CATEGORIES))
    band = F.filter(F.array(age), lambda a: a.isin(*AGE_BANDS))
    return F.array_sort(F.array_distinct(F.when(F.size(cats) > 0, cats).otherwise(one))), F.array_distinct(F.when(F.size(bands) > 0, bands).otherwise(band))


def recently_played(plays: DataFrame, as_of: str, key: str, days: int = QUARANTINE_DAYS) -> DataFrame:
    """Distinct keys played in the last `days` days."""
    since = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days))
    return plays.filter((F.col("played_at") >= since) & F.col(key).isNotNull() & (F.col(key) != "")).select(key).distinct()


def playable(bank: DataFrame, blocked: DataFrame, plays: DataFrame, as_of: str, exclude: Sequence[str] = (), days: int = QUARANTINE_DAYS) -> DataFrame:
    """Items that are valid, not reported, not blocked, and whose question and fact rest no more."""
    rows = bank.filter(~F.coalesce("is_reported", F.lit(False)) & valid_options(F.col("options"), F.col("format"), F.col("correct_answer")))
    rows = rows.join(blocked.select("question_hash").distinct(), "question_hash", "left_anti")
    rows = rows.join(recently_played(plays, as_of, "question_hash", days), "question_hash", "left_anti")
    rows = rows.join(recently_played(plays, as_of, "knowledge_id", days), "knowledge_id", "left_anti")
    return rows.filter(~F.col("question_hash").isin(*exclude)) if exclude else rows


def pick_tier(rows: DataFrame, age_band: str, requested: int | None) -> DataFrame:
    """rows with the tier of a pick: 0 exact difficulty, 1 within two steps, 2 any; and the distance in steps."""
    d = effective_difficulty(F.lit(age_band))
    if requested is None:
        return rows.withColumns({"tier": F.lit(2), "distance": F.lit(0)})
    wanted = min(5, max(1, requested))
    near = F.abs(d - wanted)
    tier = F.when(near == 0, 0).when((near <= 2) & d.between(1, 5), 1).otherwise(2)
    return rows.withColumns({"tier": F.coalesce(tier, F.lit(2)), "distance": F.when(near <= 2, near).otherwise(0)})


def pick(rows: DataFrame, category: int, age_band: str, requested: int | None = None, seed: int = 0, facts: DataFrame | None = None) -> DataFrame:
    """One item at random among the best tier; with its fact's source where facts are given."""
    fitting = pick_tier(rows.filter(category_matches(category) & age_matches(age_band)), age_band, requested)
    one = fitting.orderBy("tier", "distance", F.xxhash64("question_hash", F.lit(seed)), "question_hash").limit(1)
    return one if facts is None else one.join(facts.select("knowledge_id", F.col("source").alias("fact_source"), "source_url"), "knowledge_id", "left")


def pick_least_recent(rows: DataFrame, plays: DataFrame, key: str = "question_hash", seed: int = 0, most: int = 1) -> DataFrame:
    """The fallback when everything rests: what was played longest ago, never played ones first."""
    last = plays.groupBy(key).agg(F.max("played_at").alias("last_played"))
    return rows.join(last, key, "left").orderBy(F.col("last_played").asc_nulls_first(), F.xxhash64(key, F.lit(seed))).limit(most)


def pick_record(facts: DataFrame, category: int, age_band: str, topic: str | None = None, format_: str | None = None, least_confidence: float = 0.85, allow_superseded: bool = False, seed: int = 0) -> DataFrame:
    """One fact: highest priority (50 where unset), then at random."""
    rows = facts.filter(F.col("is_active") & (F.col("category_n") == category) & F.array_contains("age_bands", age_band) & (F.col("confidence") >= least_confidence))
    if topic:
        rows = rows.filter(F.col("topic") == topic)
    if format_:
        rows = rows.filter(F.array_contains("allowed_formats", format_))
    if not allow_superseded:
        rows = rows.filter(F.coalesce("superseded_by", F.lit("")) == "")
    return rows.orderBy(F.coalesce("priority_pt", F.lit(50)).desc(), F.xxhash64("knowledge_id", F.lit(seed)), "knowledge_id").limit(1)


def coverage(bank: DataFrame) -> DataFrame:
    """(category, age, count), dense over all categories and ages."""
    spark = bank.sparkSession
    grid = spark.range(1, CATEGORIES + 1).select(F.col("id").cast("int").alias("category")).crossJoin(spark.createDataFrame([(a,) for a in AGE_BANDS], "age string"))
    counts = taxonomy(bank).groupBy("category", "age").agg(F.count(F.lit(1)).alias("count"))
    return grid.join(counts, ["category", "age"], "left").fillna(0, ["count"])


def sparse_target(cover: DataFrame, seed: int = 0) -> DataFrame:
    """The cell with the fewest items, at random among equals."""
    return cover.orderBy("count", F.xxhash64("category", "age", F.lit(seed))).limit(1)


def stats(bank: DataFrame, blocked: DataFrame) -> DataFrame:
    """One row: items in all, active, valid, invalid, reported and blocked."""
    ok = valid_options(F.col("options"), F.col("format"), F.col("correct_answer"))
    active = ~F.coalesce("is_reported", F.lit(False))
    row = bank.agg(F.count(F.lit(1)).alias("total"), count_where(active).alias("active"), count_where(active & ok).alias("valid"), count_where(active & ~ok).alias("invalid"), count_where(~active).alias("reported"))
    return row.crossJoin(blocked.agg(F.countDistinct("question_hash").alias("blocked")))


def stats_by(bank: DataFrame) -> DataFrame:
    """(category, age, difficulty, total, valid) of active items."""
    ok = valid_options(F.col("options"), F.col("format"), F.col("correct_answer"))
    each = taxonomy(bank.filter(~F.coalesce("is_reported", F.lit(False))).withColumn("_ok", ok))
    return each.groupBy("category", "age", effective_difficulty(F.col("age")).alias("difficulty")).agg(F.count(F.lit(1)).alias("total"), count_where(F.col("_ok")).alias("valid"))


def quarantine_stats(bank: DataFrame, plays: DataFrame, as_of: str, days: int = QUARANTINE_DAYS) -> DataFrame:
    """(grain, key, items) of distinct questions that rest: in all, by category, by age and by both."""
    resting = bank.join(recently_played(plays, as_of, "question_hash", days), "question_hash", "left_semi").select("question_hash", "category_n", "age_band")
    sets = resting.groupingSets([[], [F.col("category_n")], [F.col("age_band")], [F.col("category_n"), F.col("age_band")]], "category_n", "age_band").agg(F.countDistinct("question_hash").alias("items"), F.grouping_id().alias("_g"))
    grain = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "category").when(F.col("_g") == 2, "age").otherwise("category_age")
    return sets.select(grain.alias("grain"), "category_n", "age_band", "items")


def search(bank: DataFrame, plays: DataFrame, as_of: str, query: str = "", category: int | None = None, most: int = 50) -> DataFrame:
    """Items whose text or answer holds the query, with whether they rest, newest first, up to a page."""
    rows = bank
    if query:
        needle = normalize(F.lit(query))
        rows = rows.filter(F.contains(normalize(F.col("question")), needle) | F.contains(normalize(F.col("correct_answer")), needle) | (F.col("question_hash") == query))
    if category is not None:
        rows = rows.filter(category_matches(category))
    resting = recently_played(plays, as_of, "question_hash").withColumn("resting", F.lit(True))
    return rows.join(resting, "question_hash", "left").fillna(False, ["resting"]).orderBy(F.col("created_at").desc(), "question_hash").limit(most)


def unmaterialised(facts: DataFrame, bank: DataFrame, age_band: str, least_confidence: float = 0.85) -> DataFrame:
    """Active facts for an age band from which no valid item was made yet."""
    made = bank.filter(age_matches(age_band) & valid_options(F.col("options"), F.col("format"), F.col("correct_answer"))).select("knowledge_id").distinct()
    return facts.filter(F.col("is_active") & F.array_contains("age_bands", age_band) & (F.col("confidence") >= least_confidence)).join(made, "knowledge_id", "left_anti")


# --- mutations -------------------------------------------------------------------------------------------------


def classify_import(items: DataFrame, bank: DataFrame, blocked: DataFrame, order: str = "position") -> DataFrame:
    """Items of a batch with the reason for what happens to each: inserted, blocked, exists, missing_knowledge_id or
    invalid_options. Within a batch the first of each hash counts, the others exist."""
    known = bank.select("question_hash").distinct().withColumn("_known", F.lit(True))
    shut = blocked.select("question_hash").distinct().withColumn("_shut", F.lit(True))
    first = F.row_number().over(W.partitionBy("question_hash").orderBy(order))
    rows = items.join(known, "question_hash", "left").join(shut, "question_hash", "left").withColumn("_first", first)
    reason = (
        F.when(needs_fact(F.col("category_n"), F.col("format")) & (F.coalesce("knowledge_id", F.lit("")) == ""), "missing_knowledge_id")
        .when(~valid_options(F.col("options"), F.col("format"), F.col("correct_answer")), "invalid_options")
        .when(F.col("_shut"), "blocked")
        .when(F.col("_known") | (F.col("_first") > 1), "exists")
        .otherwise("inserted")
    )
    return rows.withColumn("reason", reason).drop("_known", "_shut", "_first")


def import_items(items: DataFrame, bank: DataFrame, blocked: DataFrame, order: str = "position") -> DataFrame:
    """The bank after a batch."""
    return bank.unionByName(classify_import(items, bank, blocked, order).filter("reason = 'inserted'").select(*bank.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None, fill_only: bool = False) -> DataFrame:
    """Rows of old and new by key: of several new ones the last counts; new values replace old ones, or with fill_only
    only nulls."""
    if order:
        new = new.withColumn("_at", F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))).filter("_at = 1")
    columns = [c for c in old.columns if c != key]
    renamed = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns if c in new.columns], F.lit(True).alias("_is_new"))
    joined = old.withColumn("_is_old", F.lit(True)).join(renamed, key, "full_outer")
    pair = lambda c: (F.col(c), F.col(f"_{c}")) if fill_only else (F.col(f"_{c}"), F.col(c))
    return joined.select(key, *[F.coalesce(*pair(c)).alias(c) if c in new.columns else F.col(c) for c in columns])


def report(bank: DataFrame, facts: DataFrame, blocked: DataFrame, reported: DataFrame, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bank, facts, blocked) after reports of (question_hash, knowledge_id): the item is flagged and its hash blocked,
    the fact no longer active."""
    hashes = reported.select("question_hash").distinct()
    flagged = bank.join(hashes.withColumn("_hit", F.lit(True)), "question_hash", "left").withColumn("is_reported", F.coalesce("_hit", F.col("is_reported"))).drop("_hit")
    ids = reported.filter("knowledge_id IS NOT NULL").select("knowledge_id").distinct().withColumn("_hit", F.lit(True))
    off = facts.join(ids, "knowledge_id", "left").withColumn("is_active", F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("is_active"))).drop("_hit")
    new = hashes.join(blocked, "question_hash", "left_anti").withColumn("reported_at", F.to_timestamp(F.lit(at)))
    return flagged, off, blocked.unionByName(new)


def delete_items(bank: DataFrame, plays: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bank, plays) without the items of some hashes."""
    gone = hashes.select("question_hash").distinct()
    return bank.join(gone, "question_hash", "left_anti"), plays.join(gone, "question_hash", "left_anti")


def release_quarantine(plays: DataFrame, bank: DataFrame, scope: Column, as_of: str, days: int = QUARANTINE_DAYS) -> DataFrame:
    """Plays without the recent ones of items that a predicate over the bank selects."""
    freed = bank.filter(scope).select("question_hash").distinct().withColumn("_freed", F.lit(True))
    since = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days))
    return plays.join(freed, "question_hash", "left").filter(~(F.coalesce("_freed", F.lit(False)) & (F.col("played_at") >= since))).drop("_freed")


def merge_taxonomy(bank: DataFrame, key: str = "question_hash") -> DataFrame:
    """One row for each key: the oldest, with the categories and ages of all."""
    first = F.row_number().over(W.partitionBy(key).orderBy("created_at"))
    wide = bank.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("category_ns", F.array(F.col("category_n").cast("int"))))))).alias("_cats"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("age_bands", F.array("age_band")))))).alias("_ages"))
    kept = bank.withColumn("_at", first).filter("_at = 1").drop("_at")
    return kept.join(wide, key).withColumns({"category_ns": F.col("_cats"), "age_bands": F.col("_ages")}).drop("_cats", "_ages")


def seed_from_history(history: DataFrame, bank: DataFrame, blocked: DataFrame) -> DataFrame:
    """The newest history row of each hash that is neither in the bank nor blocked."""
    newest = F.row_number().over(W.partitionBy("question_hash").orderBy(F.col("created_at").desc()))
    rows = history.withColumn("_at", newest).filter("_at = 1").drop("_at")
    return rows.join(bank.select("question_hash"), "question_hash", "left_anti").join(blocked.select("question_hash"), "question_hash", "left_anti")


def expire_rooms(rooms: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Rooms with the ones idle for so long marked finished."""
    idle = F.col("last_active") < F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {hours} HOURS")
    return rooms.withColumn("status", F.when(idle & (F.col("status") != "finished"), "finished").otherwise(F.col("status")))
