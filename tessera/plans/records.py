"""Registered queries over records, the bank's changes, histories, item rules and reports, with the SQL of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import keys, localtime, places, text
from tessera.operators import bank as bank_ops
from tessera.operators import diagnosis, games, history, items, knowledge, picks, records, repetition, review, sequential, telemetry, validation
from tessera.plans import adapters as a
from tessera.plans.registry import AS_OF, query
from tessera.sources import markup

LOCAL = "timezone('Europe/Lisbon', timezone('UTC', {0}))"
NOW = "TIMESTAMP '2024-01-30 12:34:56'"


def number_of(column: str) -> Column:
    return F.substring(column, 2, 20).cast("long")


def record_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with times and reasons, some without a source's record."""
    k = number_of("knowledge_id")
    made = F.timestamp_seconds(F.lit(1704067200) + k * 2477)
    return a.facts(spark, sf_dir).withColumns({"created_at": made, "updated_at": made + F.expr("INTERVAL 1 HOUR"), "disabled_reason": F.lit(None).cast("string"), "subtopic": F.lit(None).cast("string")})


RECORDS = """
WITH r AS (
  SELECT p_partkey AS k, 'k' || p_partkey AS knowledge_id, (p_size % 20 + 1)::INT AS category_n, CASE WHEN p_partkey % 2 = 0 THEN 'curiosidade surpreendente' ELSE 'adivinha tradicional' END AS topic,
    ['Wikidata', 'manual', 'sample', 'outro'][p_partkey % 4 + 1] AS source, 0.8 + (p_partkey % 20) / 100 AS confidence, p_partkey % 9 AS priority, p_partkey % 13 > 0 AS is_active,
    CASE WHEN p_partkey % 29 = 0 THEN 'k1' END AS superseded_by, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(p_partkey * 2477) AS created_at, 'Resposta ' || (p_partkey % 150) AS answer,
    p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) || ' lote' || (p_partkey % 50) AS fact
  FROM part
)
"""


@query(RECORDS + f"""
, b AS (SELECT CASE WHEN p_partkey % 6 > 0 THEN 'k' || (p_partkey % 300) END AS kid FROM part),
t AS (SELECT *, {LOCAL.format("created_at")} AS wall FROM r)
SELECT 'all' AS grain, NULL::VARCHAR AS key, NULL::VARCHAR AS source, NULL::INT AS category_n, NULL::VARCHAR AS topic, count(*) FILTER (is_active) AS active, count(*) FILTER (NOT is_active) AS inactive, count(*) AS total FROM r
UNION ALL SELECT 'category_topic', NULL, NULL, category_n, topic, count(*), 0, count(*) FROM r WHERE is_active GROUP BY ALL
UNION ALL SELECT 'source', NULL, source, NULL, NULL, count(*) FILTER (is_active), count(*) FILTER (NOT is_active), count(*) FROM r GROUP BY source
UNION ALL SELECT 'source_topic', NULL, source, category_n, topic, count(*) FILTER (is_active), count(*) FILTER (NOT is_active), count(*) FROM r GROUP BY source, category_n, topic
UNION ALL SELECT 'day', strftime(wall, '%Y-%m-%d'), source, NULL, NULL, count(*) FILTER (is_active), count(*) FILTER (NOT is_active), count(*) FROM t GROUP BY 2, 3
UNION ALL SELECT 'hour', strftime(wall, '%Y-%m-%dT%H'), source, NULL, NULL, count(*) FILTER (is_active), count(*) FILTER (NOT is_active), count(*) FROM t WHERE created_at >= {NOW} - INTERVAL 24 HOUR GROUP BY 2, 3
UNION ALL SELECT 'minute', strftime(time_bucket(INTERVAL 5 MINUTE, wall), '%Y-%m-%dT%H:%M'), source, NULL, NULL, count(*) FILTER (is_active), count(*) FILTER (NOT is_active), count(*) FROM t WHERE created_at >= {NOW} - INTERVAL 6 HOUR GROUP BY 2, 3
UNION ALL SELECT 'bank', NULL, NULL, NULL, NULL, count(kid), count(*) - count(kid), count(*) FROM b
UNION ALL SELECT 'bank_source', NULL, coalesce(r.source, '(facto removido)'), NULL, NULL, count(*), 0, count(*) FROM b LEFT JOIN r ON r.knowledge_id = b.kid WHERE kid IS NOT NULL GROUP BY 3
""")
def record_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.inventory(record_table(spark, sf_dir), a.bank(spark, sf_dir), AS_OF)


@query(RECORDS + """
SELECT knowledge_id FROM r WHERE is_active AND superseded_by IS NULL AND category_n = 7 AND confidence >= 0.85 AND topic = 'adivinha tradicional' ORDER BY created_at DESC, knowledge_id LIMIT 10 OFFSET 3
""")
def record_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.page(record_table(spark, sf_dir), 7, topic=knowledge.RIDDLES, age_band="6-9", format_="RESPOSTA_DIRETA", most=10, skip=3).select("knowledge_id")


@query(RECORDS + """
, q AS (SELECT DISTINCT 'k' || (event_id % 40) AS kid FROM events WHERE event_id % 4 = 0 AND ts >= TIMESTAMP '2024-01-30 12:34:56' - INTERVAL 30 DAY)
SELECT knowledge_id, knowledge_id IN (SELECT kid FROM q) AS in_quarantine FROM r WHERE contains(lower(fact), 'lote4') AND contains(lower(source), 'wiki') AND is_active
  AND created_at >= TIMESTAMP '2024-01-02 00:00:00' AND created_at < TIMESTAMP '2024-01-21 00:00:00' ORDER BY created_at DESC, knowledge_id DESC LIMIT 40 OFFSET 1
""")
def record_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records.search(record_table(spark, sf_dir), a.plays(spark, sf_dir), AS_OF, query="LOTE4", source="wiki", active=True, created_from="2024-01-02", created_to="2024-01-20", most=40, skip=1)
    return found.select("knowledge_id", "in_quarantine")


@query(RECORDS + """
SELECT knowledge_id, is_active AND k % 7 <> 0 AND NOT coalesce(k % 11 = 0 AND k % 3 <> 0, FALSE) AS is_active, CASE WHEN k % 7 = 0 AND k % 2 = 0 THEN 'duplicado ' || k END AS disabled_reason,
  CASE WHEN k % 11 = 0 THEN 'k' || (k + 1) ELSE superseded_by END AS superseded_by FROM r WHERE k % 17 <> 5
""")
def record_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after some were disabled, some superseded and some deleted."""
    rows = record_table(spark, sf_dir)
    k = number_of("knowledge_id")
    asked = rows.filter(k % 7 == 0).select("knowledge_id", F.when(k % 2 == 0, F.concat(F.lit(" duplicado "), k.cast("string"))).otherwise(" ").alias("reason"), k.alias("position"))
    replaced = rows.filter(k % 11 == 0).select("knowledge_id", F.concat(F.lit("k"), (k + 1).cast("string")).alias("superseded_by"), F.when(k % 3 == 0, False).alias("deactivate"), k.alias("position"))
    after = records.supersede(records.disable(rows, asked), replaced)
    gone = rows.filter(k % 17 == 5).select(F.concat(F.lit(" "), "knowledge_id").alias("knowledge_id"))
    return records.delete(after, a.bank(spark, sf_dir), a.plays(spark, sf_dir), gone)[0].select("knowledge_id", "is_active", "disabled_reason", "superseded_by")


@query("""
WITH b AS (SELECT p_partkey::VARCHAR AS h, CASE WHEN p_partkey % 6 > 0 THEN 'k' || (p_partkey % 300) END AS kid FROM part),
p AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'k' || (event_id % 40) END AS kid FROM events)
SELECT (SELECT count(*) FROM b WHERE kid IS NULL OR kid NOT IN ('k12', 'k24', 'k7'))::BIGINT AS bank, (SELECT count(*) FROM p WHERE kid IS NULL OR kid NOT IN ('k12', 'k24', 'k7'))::BIGINT AS plays
""")
def record_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the bank and of the plays when three records are deleted."""
    gone = spark.createDataFrame([("k12",), (" k24 ",), ("k7",), ("",)], "knowledge_id string")
    _, left, played = records.delete(record_table(spark, sf_dir), a.bank(spark, sf_dir), a.plays(spark, sf_dir), gone)
    return left.agg(F.count(F.lit(1)).alias("bank")).crossJoin(played.agg(F.count(F.lit(1)).alias("plays")))


@query("""
SELECT question_hash, knowledge_id, count(*) AS plays FROM (
  SELECT user_id::VARCHAR AS question_hash, CASE WHEN event_id % 4 = 0 THEN 'k' || (event_id % 40) END AS knowledge_id FROM events
  UNION ALL SELECT p_partkey::VARCHAR, CASE WHEN p_partkey % 2 = 0 THEN 'k' || p_partkey END FROM part WHERE p_partkey % 5 > 0
  UNION ALL SELECT 'kid:k' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN ':s' || (p_partkey % 7) ELSE '' END, 'k' || p_partkey FROM part WHERE p_partkey % 9 = 0) GROUP BY ALL
""")
def recorded_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays after items and bare facts were shown."""
    p, k = a.table(spark, sf_dir, "part"), F.col("p_partkey")
    at = F.to_timestamp(F.lit(AS_OF))
    shown = p.select(F.when(k % 5 > 0, k.cast("string")).otherwise(" ").alias("question_hash"), F.when(k % 2 == 0, F.concat(F.lit("k"), k.cast("string"))).otherwise("").alias("knowledge_id"), at.alias("played_at"))
    used = p.filter(k % 9 == 0).select(F.concat(F.lit("k"), k.cast("string")).alias("knowledge_id"), F.when(k % 3 == 0, F.concat(F.lit("s"), (k % 7).cast("string"))).alias("session_id"), at.alias("played_at"))
    found = records.record_used(records.record_plays(a.plays(spark, sf_dir), shown), used)
    return found.groupBy("question_hash", "knowledge_id").agg(F.count(F.lit(1)).alias("plays"))


@query("""
WITH c AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS two, p_partkey % 10 <> 7 AS valid FROM part WHERE p_partkey % 23 = 0 OR p_partkey % 50 = 1)
SELECT CASE WHEN k % 19 = 0 THEN 'missing_fields' WHEN k % 13 = 0 THEN 'hash_unchanged' WHEN k % 23 <> 0 THEN 'not_blocked' WHEN NOT valid THEN 'missing_options' WHEN k % 46 = 0 THEN 'new_hash_blocked' ELSE 'corrected' END AS reason, count(*) AS items
FROM c GROUP BY ALL
""")
def corrected_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens to corrections of blocked items; some are incomplete, unchanged, of items that are not blocked, without
    options, or to a hash that is blocked itself."""
    k = F.col("question_hash").cast("long")
    whole = a.bank(spark, sf_dir)
    shut = a.blocked(spark, sf_dir)
    # an even blocked number is corrected to the hash 23, which is blocked
    fixed = whole.filter((k % 23 == 0) | (k % 50 == 1)).withColumn("old_hash", F.col("question_hash")).withColumn("question", F.when(k % 19 == 0, " ").otherwise(F.col("question")))
    new = F.when(k % 13 == 0, F.col("old_hash")).when(k % 46 == 0, "23").otherwise(F.concat(F.lit("n"), "old_hash"))
    fixed = fixed.withColumn("question_hash", new)
    *_, outcomes = records.correct_reported(whole, shut, a.facts(spark, sf_dir), fixed)
    return outcomes.groupBy("reason").agg(F.count(F.lit(1)).alias("items"))


@query("""
SELECT count(*) AS items, count(*) FILTER (difficulty IS NULL) AS without_difficulty, count(*) FILTER (m) AS mapped FROM (
  SELECT p_partkey % 17 = 0 AS reported, p_partkey % 10 <> 7 AS valid,
    CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 5 + 1 WHEN p_partkey % 17 <> 0 THEN p_size % 5 + 1 END AS difficulty, p_partkey % 9 = 0 OR p_partkey % 17 <> 0 AS m FROM part) WHERE reported OR valid
""")
def repaired_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank without invalid items and with missing difficulties filled in."""
    rows = records.backfill_difficulty(records.purge_invalid(a.bank(spark, sf_dir)))
    return rows.agg(F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("difficulty").isNull(), 1)).alias("without_difficulty"), F.count(F.when(F.size("difficulty_by_age_band") > 0, 1)).alias("mapped"))


@query("""
SELECT status, count(*) AS items, count(imported_at) AS dated FROM (
  SELECT CASE WHEN p_partkey % 4 = 1 THEN 'imported' WHEN p_partkey % 3 = 0 THEN 'pending' WHEN p_partkey % 3 = 1 THEN 'pending' ELSE 'rejected' END AS status,
    CASE WHEN p_partkey % 4 = 1 THEN TIMESTAMP '2024-01-30 12:34:56' END AS imported_at FROM part) GROUP BY status
""")
def import_queue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import queue after what was imported was opened again and every fourth entry was imported anew."""
    k = F.col("p_partkey")
    state = F.when(k % 3 == 0, "pending").when(k % 3 == 1, "imported").otherwise("rejected")
    queue = a.table(spark, sf_dir, "part").select(k.cast("string").alias("queue_id"), state.alias("status"), F.when(k % 3 == 1, F.to_timestamp(F.lit("2024-01-01"))).alias("imported_at"))
    after = records.mark_imported(records.reset_imported(queue), queue.filter(F.col("queue_id").cast("int") % 4 == 1), AS_OF)
    return after.groupBy("status").agg(F.count(F.lit(1)).alias("items"), F.count("imported_at").alias("dated"))


@query("""
SELECT count(*) FILTER (s IN ('lobby', 'playing')) AS open_rooms, count(*) FILTER (s = 'playing') AS playing, count(*) FILTER (s = 'lobby') AS lobby, count(*) AS total_rooms,
  (SELECT count(*) FROM orders) AS total_games, (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS multiplayer_games, (SELECT count(*) FROM orders WHERE o_orderpriority <> '1-URGENT') AS single_games
FROM (SELECT CASE WHEN idle AND state <> 'finished' THEN 'finished' ELSE state END AS s FROM (
  SELECT ['lobby', 'playing', 'finished'][c_custkey % 3 + 1] AS state, TIMESTAMP '2024-01-30 12:34:56' - to_hours(c_custkey % 40) < TIMESTAMP '2024-01-30 12:34:56' - INTERVAL 24 HOUR AS idle FROM customer))
""")
def room_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms by state once idle ones are closed, and games by mode."""
    k, now = F.col("c_custkey"), F.to_timestamp(F.lit(AS_OF))
    rooms = a.table(spark, sf_dir, "customer").select(a._pick(("lobby", "playing", "finished"), F.pmod(k, F.lit(3))).alias("status"), (now - F.make_dt_interval(F.lit(0), F.pmod(k, F.lit(40)).cast("int"))).alias("last_active"))
    matches = a.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderpriority") == "1-URGENT", "multiplayer").otherwise("single").alias("mode"))
    return records.room_stats(bank_ops.expire_rooms(rooms, AS_OF), matches)


@query("""
SELECT h AS question_hash, coalesce(r, FALSE) AS resting FROM (SELECT p_partkey::VARCHAR AS h, p_partkey AS k, p_name FROM part WHERE (contains(lower(p_name), 'a') OR p_partkey % 3 = 0) AND (list_contains(CASE WHEN p_partkey % 5 = 0 THEN [p_size % 20 + 1, p_partkey % 20 + 1] ELSE [p_size % 20 + 1] END, 3)))
LEFT JOIN (SELECT DISTINCT user_id::VARCHAR AS q, TRUE AS r FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:34:56' - INTERVAL 30 DAY) ON q = h ORDER BY k DESC LIMIT 25
""")
def bank_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_ops.search(a.bank(spark, sf_dir), a.plays(spark, sf_dir), AS_OF, query="A", category=3, most=25).select("question_hash", "resting")


@query("""
WITH freed AS (SELECT p_partkey::VARCHAR AS h FROM part WHERE p_size % 20 + 1 = 4)
SELECT count(*) AS plays, count(DISTINCT user_id) AS items FROM events WHERE NOT (user_id::VARCHAR IN (SELECT h FROM freed) AND ts >= TIMESTAMP '2024-01-30 12:34:56' - INTERVAL 30 DAY)
""")
def released_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = bank_ops.release_quarantine(a.plays(spark, sf_dir), a.bank(spark, sf_dir), F.col("category_n") == 4, AS_OF)
    return left.agg(F.count(F.lit(1)).alias("plays"), F.countDistinct("question_hash").alias("items"))


@query("""
SELECT (SELECT count(*) FROM part WHERE p_partkey % 8 <> 0)::BIGINT AS bank, (SELECT count(*) FROM events WHERE user_id % 8 <> 0 OR user_id NOT IN (SELECT p_partkey FROM part))::BIGINT AS plays
""")
def deleted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = a.bank(spark, sf_dir)
    left, played = bank_ops.delete_items(whole, a.plays(spark, sf_dir), whole.filter(F.col("question_hash").cast("int") % 8 == 0))
    return left.agg(F.count(F.lit(1)).alias("bank")).crossJoin(played.agg(F.count(F.lit(1)).alias("plays")))


@query("""
SELECT (SELECT count(*) FROM part WHERE p_partkey % 17 = 0 OR p_partkey % 12 = 0)::BIGINT AS reported, (SELECT count(*) FROM part WHERE p_partkey % 13 > 0 AND p_partkey % 12 <> 0)::BIGINT AS active_facts,
  (SELECT count(*) FROM part WHERE p_partkey % 23 = 0 OR p_partkey % 12 = 0)::BIGINT AS blocked
""")
def reported_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bank, the facts and the blocked hashes after every twelfth item was reported with its fact."""
    k = F.col("question_hash").cast("int")
    told = a.bank(spark, sf_dir).filter(k % 12 == 0).select("question_hash", F.concat(F.lit("k"), "question_hash").alias("knowledge_id"))
    shut = a.blocked(spark, sf_dir).withColumn("reported_at", F.to_timestamp(F.lit("2024-01-01")))
    flagged, facts, blocked = bank_ops.report(a.bank(spark, sf_dir), a.facts(spark, sf_dir), shut, told, AS_OF)
    return flagged.agg(F.count(F.when(F.col("is_reported"), 1)).alias("reported")).crossJoin(facts.agg(F.count(F.when(F.col("is_active"), 1)).alias("active_facts"))).crossJoin(blocked.agg(F.count(F.lit(1)).alias("blocked")))


@query("""
WITH b AS (SELECT p_partkey % 40 AS h, p_partkey AS k, unnest(CASE WHEN p_partkey % 5 = 0 THEN [p_size % 20 + 1, p_partkey % 20 + 1] ELSE [p_size % 20 + 1] END)::INT AS c FROM part)
SELECT h::VARCHAR AS question_hash, string_agg(DISTINCT c::VARCHAR, ',' ORDER BY c::VARCHAR) AS categories, (SELECT min(p_partkey) FROM part WHERE p_partkey % 40 = h)::BIGINT AS oldest FROM b GROUP BY h
""")
def merged_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of one hash as the oldest of them, with the categories of all."""
    k = F.col("question_hash").cast("long")
    rows = bank_ops.merge_taxonomy(a.bank(spark, sf_dir).withColumn("k", k).withColumn("question_hash", F.pmod(k, F.lit(40)).cast("string")))
    return rows.select("question_hash", F.array_join(F.array_sort(F.col("category_ns").cast("array<string>")), ",").alias("categories"), F.col("k").alias("oldest"))


@query("""
SELECT count(*) FILTER (two) + count(*) FILTER (NOT two AND p_partkey % 10 <> 7) AS strict, count(*) FILTER (p_partkey % 10 <> 7) AS loose FROM (
  SELECT p_partkey, p_partkey % 3 = 0 AND p_partkey % 10 <> 7 AS two FROM part)
""")
def strict_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = [F.col(c) for c in ("options", "format", "correct_answer")]
    return a.bank(spark, sf_dir).agg(F.count(F.when(bank_ops.valid_options_strict(*o), 1)).alias("strict"), F.count(F.when(bank_ops.valid_options(*o), 1)).alias("loose"))


# --- item rules and reports --------------------------------------------------------------------------------------------

#: What the bank's items can break: the names of parts are English words, an option repeats the question with a letter
#: more, and a missing difficulty is the least of the band. Names of parts are in no other rule's patterns.
BANK_ITEMS = f"""
WITH b AS (SELECT p_partkey AS k, p_partkey % 3 = 0 AS two, ['6-9', '10-15', '15+'][p_partkey % 3 + 1] AS age, p_name AS q, CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 5 + 1 END AS d,
  CASE WHEN p_partkey % 10 = 7 THEN [p_name, p_name || ' a', p_brand] WHEN p_partkey % 3 = 0 THEN ['Verdadeiro', 'Falso'] ELSE [p_name, p_name || ' a', p_brand, p_type] END AS o FROM part),
l AS (SELECT *, CASE age WHEN '6-9' THEN 4 WHEN '10-15' THEN 6 ELSE 8 END AS w, CASE age WHEN '6-9' THEN 38 WHEN '10-15' THEN 52 ELSE 72 END AS c, CASE age WHEN '6-9' THEN 3 WHEN '10-15' THEN 4 ELSE 5 END AS most FROM b),
i AS (
  SELECT age, 'MC_OPTIONS_TOO_LONG' AS code FROM l WHERE len(list_filter(o, lambda x: len(string_split(x, ' ')) > w OR length(x) > c)) > 0
  UNION ALL SELECT age, 'ANSWER_LEAKED' FROM l WHERE NOT two
  UNION ALL SELECT age, 'DIFFICULTY_OUT_OF_RANGE' FROM l WHERE d > most
  UNION ALL SELECT age, 'DIFFICULTY_EASIER_THAN_REQUESTED' FROM l WHERE d >= 4 AND least(d, most) >= 4
  UNION ALL SELECT age, 'MC_MULTIPLE_CORRECT' FROM l WHERE two AND k % 10 = 7
  UNION ALL SELECT age, 'AGE_TOO_HARD' FROM l WHERE age = '6-9' AND d >= 4
  UNION ALL SELECT age, 'MC_OPTION_LEAKS_QUESTION' FROM l WHERE NOT two AND len(o) = 4
  UNION ALL SELECT age, 'PT_ENGLISH_ONLY' FROM l WHERE age IN ('6-9', '10-15') AND (regexp_matches(q, '{items.ENGLISH_WORDS}')
    OR (len(o) = 4 AND NOT two AND o[4] NOT LIKE '% %' AND regexp_matches(lower(o[4]), '{items.ENGLISH_WORDS}')))
)
"""


def bank_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.bank(spark, sf_dir)
    return rows.select("question_hash", "question", F.col("correct_answer").alias("answer"), "options", F.array().cast("array<string>").alias("clues"), "format", "age_band", "difficulty", "category_n", F.lit(True).alias("is_mc"))


@query(BANK_ITEMS + "SELECT age AS age_band, code, count(*) AS items FROM i GROUP BY ALL")
def item_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items of the bank have each issue, of all rules."""
    # the table is one file; judging is work for every core
    rows = bank_items(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "question_hash")
    each = items.each_issue(items.with_issues(rows), "age_band")
    return each.groupBy("age_band", F.col("issue.code").alias("code")).agg(F.count(F.lit(1)).alias("items"))


REPORTS = """
WITH r AS (
  SELECT event_id AS k, ['wrong_answer', 'confusing', 'portuguese', 'suggestion', '', 'bad_options'][event_id % 6 + 1] AS kind, event_id % 101 AS quality, CASE WHEN event_id % 2 = 0 THEN 'open' ELSE 'resolved' END AS status,
    list_filter([CASE WHEN event_id % 3 = 0 THEN 'FACT_09' END, CASE WHEN event_id % 4 = 0 THEN 'PT_ENGLISH_ONLY' END, CASE WHEN event_id % 5 = 0 THEN 'MC_MULTIPLE_CORRECT' END, CASE WHEN event_id % 7 = 0 THEN 'FORMAT_VIOLATION' END], lambda c: c IS NOT NULL) AS codes
  FROM events
), v AS (
  SELECT *, len(codes) AS n, CASE WHEN list_contains(codes, 'FACT_09') THEN 'factual_error' WHEN list_contains(codes, 'MC_MULTIPLE_CORRECT') THEN 'ambiguity' WHEN list_contains(codes, 'PT_ENGLISH_ONLY') THEN 'pt_pt' WHEN len(codes) > 0 THEN 'bad_formulation' ELSE 'valid' END AS verdict,
    CASE kind WHEN 'wrong_answer' THEN 'factual_error' WHEN 'confusing' THEN 'ambiguity' WHEN 'portuguese' THEN 'pt_pt' WHEN 'bad_options' THEN 'bad_formulation' ELSE '' END AS told FROM r
), d AS (
  SELECT *, CASE WHEN verdict = 'valid' THEN 'low' WHEN verdict IN ('factual_error', 'ambiguity') THEN CASE WHEN quality < 55 THEN 'high' ELSE 'medium' END WHEN n >= 3 THEN 'high' ELSE 'medium' END AS severity,
    CASE WHEN n = 0 THEN CASE WHEN kind IN ('', 'suggestion') THEN 93 ELSE 38 END WHEN told = verdict THEN least(98, 84 + 3 * least(n, 4)) WHEN told = '' THEN least(90, 72 + 3 * least(n, 5)) ELSE greatest(45, 62 + 2 * least(n, 3)) END AS confidence,
    CASE WHEN n = 0 THEN kind IN ('', 'suggestion') WHEN told = verdict THEN TRUE WHEN told = '' THEN NULL ELSE FALSE END AS aligns FROM v
), x AS (SELECT *, CASE WHEN verdict = 'valid' THEN CASE WHEN confidence >= 70 THEN 'validate' ELSE 'review' END WHEN kind = 'suggestion' OR (NOT aligns AND confidence < 55) THEN 'review' ELSE 'correct' END AS action FROM d)
"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as reports with the issues that rules found."""
    k = F.col("event_id")
    code = lambda n, name: F.when(F.pmod(k, F.lit(n)) == 0, F.struct(F.lit(name).alias("code"), F.lit("x").alias("layer"), F.lit(name).alias("message")))
    found = F.array_compact(F.array(code(3, "FACT_09"), code(4, "PT_ENGLISH_ONLY"), code(5, "MC_MULTIPLE_CORRECT"), code(7, "FORMAT_VIOLATION")))
    kind = a._pick(("wrong_answer", "confusing", "portuguese", "suggestion", "", "bad_options"), F.pmod(k, F.lit(6)))
    return a.table(spark, sf_dir, "events").select(k.alias("report_id"), kind.alias("issue_type"), F.pmod(k, F.lit(101)).cast("int").alias("quality"), F.when(F.pmod(k, F.lit(2)) == 0, "open").otherwise("resolved").alias("status"), found.alias("issues"))


@query(REPORTS + "SELECT verdict, severity, confidence, aligns, action, count(*) AS reports FROM x GROUP BY ALL")
def report_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnosis.diagnose(reports(spark, sf_dir))
    return rows.groupBy("verdict", "severity", "confidence", "aligns", "action").agg(F.count(F.lit(1)).alias("reports"))


@query(REPORTS + """
, c AS (SELECT unnest(codes) AS code FROM x)
SELECT 'diagnosed' AS dimension, '' AS value, count(*) AS count FROM x
UNION ALL SELECT 'aligns', '', count(*) FROM x WHERE aligns UNION ALL SELECT 'mismatches', '', count(*) FROM x WHERE NOT aligns
UNION ALL SELECT 'open_with_problems', '', count(*) FROM x WHERE status = 'open' AND verdict <> 'valid'
UNION ALL SELECT 'verdict', verdict, count(*) FROM x GROUP BY verdict UNION ALL SELECT 'complaint', kind, count(*) FROM x WHERE kind <> '' GROUP BY kind
UNION ALL (SELECT 'code', code, count(*) FROM c GROUP BY code ORDER BY count(*) DESC, code LIMIT 3)
UNION ALL SELECT 'mean_quality', '', floor(avg(quality) + 0.5)::BIGINT FROM x
""")
def diagnosis_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnosis.statistics(diagnosis.diagnose(reports(spark, sf_dir)), codes=3)


@query("""
WITH r AS (SELECT event_id, ['open', 'resolved', 'cancelled'][event_id % 3 + 1] AS status, 't' || (event_id % 4) AS issue_type, ['6-9', '10-15', '15+'][event_id % 3 + 1] AS age_band, CASE WHEN event_id % 2 = 0 THEN 'mobile' ELSE '' END AS device_type,
  'cat ' || (user_id % 5) AS category_name, user_id AS reporter_id FROM events)
SELECT 'status' AS dimension, status AS value, count(*) AS count FROM r GROUP BY ALL UNION ALL SELECT 'issue_type', issue_type, count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'age_band', age_band, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'device_type', device_type, count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'category_name', category_name, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'reporters', '', count(DISTINCT reporter_id) FROM r
""")
def report_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.report_stats(report_index(spark, sf_dir))


def report_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return a.table(spark, sf_dir, "events").select(
        k.cast("string").alias("report_id"),
        a._pick(("open", "resolved", "cancelled"), F.pmod(k, F.lit(3))).alias("status"),
        F.concat(F.lit("t"), F.pmod(k, F.lit(4)).cast("string")).alias("issue_type"),
        a._pick(("6-9", "10-15", "15+"), F.pmod(k, F.lit(3))).alias("age_band"),
        F.when(F.pmod(k, F.lit(2)) == 0, "mobile").alias("device_type"),
        F.concat(F.lit("cat "), F.pmod("user_id", F.lit(5)).cast("string")).alias("category_name"),
        F.col("user_id").alias("reporter_id"),
        F.pmod(k, F.lit(97)).cast("string").alias("question_hash"),
        F.col("ts").cast("timestamp").alias("received_at"),
    )


@query("""
SELECT event_id::VARCHAR AS report_id FROM events WHERE event_id % 3 = 0 AND event_id % 4 = 1 AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-21 00:00:00' AND contains('cat ' || (user_id % 5), 'cat 2')
""")
def filtered_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.filter_reports(report_index(spark, sf_dir), "open", "t1", "2024-01-10", "2024-01-20", "CAT 2").select("report_id")


@query("""
SELECT (event_id % 97)::VARCHAR AS question_hash, bool_or(event_id % 3 = 0) AS open, bool_or(event_id % 3 = 1) AS resolved, bool_or(event_id % 3 = 2) AS cancelled, count(*) AS reports FROM events GROUP BY 1
""")
def reported_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.hash_sets(report_index(spark, sf_dir))


# --- evaluations, imports, review ----------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT p_partkey AS k, ['6-9', '10-15', '15+'][p_partkey % 3 + 1] AS age, 'F' || (p_partkey % 2) AS format, CASE WHEN p_partkey % 4 = 0 THEN ['mc-close'] WHEN p_partkey % 4 = 1 THEN ['too-long', 'leak'] ELSE [] END AS issues,
  p_size % 5 + 1 AS before, p_partkey % 5 + 1 AS after, p_partkey % 13 AS motor, p_size % 13 AS human FROM part),
k AS (
  SELECT k, 'issue' AS type, 'issue|' || age || '|' || CASE WHEN i LIKE 'mc-%' THEN format ELSE '*' END || '|' || i AS rule_key FROM (SELECT *, unnest(issues) AS i FROM e)
  UNION ALL SELECT k, 'difficulty', 'difficulty|' || age || '|' || before || '->' || after FROM e WHERE before <> after
  UNION ALL SELECT k, 'difficulty', 'difficulty-cap|' || age FROM e WHERE after < before
  UNION ALL SELECT k, 'layer', 'layer-over|age|' || age FROM e WHERE abs(motor - human) > 1 AND human / 12 <= 0.6 AND motor / 12 >= 0.8
  UNION ALL SELECT k, 'layer', 'layer-under|age|' || age FROM e WHERE abs(motor - human) > 1 AND motor / 12 <= 0.6 AND human / 12 >= 0.8 AND NOT (human / 12 <= 0.6 AND motor / 12 >= 0.8)
)
SELECT rule_key, any_value(type) AS type, count(*) AS evidence, least(0.99, floor((0.42::DOUBLE + count(*) * 0.055::DOUBLE) * 100 + 0.5) / 100) AS confidence, CASE WHEN count(*) >= 8 THEN 'high' ELSE 'medium' END AS level FROM k GROUP BY rule_key HAVING count(*) >= 3
""")
def mined_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules mined from parts as evaluations."""
    return validation.derive_rules(evaluations(spark, sf_dir)).select("rule_key", "type", "evidence", "confidence", "level")


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    none = F.array().cast("array<string>")
    told = F.when(k % 4 == 0, F.array(F.lit("mc-close"))).when(k % 4 == 1, F.array(F.lit("too-long"), F.lit("leak"))).otherwise(none)
    change = F.array(F.struct(F.lit("difficulty").alias("field"), (size % 5 + 1).cast("string").alias("ai_value"), (k % 5 + 1).cast("string").alias("human_value")))
    return a.table(spark, sf_dir, "part").select(k.alias("id"), a._pick(("6-9", "10-15", "15+"), k % 3).alias("age"), F.concat(F.lit("F"), (k % 2).cast("string")).alias("format"), told.alias("issues"), change.alias("field_errors"), F.create_map(F.lit("age"), (k % 13).cast("int")).alias("engine_layers"), F.create_map(F.lit("age"), (size % 13).cast("int")).alias("human_layers"))


@query("""
SELECT layer, result, count(*) AS evaluations FROM (SELECT 'age' AS layer, CASE WHEN abs(m - h) <= 1 THEN 'ok' WHEN h / 12 <= 0.6 AND m / 12 >= 0.8 THEN 'motor-high' WHEN m / 12 <= 0.6 AND h / 12 >= 0.8 THEN 'motor-low' ELSE 'warn' END AS result
  FROM (SELECT p_partkey % 13 AS m, p_size % 13 AS h FROM part)) GROUP BY ALL
""")
def layer_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = evaluations(spark, sf_dir).select(F.explode(validation.layer_matrix(F.col("engine_layers"), F.col("human_layers"))).alias("m"))
    return each.groupBy("m.layer", "m.result").agg(F.count(F.lit(1)).alias("evaluations"))


@query("""
WITH i AS (SELECT p_partkey AS k, 'k' || (p_partkey % 700) AS kid, ['Wikidata', 'manual', 'sample', 'outro'][p_partkey % 4 + 1] AS source, 'S' || (p_partkey % 400) AS sid FROM part),
r AS (SELECT * FROM i WHERE k % 2 = 0 AND k < 700),
o AS (SELECT source, sid, min(kid) AS lo, max(kid) AS hi FROM r GROUP BY ALL),
l AS (SELECT *, row_number() OVER (PARTITION BY kid ORDER BY k DESC) AS n FROM i)
SELECT CASE WHEN n > 1 THEN 'superseded' WHEN o.lo IS NOT NULL AND o.lo <> l.kid THEN 'skipped' WHEN kid IN (SELECT kid FROM r) THEN 'updated' ELSE 'inserted' END AS outcome, count(*) AS items
FROM l LEFT JOIN o ON o.source = l.source AND o.sid = l.sid GROUP BY ALL
""")
def imported_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of an import of facts, several of one id, into a repository with one record of each source's id."""
    k = number_of("knowledge_id")
    batch = a.facts(spark, sf_dir).withColumn("position", k).withColumn("knowledge_id", F.concat(F.lit("k"), (k % 700).cast("string")))
    p = F.col("position")
    held = batch.filter((p % 2 == 0) & (p < 700)).groupBy("source", "source_id").agg(F.min("knowledge_id").alias("knowledge_id"))
    known = batch.filter((p % 2 == 0) & (p < 700)).select("knowledge_id", F.lit("none").alias("source"), F.col("knowledge_id").alias("source_id"))
    return knowledge.import_batch(batch, held.select("knowledge_id", "source", "source_id").unionByName(known)).groupBy("outcome").agg(F.count(F.lit(1)).alias("items"))


@query("""
WITH e AS (SELECT event_id AS k, ts, 'Pergunta ' || (event_id % 300) AS q, CASE WHEN event_id % 10 > 0 THEN 'R' || (event_id % 300) ELSE ' ' END AS a,
  CASE WHEN event_id % 3 = 0 THEN ['DIFFICULTY_OUT_OF_RANGE'] WHEN event_id % 3 = 1 THEN ['DIFFICULTY_HARDER_THAN_REQUESTED', 'DIFFICULTY_EASIER_THAN_REQUESTED'] ELSE ['PT_ENGLISH_ONLY', 'DIFFICULTY_OUT_OF_RANGE'] END AS codes FROM events WHERE event_type = 'click'),
f AS (SELECT *, k % 3 <> 2 AND trim(a) <> '' AS fit FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY q, trim(a) ORDER BY fit DESC, ts DESC, k) AS n FROM f)
SELECT CASE WHEN NOT fit THEN 'skipped' WHEN k % 300 < 40 THEN 'already_reviewed' WHEN n > 1 THEN 'skipped' ELSE 'queued' END AS reason, count(*) AS events FROM n GROUP BY ALL
""")
def review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rejected_events(spark, sf_dir)
    n = spark.range(40).select(text.question_hash(F.concat(F.lit("Pergunta "), F.col("id").cast("string")), F.concat(F.lit("R"), F.col("id").cast("string"))).alias("question_hash"))
    return review.candidates(rows, n).groupBy("reason").agg(F.count(F.lit(1)).alias("events"))


def rejected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    n = F.pmod(k, F.lit(300)).cast("string")
    listed = lambda *names: F.array(*[F.lit(x) for x in names])
    codes = F.when(k % 3 == 0, listed("DIFFICULTY_OUT_OF_RANGE")).when(k % 3 == 1, listed("DIFFICULTY_HARDER_THAN_REQUESTED", "DIFFICULTY_EASIER_THAN_REQUESTED")).otherwise(listed("PT_ENGLISH_ONLY", "DIFFICULTY_OUT_OF_RANGE"))
    rows = a.table(spark, sf_dir, "events").filter("event_type = 'click'")
    return rows.select(k.alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("Pergunta "), n).alias("question_text"), F.when(k % 10 > 0, F.concat(F.lit("R"), n)).otherwise(" ").alias("answer_text"), codes.alias("issue_codes"), F.lit("rejected").alias("outcome"), F.when(k % 4 == 0, F.col("ts").cast("timestamp")).alias("dismissed_at"), F.lit(None).cast("timestamp").alias("validated_at"), n.alias("question_hash"))


@query("""
WITH e AS (SELECT event_id AS k, CASE WHEN event_id % 3 = 0 THEN ['DIFFICULTY_OUT_OF_RANGE'] WHEN event_id % 3 = 1 THEN ['DIFFICULTY_HARDER_THAN_REQUESTED', 'DIFFICULTY_EASIER_THAN_REQUESTED'] ELSE ['PT_ENGLISH_ONLY', 'DIFFICULTY_OUT_OF_RANGE'] END AS codes FROM events WHERE event_type = 'click'),
u AS (SELECT *, unnest(codes) AS code FROM e), p AS (SELECT * FROM u WHERE k % 300 < 30),
h AS (SELECT DISTINCT k % 300 AS h FROM e WHERE k % 300 < 30)
SELECT code, count(*) FILTER (k % 300 < 30) AS pending, count(*) AS telemetry, count(*) FILTER (k % 4 <> 0 AND k % 300 NOT IN (SELECT h FROM h)) AS telemetry_open, count(*) FILTER (k % 3 <> 2) AS difficulty_import FROM u GROUP BY code
""")
def review_code_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rejected_events(spark, sf_dir)
    return review.code_options(rows.filter(F.col("question_hash").cast("int") < 30), rows)


@query("""
WITH q AS (SELECT p_partkey AS k, ['pending', 'approved', 'rejected'][p_partkey % 3 + 1] AS status FROM part WHERE p_partkey % 2 = 0),
n AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 5 = 0)
SELECT count(*) AS total, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'approved') AS approved, count(*) FILTER (s = 'rejected') AS rejected FROM (
  SELECT status AS s FROM q WHERE NOT (k IN (SELECT k FROM n) AND status = 'pending') UNION ALL SELECT 'pending' FROM n WHERE k NOT IN (SELECT k FROM q WHERE status <> 'pending'))
""")
def merged_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = a.table(spark, sf_dir, "part")
    queue = p.filter(k % 2 == 0).select(k.cast("string").alias("question_hash"), a._pick(("pending", "approved", "rejected"), k % 3).alias("status"))
    return review.stats(review.merge_queue(queue, p.filter(k % 5 == 0).select(k.cast("string").alias("question_hash"))))


# --- histories and picks -------------------------------------------------------------------------------------------------


@query("""
SELECT question_hash, max(ts) AS ts FROM (SELECT CASE WHEN user_id % 3 > 0 THEN 'h' || user_id ELSE 'h' || (user_id + 1) END AS question_hash, ts FROM events) WHERE ts >= TIMESTAMP '2024-01-30 12:34:56' - INTERVAL 10 DAY GROUP BY 1
""")
def history_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    name = F.concat(F.lit("h"), F.when(u % 3 > 0, u).otherwise(u + 1).cast("string"))
    rows = a.table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), F.lit("q").alias("q"), F.lit("a").alias("a"), name.alias("question_hash"), F.col("ts").cast("timestamp").alias("ts"))
    return history.snapshot(rows, AS_OF, 10).select("question_hash", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def recent_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recent_slice(a.table(spark, sf_dir, "events"), "user_id", "event_id", 3).select("event_id")


@query("""
WITH l AS (SELECT user_id, event_id, event_type, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS last FROM events),
b AS (SELECT *, sum((event_type <> last)::INT) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS broken FROM l)
SELECT user_id, any_value(last) AS event_type, count(*) AS run FROM b WHERE broken = 0 GROUP BY user_id
""")
def trailing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.trailing_run(a.table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id % 7 ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) <= 2 AS allowed FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)
""")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.table(spark, sf_dir, "events").select("event_id", F.pmod("user_id", F.lit(7)).alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    return history.over_limit(rows, "client", "ts", 2).select("event_id", "allowed")


@query("""
WITH m AS (SELECT provider, model, row_number() OVER (PARTITION BY provider ORDER BY model) AS turn FROM (SELECT DISTINCT 'p' || (user_id % 6) AS provider, 'm' || (user_id % 9) AS model FROM events) WHERE provider <> 'p5')
SELECT row_number() OVER (ORDER BY turn, provider)::INT AS position, provider, model FROM m
""")
def attempt_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    pairs = a.table(spark, sf_dir, "events").select(F.pmod(u, F.lit(6)).cast("int").alias("provider_order"), F.pmod(u, F.lit(9)).cast("int").alias("model_order")).distinct()
    named = pairs.select(F.concat(F.lit("p"), F.col("provider_order").cast("string")).alias("provider"), "provider_order", F.concat(F.lit("m"), F.col("model_order").cast("string")).alias("model"), "model_order", (F.col("provider_order") == 5).alias("is_open"))
    return picks.interleaved(named)


@query("""
WITH t AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_size % 6 ORDER BY p_partkey) AS turn, min(p_partkey) OVER (PARTITION BY p_size % 6) AS first FROM part)
SELECT p_partkey FROM t ORDER BY turn, first, p_partkey LIMIT 50
""")
def spread_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.table(spark, sf_dir, "part").select("p_partkey", F.pmod("p_size", F.lit(6)).alias("kind"))
    return knowledge.spread_by_kind(rows, "kind", "p_partkey", 50).select("p_partkey")


# --- games from flat tables ----------------------------------------------------------------------------------------------


@query("""
SELECT lpad(o_orderkey::VARCHAR, 10, '0') AS game_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'multiplayer' ELSE 'single' END AS mode, strftime(timezone('Europe/Lisbon', timezone('UTC', date_trunc('second', o_orderdate::TIMESTAMP))), '%d/%m/%Y, %H:%M') AS date,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Multijogador' ELSE 'Individual' END || ' · ' || strftime(timezone('Europe/Lisbon', timezone('UTC', date_trunc('second', o_orderdate::TIMESTAMP))), '%d/%m/%Y, %H:%M') AS title
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
""")
def match_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, _, _ = a.game_frames(spark, sf_dir)
    return games.match_labels(normal).select("game_id", "mode", "date", "title")


@query("""
WITH e AS (SELECT l_orderkey AS m, l_linenumber AS r, 's' || (l_suppkey % 3) AS p, l_partkey AS id, l_shipdate AS said, l_discount >= 0.05 AS ok FROM lineitem),
l AS (SELECT m, r, p, arg_max(ok, (said, id)) AS ok FROM e GROUP BY m, r, p),
g AS (SELECT m, r, count(*) AS n, count(*) FILTER (ok) AS c FROM l GROUP BY m, r), h AS (SELECT DISTINCT l_orderkey AS m, l_linenumber AS r FROM lineitem WHERE l_linenumber <= 2)
SELECT h.r IS NOT NULL AS known, count(*) AS rounds, sum(n)::BIGINT AS answers FROM g LEFT JOIN h USING (m, r) GROUP BY 1
""")
def merged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds of orders with the answers of line items as flat events; only the first two rounds are known beforehand."""
    i = a.table(spark, sf_dir, "lineitem")
    empty = F.array().cast(f"array<{games.ANSWER}>")
    known = i.filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("round")).distinct()
    told = known.select("match_id", "round", F.lit("kept").alias("category"), F.lit("q").alias("question"), F.lit("a").alias("correctAnswer"), F.lit("6-9").alias("ageBand"), empty.alias("answers"))
    events = i.select(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("round"), F.col("l_partkey").alias("event_id"), F.concat(F.lit("s"), F.pmod("l_suppkey", F.lit(3)).cast("string")).alias("player_id"), F.lit("n").alias("nickname"), F.lit("x").alias("selected_answer"), (F.col("l_discount") >= 0.05).alias("correct"), F.lit(5).alias("response_ms"), F.col("l_shipdate").cast("string").alias("answered_at"), F.lit("new").alias("category"), F.lit("q").alias("question"), F.lit("a").alias("correct_answer"), F.lit("15+").alias("age_band"))
    rows = games.merge_answer_events(told, events)
    return rows.groupBy((F.col("category") == "kept").alias("known")).agg(F.count(F.lit(1)).alias("rounds"), F.sum(F.size("answers")).alias("answers"))


# --- texts, keys and times ------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, 'geral|' || lower(p_brand) || '|' || lower(p_type) || '|de' AS key, CASE WHEN p_partkey % 3 = 0 THEN 'capital ' || lower(p_brand) ELSE lower(p_brand) END AS free_key FROM part
""")
def knowledge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, brand = F.col("p_partkey"), F.col("p_brand")
    asked = F.when(k % 3 == 0, "Qual é a capital?").otherwise("Como se chama a marca?")
    return a.table(spark, sf_dir, "part").select("p_partkey", keys.structured_key(F.lit(None).cast("string"), brand, F.col("p_type"), F.lit("de")).alias("key"), keys.knowledge_key(asked, brand).alias("free_key"))


@query("""
SELECT p_partkey, [0, 1, 2][p_partkey % 3 + 1] = 0 AS same_place, CASE WHEN p_partkey % 3 = 0 THEN 'De Moscovo a Pequim ' WHEN p_partkey % 3 = 1 THEN 'NOVA IORQUE e Irão ' ELSE 'Lisboa ' END || p_partkey AS canonical,
  CASE WHEN p_partkey % 3 = 0 THEN 'Moscow' WHEN p_partkey % 3 = 1 THEN 'New York' END AS variant FROM part
""")
def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    told = F.concat(a._pick(("De Moscow a Beijing ", "NEW YORK e Iran ", "Lisboa "), k % 3), k.cast("string"))
    return a.dealt(a.table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("p_partkey", F.coalesce(places.mismatch(told, F.lit("Moscovo")) == "Moscovo", F.lit(False)).alias("same_place"), places.canonical(told).alias("canonical"), places.first_variant(told)["variant"].alias("variant"))


@query("""
WITH d AS (SELECT event_id, date_trunc('day', ts) AS day FROM events WHERE event_id % 5 = 0)
SELECT event_id, strftime(day + INTERVAL 40 DAY, '%Y-%m-%d') AS later, timezone('UTC', timezone('Europe/Lisbon', day)) AS begins, timezone('UTC', timezone('Europe/Lisbon', day + INTERVAL 1 DAY)) AS ends, timezone('UTC', timezone('Europe/Lisbon', day + INTERVAL 10 HOUR)) + INTERVAL 1 MINUTE AS minute_ends FROM d
""")
def local_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    plain = lambda c, name: c.cast("timestamp_ntz").alias(name)
    return a.table(spark, sf_dir, "events").filter("event_id % 5 = 0").select("event_id", localtime.add_days(day, 40).alias("later"), plain(localtime.instant(day), "begins"), plain(localtime.exclusive_end(day), "ends"), plain(localtime.exclusive_end(F.concat(day, F.lit("T10:00"))), "minute_ends"))


@query("""
SELECT p_partkey, 'Peça ' || p_partkey AS title, 'https://a.pt/' || p_partkey AS link, 'Marca & tipo ' || p_size AS description FROM part
""")
def rss_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    xml = F.concat(F.lit("<rss><channel><item><title><![CDATA[Peça "), k, F.lit("]]></title><link>https://a.pt/"), k, F.lit("</link><description>&lt;p&gt;Marca &amp;amp; tipo "), F.col("p_size").cast("string"), F.lit("&lt;/p&gt;</description></item><item><title>sem ligação</title></item></channel></rss>"))
    return markup.rss_items(a.dealt(a.table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", xml.alias("xml")), "xml").select("p_partkey", "title", "link", "description")


@query("""
SELECT p_partkey, 'Qual é a peça número ' || n || ' da lista?' AS question, 'Peça ' || (p_partkey + n) AS answer FROM part, (VALUES (1), (2)) AS v(n)
""")
def listed_riddles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    one = lambda n: F.concat(F.lit(f"<p>Qual é a peça número {n} da lista?</p><p>Resposta: Peça "), (k + n).cast("string"), F.lit(".</p>"))
    pages = a.dealt(a.table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.concat(one(1), one(2)).alias("html"))
    return markup.riddle_list(pages, "html", "answered")


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_type IN ('purchase', 'view') THEN 'accepted' WHEN event_type = 'click' THEN 'rejected' WHEN event_type = 'error' THEN 'api_error' WHEN event_type = 'signup' THEN 'parse_error' ELSE 'unknown' END AS outcome, CASE WHEN event_id % 3 > 0 THEN 'multi' ELSE 'local' END AS mode FROM events)
SELECT outcome, mode AS game_mode, count(*) AS events FROM e GROUP BY ALL
""")
def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as rows, read under a newer schema and made events again."""
    stored = telemetry.to_rows(a.generation_events(spark, sf_dir))
    wanted = {f.name: f.dataType.simpleString() for f in stored.schema} | {"score": "int"}
    again = telemetry.from_rows(telemetry.with_columns(stored, wanted))
    return again.groupBy("outcome", "game_mode").agg(F.count(F.lit(1)).alias("events"))


@query("""
WITH RECURSIVE p AS (
  SELECT p_partkey AS k, p_size % 20 + 1 AS category, list_filter(list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(p_type || ' ' || p_name || ' lote' || p_partkey % 7), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' ')), lambda w: length(w) > 2) AS words FROM part
), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY k) AS pos FROM p),
walk(category, pos, k, held, kept) AS (
  SELECT category, pos, k, words, TRUE FROM r WHERE pos = 1
  UNION ALL
  SELECT category, pos, k, CASE WHEN alike THEN held ELSE words END, NOT alike FROM (
    SELECT r.category, r.pos, r.k, r.words, w.held, len(list_intersect(r.words, w.held)) / len(list_distinct(r.words || w.held)) >= 0.5 AS alike FROM walk w JOIN r ON r.category = w.category AND r.pos = w.pos + 1)
)
SELECT category::INT AS category_n, count(*) AS records, count(*) FILTER (kept) AS kept, (sum(k) FILTER (kept))::BIGINT AS kept_keys FROM walk GROUP BY category
""")
def unlike_last_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each category that are not like the last one kept before them."""
    p = a.table(spark, sf_dir, "part")
    text = F.concat_ws(" ", "p_type", "p_name", F.concat(F.lit("lote"), F.pmod("p_partkey", F.lit(7)).cast("string")))
    category = (F.pmod("p_size", F.lit(20)) + 1).cast("int").alias("category_n")
    found = sequential.unlike_last(p.select("p_partkey", category, text.alias("fact")), F.col("category_n"), ["p_partkey"], F.col("fact"), 0.5)
    return found.groupBy("category_n").agg(F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("kept"), 1)).alias("kept"), F.sum(F.when(F.col("kept"), F.col("p_partkey"))).alias("kept_keys"))


REPETITIONS = """
WITH i AS (
  SELECT l_suppkey AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS p, CASE WHEN l_partkey % 3 = 0 THEN 'k' || l_partkey % 900 END AS id,
    'geo|e' || l_partkey % 700 || '|c' || l_quantity::INT % 5 || '|r' AS key, 'h' || l_orderkey % 400 AS hash, 'resposta ' || l_partkey % 800 AS answer, l_linenumber = 1 AS two,
    list_distinct(['lote' || l_partkey % 41, 'cor' || l_partkey % 13, 'tipo' || l_linenumber]) AS words FROM lineitem
), f AS (
  SELECT *, min(p) OVER (PARTITION BY s, id) AS first_id, min(p) OVER (PARTITION BY s, key) AS first_key, min(CASE WHEN NOT two THEN p END) OVER (PARTITION BY s, answer) AS first_answer FROM i
), c AS (
  SELECT 'KNOWLEDGE_ID_REPEATED' AS code FROM f WHERE id IS NOT NULL AND first_id < p
  UNION ALL SELECT 'KNOWLEDGE_REPEATED' FROM f WHERE id IS NULL AND first_key < p
  UNION ALL SELECT 'KNOWLEDGE_REPORTED' FROM f WHERE id IN ('k3', 'k6')
  UNION ALL SELECT 'QUESTION_REPORTED' FROM f WHERE hash = 'h7'
  UNION ALL SELECT 'ANSWER_REPEATED' FROM f WHERE NOT two AND first_answer < p
  UNION ALL SELECT 'QUESTION_SIMILAR' FROM f WHERE EXISTS (SELECT 1 FROM i WHERE i.s = f.s AND i.p BETWEEN f.p - 8 AND f.p - 1 AND len(list_intersect(i.words, f.words)) / len(list_distinct(i.words || f.words)) >= 0.55)
)
"""


@query(REPETITIONS + "SELECT code, count(*) AS items FROM c GROUP BY code")
def repeated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many line items, as items of their supplier's session, have each issue of repetition."""
    number = lambda c, n: F.pmod(c, F.lit(n)).cast("string")
    place = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1
    items_ = a.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("session"),
        place.alias("position"),
        F.concat(F.lit("lote"), number("l_partkey", 41), F.lit(" cor"), number("l_partkey", 13), F.lit(" tipo"), F.col("l_linenumber").cast("string")).alias("question"),
        F.concat(F.lit("Resposta "), number("l_partkey", 800)).alias("answer"),
        F.when(F.col("l_linenumber") == 1, "VERDADEIRO_FALSO").otherwise("RESPOSTA_DIRETA").alias("format"),
        F.when(F.pmod("l_partkey", F.lit(3)) == 0, F.concat(F.lit("k"), number("l_partkey", 900))).alias("knowledge_id"),
        F.concat(F.lit("geo|e"), number("l_partkey", 700), F.lit("|c"), number(F.col("l_quantity").cast("int"), 5), F.lit("|r")).alias("knowledge_key"),
        F.concat(F.lit("h"), number("l_orderkey", 400)).alias("question_hash"),
    )
    blocked = spark.createDataFrame([(None, "blocked", "knowledge_id", "k3"), (None, "blocked", "knowledge_id", "k6"), (None, "blocked", "question_hash", "h7")], "session string, kind string, field string, value string")
    return repetition.repetition_issues(items_, blocked).groupBy("code").agg(F.count(F.lit(1)).alias("items"))
