"""Registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import localtime, text
from tessera.operators import bank as bank_ops
from tessera.operators import games, knowledge, series, telemetry, usage
from tessera.plans import adapters as a
from tessera.plans import records as _records  # noqa: F401  registers its queries
from tessera.plans.registry import AS_OF, AS_OF_LOCAL, ORACLE_SQL, QUERIES, query
from tessera.sources import markup

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]

# --- games -----------------------------------------------------------------------------------------------------

PCT = "floor({0}::DOUBLE / {1} * 1000 + 0.5) / 10"
ANSWERS = """
WITH x AS (
  SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 10, '0') AS game_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'multiplayer' ELSE 'single' END AS mode,
    'c' || (o_custkey % 200) AS player_id, CASE WHEN o_custkey % 3 > 0 THEN 'Nick c' || (o_custkey % 200) ELSE '' END AS nickname,
    l_linenumber AS round, l_shipdate AS answered_at, (l_partkey % 12 + 1)::INT AS category_n, l_returnflag || l_linestatus AS format,
    CASE l_suppkey % 4 WHEN 0 THEN '6-9' WHEN 1 THEN '10-15' WHEN 2 THEN '15+' ELSE '—' END AS age_band,
    'questao ' || (l_partkey % 100) || '::r' || (l_partkey % 100) AS question_key, 's' || (l_suppkey % 4) AS selected,
    l_discount >= 0.05 AS correct, CASE WHEN l_linenumber = 4 THEN 0 ELSE l_quantity * 100 END AS ms, o_orderdate,
    row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)
"""


@query(
    """
SELECT event_type AS category, count(*) AS answers_total, count(*) FILTER (value > 50) AS correct_total,
  floor(count(*) FILTER (value > 50)::DOUBLE / count(*) * 1000 + 0.5) / 10 AS accuracy_pct
FROM events GROUP BY event_type
"""
)
def event_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.numbers import count_where, percent

    rows = a.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category")).agg(F.count(F.lit(1)).alias("answers_total"), count_where(F.col("value") > 50).alias("correct_total"))
    return rows.withColumn("accuracy_pct", percent(F.col("correct_total"), F.col("answers_total")))


@query(
    ANSWERS
    + f"""
SELECT game_id, any_value(mode) AS mode, count(*) AS rounds_total, count(*) AS answers_total, count(*) FILTER (correct) AS correct_total,
  {PCT.format("count(*) FILTER (correct)", "count(*)")} AS accuracy_pct, floor(sum(ms) / count(*) + 0.5)::BIGINT AS avg_response_ms,
  any_value(86400000 * (date_diff('day', o_orderdate, date_trunc('day', o_orderdate)) + (SELECT 0)) )::BIGINT + count(*) * 86400000
    - any_value(date_diff('millisecond', date_trunc('day', o_orderdate), o_orderdate)) AS duration_ms
FROM x GROUP BY game_id
"""
)
def game_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, _, events = a.game_frames(spark, sf_dir)
    return games.game_stats(normal, events).select("game_id", "mode", "rounds_total", "answers_total", "correct_total", "accuracy_pct", "avg_response_ms", "duration_ms")


@query(
    ANSWERS
    + f"""
, g AS (SELECT game_id, any_value(mode) AS mode, count(*) AS n, count(*) FILTER (correct) AS c FROM x GROUP BY game_id)
SELECT count(*) AS games_total, sum(n)::BIGINT AS rounds_total, count(*) FILTER (mode = 'single') AS single_games,
  count(*) FILTER (mode = 'multiplayer') AS multiplayer_games, sum(n)::BIGINT AS answers_total, sum(c)::BIGINT AS correct_total,
  {PCT.format("sum(c)", "sum(n)")} AS accuracy_pct, floor(sum(n)::DOUBLE / count(*) * 10 + 0.5) / 10 AS avg_rounds_per_game FROM g
"""
)
def nested_games_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `games_summary`, from nested games."""
    normal, _, events = a.game_frames(spark, sf_dir)
    row = games.games_summary(games.game_stats(normal, events))
    return row.select("games_total", "rounds_total", "single_games", "multiplayer_games", "answers_total", "correct_total", "accuracy_pct", "avg_rounds_per_game")


ORACLE_SQL["games_summary"] = ORACLE_SQL["nested_games_summary"]


@query()
def games_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From games that are stored flat, the other kind of input."""
    normal, _, events = a.flat_frames(spark, sf_dir)
    row = games.games_summary(games.game_stats(normal, events))
    return row.select("games_total", "rounds_total", "single_games", "multiplayer_games", "answers_total", "correct_total", "accuracy_pct", "avg_rounds_per_game")


@query(
    ANSWERS
    + """
SELECT question_key, age_band, count(*) AS times_presented FROM x GROUP BY ALL
"""
)
def nested_question_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question keys as normalised from nested games."""
    _, flat, _ = a.game_frames(spark, sf_dir)
    return flat.groupBy("question_key", "age_band").agg(F.count(F.lit(1)).alias("times_presented"))


@query(
    ANSWERS
    + f"""
, c AS (
  SELECT player_id, category_n, count(*) AS n, count(*) FILTER (correct) AS ok, min((game_id, pos)) AS first FROM x WHERE mode <> 'multiplayer' GROUP BY ALL
), r AS (
  SELECT *, {PCT.format("ok", "n")} AS acc FROM c
), best AS (
  SELECT player_id, category_n || '. Tema' AS best_category, row_number() OVER (PARTITION BY player_id ORDER BY acc DESC, n DESC, first) AS k FROM r
), worst AS (
  SELECT player_id, category_n || '. Tema' AS worst_category, row_number() OVER (PARTITION BY player_id ORDER BY acc, n DESC, first) AS k FROM r WHERE n >= 2
), p AS (
  SELECT player_id, count(DISTINCT game_id) AS games_played, count(*) AS answers_total, count(*) FILTER (correct) AS correct_total,
    {PCT.format("count(*) FILTER (correct)", "count(*)")} AS accuracy_pct, floor(sum(ms) / count(*) + 0.5)::BIGINT AS avg_response_ms,
    coalesce(arg_min(nickname, (game_id, pos)) FILTER (nickname <> ''), CASE WHEN length(player_id) >= 4 THEN 'Jogador ' || upper(right(player_id, 4)) ELSE 'Jogador' END) AS display_name
  FROM x WHERE mode <> 'multiplayer' GROUP BY player_id
)
SELECT p.*, best_category, worst_category FROM p LEFT JOIN best ON best.player_id = p.player_id AND best.k = 1
LEFT JOIN worst ON worst.player_id = p.player_id AND worst.k = 1
"""
)
def player_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, events = a.game_frames(spark, sf_dir)
    rows = games.player_stats(games.single_player(events))
    return rows.select("player_id", "games_played", "answers_total", "correct_total", "accuracy_pct", "avg_response_ms", "display_name", F.col("best_category.category").alias("best_category"), F.col("worst_category.category").alias("worst_category"))


@query(
    ANSWERS
    + f"""
, f AS (SELECT category_n, format, count(*) AS n, min((game_id, pos)) AS first FROM x GROUP BY ALL),
t AS (SELECT category_n, string_agg(format || '=' || n, ',' ORDER BY n DESC, first) AS top_formats FROM (
  SELECT *, row_number() OVER (PARTITION BY category_n ORDER BY n DESC, first) AS k FROM f) WHERE k <= 5 GROUP BY category_n)
SELECT category_n, count(*) AS rounds_presented, count(*) AS answers_total, count(*) FILTER (correct) AS correct_total,
  {PCT.format("count(*) FILTER (correct)", "count(*)")} AS accuracy_pct, any_value(top_formats) AS top_formats
FROM x JOIN t USING (category_n) GROUP BY category_n
"""
)
def category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, flat, events = a.game_frames(spark, sf_dir)
    rows = games.category_stats(flat, events)
    top = F.array_join(F.transform("top_formats", lambda t: F.concat(t["format"], F.lit("="), t["count"].cast("string"))), ",")
    return rows.select("category_n", "rounds_presented", "answers_total", "correct_total", "accuracy_pct", top.alias("top_formats"))


@query(
    ANSWERS
    + f"""
SELECT age_band, count(*) AS rounds_presented, count(*) AS answers_total, count(*) FILTER (correct) AS correct_total,
  {PCT.format("count(*) FILTER (correct)", "count(*)")} AS accuracy_pct, floor(sum(ms) / count(*) + 0.5)::BIGINT AS avg_response_ms,
  CASE age_band WHEN '6-9' THEN 0 WHEN '10-15' THEN 1 WHEN '15+' THEN 2 ELSE 3 END AS band_order FROM x GROUP BY age_band
"""
)
def age_band_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, flat, events = a.game_frames(spark, sf_dir)
    return games.age_band_stats(flat, events).select("age_band", "rounds_presented", "answers_total", "correct_total", "accuracy_pct", "avg_response_ms", F.col("band_order").cast("int").alias("band_order"))


QUESTIONS = """
, w AS (SELECT {keys}, selected, count(*) AS n, min((game_id, pos)) AS first FROM x WHERE NOT correct GROUP BY ALL),
t AS (SELECT {keys}, string_agg(selected || '=' || n, ',' ORDER BY n DESC, first) AS top_wrong FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, first) AS k FROM w) WHERE k <= 5 GROUP BY ALL),
q AS (SELECT {keys}, count(*) AS times_presented, count(*) AS answers_total, count(*) FILTER (correct) AS correct_total,
  floor(count(*) FILTER (correct)::DOUBLE / count(*) * 1000 + 0.5) / 10 AS accuracy_pct FROM x GROUP BY ALL)
SELECT q.*, CASE WHEN accuracy_pct >= 80 THEN 'easy' WHEN accuracy_pct >= 55 THEN 'medium' ELSE 'hard' END AS difficulty_label, coalesce(top_wrong, '') AS top_wrong
FROM q LEFT JOIN t USING ({keys})
"""


def _questions(rows: DataFrame, keys: list[str]) -> DataFrame:
    wrong = F.coalesce(F.array_join(F.transform("top_wrong_answers", lambda t: F.concat(t["answer"], F.lit("="), t["count"].cast("string"))), ","), F.lit(""))
    return rows.select(*keys, "times_presented", "answers_total", "correct_total", "accuracy_pct", "difficulty_label", wrong.alias("top_wrong"))


@query(ANSWERS + QUESTIONS.format(keys="question_key"))
def question_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, flat, events = a.game_frames(spark, sf_dir)
    return _questions(games.question_stats(flat, events), ["question_key"])


@query(ANSWERS + QUESTIONS.format(keys="question_key, age_band"))
def question_stats_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, flat, events = a.game_frames(spark, sf_dir)
    return _questions(games.question_stats(flat, events, by_age_band=True), ["question_key", "age_band"])


@query(
    ANSWERS
    + """
, q AS (SELECT question_key, age_band, count(*) AS n, min((game_id, pos)) AS first, floor(count(*) FILTER (correct)::DOUBLE / count(*) * 1000 + 0.5) / 10 AS acc FROM x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY age_band ORDER BY acc DESC, n DESC, first) AS b, row_number() OVER (PARTITION BY age_band ORDER BY acc, n DESC, first) AS w FROM q WHERE n >= 3)
SELECT age_band, 'best' AS extreme, question_key, acc AS accuracy_pct FROM r WHERE b = 1
UNION ALL SELECT age_band, 'worst', question_key, acc FROM r WHERE w = 1
"""
)
def question_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, flat, events = a.game_frames(spark, sf_dir)
    rows = games.question_stats(flat, events, by_age_band=True)
    return games.extremes(rows, [F.col("answers_total").desc(), F.col("ordinal")], ["age_band"]).select("age_band", "extreme", "question_key", "accuracy_pct")


@query(
    ANSWERS
    + """
, i AS (SELECT *, sum((NOT correct)::INT) OVER (PARTITION BY player_id ORDER BY answered_at, game_id, round, pos ROWS UNBOUNDED PRECEDING) AS island FROM x),
r AS (SELECT player_id, island, count(*) FILTER (correct) AS run FROM i GROUP BY ALL)
SELECT player_id, max(run) AS best_streak, arg_max(run, island) AS current_streak FROM r GROUP BY player_id
"""
)
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, events = a.game_frames(spark, sf_dir)
    return games.streaks(events).select("player_id", "best_streak", "current_streak")


@query(
    ANSWERS
    + """
, r AS (SELECT game_id, round, count(*) AS n, count(*) FILTER (correct) AS c, min(pos) AS first FROM x WHERE mode = 'multiplayer' GROUP BY ALL)
SELECT game_id, 'match_accuracy' AS type, floor(sum(c)::DOUBLE / sum(n) * 1000 + 0.5) / 10 AS value, sum(n)::BIGINT AS answers FROM r GROUP BY game_id
UNION ALL SELECT game_id, 'match_devices', 1.0, sum(n)::BIGINT FROM r GROUP BY game_id
"""
)
def room_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, _, events = a.game_frames(spark, sf_dir)
    return games.match_insights(normal, events).filter("type IN ('match_accuracy', 'match_devices')").select("game_id", "type", "value", "answers")


FIRST_NAME = "coalesce(arg_min(nickname, (game_id, pos)) FILTER (nickname <> ''), CASE WHEN length(player_id) >= 4 THEN 'Jogador ' || upper(right(player_id, 4)) ELSE 'Jogador' END)"
NAME = "coalesce(nullif(any_value(nickname), ''), CASE WHEN length(player_id) >= 4 THEN 'Jogador ' || upper(right(player_id, 4)) ELSE 'Jogador' END)"


@query(
    ANSWERS
    + f"""
, room AS (SELECT game_id, count(*) AS n, count(*) FILTER (correct) AS c, floor(sum(ms) / count(*) + 0.5) AS pace, count(DISTINCT player_id) AS players FROM x WHERE mode = 'multiplayer' GROUP BY game_id),
p AS (SELECT game_id, player_id, {NAME} AS name, count(*) AS n, {PCT.format("count(*) FILTER (correct)", "count(*)")} AS acc, floor(sum(ms) / count(*) + 0.5) AS pace, min(pos) AS first FROM x WHERE mode <> 'multiplayer' GROUP BY game_id, player_id),
c AS (SELECT game_id, player_id, category_n, count(*) AS n, {PCT.format("count(*) FILTER (correct)", "count(*)")} AS acc, min(pos) AS first FROM x WHERE mode <> 'multiplayer' GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, player_id ORDER BY acc DESC, n DESC, first) AS k FROM c) WHERE k = 1 AND n >= 2),
i AS (SELECT *, sum((NOT correct)::INT) OVER (PARTITION BY game_id, player_id ORDER BY answered_at, round, pos ROWS UNBOUNDED PRECEDING) AS island FROM x WHERE mode <> 'multiplayer'),
s AS (SELECT game_id, player_id, any_value(nickname) AS nickname, island, count(*) FILTER (correct) AS run, min(pos) AS first FROM i GROUP BY game_id, player_id, island),
t AS (SELECT game_id, player_id, {NAME} AS name, max(run) AS run, min(first) AS first FROM s GROUP BY game_id, player_id),
r AS (SELECT game_id, round, count(*) AS n, count(*) FILTER (correct) AS c, {PCT.format("count(*) FILTER (correct)", "count(*)")} AS acc, min(pos) AS first, arg_min('Quêstão <b>' || split_part(split_part(question_key, ' ', 2), ':', 1) || '</b>', pos) AS question FROM x GROUP BY ALL)
SELECT game_id, 'match_accuracy' AS type, NULL::VARCHAR AS subject, {PCT.format("c", "n")} AS value, n AS answers FROM room
UNION ALL SELECT game_id, 'match_pace', NULL, pace, n FROM room UNION ALL SELECT game_id, 'match_devices', NULL, players, n FROM room
UNION ALL SELECT game_id, 'accuracy_leader', name, acc, n FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY n DESC, first) AS k FROM p) WHERE k = 1
UNION ALL SELECT game_id, 'fastest', name, pace, n FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY pace, n DESC, first) AS k FROM p) WHERE k = 1
UNION ALL SELECT game_id, 'category_dominance', category_n || '. Tema', acc, n FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY acc DESC, first) AS j FROM best) WHERE j = 1
UNION ALL SELECT game_id, 'streak', name, run, run FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY run DESC, first) AS k FROM t WHERE run >= 2) WHERE k = 1
UNION ALL SELECT game_id, 'hardest_question', question, acc, n FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY acc, first) AS k FROM r) WHERE k = 1 AND n >= 2
UNION ALL SELECT game_id, 'split_question', question, c, n FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY n DESC, first) AS k FROM r WHERE n >= 2 AND abs(c - (n - c)) <= 1) WHERE k = 1
"""
)
def match_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal, _, events = a.game_frames(spark, sf_dir)
    return games.match_insights(normal, events)


@query(
    ANSWERS
    + f"""
, g AS (SELECT game_id, any_value(mode) AS mode, count(*) AS n FROM x GROUP BY game_id),
q AS (SELECT question_key, count(*) AS n, {PCT.format("count(*) FILTER (correct)", "count(*)")} AS acc, min((game_id, pos)) AS first FROM x GROUP BY question_key HAVING count(*) >= 3),
hard AS (SELECT * FROM q ORDER BY acc, n DESC, first LIMIT 1), easy AS (SELECT * FROM q ORDER BY acc DESC, n, first DESC LIMIT 1),
c AS (SELECT category_n || '. Tema' AS category, count(*) AS n, {PCT.format("count(*) FILTER (correct)", "count(*)")} AS acc, min((game_id, pos)) AS first FROM x GROUP BY category_n),
top AS (SELECT * FROM c ORDER BY n DESC, first LIMIT 1), weak AS (SELECT * FROM c WHERE n >= 3 ORDER BY acc, n DESC, first LIMIT 1),
b AS (SELECT age_band, CASE age_band WHEN '6-9' THEN 0 WHEN '10-15' THEN 1 WHEN '15+' THEN 2 ELSE 3 END AS place, count(*) AS n, {PCT.format("count(*) FILTER (correct)", "count(*)")} AS acc FROM x GROUP BY age_band HAVING count(*) >= 3),
high AS (SELECT * FROM b ORDER BY acc DESC, place LIMIT 1), low AS (SELECT * FROM b ORDER BY acc, place LIMIT 1),
p AS (SELECT player_id, {FIRST_NAME} AS name, count(*) AS n, {PCT.format("count(*) FILTER (correct)", "count(*)")} AS acc, min((game_id, pos)) AS first FROM x WHERE mode <> 'multiplayer' GROUP BY player_id HAVING count(*) >= 3),
i AS (SELECT *, sum((NOT correct)::INT) OVER (PARTITION BY player_id ORDER BY answered_at, game_id, round, pos ROWS UNBOUNDED PRECEDING) AS island FROM x WHERE mode <> 'multiplayer'),
s AS (SELECT player_id, arg_min(nickname, (game_id, pos)) FILTER (nickname <> '') AS nickname, island, count(*) FILTER (correct) AS run, min((game_id, pos)) AS first FROM i GROUP BY player_id, island),
t AS (SELECT player_id, coalesce(arg_min(nickname, first) FILTER (nickname IS NOT NULL), 'Jogador') AS name, max(run) AS run FROM s GROUP BY player_id HAVING max(run) >= 2)
SELECT 'corpus_overview' AS type, (SELECT count(*) FROM g)::VARCHAR AS subject, {PCT.format("count(*) FILTER (correct)", "count(*)")} AS value, count(*) AS answers FROM x
UNION ALL SELECT 'games_split', (SELECT count(*) FROM g WHERE mode = 'multiplayer')::VARCHAR, (SELECT count(*) FROM g WHERE mode = 'single')::DOUBLE, count(*) FROM x
UNION ALL SELECT 'global_pace', NULL, floor(sum(ms) / count(*) + 0.5), count(*) FROM x
UNION ALL SELECT 'global_hardest_question', question_key, acc, n FROM hard UNION ALL SELECT 'global_easiest_question', question_key, acc, n FROM easy WHERE question_key NOT IN (SELECT question_key FROM hard)
UNION ALL SELECT 'top_category', category, acc, n FROM top UNION ALL SELECT 'weakest_category', category, acc, n FROM weak WHERE n >= 5 AND category NOT IN (SELECT category FROM top)
UNION ALL SELECT 'best_age_band', age_band, acc, n FROM high UNION ALL SELECT 'weakest_age_band', age_band, acc, n FROM low WHERE n >= 5 AND age_band NOT IN (SELECT age_band FROM high)
UNION ALL (SELECT 'global_top_player', name, acc, n FROM p ORDER BY n DESC, first LIMIT 1)
UNION ALL (SELECT 'global_best_streak', name, run, run FROM t ORDER BY run DESC, player_id LIMIT 1)
"""
)
def global_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return games.global_insights(*a.game_frames(spark, sf_dir))


# --- series and telemetry --------------------------------------------------------------------------------------

LOCAL = "timezone('Europe/Lisbon', timezone('UTC', ts))"
GEN = """
WITH e AS (
  SELECT event_id AS id, ts, event_id AS k, CASE WHEN event_type IN ('purchase', 'view') THEN 'accepted' WHEN event_type = 'click' THEN 'rejected'
      WHEN event_type = 'error' THEN 'api_error' WHEN event_type = 'signup' THEN 'parse_error' ELSE 'unknown' END AS outcome,
    (user_id % 20 + 1)::INT AS category, 'F' || (event_id % 4) AS format_id, ['ai', 'bank', 'repo-ai', 'repo-direct', 'bank-replenish'][event_id % 5 + 1] AS source,
    'p' || (user_id % 6) AS provider, 'm' || (user_id % 9) AS model, CASE WHEN event_id % 11 > 0 THEN (event_id % 13 + 1)::INT END AS attempt,
    CASE WHEN event_id % 3 > 0 THEN 'multi' ELSE 'local' END AS game_mode, (event_id % 500)::VARCHAR AS question_hash,
    CASE WHEN event_id % 8 = 0 THEN TRUE WHEN event_id % 12 = 0 THEN FALSE END AS edited
  FROM events
), g AS (
  SELECT *, CASE WHEN outcome IN ('rejected', 'api_error') THEN ['C' || (k % 7), 'D' || (k % 5)] ELSE [] END AS codes,
    CASE WHEN outcome = 'rejected' AND k % 4 = 0 THEN ts + INTERVAL 1 HOUR END AS validated_at,
    CASE WHEN outcome = 'rejected' AND k % 6 = 1 THEN ts + INTERVAL 2 HOUR END AS dismissed_at
  FROM e
)
"""
OUTCOMES = """count(*) AS total, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'rejected') AS rejected,
  count(*) FILTER (outcome = 'parse_error') AS parse_errors, count(*) FILTER (outcome = 'api_error') AS api_errors"""


@query(
    f"""
WITH c AS (SELECT strftime({LOCAL}, '%Y-%m-%d') AS key, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(d::DATE, '%Y-%m-%d') AS key, coalesce(n, 0) AS count FROM generate_series(DATE '2024-01-30' - 44, DATE '2024-01-30', INTERVAL 1 DAY) AS t(d)
LEFT JOIN c ON c.key = strftime(d::DATE, '%Y-%m-%d')
"""
)
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series(a.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", AS_OF, 45)


@query(
    f"""
WITH c AS (SELECT strftime({LOCAL}, '%Y-%m-%dT%H') AS key, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(h, '%Y-%m-%dT%H') AS key, coalesce(n, 0) AS count
FROM generate_series(TIMESTAMP '2024-01-27 13:00:00', TIMESTAMP '2024-01-30 12:00:00', INTERVAL 1 HOUR) AS t(h) LEFT JOIN c ON c.key = strftime(h, '%Y-%m-%dT%H')
"""
)
def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series(a.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", AS_OF, 72, "hour")


@query(
    f"""
WITH c AS (SELECT strftime(time_bucket(INTERVAL 5 MINUTE, {LOCAL}), '%Y-%m-%dT%H:%M') AS key, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(h, '%Y-%m-%dT%H:%M') AS key, coalesce(n, 0) AS count
FROM generate_series(TIMESTAMP '2024-01-29 12:35:00', TIMESTAMP '2024-01-30 12:30:00', INTERVAL 5 MINUTE) AS t(h) LEFT JOIN c ON c.key = strftime(h, '%Y-%m-%dT%H:%M')
"""
)
def minute_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series(a.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", AS_OF, 288, "5")


@query(
    GEN
    + f"""
, h AS (SELECT strftime({LOCAL}, '%Y-%m-%dT%H') AS hour, outcome, count(*) AS n FROM g GROUP BY ALL), o AS (SELECT DISTINCT outcome FROM h),
grid AS (
  SELECT '24h' AS "range", strftime(t, '%Y-%m-%dT%H') AS key FROM generate_series(TIMESTAMP '2024-01-29 13:00:00', TIMESTAMP '2024-01-30 12:00:00', INTERVAL 1 HOUR) AS s(t)
  UNION ALL SELECT '3d', strftime(t, '%Y-%m-%dT%H') FROM generate_series(TIMESTAMP '2024-01-27 13:00:00', TIMESTAMP '2024-01-30 12:00:00', INTERVAL 1 HOUR) AS s(t)
  UNION ALL SELECT '7d', strftime(t, '%Y-%m-%d') FROM generate_series(TIMESTAMP '2024-01-24', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) AS s(t)
  UNION ALL SELECT '14d', strftime(t, '%Y-%m-%d') FROM generate_series(TIMESTAMP '2024-01-17', TIMESTAMP '2024-01-30', INTERVAL 1 DAY) AS s(t)
)
SELECT "range", key, o.outcome, coalesce(sum(n), 0)::BIGINT AS count FROM grid CROSS JOIN o
LEFT JOIN h ON h.outcome = o.outcome AND h.hour[:length(key)] = key GROUP BY ALL
"""
)
def outcome_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.timelines(a.generation_events(spark, sf_dir), "ts", "outcome", AS_OF)


@query(
    GEN
    + f"""
, c AS (SELECT strftime({LOCAL}, '%Y-%m-%d') AS key, outcome, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT key, string_agg(outcome || '=' || n, ',' ORDER BY outcome) AS by_value, sum(n)::BIGINT AS count FROM c GROUP BY key)
SELECT strftime(d::DATE, '%Y-%m-%d') AS key, coalesce(by_value, '') AS by_value, coalesce(count, 0) AS count
FROM generate_series(DATE '2023-12-17', DATE '2024-01-30', INTERVAL 1 DAY) AS t(d) LEFT JOIN s ON s.key = strftime(d::DATE, '%Y-%m-%d')
"""
)
def stacked_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.stacked(a.generation_events(spark, sf_dir), "ts", "outcome", AS_OF, 45)
    said = F.array_join(F.transform(F.array_sort(F.map_entries("by_value")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return rows.select("key", said.alias("by_value"), "count")


@query(
    f"""
WITH c AS (SELECT strftime({LOCAL}, '%Y-%m-%d') AS key, count(*) AS n FROM events GROUP BY 1), f AS (SELECT greatest(min(key)::DATE, DATE '2024-01-30' - 119) AS d FROM c)
SELECT strftime(d::DATE, '%Y-%m-%d') AS key, coalesce(n, 0) AS count FROM generate_series((SELECT d FROM f), DATE '2024-01-30', INTERVAL 1 DAY) AS t(d)
LEFT JOIN c ON c.key = strftime(d::DATE, '%Y-%m-%d')
"""
)
def series_from_first_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.from_first_day(a.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", AS_OF)


@query(
    GEN
    + f"""
, s AS (SELECT {OUTCOMES}, count(validated_at) AS validated, count(*) FILTER (validated_at IS NOT NULL AND edited) AS validated_edited,
  count(*) FILTER (validated_at IS NOT NULL AND NOT edited) AS validated_as_is, count(dismissed_at) AS dismissed,
  count(*) FILTER (outcome = 'accepted' AND source IN ('repo-ai', 'repo-direct')) AS repository_accepted,
  count(*) FILTER (outcome = 'accepted' AND source = 'repo-direct') AS direct, count(*) FILTER (outcome = 'accepted' AND source = 'bank') AS bank,
  count(*) FILTER (outcome = 'accepted' AND source NOT IN ('ai', 'repo-ai')) AS non_ai,
  avg(attempt) FILTER (outcome = 'accepted' AND source = 'ai') AS ai_avg_attempts FROM g)
SELECT * EXCLUDE (direct, bank, non_ai), accepted / total AS acceptance_rate, (rejected + parse_errors + api_errors) / total AS rejection_rate,
  repository_accepted / accepted AS repository_share, direct / repository_accepted AS repo_direct_share, bank / accepted AS bank_share, non_ai / accepted AS non_ai_share FROM s
"""
)
def telemetry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.summary(telemetry.normalize_events(a.generation_events(spark, sf_dir)))


@query(
    GEN
    + f"""
, d AS (
  SELECT 'category' AS dimension, category::VARCHAR AS value, outcome FROM g UNION ALL SELECT 'format', format_id, outcome FROM g
  UNION ALL SELECT 'game_mode', game_mode, outcome FROM g UNION ALL SELECT 'source', source, outcome FROM g UNION ALL SELECT 'model', model, outcome FROM g
  UNION ALL SELECT 'provider', provider, outcome FROM g WHERE source IN ('ai', 'bank-replenish', 'repo-ai')
  UNION ALL SELECT 'attempt', least(greatest(attempt, 1), 10)::VARCHAR, outcome FROM g WHERE outcome = 'accepted' AND attempt IS NOT NULL
  UNION ALL SELECT 'issue_code', unnest(codes), outcome FROM g
) SELECT dimension, value, {OUTCOMES} FROM d GROUP BY dimension, value
"""
)
def telemetry_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.by_dimension(telemetry.normalize_events(a.generation_events(spark, sf_dir)))


@query(
    GEN
    + f"""
, p AS (SELECT provider, {OUTCOMES}, sum(attempt) FILTER (outcome IN ('accepted', 'rejected', 'parse_error'))::BIGINT AS attempt_sum,
  count(attempt) FILTER (outcome IN ('accepted', 'rejected', 'parse_error')) AS attempt_count FROM g WHERE source IN ('ai', 'bank-replenish', 'repo-ai') GROUP BY provider),
r AS (SELECT *, accepted / total AS acceptance_rate, (rejected + parse_errors + api_errors) / total AS rejection_rate, attempt_sum / attempt_count AS avg_attempts FROM p)
SELECT *, row_number() OVER (ORDER BY acceptance_rate DESC, coalesce(avg_attempts, 99), total DESC, provider)::INT AS rank,
  row_number() OVER (ORDER BY total < 3, acceptance_rate DESC, coalesce(avg_attempts, 99), total DESC, provider) = 1 AND total >= 3 AS best FROM r
"""
)
def provider_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.provider_ranking(telemetry.normalize_events(a.generation_events(spark, sf_dir)))


@query(
    GEN
    + """
, c AS (SELECT category, count(*) AS accepted, count(*) FILTER (source NOT IN ('ai', 'repo-ai')) AS non_ai, count(*) FILTER (source IN ('repo-ai', 'repo-direct')) AS repository,
  count(*) FILTER (source = 'ai') AS free_form, count(*) FILTER (source = 'bank') AS bank FROM g WHERE outcome = 'accepted' GROUP BY category)
SELECT *, non_ai / accepted AS non_ai_share, repository / accepted AS repository_share, free_form / accepted AS free_form_share, bank / accepted AS bank_share,
  non_ai / accepted >= 0.95 AS meets_target FROM c
"""
)
def category_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.category_delivery(a.generation_events(spark, sf_dir))


@query(
    GEN
    + """
, pending AS (SELECT DISTINCT (event_id % 500)::VARCHAR AS question_hash FROM events WHERE event_id % 50 = 3),
u AS (SELECT g.*, unnest(codes) AS code, generate_subscripts(codes, 1) AS pos,
  outcome IN ('rejected', 'parse_error', 'api_error') AND dismissed_at IS NULL AND validated_at IS NULL AND question_hash NOT IN (SELECT question_hash FROM pending) AS open FROM g),
l AS (SELECT code, string_agg(id::VARCHAR, ',' ORDER BY ts DESC, id DESC) AS recent_open FROM (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts DESC, id DESC) AS n FROM u WHERE open) WHERE n <= 10 GROUP BY code)
SELECT code, count(*) AS count, count(validated_at) AS validated, count(*) FILTER (validated_at IS NOT NULL AND edited) AS validated_edited,
  count(*) FILTER (validated_at IS NOT NULL AND NOT edited) AS validated_as_is, count(dismissed_at) AS dismissed, count(*) FILTER (open) AS open,
  arg_min('msg ' || (k % 7), (ts, id)) AS sample_message, arg_max(id, (ts, id)) AS last_id, any_value(recent_open) AS recent_open
FROM u LEFT JOIN l USING (code) GROUP BY code
"""
)
def issue_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = a.table(spark, sf_dir, "events").filter("event_id % 50 = 3").select(F.pmod("event_id", F.lit(500)).cast("string").alias("question_hash"))
    rows = telemetry.issue_details(telemetry.normalize_events(a.generation_events(spark, sf_dir)), pending)
    return rows.select("code", "count", "validated", "validated_edited", "validated_as_is", "dismissed", "open", "sample_message", F.col("last.id").alias("last_id"), F.array_join(F.col("recent_open").cast("array<string>"), ",").alias("recent_open"))


@query(
    GEN
    + """
, r AS (SELECT id, outcome, row_number() OVER (PARTITION BY outcome = 'accepted' ORDER BY ts DESC, id) AS n FROM g WHERE outcome <> 'unknown')
SELECT outcome, count(*) AS kept, min(id) AS least_id FROM r WHERE n <= CASE WHEN outcome = 'accepted' THEN 3000 ELSE 1000 END GROUP BY outcome
"""
)
def capped_stats_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.stats_input(a.generation_events(spark, sf_dir), 3000, 1000)
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("kept"), F.min("id").alias("least_id"))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_id) <= 700")
def retained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.trim(a.table(spark, sf_dir, "events"), 700, "ts", "event_id").select("event_id")


ACTIONS = """
, act AS (
  SELECT validated_at AS moment, CASE WHEN edited THEN 'edited' WHEN NOT edited THEN 'as_is' ELSE 'accepted' END AS kind, category, codes FROM g WHERE validated_at IS NOT NULL
  UNION ALL SELECT dismissed_at, 'dismissed', category, codes FROM g WHERE dismissed_at IS NOT NULL)
"""


@query(GEN + ACTIONS + "SELECT kind, category, count(*) AS actions, min(moment) AS first_at FROM act GROUP BY ALL")
def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.review_actions(a.generation_events(spark, sf_dir))
    return rows.groupBy("kind", "category").agg(F.count(F.lit(1)).alias("actions"), F.min("at").cast("timestamp_ntz").alias("first_at"))


@query(GEN + ACTIONS + """
SELECT 'category' AS dimension, category::VARCHAR AS value, count(*) AS count FROM act GROUP BY ALL
UNION ALL SELECT 'issue_code', code, count(*) FROM (SELECT unnest(codes) AS code FROM act) GROUP BY ALL
""")
def review_filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.review_filter_options(telemetry.review_actions(a.generation_events(spark, sf_dir)))


@query(GEN + ACTIONS + "SELECT DISTINCT category, unnest(codes) AS code FROM act")
def review_filter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.review_filter_keys(telemetry.review_actions(a.generation_events(spark, sf_dir)))


@query(GEN + ACTIONS + """
, h AS (SELECT kind, strftime(timezone('Europe/Lisbon', timezone('UTC', moment)), '%Y-%m-%d') AS key, count(*) AS n FROM act WHERE category = 7 GROUP BY ALL)
SELECT strftime(d::DATE, '%Y-%m-%d') AS key, coalesce(sum(n) FILTER (kind IN ('edited', 'as_is')), 0)::BIGINT AS count
FROM generate_series(DATE '2024-01-17', DATE '2024-01-30', INTERVAL 1 DAY) AS t(d) LEFT JOIN h ON h.key = strftime(d::DATE, '%Y-%m-%d') GROUP BY ALL
""")
def review_timeline_of_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.review_filter(telemetry.review_actions(a.generation_events(spark, sf_dir)), category=7)
    return series.merged(*[series.series(rows.filter(F.col("kind") == k), "at", AS_OF, 14) for k in ("edited", "as_is")])


# --- usage -----------------------------------------------------------------------------------------------------

ROLLUP = f"""
WITH u AS (
  SELECT time_bucket(INTERVAL 5 MINUTE, {LOCAL}) AS bucket_start, 'p' || (user_id % 3) AS provider, 'm' || (user_id % 4) AS model,
    event_type = 'error' AS failed, (props::JSON ->> 'k')::BIGINT AS tokens, floor(value)::BIGINT AS ms, event_id, event_type FROM events
), roll AS (
  SELECT bucket_start, provider, model, count(*) AS request_count, count(*) FILTER (failed) AS error_count, sum(tokens)::BIGINT AS token_count,
    coalesce(sum(ms) FILTER (ms > 0), 0)::BIGINT AS latency_sum_ms, count(*) FILTER (ms > 0) AS latency_count, count(*) FILTER (failed AND event_id % 2 = 0) AS limit_count,
    max(event_id % 1000) AS quota_used_peak, count(*) FILTER (failed AND event_id % 2 = 0) AS app_limit_count,
    count(*) FILTER (failed AND event_id % 2 <> 0 AND event_id % 5 = 0) AS provider_limit_count, count(*) FILTER (event_type = 'signup') AS replenish_count
  FROM u GROUP BY ALL
), b AS (
  SELECT bucket_start, sum(request_count)::BIGINT AS requests, sum(error_count)::BIGINT AS errors, sum(token_count)::BIGINT AS tokens, sum(latency_sum_ms)::BIGINT AS ls,
    sum(latency_count)::BIGINT AS lc, sum(limit_count)::BIGINT AS limits, max(quota_used_peak) AS quota_pressure, sum(app_limit_count)::BIGINT AS app_limits,
    sum(provider_limit_count)::BIGINT AS provider_limits, sum(replenish_count)::BIGINT AS replenish_requests FROM roll GROUP BY ALL
)
"""
FILLED = """
, f AS (SELECT bucket_start, coalesce(requests, 0) AS requests, coalesce(errors, 0) AS errors, coalesce(tokens, 0) AS tokens, coalesce(ls, 0) AS ls, coalesce(lc, 0) AS lc,
  coalesce(limits, 0) AS limits, coalesce(quota_pressure, 0) AS quota_pressure, coalesce(app_limits, 0) AS app_limits, coalesce(provider_limits, 0) AS provider_limits,
  coalesce(replenish_requests, 0) AS replenish_requests
  FROM (SELECT h AS bucket_start FROM generate_series(TIMESTAMP '2024-01-28 12:35:00', TIMESTAMP '2024-01-30 12:30:00', INTERVAL 5 MINUTE) AS t(h)) FULL JOIN b USING (bucket_start)),
s AS (SELECT strftime(bucket_start, '%Y-%m-%dT%H:%M') AS key, requests,
  sum(requests) OVER w::BIGINT AS cumulative, sum(tokens) OVER w::BIGINT AS cumulative_tokens, errors, tokens, limits, quota_pressure, app_limits, provider_limits,
  greatest(0, errors - app_limits - provider_limits) AS other_errors, replenish_requests, CASE WHEN lc > 0 THEN floor(ls::DOUBLE / lc + 0.5)::BIGINT ELSE 0 END AS latency
  FROM f WINDOW w AS (PARTITION BY strftime(bucket_start, '%Y-%m-%d') ORDER BY bucket_start ROWS UNBOUNDED PRECEDING))
"""


@query(ROLLUP + "SELECT * FROM roll")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.rollup(a.usage_calls(spark, sf_dir), 5)


@query(ROLLUP + FILLED.replace("sum(requests) OVER w::BIGINT", "(sum(requests) OVER w)::BIGINT").replace("sum(tokens) OVER w::BIGINT", "(sum(tokens) OVER w)::BIGINT") + "SELECT * FROM s")
def usage_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.bucket_series(usage.rollup(a.usage_calls(spark, sf_dir), 5), AS_OF_LOCAL, 48)


@query(
    ROLLUP
    + FILLED.replace("sum(requests) OVER w::BIGINT", "(sum(requests) OVER w)::BIGINT").replace("sum(tokens) OVER w::BIGINT", "(sum(tokens) OVER w)::BIGINT")
    + """SELECT sum(requests)::BIGINT AS total_requests, sum(errors)::BIGINT AS total_errors, sum(tokens)::BIGINT AS total_tokens, sum(limits)::BIGINT AS total_limits,
  sum(app_limits)::BIGINT AS total_app_limits, sum(provider_limits)::BIGINT AS total_provider_limits, sum(other_errors)::BIGINT AS total_other_errors,
  sum(replenish_requests)::BIGINT AS total_replenish_requests, max(quota_pressure) AS peak_quota_pressure,
  floor((sum(latency) FILTER (latency > 0))::DOUBLE / count(*) FILTER (latency > 0) + 0.5)::BIGINT AS avg_latency_ms FROM s"""
)
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.series_totals(usage.bucket_series(usage.rollup(a.usage_calls(spark, sf_dir), 5), AS_OF_LOCAL, 48))


@query(
    ROLLUP
    + """
SELECT coalesce(sum(requests) FILTER (bucket_start >= TIMESTAMP '2024-01-30 11:34:56'), 0)::BIGINT AS last_1h, coalesce(sum(requests) FILTER (bucket_start >= TIMESTAMP '2024-01-29 12:34:56'), 0)::BIGINT AS last_24h,
  coalesce(sum(requests) FILTER (bucket_start >= TIMESTAMP '2024-01-28 12:34:56'), 0)::BIGINT AS last_48h, coalesce(sum(errors) FILTER (bucket_start >= TIMESTAMP '2024-01-28 12:34:56'), 0)::BIGINT AS errors,
  coalesce(sum(requests) FILTER (bucket_start::DATE = DATE '2024-01-30'), 0)::BIGINT AS quota_used_today,
  floor((sum(requests) FILTER (bucket_start >= TIMESTAMP '2024-01-28 12:34:56') - sum(errors) FILTER (bucket_start >= TIMESTAMP '2024-01-28 12:34:56'))::DOUBLE
    / (sum(requests) FILTER (bucket_start >= TIMESTAMP '2024-01-28 12:34:56')) * 1000 + 0.5) / 10 AS success_rate FROM b
"""
)
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.summary(usage.by_bucket(usage.rollup(a.usage_calls(spark, sf_dir), 5), 5), AS_OF_LOCAL)


@query(ROLLUP + "SELECT sum(app_limits)::BIGINT AS app_rate_limit, sum(provider_limits)::BIGINT AS provider_rate_limit, greatest(0, sum(errors) - sum(app_limits) - sum(provider_limits))::BIGINT AS other_errors, sum(replenish_requests)::BIGINT AS replenish_requests FROM b")
def usage_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.error_breakdown(usage.by_bucket(usage.rollup(a.usage_calls(spark, sf_dir), 5), 5))


@query(ROLLUP + "SELECT provider, NULL::VARCHAR AS model, sum(request_count)::BIGINT AS count FROM roll GROUP BY provider UNION ALL SELECT provider, model, sum(request_count)::BIGINT FROM roll GROUP BY ALL")
def usage_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.catalog(usage.rollup(a.usage_calls(spark, sf_dir), 5))


# --- the bank --------------------------------------------------------------------------------------------------

BANK = """
WITH bank AS (
  SELECT p_partkey AS k, p_partkey::VARCHAR AS question_hash, (p_size % 20 + 1)::INT AS category_n, ['6-9', '10-15', '15+'][p_partkey % 3 + 1] AS age_band,
    list_distinct(CASE WHEN p_partkey % 5 = 0 THEN [(p_size % 20 + 1)::INT, (p_partkey % 20 + 1)::INT] ELSE [(p_size % 20 + 1)::INT] END) AS cats,
    CASE WHEN p_partkey % 4 = 0 THEN ['6-9', '15+'] ELSE [['6-9', '10-15', '15+'][p_partkey % 3 + 1]] END AS ages,
    p_partkey % 10 <> 7 AS valid, CASE WHEN p_partkey % 6 > 0 THEN 'k' || (p_partkey % 300) END AS knowledge_id,
    CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 5 + 1)::INT END AS difficulty, (p_size % 5 + 1)::INT AS estimated, p_partkey % 9 = 0 AS mapped, p_partkey % 17 = 0 AS is_reported
  FROM part
), tax AS (
  SELECT *, coalesce(CASE WHEN mapped AND age = '6-9' THEN 1 WHEN mapped AND age = '15+' THEN 5 END, difficulty, estimated) AS effective
  FROM (SELECT *, unnest(ages) AS age FROM (SELECT *, unnest(cats) AS category FROM bank))
), rest AS (SELECT DISTINCT user_id::VARCHAR AS question_hash FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:34:56' - INTERVAL {days} DAY),
restk AS (SELECT DISTINCT 'k' || (event_id % 40) AS knowledge_id FROM events WHERE event_id % 4 = 0 AND ts >= TIMESTAMP '2024-01-30 12:34:56' - INTERVAL {days} DAY),
playable AS (SELECT * FROM bank WHERE NOT is_reported AND valid AND k % 23 <> 0 AND question_hash NOT IN (SELECT question_hash FROM rest)
  AND (knowledge_id IS NULL OR knowledge_id NOT IN (SELECT knowledge_id FROM restk)))
"""


@query(BANK.format(days=30) + """
SELECT count(*) AS total, count(*) FILTER (NOT is_reported) AS active, count(*) FILTER (NOT is_reported AND valid) AS valid, count(*) FILTER (NOT is_reported AND NOT valid) AS invalid,
  count(*) FILTER (is_reported) AS reported, (SELECT count(*) FROM part WHERE p_partkey % 23 = 0) AS blocked FROM bank
""")
def bank_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_ops.stats(a.bank(spark, sf_dir), a.blocked(spark, sf_dir))


@query(BANK.format(days=30) + "SELECT category, age, effective AS difficulty, count(*) AS total, count(*) FILTER (valid) AS valid FROM tax WHERE NOT is_reported GROUP BY ALL")
def bank_stats_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_ops.stats_by(a.bank(spark, sf_dir))


@query(BANK.format(days=30) + """
SELECT c::INT AS category, age, count(question_hash) AS count FROM generate_series(1, 20) AS g(c) CROSS JOIN (VALUES ('6-9'), ('10-15'), ('15+')) AS v(age)
LEFT JOIN tax ON tax.category = c AND tax.age = v.age GROUP BY ALL
""".replace("v(age)", "v(age_)").replace("SELECT c::INT AS category, age,", "SELECT c::INT AS category, age_ AS age,").replace("tax.age = v.age", "tax.age = v.age_"))
def bank_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_ops.coverage(a.bank(spark, sf_dir))


@query(BANK.format(days=3) + "SELECT question_hash, category_n, age_band FROM playable")
def bank_playable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_ops.playable(a.bank(spark, sf_dir), a.blocked(spark, sf_dir), a.plays(spark, sf_dir), AS_OF, days=3).select("question_hash", "category_n", "age_band")


@query(BANK.format(days=3) + """
, t AS (SELECT question_hash, CASE WHEN mapped THEN 1 ELSE coalesce(difficulty, estimated) END AS d FROM playable WHERE list_contains(cats, 5) AND list_contains(ages, '6-9'))
SELECT question_hash, CASE WHEN d = 3 THEN 0 WHEN abs(d - 3) <= 2 THEN 1 ELSE 2 END AS tier, CASE WHEN abs(d - 3) <= 2 THEN abs(d - 3) ELSE 0 END AS distance FROM t
""")
def bank_pick_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bank_ops.playable(a.bank(spark, sf_dir), a.blocked(spark, sf_dir), a.plays(spark, sf_dir), AS_OF, days=3)
    fitting = rows.filter(bank_ops.category_matches(5) & bank_ops.age_matches("6-9"))
    return bank_ops.pick_tier(fitting, "6-9", 3).select("question_hash", "tier", "distance")


@query(BANK.format(days=30) + """
, r AS (SELECT * FROM bank WHERE question_hash IN (SELECT question_hash FROM rest))
SELECT CASE WHEN grouping(category_n, age_band) = 3 THEN 'all' WHEN grouping(category_n, age_band) = 1 THEN 'category' WHEN grouping(category_n, age_band) = 2 THEN 'age' ELSE 'category_age' END AS grain,
  category_n, age_band, count(DISTINCT question_hash) AS items FROM r GROUP BY GROUPING SETS ((), (category_n), (age_band), (category_n, age_band))
""")
def bank_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_ops.quarantine_stats(a.bank(spark, sf_dir), a.plays(spark, sf_dir), AS_OF)


@query(BANK.format(days=30) + """
, batch AS (SELECT *, k % 2 = 0 AS known FROM bank WHERE k % 3 <> 2)
SELECT CASE WHEN NOT valid THEN 'invalid_options' WHEN k % 23 = 0 THEN 'blocked' WHEN known THEN 'exists' ELSE 'inserted' END AS reason, count(*) AS items FROM (
  SELECT CASE WHEN category_n = 20 AND k % 3 = 0 AND knowledge_id IS NULL THEN TRUE ELSE FALSE END AS lacking, * FROM batch) WHERE NOT lacking GROUP BY ALL
UNION ALL SELECT 'missing_knowledge_id', count(*) FROM batch WHERE category_n = 20 AND k % 3 = 0 AND knowledge_id IS NULL HAVING count(*) > 0
""")
def bank_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = a.bank(spark, sf_dir)
    number = F.col("question_hash").cast("long")
    rows = bank_ops.classify_import(whole.filter(number % 3 != 2).withColumn("position", number), whole.filter(number % 2 == 0), a.blocked(spark, sf_dir))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("items"))


@query(BANK.format(days=30) + """
SELECT 'k' || p_partkey AS knowledge_id FROM part WHERE p_partkey % 13 > 0 AND 0.8 + (p_partkey % 20) / 100 >= 0.85
  AND 'k' || p_partkey NOT IN (SELECT knowledge_id FROM bank WHERE knowledge_id IS NOT NULL AND valid AND list_contains(ages, '15+'))
""")
def unmaterialised_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bank_ops.unmaterialised(a.facts(spark, sf_dir), a.bank(spark, sf_dir), "15+").select("knowledge_id")


@query("""
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment
FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey, -c_acctbal AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 2 = 0) n ON o.c_custkey = n.c_custkey
""")
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = a.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return bank_ops.upsert(c.filter("c_custkey % 3 <> 0"), c.filter("c_custkey % 2 = 0").withColumn("c_acctbal", -F.col("c_acctbal")), "c_custkey")


@query("""
SELECT l_partkey::VARCHAR AS question_hash, l_shipdate AS created_at FROM (
  SELECT DISTINCT ON (l_partkey) l_partkey, l_shipdate FROM lineitem ORDER BY l_partkey, l_shipdate DESC)
WHERE l_partkey % 5 <> 0 AND l_partkey % 23 <> 0
""")
def seeded_from_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = a.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("question_hash"), F.col("l_shipdate").alias("created_at"))
    known = a.table(spark, sf_dir, "part").filter("p_partkey % 5 = 0").select(F.col("p_partkey").cast("string").alias("question_hash"))
    return bank_ops.seed_from_history(history.distinct(), known, a.blocked(spark, sf_dir))


# --- knowledge -------------------------------------------------------------------------------------------------

FACTS = """
WITH facts AS (
  SELECT p_partkey AS k, 'k' || p_partkey AS knowledge_id, CASE WHEN p_partkey % 2 = 0 THEN 'curiosidade surpreendente' ELSE 'adivinha tradicional' END AS topic,
    trim(regexp_replace(regexp_replace(strip_accents(lower(p_name || ' ' || p_type || ' ' || p_brand || ' lote' || (p_partkey % 50))), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key,
    ['Wikidata', 'manual', 'sample', 'outro'][p_partkey % 4 + 1] AS source, p_partkey % 9 AS priority, p_partkey % 13 > 0 AS is_active, 'Resposta ' || (p_partkey % 150) AS answer
  FROM part
), words AS (SELECT k, knowledge_id, topic, is_active, list_distinct(list_filter(string_split(key, ' '), lambda w: length(w) > 2)) AS w FROM facts)
"""


@query(FACTS + "SELECT lower(answer) AS key, count(*) AS n, string_agg(knowledge_id, ',' ORDER BY knowledge_id) AS ids FROM facts GROUP BY lower(answer) HAVING count(*) > 1")
def exact_answer_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = knowledge.exact_groups(a.facts(spark, sf_dir), text.normalize_key(F.col("answer")))
    return rows.select("key", "n", F.array_join("ids", ",").alias("ids"))


@query(FACTS + """
SELECT x.knowledge_id AS a, y.knowledge_id AS b, len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) AS similarity
FROM words x JOIN words y ON x.knowledge_id < y.knowledge_id AND x.topic = y.topic
WHERE len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) >= 0.72
""")
def similar_fact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.similar_pairs(a.facts(spark, sf_dir), "fact", block="topic")


@query(FACTS + """
, s AS (SELECT *, CASE source WHEN 'Wikidata' THEN 45 WHEN 'manual' THEN 80 WHEN 'sample' THEN 10 ELSE 30 END * 1000 + 300 + priority AS score FROM facts WHERE is_active AND topic = 'adivinha tradicional')
SELECT knowledge_id, keeper, 'exact_answer' AS reason FROM (SELECT *, first_value(knowledge_id) OVER (PARTITION BY answer ORDER BY score DESC, knowledge_id) AS keeper FROM s) WHERE knowledge_id <> keeper
""")
def riddle_dedupe_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.dedupe_plan(a.facts(spark, sf_dir), riddles=True, curiosities=False).select("knowledge_id", "keeper", "reason")


#: Pairs of similar facts of a topic, and a greedy pass in order of id as a recursion over the places of the ids: a
#: record is a seed if no earlier neighbour is one.
SIMILAR = """
, near AS (SELECT x.knowledge_id AS a, y.knowledge_id AS b FROM words x JOIN words y ON x.knowledge_id < y.knowledge_id AND x.topic = y.topic AND x.topic = 'curiosidade surpreendente'
  WHERE len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) >= 0.72)
"""
GREEDY = """
, n AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS place FROM ids), e AS MATERIALIZED (SELECT b AS id, list(a) AS earlier FROM edges GROUP BY b),
o AS MATERIALIZED (SELECT n.place, n.id, coalesce(earlier, []) AS earlier FROM n LEFT JOIN e ON e.id = n.id),
pass(place, seeds) AS (
  SELECT 0::BIGINT, []::VARCHAR[] UNION ALL
  SELECT o.place, CASE WHEN list_has_any(pass.seeds, o.earlier) THEN pass.seeds ELSE list_append(pass.seeds, o.id) END FROM pass JOIN o ON o.place = pass.place + 1
), seeds AS (SELECT unnest(seeds) AS seed FROM (SELECT seeds FROM pass ORDER BY place DESC LIMIT 1))
"""


@query(FACTS.replace("WITH facts", "WITH RECURSIVE facts") + SIMILAR + """
, s AS (SELECT f.*, CASE source WHEN 'Wikidata' THEN 45 WHEN 'manual' THEN 80 WHEN 'sample' THEN 10 ELSE 30 END * 1000 + 300 + priority AS score FROM facts f WHERE is_active AND topic = 'curiosidade surpreendente'),
exact AS (SELECT knowledge_id, first_value(knowledge_id) OVER (PARTITION BY key ORDER BY score DESC, knowledge_id) AS keeper, count(*) OVER (PARTITION BY key) AS n FROM s),
alone AS (SELECT knowledge_id FROM exact WHERE n = 1), ids AS (SELECT knowledge_id AS id FROM alone),
edges AS (SELECT a, b FROM near WHERE a IN (SELECT knowledge_id FROM alone) AND b IN (SELECT knowledge_id FROM alone))
""" + GREEDY + """
, member AS (SELECT b AS id, min(a) AS seed FROM edges WHERE a IN (SELECT seed FROM seeds) AND b NOT IN (SELECT seed FROM seeds) GROUP BY b UNION ALL SELECT seed, seed FROM seeds),
kept AS (SELECT m.id, first_value(s.knowledge_id) OVER (PARTITION BY m.seed ORDER BY score DESC, s.knowledge_id) AS keeper FROM member m JOIN s ON s.knowledge_id = m.id)
SELECT knowledge_id, keeper, 'exact_fact' AS reason FROM exact WHERE knowledge_id <> keeper
UNION ALL SELECT id, keeper, 'similar_fact' FROM kept WHERE id <> keeper
""")
def curiosity_dedupe_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.dedupe_plan(a.facts(spark, sf_dir)).select("knowledge_id", "keeper", "reason")


@query(FACTS.replace("WITH facts", "WITH RECURSIVE facts") + """
, new AS (SELECT * FROM facts WHERE k % 3 <> 0), old AS (SELECT * FROM facts WHERE k % 3 = 0 AND is_active),
repeated AS MATERIALIZED (SELECT n.knowledge_id FROM new n JOIN old o ON n.key = o.key AND n.topic = o.topic
  UNION SELECT x.knowledge_id FROM words x JOIN words y ON x.topic = y.topic AND x.k % 3 <> 0 AND y.k % 3 = 0 AND y.is_active JOIN facts fx ON fx.k = x.k JOIN facts fy ON fy.k = y.k
    WHERE len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) >= 0.72 AND (x.topic = 'curiosidade surpreendente' OR fx.answer = fy.answer)),
ids AS MATERIALIZED (SELECT knowledge_id AS id FROM new WHERE knowledge_id NOT IN (SELECT knowledge_id FROM repeated)),
edges AS MATERIALIZED (SELECT x.knowledge_id AS a, y.knowledge_id AS b FROM new x JOIN new y ON x.key = y.key AND x.topic = y.topic AND x.knowledge_id < y.knowledge_id WHERE x.knowledge_id IN (SELECT id FROM ids) AND y.knowledge_id IN (SELECT id FROM ids)
  UNION SELECT x.knowledge_id, y.knowledge_id FROM words x JOIN words y ON x.knowledge_id < y.knowledge_id AND x.topic = y.topic AND x.topic = 'curiosidade surpreendente'
    WHERE x.knowledge_id IN (SELECT id FROM ids) AND y.knowledge_id IN (SELECT id FROM ids) AND len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))) >= 0.72)
""" + GREEDY + "SELECT knowledge_id, knowledge_id IN (SELECT seed FROM seeds) AS accepted FROM new")
def accepted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.facts(spark, sf_dir)
    number = F.substring("knowledge_id", 2, 20).cast("long")
    return knowledge.accept_new(rows.filter(number % 3 != 0), rows.filter(number % 3 == 0)).select("knowledge_id", "accepted")


@query(FACTS + """
, w AS (SELECT *, 'S' || (k % 400) AS source_id, CASE WHEN k % 3 = 0 THEN 'Q' || (k % 60) ELSE '' END AS qid, CASE WHEN k % 2 = 0 THEN 'p' || (k % 4) ELSE '' END AS fact_key, list_distinct(list_filter(string_split(key, ' '), lambda t: length(t) > 2)) AS words FROM facts),
r AS (SELECT * FROM w WHERE k % 7 = 0), o AS (SELECT * FROM w WHERE k % 7 <> 0 OR k % 5 = 0)
SELECT o.knowledge_id, CASE WHEN o.knowledge_id IN (SELECT knowledge_id FROM r) THEN 'same_id'
  WHEN EXISTS (SELECT 1 FROM r WHERE r.source = o.source AND r.source_id = o.source_id) THEN 'same_source'
  WHEN o.key IN (SELECT key FROM r) THEN 'same_fact'
  WHEN o.qid <> '' AND o.fact_key <> '' AND EXISTS (SELECT 1 FROM r WHERE r.qid = o.qid AND r.fact_key = o.fact_key) THEN 'same_property'
  WHEN o.qid <> '' AND EXISTS (SELECT 1 FROM r WHERE r.qid = o.qid AND len(list_intersect(r.words, o.words)) / (len(r.words) + len(o.words) - len(list_intersect(r.words, o.words))) >= 0.3) THEN 'similar_fact' END AS rejection FROM o
""")
def rejected_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts against rejected ones, with each of the five reasons; similar is 0.3 here, since the facts have few words in
    common."""
    k = F.substring("knowledge_id", 2, 20).cast("long")
    qid = F.when(k % 3 == 0, F.concat(F.lit("Q"), (k % 60).cast("string"))).otherwise("")
    rows = a.facts(spark, sf_dir).withColumns({"qid": qid, "fact_key": F.when(k % 2 == 0, F.concat(F.lit("p"), (k % 4).cast("string"))).otherwise("")})
    rows = rows.select("knowledge_id", "source", "source_id", "qid", "fact_key", "fact")
    return knowledge.rejection_reasons(rows.filter((k % 7 != 0) | (k % 5 == 0)), rows.filter(k % 7 == 0), threshold=0.3).select("knowledge_id", "rejection")


@query("""
SELECT CASE WHEN p_partkey % 13 = 0 OR p_partkey % 29 = 0 THEN 'blocked_or_superseded' WHEN 0.8 + (p_partkey % 20) / 100 < 0.85 THEN 'confidence_below_minimum'
  WHEN (p_size % 20 + 1) <> 20 AND 0.8 + (p_partkey % 20) / 100 < 0.92 THEN 'source_not_allowed' WHEN p_partkey % 4 = 3 AND 0.8 + (p_partkey % 20) / 100 < 0.92 THEN 'source_not_allowed' END AS reason, count(*) AS n
FROM part GROUP BY ALL
""")
def policy_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = knowledge.policy(F.col("category_n"), F.lit("RESPOSTA_DIRETA"), F.col("source"), F.col("confidence"), F.col("is_active"), F.col("superseded_by"))
    return a.facts(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# --- texts and pages -------------------------------------------------------------------------------------------


@query("""
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '<[^>]*>', ' ', 'g'), '[\\s\\xA0]+', ' ', 'g')) AS normal FROM documents
""")
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("normal"))


@query("""
WITH t AS (SELECT p_partkey, p_name || '|' || p_brand AS s FROM part), h AS (
  SELECT p_partkey, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS v FROM t)
SELECT p_partkey, lower(to_base(v, 36)) AS question_hash FROM h
""")
def question_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.table(spark, sf_dir, "part").select("p_partkey", text.question_hash(F.col("p_name"), F.col("p_brand")).alias("question_hash"))


@query("""
SELECT regexp_extract(url, '^https?://(?:www\\.)?([^/?#]+)', 1) AS host, count(*) AS pages FROM pages GROUP BY 1
""")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = markup.canonical_url(F.col("url"))
    return a.table(spark, sf_dir, "pages").groupBy(F.regexp_extract(url, r"^https?://([^/?#]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("pages"))


@query()
def page_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = markup.pages(a.table(spark, sf_dir, "pages"))
    return rows.select("page_id", "title", F.length("text").alias("text_length"), F.size("links").alias("n_links"), "lead")


@query("""
WITH r AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
i AS (SELECT *, sum((role IS DISTINCT FROM before)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM r),
n AS (SELECT conv_id, island, count(*) AS run FROM i GROUP BY ALL)
SELECT conv_id, sum(run)::BIGINT AS turns, max(run) AS longest_run, max(run) = 1 AS alternates FROM n GROUP BY conv_id
""")
def conversation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    order = W.partitionBy("conv_id").orderBy("turn")
    c = a.table(spark, sf_dir, "conversations").withColumn("new", (~F.col("role").eqNullSafe(F.lag("role").over(order))).cast("int"))
    runs = c.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy("conv_id", "island").agg(F.count(F.lit(1)).alias("run"))
    return runs.groupBy("conv_id").agg(F.sum("run").alias("turns"), F.max("run").alias("longest_run"), (F.max("run") == 1).alias("alternates"))


@query(f"SELECT event_id, strftime({LOCAL}, '%Y-%m-%d') AS day, strftime({LOCAL}, '%Y-%m-%dT%H') AS hour, strftime(time_bucket(INTERVAL 15 MINUTE, {LOCAL}), '%Y-%m-%dT%H:%M') AS bucket FROM events")
def local_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return a.table(spark, sf_dir, "events").select("event_id", localtime.day_key(ts).alias("day"), localtime.hour_key(ts).alias("hour"), localtime.bucket_key(ts, 15).alias("bucket"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of categories: the query that `entry` runs."""
    return event_accuracy(spark, sf_dir)


from tessera.plans import streams as _streams  # noqa: E402, F401  registers its queries, over SQL from above
from tessera.plans import texts as _texts  # noqa: E402, F401
