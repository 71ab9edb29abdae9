"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import games


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows by a key over as many tasks as shuffles have. A small file is read by one task or few, which is too few where
    the work on each row is long."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def order_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as games whose line items are rounds with one answer each: by the customer, right if the discount is five
    per cent or more, as fast as the quantity says."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    player = F.concat(F.lit("c"), F.pmod("o_custkey", F.lit(200)).cast("string"))
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    answer = F.struct(
        player.alias("playerId"),
        F.when(F.pmod("o_custkey", F.lit(3)) > 0, F.concat(F.lit("Nick "), player)).otherwise("").alias("nickname"),
        F.concat(F.lit("s"), F.pmod("l_suppkey", F.lit(4)).cast("string")).alias("selectedAnswer"),
        (F.col("l_discount") >= 0.05).alias("correct"),
        F.when(F.col("l_linenumber") != 4, F.col("l_quantity") * 100).alias("responseMs"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("answeredAt"),
    )
    round_ = F.struct(
        F.col("l_linenumber").alias("round"),
        F.concat((F.pmod("l_partkey", F.lit(12)) + 1).cast("string"), F.lit(". Tema")).alias("category"),
        F.lit(None).cast("int").alias("categoryN"),
        F.concat("l_returnflag", "l_linestatus").alias("format"),
        F.lit(None).cast("double").alias("difficulty"),
        _pick(("6-9", "10-15", "15+", ""), F.pmod("l_suppkey", F.lit(4))).alias("ageBand"),
        F.concat(F.lit("Quêstão <b>"), F.pmod("l_partkey", F.lit(100)).cast("string"), F.lit("</b>")).alias("question"),
        F.concat(F.lit("R"), F.pmod("l_partkey", F.lit(100)).cast("string")).alias("correctAnswer"),
        F.lit(None).cast("string").alias("questionHash"),
        F.lit(None).cast("string").alias("knowledgeId"),
        F.array().cast("array<string>").alias("options"),
        F.array(answer).alias("answers"),
    )
    by_game = joined.groupBy("o_orderkey", "o_orderdate", "o_orderpriority").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", round_.alias("r")))).alias("x"))
    return by_game.select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "multiplayer").otherwise("single").alias("mode"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("startedAt"),
        F.date_format(F.date_add("o_orderdate", F.size("x")).cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("finishedAt"),
        F.lit(None).cast("string").alias("roomCode"),
        F.lit(None).cast("string").alias("sessionName"),
        F.array().cast(f"array<{games.PLAYER}>").alias("players"),
        F.transform("x", lambda y: y["r"]).alias("rounds"),
    )


def game_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(normalized games, flat rounds, answer events)."""
    normal = games.normalize_games(order_games(spark, sf_dir))
    flat = games.rounds(normal)
    return normal, flat, games.answers(flat)


def flat_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The games of `order_games` as they are stored flat, without the way through nested rows: (games, rounds, answers)
    with the same columns and values."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    order = W.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey).withColumn("pos", F.row_number().over(order) - 1)
    player = F.concat(F.lit("c"), F.pmod("o_custkey", F.lit(200)).cast("string"))
    game = F.lpad(F.col("o_orderkey").cast("string"), 10, "0")
    number = F.pmod("l_partkey", F.lit(100)).cast("string")
    common = {
        "game_id": game,
        "mode": F.when(F.col("o_orderpriority") == "1-URGENT", "multiplayer").otherwise("single"),
        "started_at": F.date_trunc("second", F.col("o_orderdate").cast("timestamp")),
        "round": F.col("l_linenumber"),
        "category": F.concat((F.pmod("l_partkey", F.lit(12)) + 1).cast("string"), F.lit(". Tema")),
        "category_n": (F.pmod("l_partkey", F.lit(12)) + 1).cast("int"),
        "format": F.concat("l_returnflag", "l_linestatus"),
        "age_band": _pick(("6-9", "10-15", "15+", games.NO_AGE_BAND), F.pmod("l_suppkey", F.lit(4))),
        "question": F.concat(F.lit("Quêstão <b>"), number, F.lit("</b>")),
        "correct_answer": F.concat(F.lit("R"), number),
        "knowledge_id": F.lit(None).cast("string"),
        "question_key": F.concat(F.lit("questao "), number, F.lit("::r"), number),
    }
    columns = [c.alias(name) for name, c in common.items()]
    rounds = joined.select(*columns, F.struct(game.alias("game"), F.col("pos").alias("round")).alias("ordinal"))
    answers = joined.select(
        *columns,
        F.struct(game.alias("game"), F.col("pos").alias("round"), F.lit(0).alias("answer")).alias("ordinal"),
        player.alias("player_id"),
        F.when(F.pmod("o_custkey", F.lit(3)) > 0, F.concat(F.lit("Nick "), player)).otherwise("").alias("nickname"),
        F.concat(F.lit("s"), F.pmod("l_suppkey", F.lit(4)).cast("string")).alias("selected_answer"),
        (F.col("l_discount") >= 0.05).alias("correct"),
        F.when(F.col("l_linenumber") != 4, F.col("l_quantity") * 100).otherwise(0.0).alias("response_ms"),
        F.col("l_shipdate").cast("timestamp").alias("answered_at"),
    )
    held = joined.groupBy("o_orderkey", "o_orderdate", "o_orderpriority").agg(F.collect_list(F.lit(1)).alias("rounds"))
    whole = held.select(game.alias("game_id"), common["mode"].alias("mode"), common["started_at"].alias("started_at"), F.date_add("o_orderdate", F.size("rounds")).cast("timestamp").alias("finished_at"), "rounds")
    return whole, rounds, answers


def generation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as generation telemetry."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    outcome = F.when(F.col("event_type").isin("purchase", "view"), "accepted").when(F.col("event_type") == "click", "rejected").when(F.col("event_type") == "error", "api_error").when(F.col("event_type") == "signup", "parse_error").otherwise("unknown")
    at = F.col("ts").cast("timestamp")
    return e.select(
        k.alias("id"),
        at.alias("ts"),
        outcome.alias("outcome"),
        (F.pmod("user_id", F.lit(20)) + 1).cast("int").alias("category"),
        F.concat(F.lit("F"), F.pmod(k, F.lit(4)).cast("string")).alias("format_id"),
        _pick(("ai", "bank", "repo-ai", "repo-direct", "bank-replenish"), F.pmod(k, F.lit(5))).alias("source"),
        F.concat(F.lit("p"), F.pmod("user_id", F.lit(6)).cast("string")).alias("provider"),
        F.concat(F.lit("m"), F.pmod("user_id", F.lit(9)).cast("string")).alias("model"),
        F.when(F.pmod(k, F.lit(11)) > 0, (F.pmod(k, F.lit(13)) + 1).cast("int")).alias("attempt"),
        F.when(F.pmod(k, F.lit(3)) > 0, "multi").alias("game_mode"),
        F.when(outcome.isin("rejected", "api_error"), F.array(F.concat(F.lit("C"), F.pmod(k, F.lit(7)).cast("string")), F.concat(F.lit("D"), F.pmod(k, F.lit(5)).cast("string")))).otherwise(F.array().cast("array<string>")).alias("issue_codes"),
        F.array(F.concat(F.lit("msg "), F.pmod(k, F.lit(7)).cast("string"))).alias("issue_messages"),
        F.pmod(k, F.lit(500)).cast("string").alias("question_hash"),
        F.when((outcome == "rejected") & (F.pmod(k, F.lit(4)) == 0), at + F.expr("INTERVAL 1 HOUR")).alias("validated_at"),
        F.when(F.pmod(k, F.lit(8)) == 0, True).when(F.pmod(k, F.lit(12)) == 0, False).alias("validated_edited"),
        F.when((outcome == "rejected") & (F.pmod(k, F.lit(6)) == 1), at + F.expr("INTERVAL 2 HOURS")).alias("dismissed_at"),
    )


def usage_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as provider calls."""
    return calls_of(table(spark, sf_dir, "events"))


def calls_of(e: DataFrame) -> DataFrame:
    """Rows of the table of events, stored or streaming, as provider calls."""
    failed = F.col("event_type") == "error"
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("P"), F.pmod("user_id", F.lit(3)).cast("string")).alias("provider"),
        F.concat(F.lit("m"), F.pmod("user_id", F.lit(4)).cast("string")).alias("model"),
        (~failed).alias("ok"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
        F.floor("value").cast("long").alias("latency_ms"),
        (failed & (F.pmod("event_id", F.lit(2)) == 0)).alias("limit_hit"),
        F.pmod("event_id", F.lit(1000)).alias("quota_used"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, "app_limit").when(F.pmod("event_id", F.lit(5)) == 0, "provider_limit").alias("error_kind"),
        (F.col("event_type") == "signup").alias("replenish"),
    )


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as bank items: every third is a true-or-false one, some are invalid or reported."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    age = _pick(("6-9", "10-15", "15+"), F.pmod(k, F.lit(3)))
    two = F.pmod(k, F.lit(3)) == 0
    labels = F.array(F.lit("Verdadeiro"), F.lit("<b>Falso</b>"))
    four = F.array(F.col("p_name"), F.concat("p_name", F.lit(" a")), F.col("p_brand"), F.col("p_type"))
    return p.select(
        k.cast("string").alias("question_hash"),
        (F.pmod("p_size", F.lit(20)) + 1).cast("int").alias("category_n"),
        F.when(F.pmod(k, F.lit(5)) == 0, F.array((F.pmod("p_size", F.lit(20)) + 1).cast("int"), (F.pmod(k, F.lit(20)) + 1).cast("int"))).alias("category_ns"),
        age.alias("age_band"),
        F.when(F.pmod(k, F.lit(4)) == 0, F.array(F.lit("6-9"), F.lit("15+"))).alias("age_bands"),
        F.col("p_name").alias("question"),
        F.when(two, "verdadeiro").otherwise(F.col("p_name")).alias("correct_answer"),
        F.when(F.pmod(k, F.lit(10)) == 7, F.slice(four, 1, 3)).when(two, labels).otherwise(four).alias("options"),
        F.when(two, "VERDADEIRO_FALSO").otherwise("ESCOLHA").alias("format"),
        F.when(F.pmod(k, F.lit(6)) > 0, F.concat(F.lit("k"), F.pmod(k, F.lit(300)).cast("string"))).alias("knowledge_id"),
        F.lit("ai").alias("source"),
        F.when(F.pmod(k, F.lit(7)) > 0, (F.pmod(k, F.lit(5)) + 1).cast("int")).alias("difficulty"),
        (F.pmod("p_size", F.lit(5)) + 1).cast("int").alias("estimated_difficulty"),
        F.when(F.pmod(k, F.lit(9)) == 0, F.create_map(F.lit("6-9"), F.lit(1), F.lit("15+"), F.lit(5))).alias("difficulty_by_age_band"),
        (F.pmod(k, F.lit(17)) == 0).alias("is_reported"),
        F.timestamp_seconds(F.lit(1704067200) + k * 977).alias("created_at"),
    )


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_partkey % 23 = 0").select(F.col("p_partkey").cast("string").alias("question_hash"))


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as plays: of the item numbered like the user, and of a fact."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("question_hash"), F.when(F.pmod("event_id", F.lit(4)) == 0, F.concat(F.lit("k"), F.pmod("event_id", F.lit(40)).cast("string"))).alias("knowledge_id"), F.col("ts").cast("timestamp").alias("played_at"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts as facts."""
    p = dealt(table(spark, sf_dir, "part"), "p_partkey")
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("k"), k.cast("string")).alias("knowledge_id"),
        (F.pmod("p_size", F.lit(20)) + 1).cast("int").alias("category_n"),
        F.when(F.pmod(k, F.lit(2)) == 0, "curiosidade surpreendente").otherwise("adivinha tradicional").alias("topic"),
        F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand"), F.concat(F.lit("lote"), F.pmod(k, F.lit(50)).cast("string"))).alias("fact"),
        F.concat(F.lit("Resposta "), F.pmod(k, F.lit(150)).cast("string")).alias("answer"),
        _pick(("Wikidata", "manual", "sample", "outro"), F.pmod(k, F.lit(4))).alias("source"),
        F.concat(F.lit("S"), F.pmod(k, F.lit(400)).cast("string")).alias("source_id"),
        F.lit(None).cast("string").alias("source_url"),
        (F.lit(0.8) + F.pmod(k, F.lit(20)) / 100).alias("confidence"),
        F.pmod(k, F.lit(9)).cast("int").alias("priority_pt"),
        F.array(F.lit("6-9"), F.lit("15+")).alias("age_bands"),
        F.array(F.lit("RESPOSTA_DIRETA")).alias("allowed_formats"),
        (F.pmod(k, F.lit(13)) > 0).alias("is_active"),
        F.when(F.pmod(k, F.lit(29)) == 0, "k1").alias("superseded_by"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )
