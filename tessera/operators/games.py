"""Game statistics: nested games to rounds and answers, and the tables computed from them.

A game is (id, mode, started_at, finished_at, room_code, session_name, players, rounds); the rounds hold the answers.
Ties go to what comes first, by the ordinal (game, round, answer) that every row carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.lineage import cut
from tessera.functions.numbers import count_where, percent, rounded_mean

DEFAULT_PLAYER = "local"
#: Age bands in the order in which they are listed, and the band of rounds without one.
AGE_BANDS = ("6-9", "10-15", "15+")
NO_AGE_BAND = "—"
#: Best and worst are taken among what has so many answers at least.
SUPPORT = 3

ANSWER = "struct<playerId:string,nickname:string,selectedAnswer:string,correct:boolean,responseMs:double,answeredAt:string>"
ROUND = f"struct<round:int,category:string,categoryN:int,format:string,difficulty:double,ageBand:string,question:string,correctAnswer:string,questionHash:string,knowledgeId:string,options:array<string>,answers:array<{ANSWER}>>"
PLAYER = "struct<playerId:string,nickname:string,isHost:boolean>"
GAME = f"id string, mode string, startedAt string, finishedAt string, roomCode string, sessionName string, players array<{PLAYER}>, rounds array<{ROUND}>"


def instant(x: Column) -> Column:
    return F.try_to_timestamp(x)


def normalize_games(games: DataFrame) -> DataFrame:
    """Games with defaults filled in; games without rounds are dropped.

    A null response time or difficulty counts as 0, as stored events have it; single games get one default player."""
    given = F.coalesce(F.col("players"), F.array().cast(f"array<{PLAYER}>"))
    named = F.transform(given, lambda p: F.struct(F.coalesce(text.nullif_empty(text.clip(p["playerId"], 64)), F.lit(DEFAULT_PLAYER)).alias("playerId"), text.clip(p["nickname"], 64).alias("nickname"), F.coalesce(p["isHost"], F.lit(False)).alias("isHost")))
    alone = F.array(F.struct(F.lit(DEFAULT_PLAYER).alias("playerId"), F.lit("Jogador").alias("nickname"), F.lit(True).alias("isHost")))
    mode = F.when(F.col("mode") == "multiplayer", "multiplayer").otherwise("single")
    return games.filter(F.size("rounds") > 0).select(
        F.coalesce(text.nullif_empty(text.clip(F.col("id"), 64)), F.lit("unknown")).alias("game_id"),
        mode.alias("mode"),
        instant(F.col("startedAt")).alias("started_at"),
        instant(F.col("finishedAt")).alias("finished_at"),
        text.nullif_empty(F.upper(text.clip(F.col("roomCode"), 8))).alias("room_code"),
        text.nullif_empty(text.clip(F.col("sessionName"), 64)).alias("session_name"),
        F.when(F.size(given) > 0, named).when(mode == "multiplayer", given).otherwise(alone).alias("players"),
        F.col("rounds"),
    )


def question_key(question: Column, answer: Column, hash_: Column) -> Column:
    q, a = text.normalize(question), text.normalize(answer)
    both = F.when((q != "") & (a != ""), F.concat(q, F.lit("::"), a))
    return F.coalesce(text.nullif_empty(text.clip(hash_, 128)), both, text.nullif_empty(q), text.nullif_empty(a), F.lit("unknown"))


def rounds(games: DataFrame) -> DataFrame:
    """One row a round of normalized games, with its ordinal and question key."""
    r = F.col("r")
    flat = games.select("game_id", "mode", "started_at", F.posexplode("rounds").alias("pos", "r"))
    number = F.coalesce(r["categoryN"], F.regexp_extract(F.coalesce(r["category"], F.lit("")), r"(\d{1,2})", 1).try_cast("int"))
    return flat.select(
        "game_id",
        "mode",
        "started_at",
        F.struct(F.col("game_id").alias("game"), F.col("pos").alias("round")).alias("ordinal"),
        F.when(F.coalesce(r["round"], F.lit(0)) == 0, F.col("pos") + 1).otherwise(r["round"]).alias("round"),
        text.clip(r["category"], 120).alias("category"),
        number.alias("category_n"),
        text.clip(r["format"], 48).alias("format"),
        F.coalesce(r["difficulty"], F.lit(0.0)).alias("difficulty"),
        F.coalesce(text.nullif_empty(text.clip(r["ageBand"], 16)), F.lit(NO_AGE_BAND)).alias("age_band"),
        F.coalesce(r["question"], F.lit("")).alias("question"),
        F.coalesce(r["correctAnswer"], F.lit("")).alias("correct_answer"),
        text.nullif_empty(text.clip(r["knowledgeId"], 64)).alias("knowledge_id"),
        question_key(r["question"], r["correctAnswer"], r["questionHash"]).alias("question_key"),
        r["questionHash"].alias("question_hash"),
        F.coalesce(r["answers"], F.array().cast(f"array<{ANSWER}>")).alias("answers"),
    )


def answers(flat: DataFrame) -> DataFrame:
    """One row an answer of flat rounds."""
    a = F.col("a")
    kept = [c for c in flat.columns if c not in ("answers", "ordinal")]
    each = flat.select(*kept, "ordinal", F.posexplode("answers").alias("pos", "a"))
    return each.select(
        *kept,
        F.struct(F.col("ordinal.game").alias("game"), F.col("ordinal.round").alias("round"), F.col("pos").alias("answer")).alias("ordinal"),
        F.coalesce(text.nullif_empty(text.clip(a["playerId"], 64)), F.lit(DEFAULT_PLAYER)).alias("player_id"),
        text.clip(a["nickname"], 64).alias("nickname"),
        F.coalesce(a["selectedAnswer"], F.lit("")).alias("selected_answer"),
        F.coalesce(a["correct"], F.lit(False)).alias("correct"),
        F.coalesce(a["responseMs"], F.lit(0.0)).alias("response_ms"),
        F.coalesce(instant(a["answeredAt"]), F.col("started_at")).alias("answered_at"),
    )


def date_label(ts: Column, zone: str = "Europe/Lisbon") -> Column:
    """A local time as it is shown: day, month, year, hour and minute."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "dd/MM/yyyy, HH:mm")


def match_labels(games: DataFrame) -> DataFrame:
    """(game_id, mode, name, date, room_code, title) of normalized games: rooms go by their host, single games by their
    session."""
    many = F.col("mode") == "multiplayer"
    host = F.coalesce(F.try_element_at(F.filter("players", lambda p: p["isHost"]), F.lit(1)), F.try_element_at("players", F.lit(1)))
    name = F.when(many, F.coalesce(text.nullif_empty(host["nickname"]), text.nullif_empty(host["playerId"]), F.lit("Multijogador"))).otherwise(F.coalesce("session_name", F.lit("Individual")))
    room = F.when(many, text.nullif_empty(F.upper(F.trim("room_code"))))
    date = date_label(F.col("started_at"))
    title = F.concat_ws(" · ", name, F.concat(F.lit("Sala "), room), date)
    return games.select("game_id", "mode", name.alias("name"), date.alias("date"), room.alias("room_code"), title.alias("title"))


def all_stats(games: DataFrame, flat: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """Every table of the statistics by its name; match and global insights among them."""
    stats = game_stats(games, events)
    alone = single_player(events)
    return {"summary": games_summary(stats), "games": stats, "labels": match_labels(games), "players": player_stats(alone), "streaks": streaks(alone), "categories": category_stats(flat, events), "age_bands": age_band_stats(flat, events), "questions": question_stats(flat, events), "questions_by_age": question_stats(flat, events, by_age_band=True), "match_insights": match_insights(games, events), "global_insights": global_insights(games, flat, events)}


def single_player(events: DataFrame) -> DataFrame:
    return events.filter(F.col("mode") != "multiplayer")


def _tally(total: str = "answers_total") -> list[Column]:
    return [F.count(F.lit(1)).alias(total), count_where(F.col("correct")).alias("correct_total")]


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumn("wrong_total", F.col("answers_total") - F.col("correct_total")).withColumn("accuracy_pct", percent(F.col("correct_total"), F.col("answers_total")))


def _pace(at_least: float | None = 0) -> list[Column]:
    counted = F.col("response_ms") if at_least is None else F.when(F.col("response_ms") >= at_least, F.col("response_ms"))
    return [F.sum(counted).alias("_ms"), F.count(counted).alias("_n")]


def _paced(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_response_ms", rounded_mean(F.col("_ms"), F.col("_n"))).drop("_ms", "_n")


def game_stats(games: DataFrame, events: DataFrame) -> DataFrame:
    """Per game: rounds, answers, accuracy, mean latency and duration; games without answers stay with nulls."""
    length = F.when(F.col("finished_at") >= F.col("started_at"), F.unix_millis("finished_at") - F.unix_millis("started_at"))
    base = games.select("game_id", "mode", "started_at", "finished_at", length.alias("duration_ms"), F.size("rounds").cast("long").alias("rounds_total"))
    tally = events.groupBy("game_id").agg(*_tally(), *_pace())
    joined = base.join(tally, "game_id", "left").fillna(0, ["answers_total", "correct_total", "_n"])
    return _paced(_rates(joined)).withColumn("has_answer_data", F.col("answers_total") > 0)


def games_summary(stats: DataFrame) -> DataFrame:
    """One row over all games, from `game_stats`."""
    total = stats.agg(
        F.count(F.lit(1)).alias("games_total"),
        F.coalesce(F.sum("rounds_total"), F.lit(0)).alias("rounds_total"),
        count_where(F.col("mode") == "single").alias("single_games"),
        count_where(F.col("mode") == "multiplayer").alias("multiplayer_games"),
        F.coalesce(F.sum("answers_total"), F.lit(0)).alias("answers_total"),
        F.coalesce(F.sum("correct_total"), F.lit(0)).alias("correct_total"),
        rounded_mean(F.sum("duration_ms"), F.count("duration_ms")).alias("avg_duration_ms"),
    )
    mean = F.when(F.col("games_total") > 0, F.floor(F.col("rounds_total") / F.col("games_total") * 10 + 0.5) / 10).otherwise(F.lit(0.0))
    return _rates(total).withColumn("avg_rounds_per_game", mean)


def _category_key() -> Column:
    return F.coalesce(F.concat(F.lit("n:"), F.col("category_n").cast("string")), F.concat(F.lit("t:"), F.coalesce(text.nullif_empty(F.col("category")), F.lit("unknown"))))


def player_stats(events: DataFrame) -> DataFrame:
    """Per player: distinct games, accuracy, latency, categories by number of answers, the best and the worst one.

    Among equal accuracies the category with more answers comes first, then the one seen first; the worst one needs two
    answers."""
    keyed = events.withColumn("_cat", _category_key())
    by_category = _rates(keyed.groupBy("player_id", "_cat").agg(*_tally(), F.min("ordinal").alias("_first"), F.min_by(F.struct("category", "category_n"), "ordinal").alias("_name")))
    entry = F.struct((-F.col("answers_total")).alias("order"), F.col("_first").alias("first"), F.col("_name.category").alias("category"), F.col("_name.category_n").alias("category_n"), "answers_total", "correct_total", "accuracy_pct")
    label = F.col("_name.category")
    cats = by_category.groupBy("player_id").agg(
        F.array_sort(F.collect_list(entry)).alias("by_category"),
        F.min_by(F.struct(label.alias("category"), "accuracy_pct"), F.struct((-F.col("accuracy_pct")).alias("a"), (-F.col("answers_total")).alias("n"), F.col("_first").alias("f"))).alias("best_category"),
        F.min_by(F.struct(label.alias("category"), "accuracy_pct"), F.when(F.col("answers_total") >= 2, F.struct(F.col("accuracy_pct").alias("a"), (-F.col("answers_total")).alias("n"), F.col("_first").alias("f")))).alias("worst_category"),
    )
    nick = F.min_by("nickname", F.when(F.col("nickname") != "", F.col("ordinal")))
    base = events.groupBy("player_id").agg(F.countDistinct("game_id").alias("games_played"), *_tally(), *_pace(None), nick.alias("nickname"), F.min("ordinal").alias("ordinal"))
    return _paced(_rates(base)).join(cats, "player_id").withColumn("display_name", text.display_name(F.col("player_id"), F.col("nickname")))


def _grain(flat: DataFrame, events: DataFrame, key: Column, name: str, labels: list[str]) -> DataFrame:
    """Rounds presented and answers given by a key, side by side."""
    presented = flat.withColumn(name, key).groupBy(name).agg(F.count(F.lit(1)).alias("rounds_presented"), F.min("ordinal").alias("ordinal"), *[F.min_by(c, "ordinal").alias(c) for c in labels])
    given = events.withColumn(name, key).groupBy(name).agg(*_tally(), *_pace())
    return _paced(_rates(presented.join(given, name, "left").fillna(0, ["answers_total", "correct_total", "_n"])))


def category_stats(flat: DataFrame, events: DataFrame, formats: int = 5) -> DataFrame:
    """Per category: rounds, answers, accuracy and the most frequent formats, first seen first among equals."""
    base = _grain(flat, events, _category_key(), "category_key", ["category", "category_n"])
    used = flat.filter("format <> ''").withColumn("category_key", _category_key()).groupBy("category_key", "format").agg(F.count(F.lit(1)).alias("count"), F.min("ordinal").alias("first"))
    ranked = used.groupBy("category_key").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), "first", "format", "count"))), 1, formats).alias("_top"))
    top = F.transform("_top", lambda x: F.struct(x["format"].alias("format"), x["count"].alias("count")))
    return base.join(ranked, "category_key", "left").withColumn("top_formats", top).drop("_top")


def age_band_stats(flat: DataFrame, events: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*[F.lit(b) for b in AGE_BANDS]), F.col("age_band"))
    return _grain(flat, events, F.col("age_band"), "age_band", []).withColumn("band_order", F.when(order > 0, order - 1).otherwise(len(AGE_BANDS)))


def difficulty_label(accuracy: Column) -> Column:
    return F.when(accuracy.isNull(), "unknown").when(accuracy >= 80, "easy").when(accuracy >= 55, "medium").otherwise("hard")


def _asked(rows: DataFrame) -> tuple[list[str], Column]:
    """What a question's key is made from, as far as the rows have it, and the key: texts that differ are few, so that
    rows are counted by them and the key is made for what is counted."""
    made = ["question", "correct_answer", "question_hash"]
    return (made, question_key(*[F.col(c) for c in made])) if "question_hash" in rows.columns else (["question_key"], F.col("question_key"))


def question_stats(flat: DataFrame, events: DataFrame, by_age_band: bool = False, wrong: int = 5) -> DataFrame:
    """Per question (and age band): times presented, answers, accuracy, label and the most frequent wrong answers.

    Rounds are read once and answers once: what is counted of them is small, and everything else is made from it."""
    band = ["age_band"] if by_age_band else []
    keys = ["question_key", *band]
    labels = [c for c in ("question", "correct_answer", "category", "category_n", "format", "age_band", "knowledge_id") if c not in keys]
    raw, key = _asked(flat)
    shown = flat.groupBy(*raw, *band).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("ordinal", *labels), "ordinal").alias("first"))
    shown = shown.select(key.alias("question_key"), *band, "n", "first").groupBy(*keys).agg(F.sum("n").alias("times_presented"), F.min_by("first", "first.ordinal").alias("first")).select(*keys, "times_presented", "first.*")
    raw, key = _asked(events)
    said = events.groupBy(*raw, *band, "selected_answer", "correct").agg(*_tally(), *_pace(None), F.min("ordinal").alias("first"))
    said = cut(said.select(key.alias("question_key"), *band, "selected_answer", "correct", "answers_total", "correct_total", "_ms", "_n", "first"))
    given = said.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("answers_total", "correct_total", "_ms", "_n")])
    answer = F.coalesce(text.nullif_empty(text.clip(F.col("selected_answer"), 120)), F.lit("(vazio)"))
    missed = said.filter(~F.col("correct")).withColumn("answer", answer).groupBy(*keys, "answer").agg(F.sum("answers_total").alias("count"), F.min("first").alias("first"))
    top = missed.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("order"), "first", "answer", "count"))), 1, wrong).alias("_top"))
    joined = shown.join(given, keys, "left").join(top, keys, "left").fillna(0, ["answers_total", "correct_total", "_n"])
    answered = F.transform("_top", lambda x: F.struct(x["answer"].alias("answer"), x["count"].alias("count")))
    return _paced(_rates(joined)).withColumn("difficulty_label", difficulty_label(F.col("accuracy_pct"))).withColumn("top_wrong_answers", answered).drop("_top")


def extremes(stats: DataFrame, order: list[Column], by: list[str] | None = None, support: int = SUPPORT) -> DataFrame:
    """The rows of highest and lowest accuracy among those with enough answers, as `extreme` best and worst; ties in the
    given order."""
    enough = stats.filter(F.col("answers_total") >= support)
    part = W.partitionBy(*(by or [F.lit(1)]))
    best = F.row_number().over(part.orderBy(F.col("accuracy_pct").desc(), *order))
    worst = F.row_number().over(part.orderBy(F.col("accuracy_pct").asc(), *order))
    ranked = enough.withColumn("_best", best).withColumn("_worst", worst).filter("_best = 1 OR _worst = 1")
    named = F.array_compact(F.array(F.when(F.col("_best") == 1, F.lit("best")), F.when(F.col("_worst") == 1, F.lit("worst"))))
    return ranked.withColumn("extreme", F.explode(named)).drop("_best", "_worst")


def streaks(events: DataFrame) -> DataFrame:
    """Per player: the current and the best run of right answers in order of time, game and round.

    Wrong answers cut the order into islands; a run is the right answers of one island."""
    order = [F.coalesce(F.col("answered_at"), F.timestamp_seconds(F.lit(0))), F.col("game_id"), F.col("round"), F.col("ordinal")]
    island = F.sum((~F.col("correct")).cast("int")).over(W.partitionBy("player_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    runs = events.withColumn("_island", island).groupBy("player_id", "_island").agg(count_where(F.col("correct")).alias("run"), F.min_by("nickname", F.when(F.col("nickname") != "", F.col("ordinal"))).alias("nickname"), F.min("ordinal").alias("ordinal"))
    return runs.groupBy("player_id").agg(F.max("run").alias("best_streak"), F.max_by("run", "_island").alias("current_streak"), F.min_by("nickname", F.when(F.col("nickname").isNotNull(), F.col("ordinal"))).alias("nickname"))


INSIGHT = ["game_id", "type", "subject", "value", "answers"]


def _insight(df: DataFrame, kind: str, subject: Column, value: Column, answered: Column) -> DataFrame:
    game = F.col("game_id") if "game_id" in df.columns else F.lit(None).cast("string")
    return df.select(game.alias("game_id"), F.lit(kind).alias("type"), subject.cast("string").alias("subject"), value.cast("double").alias("value"), answered.cast("long").alias("answers"))


def match_insights(games: DataFrame, events: DataFrame) -> DataFrame:
    """Insights of each game as (game_id, type, subject, value, answers).

    In single games: accuracy and pace of players, the dominated category and the longest run; in multiplayer ones the
    accuracy, pace and number of devices of the room; in both the hardest round and the round that split the players.
    accuracy_leader names the player with most answers. The events are read by each insight, so they are written once,
    without what no insight asks for: keys of questions are long work."""
    events = cut(events.select("game_id", "mode", "round", "ordinal", "player_id", "nickname", "category", "category_n", "question", "correct", "response_ms", "answered_at"))
    stats = game_stats(games, events)
    found = [_insight(stats.filter("answers_total = 0"), "info", F.lit("no answers"), F.col("rounds_total"), F.lit(0))]
    room = stats.filter("mode = 'multiplayer' AND answers_total > 0")
    found.append(_insight(room, "match_accuracy", F.lit(None), F.col("accuracy_pct"), F.col("answers_total")))
    found.append(_insight(room.filter("avg_response_ms IS NOT NULL"), "match_pace", F.lit(None), F.col("avg_response_ms"), F.col("answers_total")))
    devices = events.filter("mode = 'multiplayer'").groupBy("game_id").agg(F.countDistinct("player_id").alias("n"), F.count(F.lit(1)).alias("k"))
    found.append(_insight(devices, "match_devices", F.lit(None), F.col("n"), F.col("k")))

    alone = single_player(events)
    nick = F.min_by("nickname", F.when(F.col("nickname") != "", F.col("ordinal")))
    players = _paced(_rates(alone.groupBy("game_id", "player_id").agg(*_tally(), *_pace(None), nick.alias("nickname"), F.min("ordinal").alias("first"))))
    name = text.display_name(F.col("player_id"), F.col("nickname"))

    def first(df: DataFrame, *order: Column) -> DataFrame:
        return df.withColumn("_at", F.row_number().over(W.partitionBy("game_id").orderBy(*order))).filter("_at = 1").drop("_at")

    found.append(_insight(first(players, F.col("answers_total").desc(), F.col("first")), "accuracy_leader", name, F.col("accuracy_pct"), F.col("answers_total")))
    found.append(_insight(first(players.filter("avg_response_ms IS NOT NULL"), F.col("avg_response_ms"), F.col("answers_total").desc(), F.col("first")), "fastest", name, F.col("avg_response_ms"), F.col("answers_total")))
    cats = _rates(alone.withColumn("_cat", _category_key()).groupBy("game_id", "player_id", "_cat").agg(*_tally(), F.min("ordinal").alias("first"), F.min_by("category", "ordinal").alias("category")))
    best = cats.withColumn("_at", F.row_number().over(W.partitionBy("game_id", "player_id").orderBy(F.col("accuracy_pct").desc(), F.col("answers_total").desc(), "first"))).filter("_at = 1 AND answers_total >= 2").drop("_at")
    found.append(_insight(first(best, F.col("accuracy_pct").desc(), F.col("first")), "category_dominance", F.col("category"), F.col("accuracy_pct"), F.col("answers_total")))
    order = [F.coalesce(F.col("answered_at"), F.timestamp_seconds(F.lit(0))), F.col("round"), F.col("ordinal")]
    island = F.sum((~F.col("correct")).cast("int")).over(W.partitionBy("game_id", "player_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    runs = alone.withColumn("_island", island).groupBy("game_id", "player_id", "_island").agg(count_where(F.col("correct")).alias("run"), F.min("ordinal").alias("first"), nick.alias("nickname"))
    runs = runs.groupBy("game_id", "player_id").agg(F.max("run").alias("run"), F.min("first").alias("first"), F.max("nickname").alias("nickname"))
    found.append(_insight(first(runs.filter("run >= 2"), F.col("run").desc(), F.col("first")), "streak", name, F.col("run"), F.col("run")))

    by_round = _rates(events.groupBy("game_id", "round").agg(*_tally(), F.min("ordinal").alias("first"), F.min_by("question", "ordinal").alias("question")))
    hardest = first(by_round, F.col("accuracy_pct"), F.col("first")).filter("answers_total >= 2")
    found.append(_insight(hardest, "hardest_question", F.col("question"), F.col("accuracy_pct"), F.col("answers_total")))
    split = by_round.filter("answers_total >= 2 AND abs(correct_total - wrong_total) <= 1")
    found.append(_insight(first(split, F.col("answers_total").desc(), F.col("first")), "split_question", F.col("question"), F.col("correct_total"), F.col("answers_total")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def global_insights(games: DataFrame, flat: DataFrame, events: DataFrame) -> DataFrame:
    """Insights over all games, with the thresholds of 3 and 5 answers. Rounds and events are written once."""
    unkeyed = lambda df: df.drop("answers", *(["question_key"] if "question_hash" in df.columns else []))
    flat, events = cut(unkeyed(flat)), cut(unkeyed(events))
    stats = game_stats(games, events)
    total = games_summary(stats)
    found = [
        _insight(total.filter("answers_total > 0"), "corpus_overview", F.col("games_total"), F.col("accuracy_pct"), F.col("answers_total")),
        _insight(total.filter("answers_total > 0"), "games_split", F.col("multiplayer_games"), F.col("single_games"), F.col("answers_total")),
    ]
    pace = _paced(events.agg(*_pace(), F.count(F.lit(1)).alias("k")))
    found.append(_insight(pace.filter("avg_response_ms IS NOT NULL"), "global_pace", F.lit(None), F.col("avg_response_ms"), F.col("k")))

    def first(df: DataFrame, *order: Column) -> DataFrame:
        return df.orderBy(*order).limit(1)

    listed = [F.col("times_presented").desc(), F.col("answers_total").desc(), F.col("ordinal")]
    questions = question_stats(flat, events).filter(F.col("answers_total") >= SUPPORT)
    hard = first(questions, F.col("accuracy_pct").asc(), *listed)
    found.append(_insight(hard, "global_hardest_question", F.col("question_key"), F.col("accuracy_pct"), F.col("answers_total")))
    easy = first(questions, F.col("accuracy_pct").desc(), F.col("times_presented").asc(), F.col("answers_total").asc(), F.col("ordinal").desc())
    easy = easy.join(hard.select("question_key"), "question_key", "left_anti")
    found.append(_insight(easy, "global_easiest_question", F.col("question_key"), F.col("accuracy_pct"), F.col("answers_total")))
    cats = category_stats(flat, events)
    most = first(cats, F.col("rounds_presented").desc(), F.col("ordinal"))
    found.append(_insight(most, "top_category", F.col("category"), F.col("accuracy_pct"), F.col("answers_total")))
    weak = first(cats.filter(F.col("answers_total") >= SUPPORT), F.col("accuracy_pct").asc(), F.col("rounds_presented").desc(), F.col("ordinal"))
    weak = weak.filter("answers_total >= 5").join(most.select("category_key"), "category_key", "left_anti")
    found.append(_insight(weak, "weakest_category", F.col("category"), F.col("accuracy_pct"), F.col("answers_total")))
    bands = age_band_stats(flat, events).filter(F.col("answers_total") >= SUPPORT)
    best = first(bands, F.col("accuracy_pct").desc(), F.col("band_order"), F.col("ordinal"))
    found.append(_insight(best, "best_age_band", F.col("age_band"), F.col("accuracy_pct"), F.col("answers_total")))
    low = first(bands, F.col("accuracy_pct").asc(), F.col("band_order"), F.col("ordinal")).filter("answers_total >= 5").join(best.select("age_band"), "age_band", "left_anti")
    found.append(_insight(low, "weakest_age_band", F.col("age_band"), F.col("accuracy_pct"), F.col("answers_total")))
    alone = single_player(events)
    top = first(player_stats(alone).filter(F.col("answers_total") >= SUPPORT), F.col("answers_total").desc(), F.col("ordinal"))
    found.append(_insight(top, "global_top_player", F.col("display_name"), F.col("accuracy_pct"), F.col("answers_total")))
    runs = first(streaks(alone).filter("best_streak >= 2"), F.col("best_streak").desc(), F.col("player_id"))
    found.append(_insight(runs, "global_best_streak", text.display_name(F.col("player_id"), F.col("nickname")), F.col("best_streak"), F.col("best_streak")))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.drop("game_id")


def from_flat_tables(matches: DataFrame, history: DataFrame, players: DataFrame, rooms: DataFrame) -> DataFrame:
    """Nested games from matches (id, mode, startedAt, finishedAt, room_id, sessionName), history rows (match_id and the
    fields of a round), players (room_id, playerId, nickname, isHost) and rooms (id, code)."""
    fields = [f.split(":")[0] for f in "round:,category:,categoryN:,format:,difficulty:,ageBand:,question:,correctAnswer:,questionHash:,knowledgeId:,options:,answers:".split(",")]
    by_match = history.groupBy(F.col("match_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rounds"))
    by_room = players.groupBy("room_id").agg(F.array_sort(F.collect_list(F.struct("playerId", "nickname", "isHost"))).alias("players"))
    codes = rooms.select(F.col("id").alias("room_id"), F.col("code").alias("roomCode"))
    joined = matches.join(by_match, "id", "left").join(by_room, "room_id", "left").join(codes, "room_id", "left")
    return joined.select("id", "mode", "startedAt", "finishedAt", "roomCode", "sessionName", "players", "rounds")


def merge_answer_events(history: DataFrame, events: DataFrame) -> DataFrame:
    """History rows with the answers of flat answer events: per (match, round) the last answer of each player wins, and
    rounds that only the events know are made from their first event."""
    order = F.struct(F.col("answered_at"), F.col("event_id"))
    latest = events.groupBy("match_id", "round", "player_id").agg(F.max_by(F.struct(F.col("player_id").alias("playerId"), "nickname", F.col("selected_answer").alias("selectedAnswer"), "correct", F.col("response_ms").cast("double").alias("responseMs"), F.col("answered_at").cast("string").alias("answeredAt")), order).alias("answer"), F.min(order).alias("first"), *[F.min_by(c, order).alias(c) for c in ("category", "question", "correct_answer", "age_band")])
    given = latest.groupBy("match_id", "round").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "answer"))), lambda x: x["answer"]).alias("_answers"), *[F.min_by(c, "first").alias(f"_{c}") for c in ("category", "question", "correct_answer", "age_band")])
    joined = history.join(given, ["match_id", "round"], "full_outer")
    empty = F.coalesce(F.size("answers"), F.lit(-1)) <= 0
    return joined.select("match_id", "round", F.coalesce("category", "_category").alias("category"), F.coalesce("question", "_question").alias("question"), F.coalesce("correctAnswer", "_correct_answer").alias("correctAnswer"), F.coalesce("ageBand", "_age_band").alias("ageBand"), F.when(empty, F.col("_answers")).otherwise(F.coalesce("_answers", "answers")).alias("answers"))


def enrich_with_events(games: DataFrame, events: DataFrame) -> DataFrame:
    """Nested games with the answers that flat answer events (match_id and the columns of `merge_answer_events`) add to
    their rounds; games that only the events know are left out."""
    fields = ["round", "category", "categoryN", "format", "difficulty", "ageBand", "question", "correctAnswer", "questionHash", "knowledgeId", "options", "answers"]
    history = games.select(F.col("id").alias("match_id"), F.explode("rounds").alias("r")).select("match_id", *[F.col(f"r.{f}").alias(f) for f in fields])
    known = events.join(games.select(F.col("id").alias("match_id")), "match_id", "left_semi")
    merged = merge_answer_events(history.select("match_id", "round", "category", "question", "correctAnswer", "ageBand", "answers"), known)
    told = history.select("match_id", "round", *[F.col(f) for f in fields if f not in merged.columns])
    rounds_ = merged.join(told, ["match_id", "round"], "left").groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(*[F.col(f) for f in fields]))).alias("_rounds"))
    joined = games.join(rounds_, games["id"] == rounds_["match_id"], "left")
    return joined.withColumn("rounds", F.coalesce("_rounds", "rounds")).select(*games.columns)
