"""Game statistics on a small fixture with values known by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import games


def answer(player, nick, said, right, ms):
    return (player, nick, said, right, ms, "2024-05-01T10:00:00Z")


def fixture():
    def r(n, cat, band, answer_, answers):
        return (n, cat, None, "DIRETA", None, band, f"Pergunta {answer_}?", answer_, None, None, ["a"], answers)

    rounds = [
        r(1, "2. Geografia", "10-15", "Lisboa", [answer("p-joao", "João", "Lisboa", True, 3200.0), answer("p-maria", "Maria", "Lisboa", True, 4100.0), answer("p-tiago", "", "Porto", False, 5000.0)]),
        r(2, "3. História", "10-15", "1494", [answer("p-joao", "João", "1494", True, 6000.0), answer("p-maria", "Maria", "1492", False, 7000.0), answer("p-tiago", "", "1494", True, 8000.0)]),
        r(12, "14. Rios", "15+", "Tejo", [answer("p-joao", "João", "Douro", False, 7400.0), answer("p-maria", "Maria", "Tejo", True, 5200.0), answer("p-tiago", "", "Douro", False, None)]),
    ]
    legacy = (1, "Arte", None, None, 3.0, None, "Quem?", "Eu", "h-1", None, None, None)
    return [
        ("game-mp-1", "multiplayer", "2024-05-01T10:00:00Z", "2024-05-01T10:05:00Z", "abcd", None, [("p-joao", "João", True)], rounds),
        ("game-s-1", "single", "2024-05-02T10:00:00Z", "2024-05-02T09:00:00Z", None, "Treino", None, [legacy]),
        ("game-empty", "single", None, None, None, None, None, []),
    ]


@pytest.fixture(scope="module")
def frames(spark):
    normal = games.normalize_games(spark.createDataFrame(fixture(), games.GAME))
    flat = games.rounds(normal).cache()
    return normal, flat, games.answers(flat).cache()


def test_games_without_rounds_are_dropped_and_single_ones_get_a_player(frames):
    normal, flat, events = frames
    assert {r["game_id"] for r in normal.collect()} == {"game-mp-1", "game-s-1"}
    assert normal.filter("game_id = 'game-s-1'").first()["players"][0]["playerId"] == "local"
    assert flat.count() == 4 and events.count() == 9
    assert flat.filter("game_id = 'game-s-1'").first()["question_key"] == "h-1"
    assert flat.filter("round = 12").first()["category_n"] == 14
    assert events.filter("player_id = 'p-tiago' AND round = 12").first()["response_ms"] == 0  # null counts as 0


def test_game_stats_and_summary(frames):
    normal, _, events = frames
    stats = {r["game_id"]: r for r in games.game_stats(normal, events).collect()}
    assert stats["game-mp-1"]["accuracy_pct"] == 55.6 and stats["game-mp-1"]["duration_ms"] == 300_000
    assert stats["game-s-1"]["accuracy_pct"] is None and stats["game-s-1"]["duration_ms"] is None and not stats["game-s-1"]["has_answer_data"]
    total = games.games_summary(games.game_stats(normal, events)).first()
    assert (total["games_total"], total["rounds_total"], total["avg_rounds_per_game"], total["avg_duration_ms"]) == (2, 4, 2.0, 300_000)


def test_players(frames):
    _, _, events = frames
    got = {r["player_id"]: r for r in games.player_stats(events).collect()}
    assert got["p-joao"]["accuracy_pct"] == 66.7 and got["p-joao"]["correct_total"] == 2
    assert got["p-joao"]["best_category"]["category"] == "2. Geografia"  # the first of equal ones
    assert got["p-joao"]["worst_category"] is None  # no category with two answers
    assert got["p-tiago"]["display_name"] == "Jogador IAGO"
    assert got["p-tiago"]["avg_response_ms"] == 4333


def test_age_bands_and_questions(frames):
    _, flat, events = frames
    bands = {r["age_band"]: r for r in games.age_band_stats(flat, events).collect()}
    assert bands["10-15"]["answers_total"] == 6 and bands["—"]["band_order"] == 3 and bands["—"]["accuracy_pct"] is None
    questions = {r["correct_answer"]: r for r in games.question_stats(flat, events).collect()}
    assert questions["Tejo"]["accuracy_pct"] == 33.3 and questions["Tejo"]["difficulty_label"] == "hard"
    assert [(w["answer"], w["count"]) for w in questions["Tejo"]["top_wrong_answers"]] == [("Douro", 2)]
    assert questions["Eu"]["difficulty_label"] == "unknown"
    ends = {r["extreme"]: r["correct_answer"] for r in games.extremes(games.question_stats(flat, events), [F.col("ordinal")]).collect()}
    assert ends == {"best": "Lisboa", "worst": "Tejo"}


def test_streaks(frames):
    _, _, events = frames
    got = {r["player_id"]: (r["best_streak"], r["current_streak"]) for r in games.streaks(events).collect()}
    assert got == {"p-joao": (2, 0), "p-maria": (1, 1), "p-tiago": (1, 0)}


def test_insights(frames):
    normal, flat, events = frames
    got = {(r["game_id"], r["type"]): r for r in games.match_insights(normal, events).collect()}
    assert got["game-mp-1", "match_accuracy"]["value"] == 55.6 and got["game-mp-1", "match_devices"]["value"] == 3
    assert got["game-mp-1", "hardest_question"]["value"] == 33.3 and ("game-s-1", "info") in got
    assert not {k for k in got if k[0] == "game-mp-1"} & {("game-mp-1", "streak"), ("game-mp-1", "fastest")}
    overall = {r["type"]: r for r in games.global_insights(normal, flat, events).collect()}
    assert overall["corpus_overview"]["value"] == 55.6 and overall["global_hardest_question"]["value"] == 33.3
    assert "global_top_player" not in overall  # nobody answered in single mode


def test_ties_go_to_the_first(spark):
    rows = [("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("a", "y", 4)]
    r = [(n, f"{c}", None, "F", None, "6-9", c, c, None, None, [], [answer("p", "", "", True, 1.0)]) for _, c, n in rows]
    normal = games.normalize_games(spark.createDataFrame([("g", "single", None, None, None, None, None, r)], games.GAME))
    flat = games.rounds(normal)
    (got,) = games.player_stats(games.answers(flat)).collect()
    assert got["best_category"]["category"] == "x" == got["worst_category"]["category"]


def test_answers_are_merged_into_rounds(spark):
    answers = "array<struct<playerId:string,nickname:string,selectedAnswer:string,correct:boolean,responseMs:double,answeredAt:string>>"
    history = spark.createDataFrame([("m", 1, "c", "q", "a", "6-9", [])], f"match_id string, round int, category string, question string, correctAnswer string, ageBand string, answers {answers}")
    events = spark.createDataFrame([("m", 1, 1, "p", "n", "x", False, 5, "2024-01-01 00:00:00", "c", "q", "a", "6-9"), ("m", 1, 2, "p", "n", "y", True, 6, "2024-01-01 00:00:01", "c", "q", "a", "6-9"), ("m", 2, 3, "p", "n", "z", True, None, "2024-01-01 00:00:02", "c2", "q2", "a2", "15+")], "match_id string, round int, event_id int, player_id string, nickname string, selected_answer string, correct boolean, response_ms int, answered_at string, category string, question string, correct_answer string, age_band string")
    got = {r["round"]: r for r in games.merge_answer_events(history, events).collect()}
    assert [x["selectedAnswer"] for x in got[1]["answers"]] == ["y"] and got[2]["question"] == "q2"


def test_keys_of_questions_are_made_for_what_is_counted(spark, tmp_path, monkeypatch):
    told = [(1, "Que rio?", "Tejo", "q::t"), (2, "<b>que RIO?</b>", "tejo", None), (3, "que rio?", "Tejo", None)]
    r = lambda n, q, a, h: (n, "1. Tema", None, "f", None, "6-9", q, a, h, None, [], [("p", "N", "Douro", n == 3, 5.0, None)])
    nested = spark.createDataFrame([("g", "single", "2024-01-01 00:00:00", None, None, None, [], [r(*t) for t in told])], games.GAME)
    flat = games.rounds(games.normalize_games(nested))
    events = games.answers(flat)
    got = {x["question_key"]: (x["times_presented"], x["question"], x["answers_total"], x["correct_total"], [tuple(w) for w in x["top_wrong_answers"] or []]) for x in games.question_stats(flat, events).collect()}
    assert got == {"q::t": (1, "Que rio?", 1, 0, [("Douro", 1)]), "que rio?::tejo": (2, "<b>que RIO?</b>", 2, 1, [("Douro", 1)])}
    written = []
    whole = games.cut
    monkeypatch.setattr(games, "cut", lambda df: (written.append(df.columns), whole(df))[1])
    games.match_insights(games.normalize_games(nested), events)
    games.global_insights(games.normalize_games(nested), flat, events)
    assert not [c for c in written[:3] if "question_key" in c]  # of each round and answer none is made
