"""Telemetry, usage, bank, knowledge, validation and streaming operators on small tables."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import bank, knowledge, telemetry, usage, validation
from tessera.streaming import rollups


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- knowledge -------------------------------------------------------------------------------------------------

RECORD = "knowledge_id string, topic string, fact string, answer string, source string, source_id string, source_url string, priority_pt int, is_active boolean, metadata map<string,string>"
CUR, ADV = knowledge.CURIOSITIES, knowledge.RIDDLES


def record(k, topic, fact, answer="x", source="Wikidata", source_id=None, active=True):
    return (k, topic, fact, answer, source, source_id or f"s-{k}", None, 0, active, {})


def test_exact_duplicates_keep_the_trusted_one(spark):
    df = spark.createDataFrame([record("a-cur-daily-1", CUR, "O rio é azul."), record("b-cur-b51-1", CUR, "o RIO e azul"), record("c", CUR, "outra coisa"), record("d", CUR, "o rio é azul", active=False)], RECORD)
    assert rows(knowledge.dedupe_plan(df), "knowledge_id", "keeper", "reason") == [("a-cur-daily-1", "b-cur-b51-1", "exact_fact")]


def test_similar_texts_and_entities(spark):
    base = "girafa dorme poucos minutos cada noite africana quente"
    df = spark.createDataFrame([record("a", CUR, base), record("b", CUR, base + " sempre"), record("c", CUR, base + " hoje", source_id="Q1"), record("d", CUR, base + " ontem", source_id="Q2")], RECORD)
    got = rows(knowledge.dedupe_plan(df), "knowledge_id", "keeper", "reason")
    assert got == [("b", "a", "similar_fact"), ("c", "a", "similar_fact"), ("d", "a", "similar_fact")]
    only = df.filter("knowledge_id IN ('c', 'd')")
    assert knowledge.dedupe_plan(only).count() == 0  # of different entities


def test_clusters_are_greedy_not_transitive(spark):
    words = [f"palavra{k}" for k in range(12)]
    chain = [" ".join(words[k : k + 10]) for k in range(3)]  # neighbours share 9 of 11, ends 8 of 12
    df = spark.createDataFrame([record(k, CUR, t) for k, t in zip("abc", chain, strict=True)], RECORD)
    assert rows(knowledge.similar_pairs(df, "fact"), "a", "b") == [("a", "b"), ("b", "c")]
    assert rows(knowledge.similar_clusters(df, "fact"), "id", "seed") == [("a", "a"), ("b", "a")]


def greedy(n, pairs):
    seed = {}
    for i in range(n):
        if i in seed:
            continue
        seed[i] = i
        for j in range(i + 1, n):
            if j not in seed and (i, j) in pairs:
                seed[j] = i
    return seed


@pytest.mark.parametrize("chance", [0.02, 0.1, 0.4])
def test_greedy_pass_equals_a_loop(spark, chance):
    import random

    r = random.Random(chance)
    pairs = {(a, b) for a in range(60) for b in range(a + 1, 60) if r.random() < chance}
    got = knowledge.first_come(spark.range(60), spark.createDataFrame(sorted(pairs), "a long, b long"))
    assert {x["id"]: x["seed"] for x in got.collect()} == greedy(60, pairs)


def test_similar_pairs_equal_brute_force(spark):
    import random

    r = random.Random(1)
    texts = {f"k{k:03d}": " ".join(f"termo{r.randrange(14)}" for _ in range(r.randrange(3, 9))) for k in range(120)}
    df = spark.createDataFrame([record(k, CUR, t) for k, t in texts.items()], RECORD)
    sets = {k: set(t.split()) for k, t in texts.items()}
    expected = sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.72)
    assert expected and rows(knowledge.similar_pairs(df, "fact"), "a", "b") == expected


def similar_by_loop(data):
    sets = {k: (topic, {w for w in fact.split() if len(w) > 2}) for k, topic, fact in data}
    alike = lambda a, b: bool(a and b) and len(a & b) / len(a | b) >= 0.72
    return {(a, b) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and alike(sets[a][1], sets[b][1])}


def test_sets_are_compared_once_and_pairs_of_a_set_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(knowledge, "CELL", 4)  # so that sets of many records have several cells
    facts = ["baleia azul mar fundo", "mar azul baleia fundo", "baleia azul mar fundo quente", "gato preto"]
    data = [(f"k{i:03}", (CUR, ADV)[i % 2], facts[i % 7 % 4]) for i in range(60)]
    df = spark.createDataFrame(data, "knowledge_id string, topic string, fact string")
    got = rows(knowledge.similar_pairs(df, "fact", block="topic"), "a", "b")
    assert got == sorted(similar_by_loop(data))
    seen = []
    whole = knowledge.similar_sets
    monkeypatch.setattr(knowledge, "similar_sets", lambda keys, *a, **k: (seen.append(keys.count()), whole(keys, *a, **k))[1])
    knowledge.similar_pairs(df, "fact", block="topic")
    assert seen == [6]  # three sets in each of two topics, not 60 records


def test_copies_are_accepted_as_by_a_loop(spark):
    import random

    draw = random.Random(5)
    words = [f"palavra{k}" for k in range(9)]
    data = [(f"n{i:03}", draw.choice([CUR, CUR, ADV]), " ".join(draw.sample(words, draw.choice([5, 6, 7]))) if i % 11 else "a b") for i in range(150)]
    new = spark.createDataFrame([record(*d) for d in data], RECORD)
    near, taken = similar_by_loop(data), []
    for k, topic, fact in data:
        if not any(t == topic and (f == fact or (topic == CUR and (o, k) in near)) for o, t, f in taken):
            taken.append((k, topic, fact))
    got = knowledge.accept_new(new, new.limit(0)).filter("accepted")
    assert rows(got, "knowledge_id") == [(k,) for k, _, _ in taken]


def test_new_records_against_existing_and_each_other(spark):
    long = "baleia azul respira fora agua durante muito tempo sempre"
    old = spark.createDataFrame([record("e1", CUR, "facto velho"), record("e2", "capital", "Lisboa é a capital", "Lisboa", source_id="Q45"), record("e3", ADV, "branco por fora", "ovo"), record("e4", CUR, long)], RECORD)
    new = spark.createDataFrame([record("n1", CUR, "Facto velho!"), record("n2", "geografia", "A capital chama-se Lisboa", "lisboa", source_id="Q45"), record("n3", ADV, "branco por fora", "Ovo"), record("n4", CUR, long + " talvez"), record("n5", CUR, "novidade absoluta"), record("n6", CUR, "Novidade absoluta.")], RECORD)
    assert rows(knowledge.duplicates_of_existing(new, old), "knowledge_id", "reason", "duplicate_of") == [("n1", "exact_fact", "e1"), ("n2", "same_capital", "e2"), ("n3", "exact_answer_fact", "e3"), ("n4", "similar_fact", "e4")]
    assert [r["knowledge_id"] for r in knowledge.accept_new(new, old).filter("accepted").collect()] == ["n5"]


def test_rejection_reasons_in_order(spark):
    kind = "knowledge_id string, source string, source_id string, qid string, fact_key string, fact string"
    gone = spark.createDataFrame([("r1", "W", "1", "Q1", "capital", "um texto qualquer bastante comprido")], kind)
    new = spark.createDataFrame([("r1", "W", "9", "", "", "a"), ("n1", "W", "1", "", "", "b"), ("n2", "X", "2", "", "", "Um texto, qualquer bastante comprido"), ("n3", "X", "3", "Q1", "capital", "c"), ("n4", "X", "4", "Q1", "rio", "um texto qualquer bastante comprido hoje"), ("n5", "X", "5", "Q2", "rio", "d")], kind)
    got = {r["knowledge_id"]: r["rejection"] for r in knowledge.rejection_reasons(new, gone).collect()}
    assert got == {"r1": "same_id", "n1": "same_source", "n2": "same_fact", "n3": "same_property", "n4": "similar_fact", "n5": None}


def test_only_open_records_are_compared_by_entity(spark, monkeypatch):
    kind = "knowledge_id string, source string, source_id string, qid string, fact_key string, fact string"
    fact = "um texto qualquer bastante comprido"
    gone = spark.createDataFrame([("r1", "W", "1", "Q1", "capital", fact), ("r2", "W", "1", "Q1", "capital", fact + " aqui")], kind)
    data = [("n0", "W", "1", "Q1", "rio", fact + " sempre")] + [(f"n{i}", "X", str(i), "Q1", "rio", (fact + " hoje", "outro assunto inteiramente")[i % 2]) for i in range(1, 41)]
    seen, whole = [], knowledge.similar_sets
    monkeypatch.setattr(knowledge, "similar_sets", lambda keys, t, against: (seen.append((keys.count(), against.count())), whole(keys, t, against))[1])
    got = {r["knowledge_id"]: r["rejection"] for r in knowledge.rejection_reasons(spark.createDataFrame(data, kind), gone).collect()}
    assert got == {"n0": "same_source"} | {f"n{i}": (None if i % 2 else "similar_fact") for i in range(1, 41)}
    assert seen == [(2, 2)]  # two texts against two, not 40 records


def test_policy_and_missing_fields(spark):
    df = spark.createDataFrame([(20, "ADIVINHA", "manual", 0.88, True, None), (20, "X", "Wikidata", 0.86, True, ""), (3, "X", "outra", 0.9, True, None), (3, "X", "outra", 0.93, True, None), (3, "X", "outra", 0.99, True, "k"), (3, "X", None, 0.99, True, None)], "c int, f string, s string, conf double, act boolean, sup string")
    got = [r[0] for r in df.select(knowledge.policy(*[F.col(x) for x in ("c", "f", "s", "conf", "act", "sup")])).collect()]
    assert got == ["confidence_below_minimum", None, "source_not_allowed", None, "blocked_or_superseded", "source_not_allowed"]
    one = spark.range(1).select(knowledge.missing_fields(F.lit(21), F.lit("k"), F.lit("t"), F.lit(" "), F.lit("a"), F.lit("s"), F.lit("i"), F.array(F.lit("6-9")), F.array(F.lit("ADIVINHA")), F.array(F.lit("uma"))).alias("m")).first()["m"]
    assert one == ["category_n", "fact", "clues"]


def test_import_batch_outcomes(spark):
    old = spark.createDataFrame([("k1", "W", "1")], "knowledge_id string, source string, source_id string")
    new = spark.createDataFrame([(1, "k1", "W", "1"), (2, "k2", "W", "1"), (3, "k3", "W", "3"), (4, "k3", "W", "3")], "position int, knowledge_id string, source string, source_id string")
    assert rows(knowledge.import_batch(new, old), "position", "outcome") == [(1, "updated"), (2, "skipped"), (3, "superseded"), (4, "inserted")]


# --- the bank --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("options", "format_", "answer", "loose", "strict"),
    [
        (["Verdadeiro", "<b>Falso</b>"], "VERDADEIRO_FALSO", "verdadeiro", True, True),
        (["Sim", "Não"], "VERDADEIRO_FALSO", "verdadeiro", False, False),
        (["a", "b", "c", "d"], "ESCOLHA", "b", True, True),
        (["a", "a", "c", "d"], "ESCOLHA", "a", True, False),
        (["a", "b", "c", "d"], "ESCOLHA", "x", True, False),
        (["a", "b", "c"], "ESCOLHA", "a", False, False),
        (None, "ESCOLHA", "a", False, False),
    ],
)
def test_option_rules(spark, options, format_, answer, loose, strict):
    df = spark.createDataFrame([(options, format_, answer)], "o array<string>, f string, a string")
    c = [F.col(x) for x in "ofa"]
    assert df.select(bank.valid_options(*c), bank.valid_options_strict(*c)).first()[:] == (loose, bool(strict))


ITEM = "question_hash string, category_n int, category_ns array<int>, age_band string, age_bands array<string>, question string, correct_answer string, options array<string>, format string, knowledge_id string, source string, difficulty int, estimated_difficulty int, difficulty_by_age_band map<string,int>, is_reported boolean, created_at timestamp"


def item(h, cat=1, cats=None, age="6-9", ages=None, difficulty=3, by_age=None, knowledge=None, reported=False):
    return (h, cat, cats, age, ages, "q", "a", ["a", "b", "c", "d"], "ESCOLHA", knowledge, "ai", difficulty, 1, by_age, reported, datetime(2024, 1, 1))


def test_picks_rest_and_prefer_near_difficulties(spark):
    df = spark.createDataFrame([item("exact", difficulty=4), item("near", difficulty=2), item("mapped", difficulty=1, by_age={"6-9": 4}), item("far", difficulty=1), item("other", cat=2), item("wide", cat=2, cats=[1, 2], ages=["6-9"], age="15+"), item("shut"), item("told", reported=True), item("played"), item("fact", knowledge="k1")], ITEM)
    plays = spark.createDataFrame([("played", None, datetime(2024, 1, 2)), ("old", "k1", datetime(2024, 1, 30)), ("far", None, datetime(2023, 12, 31))], "question_hash string, knowledge_id string, played_at timestamp")
    shut = spark.createDataFrame([("shut",)], "question_hash string")
    left = bank.playable(df, shut, plays, "2024-01-31 00:00:00")
    assert {r["question_hash"] for r in left.collect()} == {"exact", "near", "mapped", "far", "other", "wide"}
    tiers = {r["question_hash"]: (r["tier"], r["distance"]) for r in bank.pick_tier(left.filter(bank.category_matches(1) & bank.age_matches("6-9")), "6-9", 4).collect()}
    assert tiers == {"exact": (0, 0), "mapped": (0, 0), "near": (1, 2), "far": (2, 0), "wide": (1, 1)}
    assert bank.pick(left, 1, "6-9", 4, seed=5).first()["question_hash"] in ("exact", "mapped")
    assert bank.pick_least_recent(df.filter("question_hash IN ('far', 'played', 'exact')"), plays, most=3).first()["question_hash"] == "exact"


def test_batches_and_merges(spark):
    old = spark.createDataFrame([item("h1")], ITEM)
    batch = spark.createDataFrame([(k, *item(h, cat=c)) for k, (h, c) in enumerate([("h1", 1), ("h2", 1), ("h2", 1), ("h3", 1)])], f"position int, {ITEM}")
    shut = spark.createDataFrame([("h3", datetime(2024, 1, 1))], "question_hash string, reported_at timestamp")
    assert rows(bank.classify_import(batch, old, shut), "position", "reason") == [(0, "exists"), (1, "inserted"), (2, "exists"), (3, "blocked")]
    assert {r["question_hash"] for r in bank.import_items(batch, old, shut).collect()} == {"h1", "h2"}
    facts = spark.createDataFrame([("k1", True)], "knowledge_id string, is_active boolean")
    flagged, off, blocked = bank.report(old, facts, shut, spark.createDataFrame([("h1", "k1"), ("h3", None)], "question_hash string, knowledge_id string"), "2024-02-01")
    assert flagged.first()["is_reported"] and not off.first()["is_active"] and blocked.count() == 2
    merged = bank.merge_taxonomy(spark.createDataFrame([item("h", cats=[2, 1]), item("h", cats=[3], ages=["15+"])], ITEM)).first()
    assert merged["category_ns"] == [1, 2, 3] and set(merged["age_bands"]) == {"6-9", "15+"}


# --- telemetry and usage ---------------------------------------------------------------------------------------

EVENT = "id int, ts timestamp, outcome string, category int, format_id string, source string, provider string, model string, attempt int, game_mode string, issue_codes array<string>, issue_messages array<string>, question_hash string, validated_at timestamp, validated_edited boolean, dismissed_at timestamp"


def event(k, outcome="rejected", codes=("C",), source="ai", validated=None, edited=None, dismissed=None, hash_="h"):
    return (k, datetime(2024, 1, 1, 0, k), outcome, 20, "F", source, "p", "m", 1, None, list(codes), ["msg"], hash_, validated, edited, dismissed)


def test_issue_details_keep_the_newest_open_ones(spark):
    day = datetime(2024, 1, 2)
    df = spark.createDataFrame([event(k) for k in range(12)] + [event(20, validated=day, edited=False), event(21, dismissed=day), event(22, hash_="pending"), event(23, "accepted", ())], EVENT)
    pending = spark.createDataFrame([("pending",)], "question_hash string")
    r = telemetry.issue_details(df, pending).first()
    assert (r["count"], r["validated"], r["validated_as_is"], r["dismissed"], r["open"], r["last"]["id"]) == (15, 1, 1, 1, 12, 22)
    assert r["recent_open"] == list(range(11, 1, -1))


def test_edits_have_three_values(spark):
    c = lambda x: F.lit(x)
    opts = F.array(F.lit("a"))
    got = spark.range(1).select(telemetry.edited(c("q"), c("a"), opts, c("q "), c("a"), opts), telemetry.edited(c("q"), c("a"), opts, c("q2"), c("a"), opts), telemetry.edited(c(""), c("a"), opts, c("q"), c("a"), opts)).first()
    assert got[:] == (False, True, None)


def test_usage_sums_start_anew_each_day(spark):
    calls = spark.createDataFrame([(datetime(2024, 1, 1, 23, 58), "P", "m", True, 5, 10, False, 1, None, False), (datetime(2024, 1, 2, 0, 1), "p ", "m", False, 7, None, True, 9, "app_limit", False), (datetime(2024, 1, 2, 0, 2), "p", "", True, 1, 31, False, 2, None, True)], "ts timestamp, provider string, model string, ok boolean, tokens int, latency_ms int, limit_hit boolean, quota_used int, error_kind string, replenish boolean")
    roll = usage.rollup(calls, 5)
    series = {r["key"]: r for r in usage.bucket_series(roll, "2024-01-02 00:04:00", 1).collect()}
    assert len(series) == 12 and series["2024-01-01T23:55"]["cumulative"] == 1 and series["2024-01-02T00:00"]["cumulative"] == 2
    assert series["2024-01-02T00:00"]["cumulative_tokens"] == 8 and series["2024-01-02T00:00"]["other_errors"] == 0
    total = usage.series_totals(usage.bucket_series(roll, "2024-01-02 00:04:00", 1)).first()
    assert total["avg_latency_ms"] == 21 and total["peak_quota_pressure"] == 9  # the mean of 10 and 31, rounded up
    assert usage.merge_rollups(roll, roll).agg(F.sum("request_count"), F.max("quota_used_peak")).first()[:] == (6, 9)


# --- validation ------------------------------------------------------------------------------------------------


ITEMS = "id int, question string, answer string, options array<string>, clues array<string>, format string, age_band string, difficulty int, category_n int, is_mc boolean"
CAPITAL = {"question": "Qual é a capital de Portugal?", "answer": "Lisboa", "options": ["Lisboa", "Porto", "Braga", "Faro"], "clues": [], "format": "RESPOSTA_DIRETA", "age_band": "15+", "difficulty": 2, "category_n": 2, "is_mc": True}
#: What of an item is changed, and the codes or parts of messages that its issues then have; a leading - means without.
CASES = [
    ({}, ["-"]),
    ({"question": " "}, ["STRUCTURE_INCOMPLETE"]),
    ({"options": ["Lisboa", "lisboa", "Porto", "Faro"]}, ["MC_MULTIPLE_CORRECT", "MC_NEAR_DUPLICATE"]),
    ({"options": ["Lisboa"]}, ["MC_INSUFFICIENT_OPTIONS"]),
    ({"question": "Quem pintou a Mona Lisa?", "answer": "Leonardo", "options": ["Leonardo", "banana", "azul", "futebol"]}, ["classes conceptuais diferentes", "MC_ABSURD_DISTRACTORS", "a pergunta pede uma pessoa"]),
    ({"question": "Que invento mudou as cartas?", "answer": "o telefone fixo", "options": ["o telefone fixo", "Portugal", "a rádio portátil", "a lâmpada nova"]}, ["países isolados"]),
    ({"question": "Que invento mudou as cartas?", "answer": "o telefone fixo", "options": ["o telefone fixo", "1876", "a rádio portátil", "a lâmpada nova"]}, ["anos isolados"]),
    ({"question": "Que invento mudou as cartas?", "answer": "o telefone fixo", "options": ["o telefone fixo", "gasolina", "a rádio portátil", "a lâmpada nova"]}, ["combustíveis ou substâncias"]),
    ({"question": "Que sigla guarda os genes?", "answer": "ADN", "options": ["ADN", "uma molécula muito comprida", "um processo bastante lento", "outra coisa muito diferente"]}, ["MC_TOO_OBVIOUS"]),
    ({"question": "Que sigla guarda os genes?", "answer": "uma molécula muito comprida", "options": ["uma molécula muito comprida", "ADN", "ARN", "PCR"]}, ["-MC_TOO_OBVIOUS"]),
    ({"question": "Que desporto se joga no gelo?", "answer": "Hóquei", "options": ["Hóquei", "Futebol", "Ténis", "Curling"]}, ["com pergunta sobre gelo"]),
    ({"question": "Quanto é 12 dividido por 4?", "answer": "4", "options": ["4", "3", "12", "6"]}, ["confirma o quociente"]),
    ({"question": "Quanto é 12 dividido por 4?", "answer": "3", "options": ["3", "12", "4", "5"]}, ["não devem incluir dividendo e divisor", "evita dividendo e divisor"]),
    ({"question": "Quem é o cowboy?", "answer": "Buzz", "options": ["Buzz", "Woody", "Wooody", "Rex"]}, ["MC_NEAR_DUPLICATE"]),
    ({"question": "Quem é o cowboy?", "answer": "Carro", "options": ["Carro", "Caro", "Livro", "Mesa"], "difficulty": 3}, ["-MC_NEAR_DUPLICATE"]),
    ({"question": "Em que ano foi?", "answer": "1990", "options": ["1990", "1991", "1992", "1993"], "difficulty": 3}, ["anos demasiado próximos", "-MC_NEAR_DUPLICATE"]),
    ({"question": "Em que ano foi?", "answer": "1990", "options": ["1990", "1890", "1790", "1690"], "difficulty": 5}, ["anos demasiado afastados"]),
    ({"question": "Como se chama?", "answer": "Mariana", "options": ["Mariana", "Marianna", "Pedro", "Rui"], "difficulty": 1}, ["quase iguais à resposta"]),
    ({"options": ["Lisboa", "uma opção que tem palavras a mais", "Porto", "Faro"], "age_band": "6-9"}, ["MC_OPTIONS_TOO_LONG", "máx. 4 palavras"]),
    ({"question": "Que animal nada?", "answer": "Golfinho", "options": ["Golfinho", "Ilusão de Müller", "Tigre", "5 a 10 minutos"]}, ["ilusão de ótica ou números", "perguntas diferentes"]),
    ({"question": "A noite escura cai cedo?", "answer": "tarde", "options": ["tarde", "noite escura", "sol", "lua"]}, ["MC_OPTION_LEAKS_QUESTION"]),
    ({"answer": "Ursinho Pooh", "options": ["Ursinho Pooh", "Winnie", "Tigre", "Leitão"]}, ["alcunha e nome", "Ursinho Puff"]),
    ({"question": "O rio Amazonas chama-se como?", "answer": "Amazonas"}, ["ANSWER_LEAKED"]),
    ({"question": "Onde fica a torre antiga e alta?", "answer": "torre muito antiga"}, ["-ANSWER_LEAKED"]),
    ({"question": "Que torre antiga e muito velha é esta?", "answer": "a torre antiga velha"}, ["ANSWER_LEAKED"]),
    ({"question": "É verdadeiro ou falso que o mar é azul?", "answer": "verdadeiro"}, ["-ANSWER_LEAKED"]),
    ({"question": "Os portugueses são simpáticos?"}, ["PT_STEREOTYPE"]),
    ({"question": "Que cidade pode ser a capital?"}, ["MULTIPLE_ANSWERS"]),
    ({"question": "Это вопрос?"}, ["PT_INVALID_SCRIPT"]),
    ({"answer": "Summer", "age_band": "10-15"}, ["PT_ENGLISH_ONLY"]),
    ({"answer": "Summer", "age_band": "15+"}, ["-PT_ENGLISH_ONLY"]),
    ({"answer": "of the sea", "age_band": "10-15"}, ["PT_ENGLISH_ONLY"]),
    ({"answer": "of the país", "age_band": "10-15"}, ["-PT_ENGLISH_ONLY"]),
    ({"answer": "New York", "age_band": "10-15"}, ["-PT_ENGLISH_ONLY", "PT_COUNTRY_NAME", "Nova Iorque"]),
    ({"question": "Onde pára o ônibus?"}, ["brasileirismo detectado"]),
    ({"question": "No futebol, quem é o goleiro?"}, ["guarda-redes"]),
    ({"question": "Quem é o goleiro?"}, ["-guarda-redes"]),
    ({"question": "Onde está ele?", "format": "QUEM_E", "answer": "1234"}, ['começar por "Quem"', "deve ser uma pessoa"]),
    ({"question": "A água vem das ___ quando chove", "format": "COMPLETA"}, ["sem texto depois", "última parte da frase"]),
    ({"question": "A água vem das ___.", "format": "COMPLETA"}, ["-COMPLETA"]),
    ({"question": "A água vem de onde?", "format": "COMPLETA"}, ["lacuna visível"]),
    ({"question": "Onde fica o rio?", "format": "ONDE_FICA"}, ["ONDE_FICA ambíguo"]),
    ({"question": "Quem pintou?", "format": "QUANDO"}, ["QUANDO deve pedir"]),
    ({"question": "Sabias que o mel não se estraga?", "format": "CURIOSIDADE", "answer": "Sim", "options": ["Sim", "Talvez"]}, ["inclui \"Verdadeiro ou Falso?\"", "resposta tem de ser Verdadeiro", "só Verdadeiro e Falso", "têm de ser Verdadeiro e Falso"]),
    ({"question": "Sabias que o mel dura? Verdadeiro ou falso?", "format": "CURIOSIDADE", "answer": "Verdadeiro", "options": ["Falso", "Verdadeiro"]}, ["-CURIOSIDADE"]),
    ({"question": "Sou redonda, o que sou?", "answer": "bola", "format": "ADIVINHA", "clues": ["sou bola", "Sou bola"]}, ["pistas duplicadas", "ADIVINHA_CLUE_LEAKS_ANSWER"]),
    ({"question": "Sou redonda, o que sou?", "answer": "bola", "format": "ADIVINHA", "clues": ["rola"], "options": ["bola", "12%", "sol", "lua"]}, ["ADIVINHA_MISSING_CLUES", "ADIVINHA_MC_BAD_DISTRACTORS"]),
    ({"question": "Que carro voa?", "category_n": 17}, ["Categoria 19"]),
    ({"question": "Que carro voa?", "category_n": 19}, ["-CATEGORY_MISMATCH"]),
    ({"age_band": "6-9", "difficulty": 5}, ["DIFFICULTY_OUT_OF_RANGE", "demasiado difícil para 6–9"]),
    ({"age_band": "10-15", "difficulty": 1}, ["-DIFFICULTY_OUT_OF_RANGE"]),
    ({"age_band": "15+", "difficulty": 1}, ["-DIFFICULTY_OUT_OF_RANGE"]),
    ({"question": "Qual é a cor do céu?", "difficulty": 4}, ["DIFFICULTY_EASIER_THAN_REQUESTED", "AGE_TOO_EASY"]),
    ({"question": "O que é a entropia?", "difficulty": 2}, ["DIFFICULTY_HARDER_THAN_REQUESTED"]),
    ({"question": "palavra " * 19, "age_band": "6-9"}, ["pergunta demasiado longa"]),
    ({"question": "x" * 111, "age_band": "6-9"}, ["pergunta demasiado longa", "palavras demasiado complexas"]),
    ({"question": "x" * 111, "age_band": "10-15"}, ["-pergunta demasiado longa"]),
    ({"question": "Quem compôs como Mozart?", "age_band": "6-9"}, ["personagem ou tema demasiado avançado"]),
]


def test_rules_of_items(spark):
    from tessera.operators import items

    rows_ = [(k, *({**CAPITAL, **change}[c] for c in CAPITAL)) for k, (change, _) in enumerate(CASES)]
    found = items.with_issues(spark.createDataFrame(rows_, ITEMS)).withColumn("score", validation.score(F.col("issues")))
    got = {r["id"]: r for r in found.collect()}
    for k, (change, wanted) in enumerate(CASES):
        told = [f"{i['code']} {i['message']}" for i in got[k]["issues"]]
        assert len(set(told)) == len(told)
        for w in wanted:
            if w == "-":
                assert not told, told
            elif w.startswith("-"):
                assert not [t for t in told if w[1:] in t], (change, w, told)
            else:
                assert [t for t in told if w in t], (change, w, told)
    assert got[0]["score"] == 100 and got[1]["score"] == 0 and got[3]["score"] == 88


def test_only_difficulty(spark):
    from tessera.operators import items

    df = spark.createDataFrame([(["DIFFICULTY_OUT_OF_RANGE", " "],), (["DIFFICULTY_HARDER_THAN_REQUESTED", "PT_BRASILISM"],), ([],), (None,)], "c array<string>")
    assert [r[0] for r in df.select(items.only_difficulty(F.col("c"))).collect()] == [True, False, False, False]


def test_riddles_from_facts(spark):
    from tessera.operators import records

    fact = "knowledge_id string, fact string, answer string, source_id string, confidence double, is_active boolean, age_bands array<string>, priority_pt int"
    df = spark.createDataFrame([("k1", "Sou redonda", "bola", "s", 0.9, True, ["6-9"], 1), ("k2", "Sou alta", "Sem resposta", "s", 0.9, True, ["6-9"], 2), ("k3", "Sou azul", "mar", "s", 0.9, True, ["15+"], 3)], fact)
    pool = F.array(*[F.lit(x) for x in ("Sol", "Lua", "Bola", "Mesa", "Faca")])
    made = records.replenish(spark.createDataFrame([], ITEM), spark.createDataFrame([], "question_hash string"), df, "6-9", pool).collect()
    assert [(r["knowledge_id"], r["reason"]) for r in made] == [("k1", "inserted")]
    (options,) = spark.range(1).select(records.fallback_options(F.lit("bola"), pool).alias("o")).first()
    assert len(set(options)) == 4 and "bola" in options and "Bola" not in options
    assert spark.range(1).select(records.fallback_options(F.lit("sol"), F.array(F.lit("Sol"), F.lit("Lua"))).alias("o")).first()["o"] is None


def test_trim_keeps_the_newest_without_a_global_sort(spark):
    day = lambda k: datetime(2024, 1, 1 + k // 3)
    df = spark.createDataFrame([(k, day(k)) for k in range(20)] + [(20, None)], "id int, ts timestamp")
    newest = sorted(range(20), key=lambda k: (-day(k).timestamp(), k))
    for most in (1, 5, 20, 21, 50):
        assert {r["id"] for r in telemetry.trim(df, most).collect()} == set(([*newest, 20])[:most])
    assert telemetry.trim(df.limit(0), 3).count() == 0 and telemetry.clear(df).count() == 0


def test_overrides_with_wildcards(spark):
    issue = validation.ISSUE
    df = spark.createDataFrame([(1, "6-9", "F", [("A", "x", "m"), ("B", "x", "n")]), (2, "15+", "F", [("A", "x", "m")])], f"id int, age_band string, format string, issues array<{issue}>")
    overrides = spark.createDataFrame([("A", None, "6-9", None)], "code string, message string, age_band string, format string")
    got = {r["id"]: [i["code"] for i in r["issues"]] for r in validation.drop_overridden(df, overrides).collect()}
    assert got == {1: ["B"], 2: ["A"]}


def test_safety_sees_through_disguises(spark):
    rules = [validation.SafetyRule("feio", "block"), validation.SafetyRule("muito mau", "block", "phrase"), validation.SafetyRule("tolo", "rewrite", replacement="amigo")]
    texts = ["és f3i0", "f e i o mesmo", "feioso", "muito  máu.", "Um tolo", "nada"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(validation.safety_matches(F.col("t"), rules).alias("m"), validation.sanitize(F.col("t"), rules).alias("s")).collect()
    assert [[m["term"] for m in r["m"]] for r in got] == [["feio"], ["feio"], [], ["muito mau"], ["tolo"], []]
    assert [r["s"]["action"] for r in got] == ["block", "block", "ok", "block", "rewrite", "ok"] and got[4]["s"]["text"] == "Um amigo"


def test_rules_from_three_equal_evaluations(spark):
    kind = "id int, age string, format string, issues array<string>, field_errors array<struct<field:string,ai_value:string,human_value:string>>, engine_layers map<string,int>, human_layers map<string,int>"
    one = lambda k: (k, "6-9", "F", ["too-long"], [("difficulty", "4", "2")], {"age": 12}, {"age": 2})
    got = {r["rule_key"]: r for r in validation.derive_rules(spark.createDataFrame([one(k) for k in range(3)], kind)).collect()}
    assert set(got) == {"issue|6-9|*|too-long", "difficulty|6-9|4->2", "difficulty-cap|6-9", "layer-over|age|6-9"}
    assert {(r["evidence"], r["confidence"], r["level"]) for r in got.values()} == {(3, 0.59, "medium")}
    assert validation.derive_rules(spark.createDataFrame([one(0), one(1)], kind)).count() == 0


def test_repeats_within_the_last_eight(spark):
    texts = ["qual capital portugal", "qual grande capital portugal"] + [f"outra coisa {chr(97 + k) * 5}" for k in range(9)] + ["qual capital portugal"]
    df = spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], "session string, position int, question string")
    assert [r["position"] for r in validation.repeated_texts(df).filter("repeats").orderBy("position").collect()][:1] == [1]
    assert not validation.repeated_texts(df).filter("position = 11").first()["repeats"]


# --- streaming -------------------------------------------------------------------------------------------------


def test_streaming_buckets_equal_the_batch(spark, tmp_path):
    kind = "id int, ts timestamp, provider string, model string, ok boolean, tokens int, latency_ms int, quota_used int"
    calls = spark.createDataFrame([(k, datetime(2024, 7, 1, 10, k % 20), f"p{k % 2}", "m", k % 3 > 0, k, k * 2, k) for k in range(60)], kind)
    calls.write.parquet(f"{tmp_path}/in")
    stream = rollups.usage_buckets(spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/in"))
    rollups.write_table(stream, "buckets", f"{tmp_path}/check").awaitTermination()
    batch = usage.rollup(calls.withColumns({"limit_hit": F.lit(False), "error_kind": F.lit(None).cast("string"), "replenish": F.lit(False)}), 5)
    columns = ["provider", "model", "request_count", "error_count", "token_count", "quota_used_peak"]
    local = lambda df: sorted((str(r["bucket_start"]), *[r[c] for c in columns]) for r in df.collect())
    assert local(spark.table("buckets")) == local(batch)


def test_a_log_is_appended_once(spark, tmp_path):
    calls = spark.createDataFrame([(k % 5, datetime(2024, 7, 1, 10, k)) for k in range(10)], "id int, ts timestamp")
    calls.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        rollups.append_parquet(rollups.once(spark.readStream.schema(calls.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 3, 4]


# --- keys, histories, review queue, picks ----------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("geo|Lisboa|capital|de", "historia|lisboa|Capital|", True),
        ("geo|Lisboa|capital|de", "geo|Porto|capital|de", False),
        ("capital lisboa", "geo|Lisboa|capital|de", True),
        ("lisboa", "geo|lisboa|capital|x", True),
        ("rio", "rio tejo", True),
        ("tejo", "rio tejo grande largo", False),
        ("o rio tejo", "o rio tejo nasce", True),
        ("", "", False),
    ],
)
def test_keys_match(spark, a, b, same):
    from tessera.functions import keys

    assert spark.range(1).select(keys.keys_match(F.lit(a), F.lit(b))).first()[0] is same


def test_ids_and_suffixes(spark):
    from tessera.functions import keys

    row = spark.range(1).select(keys.game_question_id(F.lit("rmq-3-10-15-1abc")).alias("a"), keys.game_question_id(F.lit("rmq-33-6-9-x")).alias("b"), keys.without_true_false(F.lit("O sol é uma estrela. Verdadeiro ou Falso?")).alias("c")).first()
    assert row["a"][:] == (3, "10-15", "1abc") and row["b"] is None and row["c"] == "O sol é uma estrela"


def test_snapshots_slices_and_runs(spark):
    from tessera.operators import history

    kind = "position int, q string, a string, question_hash string, ts timestamp"
    day = lambda d: datetime(2024, 1, d)
    df = spark.createDataFrame([(1, "q", "a", "h", day(20)), (2, "q", "a", "h", day(25)), (3, "x", "y", "", day(26)), (4, "x", "y", None, day(27)), (5, "o", "o", "old", datetime(2023, 1, 1))], kind)
    assert sorted(r["position"] for r in history.snapshot(df, "2024-01-31 00:00:00").collect()) == [2, 4]
    runs = spark.createDataFrame([("s", 1, "A"), ("s", 2, "B"), ("s", 3, "B"), ("t", 1, "A")], "k string, n int, f string")
    assert rows(history.trailing_run(runs, "k", "n", "f"), "k", "f", "run") == [("s", "B", 2), ("t", "A", 1)]
    assert rows(history.recent_slice(runs, "k", "n", 2), "k", "n") == [("s", 2), ("s", 3), ("t", 1)]
    store = spark.createDataFrame([("s", ["q1", "q2"], ["a1"])], "k string, questions array<string>, answers array<string>")
    assert rows(history.entries_from_parallel(store, {"questions": "q", "answers": "a"}), "position", "q") == [(0, "q1"), (1, "q2")]
    calls = spark.createDataFrame([("c", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 1, 2)] + [("c", datetime(2024, 1, 1, 0, 1, 1))], "client string, ts timestamp")
    assert [r["allowed"] for r in history.over_limit(calls, "client", "ts", 2).orderBy("ts").collect()] == [True, True, False, True]


def test_review_queue(spark):
    from tessera.functions.text import question_hash
    from tessera.operators import review

    kind = "id int, ts timestamp, question_text string, answer_text string, issue_codes array<string>"
    when = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, when, "q", "a", ["DIFFICULTY_OUT_OF_RANGE"]), (2, when, "<b>q</b>", "a", ["DIFFICULTY_HARDER_THAN_REQUESTED"]), (3, when, "r", "a", ["OTHER", "DIFFICULTY_HARDER_THAN_REQUESTED"]), (4, when, "s", "a", ["DIFFICULTY_HARDER_THAN_REQUESTED"]), (5, when, "", "a", ["DIFFICULTY_HARDER_THAN_REQUESTED"])], kind)
    done = spark.range(1).select(question_hash(F.lit("s"), F.lit("a")).alias("question_hash"))
    assert rows(review.candidates(df, done), "id", "reason") == [(1, "queued"), (2, "skipped"), (3, "skipped"), (4, "already_reviewed"), (5, "skipped")]
    queue = spark.createDataFrame([("a", "pending", 1), ("b", "approved", 1)], "question_hash string, status string, n int")
    new = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], "question_hash string, n int")
    assert rows(review.merge_queue(queue, new), "question_hash", "status", "n") == [("a", "pending", 2), ("b", "approved", 1), ("c", "pending", 2)]
    fixed = spark.range(1).select(review.corrections({"d": F.lit(4), "f": F.lit("x")}, {"d": F.lit(2), "f": F.lit("x")}).alias("c")).first()["c"]
    assert [tuple(x) for x in fixed] == [("d", "4", "2")]


def test_picks(spark):
    from tessera.operators import picks

    drawn = [picks.weighted(spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 9.0)], "k string, w double"), "k", "w", s).first()["k"] for s in range(30)]
    assert "a" not in drawn and drawn.count("c") > drawn.count("b") > 0
    df = spark.createDataFrame([(["x", "y", "y"],), (["x"],), ([],), (["y", "y"],)], "r array<string>")
    assert [r[0] for r in df.select(picks.pool(("x", "y", "z"), F.col("r"), 2)).collect()] == [["x", "z"], ["y", "z"], ["x", "y", "z"], ["x", "z"]]
    models = spark.createDataFrame([("p", 1, "p1", 1, False), ("p", 1, "p2", 2, False), ("q", 2, "q1", 1, False), ("r", 3, "r1", 1, True)], "provider string, provider_order int, model string, model_order int, is_open boolean")
    line = lambda **o: [r["model"] for r in picks.interleaved(models, **o).orderBy("position").collect()]
    assert line() == ["p1", "q1", "p2"] and line(priority="q") == ["q1", "p1", "p2"] and line(one_each=True) == ["p1", "q1"]
    cover = spark.createDataFrame([(1, "6-9", 3), (2, "6-9", 1), (1, "15+", 0)], "category int, age string, count int")
    assert picks.sparse_cell(cover, 1).first()["age"] == "15+" and picks.sparse_cell(cover, 1, "15+", balance=True).first()["category"] == 2
    assert spark.range(1).select(picks.least_used_position(F.array(*[F.lit(x) for x in (0, 1, 3, 0)]), 4, F.lit(7))).first()[0] == 2


def test_stats_input_is_a_top_k_of_each_kind(spark):
    from tessera.operators import telemetry

    rows = [(f"{k:03}", k // 3, ["accepted", "rejected", "parse_error", "other", None][k % 5]) for k in range(200)]
    got = telemetry.stats_input(spark.createDataFrame(rows, "id string, ts long, outcome string"), 7, 9)
    newest = lambda kinds, cap: sorted((r for r in rows if r[2] in kinds), key=lambda r: (-r[1], r[0]))[:cap]
    assert sorted(tuple(r) for r in got.collect()) == sorted(newest(["accepted"], 7) + newest(["rejected", "parse_error", "api_error"], 9))
    plan = got._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Window" not in plan


# --- records -----------------------------------------------------------------------------------------------------


def test_records_of_large_numbers(spark, tmp_path):
    from tessera.plans import records

    numbers = [(7, "a b", "T", "Brand#1", 6, 1.0), (900_001, "c d", "T", "Brand#2", 6, 1.0)]
    spark.createDataFrame(numbers, "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    made = records.record_table(spark, str(tmp_path)).select(F.unix_seconds("created_at").alias("at"))
    assert rows(made, "at") == [(1704067200 + 7 * 2477,), (1704067200 + 900_001 * 2477,)]
    assert [r["total"] for r in records.record_inventory(spark, str(tmp_path)).filter("grain = 'all'").collect()] == [2]


def test_small_files_are_dealt_out(spark, tmp_path):
    from tessera.plans import records

    spark.range(40).selectExpr("id AS p_partkey", "1 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for query in (records.rss_entries, records.listed_riddles, records.place_names):
        assert query(spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
