"""Reported-fact rules: one item for each rule, the index against trying every rule, and the levels that items ask for."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import items, reported

ITEMS = "id int, question string, answer string, options array<string>, clues array<string>, format string, age_band string, difficulty string, category_n int, is_mc boolean"
MAP = "Tenho cidades mas não casas, montanhas mas não árvores, água mas não peixes. O que sou?"
#: For each rule an item that breaks it: question, answer, options, format.
BROKEN = {
    1: ("Quem usa chapéu de cowboy em Toy Story?", "Woody"),
    2: ("Que ursinho da Disney adora mel?", "Ursinho Pooh"),
    3: ("Qual personagem usa chapéu?", "Woody", ["Woody", "Jessie"]),
    4: ("Que animal dorme com um olho aberto?", "Golfinho"),
    5: ("Quem foi a primeira mulher a ganhar?", "Steven Spielberg"),
    6: ("Que realizador foi a primeira mulher a ganhar?", "x"),
    7: ("Com A Lista de Schindler, quem foi a primeira mulher premiada?", "x"),
    8: ("Que animal é o maior e mede metros de altura?", "Zebra"),
    9: ("Qual é o maior animal terrestre?", "A zebra"),
    10: ("Se chove, que acessório levas nas mãos?", "Luvas"),
    11: ("Que cantor tem olhos azul mar?", "x"),
    12: ("O que é um mapa?", "Tipo de desenho"),
    13: ("O que é o arco-íris?", "Um desenho"),
    14: ("O que é um arco?", "Desenho de cores"),
    15: ("Em que difere a bica do galão, além da proporção?", "O café"),
    16: (MAP, "Mapa", ["Mapa", "Globo", "Livro", "Mar"]),
    17: ("Onde nasceu o pastel de nata?", "Porto"),
    18: ("Onde fica a origem da francesinha?", "Lisboa"),
    19: ("A chita é do traje de Viana?", "x"),
    20: ("Que prato leva bacalhau?", "Bacalhau à Brás", ["Bacalhau à Brás", "Bacalhau com natas"]),
    21: ("O que emite pulsações como um pulsar?", "x"),
    22: ("Merckx venceu o Tour de France em 1975?", "x"),
    23: ("Que vantagem de 3 dias teve na Volta?", "x"),
    24: ("Quem foi a engenheira?", "James Watt"),
    25: ("Roald Dahl escreveu sobre um rato que queria ser rei?", "x"),
    26: ("De que é a rua?", "asfato"),
    27: ("Como é a estrada para os carros?", "x"),
    28: ("A autoestrada é feita de quê?", "Alcatrão"),
    29: ("Que rato da Disney faz queijo?", "Jerry"),
    30: ("Que rato da Disney faz queijo?", "Mickey"),
    31: ("Que designer criou a sapatilha de madeira?", "Manuel Branco"),
    32: ("Tem asas e penas mas não voa?", "Pato de borracha"),
    33: ("O Nilo é o rio mais longo. Verdadeiro ou falso?", "x"),
    34: ("Quem marcou no Mundial de 2026?", "x"),
    35: ("Quem ganhou a Copa do Mundo?", "x"),
    36: ("Que cantor usa chapéu e óculos?", "x"),
    37: ("O que é a flor da planta?", "x", [], "O_QUE_E"),
    38: ("O que é a raiz da planta?", "Raiz comprida", [], "O_QUE_E"),
    39: ("O que é?", " sem resposta "),
    40: ("Tem penas e não é um pássaro?", "Avião"),
    41: ("Tem dentes e não morde?", "Relógio"),
    42: ("Que cão fala?", "Burro"),
    43: ("Quem foi o líder da Revolução dos Cravos?", "Otelo"),
    44: ("Tenho costas e não tenho corpo", "Alfinete"),
    45: ("Quem marcou na final da Liga dos Campeões de 1998?", "Paulo Futre"),
    46: ("O que tem padrão vermelho, branco, vermelho?", "x"),
    47: ("Quem quis romper com Haydn em 1781?", "x"),
    48: ("Se comer me quererias", "Uma cabra no milho"),
}
CLEAN = [("Quem usa chapéu em Toy Story?", "Woody"), ("Onde nasceu o pastel de nata?", "Em Belém"), ("Que rato da Disney faz queijo?", "Remy"), ("O que é a raiz da planta?", "Raiz", [], "OUTRO"), (None, None, None, None), ("", "", [None], ""), ("Tem dentes e não morde?", "Relógio ou pente"), ("Que prato leva bacalhau?", "Bacalhau", ["Carne"])]


def judged(spark, rows, indexed):
    rows = [(k, q, a, *(rest + [[], ""][len(rest) :])) for k, (q, a, *rest) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id int, q string, a string, options array<string>, format string")
    q, a = F.coalesce("q", F.lit("")), F.coalesce("a", F.lit(""))
    df = df.withColumns({"q": q, "a": a, **reported.fields(q, a, F.col("options"))})
    return {r["id"]: [i["code"][:7] for i in r["issues"]] for r in df.select("id", reported.issues(indexed=indexed).alias("issues")).collect()}


def test_every_rule_is_broken_by_its_item_and_the_index_changes_nothing(spark):
    assert len(reported.RULES) == len(BROKEN) == 48
    found = judged(spark, list(BROKEN.values()), True)
    for k, number in enumerate(BROKEN):
        assert f"FACT_{number:02d}" in found[k], (number, found[k])
    assert not any(judged(spark, CLEAN, True).values())
    r = random.Random(2)
    parts = [w for q, a, *_ in BROKEN.values() for w in (q, a)]
    mixed = [(" ".join(r.sample(parts, 3)), r.choice(parts), r.sample(parts, 2), r.choice(["", "O_QUE_E"])) for _ in range(300)]
    rows = [*BROKEN.values(), *CLEAN, *mixed]
    one, all_ = judged(spark, rows, True), judged(spark, rows, False)
    assert one == all_ and len(Counter(c for x in one.values() for c in x)) == 48


def test_confusing_and_factual(spark):
    found = spark.range(1).select(F.expr("array(named_struct('code', 'FACT_09', 'message', 'zebra'), named_struct('code', 'x', 'message', 'pergunta ambígua — a'), named_struct('code', 'FACT_29_PERGUNTA_CONFUSA_RATO_QUE_FA', 'message', null), named_struct('code', null, 'message', 'formulação estranha'))").alias("i"))
    assert [i["code"] for i in found.select(reported.factual(F.col("i")).alias("f")).first()["f"]] == ["FACT_09"]


def difficulty_codes(spark, rows):
    df = spark.createDataFrame([(k, q, "x", [], [], "RESPOSTA_DIRETA", age, d, 1, False) for k, (q, age, d) in enumerate(rows)], ITEMS)
    out = items.each_issue(items.with_issues(df), "id").filter("issue.code LIKE 'DIFFICULTY%'").select("id", "issue.code", "issue.message").collect()
    return {k: sorted((r["code"], r["message"]) for r in out if r["id"] == k) for k in range(len(rows))}


def test_missing_and_odd_levels_count_as_the_least(spark):
    easy, hard = "Quem pintou o quadro azul?", "Quem explicou o teorema e o quantum?"
    rows = [(easy, "15+", None), (easy, "15+", "0"), (easy, "15+", "muito"), (easy, "15+", ""), (easy, "15+", "5"), (easy, "15+", "4.4"), (easy, "15+", "3.5"), (easy, "6-9", "9"), (hard, "15+", None), (hard, "15+", "5")]
    found = difficulty_codes(spark, rows)
    assert not any(found[k] for k in range(4))
    assert found[4] == [("DIFFICULTY_EASIER_THAN_REQUESTED", "dificuldade pedida 5 mas estimada 2 — pergunta demasiado fácil para o nível pedido")]
    assert found[5] == found[6] == [("DIFFICULTY_EASIER_THAN_REQUESTED", "dificuldade pedida 4 mas estimada 2 — pergunta demasiado fácil para o nível pedido")]
    assert found[7] == [("DIFFICULTY_OUT_OF_RANGE", "dificuldade 9 incompatível com faixa 6-9")]
    assert found[8] == [("DIFFICULTY_HARDER_THAN_REQUESTED", "dificuldade pedida 1 mas estimada 5 — pergunta demasiado difícil para o nível pedido")] and found[9] == []


ADDED = [
    ({"q": "Qual é o feminino de réu?", "a": "ré", "o": ["ré", "Barroco", "Portugal", "1999"]}, "formas gramaticais"),
    ({"q": "Quantos neurónios tem? O neurónio", "a": "muitos", "o": ["muitos", "ilusão de Müller", "a esfinge", "poucos"]}, "conceitos de neurociência"),
    ({"q": "Como é a rotação de Vénus?", "a": "lenta", "o": ["lenta", "queijo", "pedra", "azeite"]}, "rotações planetárias"),
    ({"q": MAP.replace("água", "mar"), "a": "Mapa", "o": ["Mapa", "Globo", "Livro", "Mar"], "f": "ADIVINHA"}, "ambas defensáveis"),
    ({"q": "O jogador de futebol pisa o campo de grama?", "a": "sim"}, "campo de relva"),
    ({"q": "Que goleada no campeonato teve mais gols?", "a": "x"}, "mesmo com"),
    ({"q": "Que goleado teve o Brasileirao no campeonato?", "a": "x"}, "futebol brasileiro"),
    ({"q": "O que anda ao vento com cauda?", "a": "Pipa"}, "não se chama"),
    ({"q": "Onde fica Nova Iorque?", "a": "New York"}, "mesma grafia"),
]


def test_rules_that_came_in_late(spark):
    rows = [(k, c["q"], c["a"], c.get("o", [c["a"], "b", "c", "d"]), [], c.get("f", "RESPOSTA_DIRETA"), "15+", "2", 1, True) for k, (c, _) in enumerate(ADDED)]
    found = {r["id"]: " / ".join(i["message"] for i in r["issues"]) for r in items.with_issues(spark.createDataFrame(rows, ITEMS)).collect()}
    for k, (case, message) in enumerate(ADDED):
        assert message in found[k], (case, found[k])


def test_rules_by_family(spark):
    assert {name: len(family) for name, family in items.families().items()} == {"format": 40, "age": 28, "difficulty": 5, "category": 4, "portuguese": 42, "semantic": 3, "options": 39}


def test_problems_without_a_code_go_by_their_message(spark):
    from tessera.operators import diagnosis

    rows = [([(None, "semantic", "texto"), ("FACT_09", "semantic", "zebra"), ("FACT_09", "semantic", "outra"), ("", "x", "texto"), (None, None, None)],), ([],)]
    df = spark.createDataFrame(rows, "issues array<struct<code:string,layer:string,message:string>>")
    found = [[(p["code"], p["message"]) for p in r["p"]] for r in df.select(diagnosis.problems(F.col("issues")).alias("p")).collect()]
    assert found == [[("texto", "texto"), ("FACT_09", "zebra"), ("UNSPECIFIED", None)], []]
