"""What entities say of records, against the plain rule for each record."""

import json
import random
import re
import unicodedata

from tessera.operators import entities


def plain(x):
    x = "".join(c for c in unicodedata.normalize("NFD", (x or "").lower()) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", x).strip()


def slow(answer, held):
    a = plain(answer)
    if held is None:
        return "no_entity"
    if not a:
        return "no_answer"
    held = [p for p in map(plain, held) if p]
    if not held:
        return "empty_entity"
    words = [w for w in a.split(" ") if len(w) >= 4]
    there = [w for w in words if w in " ".join(held)]
    return "matched" if any(t in a or a in t for t in held) or (words and len(there) >= min(2, len(words))) else "contradiction"


def test_support_equals_the_rule_for_each_record(spark):
    rng = random.Random(5)
    bits = ["rio", "tejo", "Lisboa", "capital", "de", "Portugal", "ponte", "São", "grande", "q", ""]
    phrase = lambda most: " ".join(rng.choice(bits) for _ in range(rng.randint(0, most)))
    held = {f"Q{k}": [phrase(4) for _ in range(rng.randint(0, 4))] for k in range(20)}
    # a third of all records name one entity, many with one answer
    rows = [(i, rng.choice(["Lisboa", phrase(3)]) if i % 3 == 0 else phrase(3), "wikidata", "Q7" if i % 3 == 0 else f"q{rng.randrange(25)}", None, "x", "c", None) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, answer string, source string, source_id string, source_url string, format string, plain string, outcome string")
    known = spark.createDataFrame(list(held.items()), "qid string, texts array<string>")
    got = entities.supported(df, known).collect()
    assert sorted(r["id"] for r in got) == list(range(1500)) and {r["plain"] for r in got} == {"c"}
    for r in got:
        assert r["outcome"] == slow(r["answer"], held.get(r["source_id"].upper())), r
    assert {r["outcome"] for r in got} == {"no_entity", "no_answer", "matched", "contradiction"} | ({"empty_entity"} & {r["outcome"] for r in got})
    assert entities.supported(df.limit(0), known).count() == 0
    assert {r["outcome"] for r in entities.supported(df.filter("answer <> ''"), known.limit(0)).collect()} == {"no_entity"}


def test_what_is_not_checked_says_why(spark):
    rows = [("a", "manual", None, None, "RD"), ("a", "Wikidata", "Q1", None, " adivinha "), ("Falso", "Wikidata", "Q1", None, None), ("a", "wikidata", None, "none", None), ("Moscou", None, None, "https://x/wiki/Q1#a", None),
            ("a", None, "xQ1", None, None), (None, None, "Q1", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, answer string, source string, source_id string, source_url string, format string")
    known = spark.createDataFrame([("Q1", ["Moscow (city)"])], "qid string, texts array<string>")
    got = {r["id"]: r["outcome"] for r in entities.supported(df, known).collect()}
    assert got == {0: "not_applicable", 1: "not_applicable", 2: "true_false", 3: "no_qid", 4: "matched", 5: "not_applicable", 6: "no_answer"}


def test_texts_of_entity_documents(spark):
    rows = [
        ("q1", json.dumps({"pt": "Lisboa", "en": {"value": "Lisbon"}, "fr": {"language": "fr"}, "de": " "}), json.dumps({"pt": ["[capital]", {"value": "{cidade}"}, 5, None]}), None),
        ("q1 ", None, None, json.dumps({"pt": ["Lisboa"]})), ("q2", "{broken", "[1]", "7"), (None, "{}", None, None), ("q3", "", None, None),
    ]
    got = {r["qid"]: (sorted(r["texts"]), r["broken"]) for r in entities.texts(spark.createDataFrame(rows, "id string, labels string, descriptions string, aliases string")).collect()}
    assert got["Q1"] == (["Lisboa", "Lisbon", "[capital]", "{cidade}"], []) and got["Q2"] == ([], ["labels"]) and got["Q3"] == ([], ["labels"]) and len(got) == 3
