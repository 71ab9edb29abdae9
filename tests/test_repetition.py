"""Repetition issues against a plain walk through shuffled sessions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.functions import keys, text
from tessera.operators import repetition

ITEMS = "session string, position int, question string, answer string, format string, knowledge_id string, knowledge_key string, question_hash string, code string"
HISTORY = "session string, kind string, field string, value string"


def fold(x):
    return " ".join((x or "").lower().split())


def tokens(x):
    return {w for w in fold(x).split(" ") if len(w) > 2}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0


def match(a, b):
    pa, pb = ([p for p in map(fold, k.split("|")) if p] for k in (a, b))
    pa, pb = (p if len(p) >= 3 else None for p in (pa, pb))
    if pa and pb:
        return pa[1:3] == pb[1:3]
    if pa or pb:
        free, (entity, concept) = fold(b if pa else a), (pa or pb)[1:3]
        return bool(free) and (free == entity or free == f"{concept} {entity}" or (entity in free and concept in free))
    a, b = sorted((fold(a), fold(b)), key=len)
    return bool(a) and (a == b or (a in b and not (" " not in a and len(a) >= 4)) or jaccard(tokens(a), tokens(b)) >= 0.42)


def walk(items, history):
    out = set()
    generic = ("verdadeiro", "falso")
    past = {}
    for s, kind, field, value in history:
        past.setdefault((s, kind, field), []).append(value)
    seen = {}
    for s, p, q, a, f, i, k, h, _ in sorted(items, key=lambda r: (str(r[0]), r[1])):
        ids, ks, qs, ans = seen.setdefault(s, (list(past.get((s, "used", "knowledge_id"), [])), list(past.get((s, "used", "knowledge_key"), [])), [], [fold(x) for x in past.get((s, "used", "answer"), []) if fold(x) not in generic]))
        blocked = lambda field: past.get((s, "blocked", field), []) + past.get((None, "blocked", field), [])  # noqa: B023, E731
        codes = {
            "KNOWLEDGE_ID_REPEATED": bool(i) and i in ids,
            "KNOWLEDGE_REPEATED": not i and bool(k) and any(match(x, k) for x in ks),
            "KNOWLEDGE_REPORTED": bool(i) and i in blocked("knowledge_id"),
            "QUESTION_REPORTED": bool(h) and h in blocked("question_hash") or bool(fold(q)) and fold(q) in blocked("question"),
            "QUESTION_SIMILAR": any(jaccard(tokens(q), tokens(x)) >= 0.55 for x in qs[-8:]),
            "ANSWER_REPEATED": f != "VERDADEIRO_FALSO" and bool(fold(a)) and fold(a) not in generic and fold(a) in ans,
        }
        out |= {(s, p, c) for c, held in codes.items() if held}
        ids.append(i)
        qs.append(q)
        if k:
            ks.append(k)
        if f != "VERDADEIRO_FALSO" and fold(a) not in generic:
            ans.append(fold(a))
    return out


def test_issues_equal_the_walk_over_shuffled_sessions(spark):
    r = random.Random(4)
    nouns = ["lisboa", "porto", "rio tejo", "mar", "sol e lua", "ab", "capital"]
    free = [None, "", *nouns, "capital lisboa", "cidade grande de lisboa", "rio tejo nasce em espanha", "o sol e lua de noite"]
    structured = [f"geo|{e}|{c}|{x}" for e in nouns[:5] for c in ("capital", "rio tejo") for x in ("a", "b")] + ["geral|mar|nome|x", "a|b"]
    questions = [None, "", *[" ".join(r.sample(["qual", "cidade", "maior", "rio", "longo", "mar", "fundo", "pais"], r.randrange(3, 7))) for _ in range(40)]]
    items = []
    for s in range(14):
        for p in range(r.randrange(1, 40)):
            items.append((f"s{s}", p, r.choice(questions), r.choice([None, "", "Verdadeiro", *nouns]), r.choice(["VERDADEIRO_FALSO", "OUTRO", None]), r.choice([None, "", "k1", "k2", "k3"] + [f"u{len(items)}"] * 3), r.choice(free + structured), r.choice([None, "h1", "h2", f"x{len(items)}"]), "own"))
    history = [("s0", "used", "knowledge_id", "k1"), ("s1", "used", "knowledge_key", "geo|lisboa|capital|z"), ("s1", "used", "knowledge_key", "rio tejo"), ("s2", "used", "answer", "MAR"), ("s2", "used", "answer", "falso"), (None, "blocked", "knowledge_id", "k2"), ("s3", "blocked", "knowledge_id", "k3"), (None, "blocked", "question_hash", "h2"), ("s4", "blocked", "question", questions[5])]
    r.shuffle(items)
    found = repetition.repetition_issues(spark.createDataFrame(items, ITEMS), spark.createDataFrame(history, HISTORY)).collect()
    expected = walk(items, history)
    assert {(x["session"], x["position"], x["code"]) for x in found} == expected and len(found) == len(expected)
    assert {x[2] for x in expected} == set(repetition.MESSAGES)


def test_nothing_repeats_nothing(spark):
    assert repetition.repetition_issues(spark.createDataFrame([], ITEMS), spark.createDataFrame([], HISTORY)).collect() == []
    rows = [("s", 0, None, None, None, None, None, None, None), ("s", 1, None, None, None, None, None, None, None)]
    assert repetition.repetition_issues(spark.createDataFrame(rows, ITEMS), spark.createDataFrame([], HISTORY)).collect() == []


def test_similar_questions_are_looked_for_within_stretches(spark, monkeypatch):
    monkeypatch.setattr(repetition, "STRETCH", 10)
    r = random.Random(9)
    items = [(s, p, " ".join(r.sample(["qual", "cidade", "maior", "rio", "longo", "mar", "fundo", "pais"], r.randrange(3, 6))), None, None, None, None, None, None) for s in ("a", "b", None) for p in range(75) for _ in range(r.randrange(1, 3))]
    items += [("neg", p, "qual rio maior", None, None, None, None, None, None) for p in (-12, -5, -1, 0, 8, 17)]
    rows = spark.createDataFrame(items, ITEMS)
    asked = rows.select("session", F.col("position").cast("long").alias("position"), repetition.words(F.col("question")).alias("words"))
    similar = repetition._similar_before(asked)
    assert "sequence(" not in similar._jdf.queryExecution().optimizedPlan().toString()  # each row was sent to eight places before
    expected = {(s, p) for s, p, q, *_ in items for t, o, before, *_ in items if s is not None and s == t and p - 8 <= o < p and jaccard(tokens(q), tokens(before)) >= 0.55}
    assert {(x["session"], x["position"]) for x in similar.collect() if x["session"] is not None} == expected


def test_structured_keys_are_not_paired_with_each_other(spark):
    items = [("s", p, None, None, None, None, f"geo|lisboa|capital|r{p}", None, None) for p in range(6000)]  # 36 million pairs before
    found = repetition.repetition_issues(spark.createDataFrame(items, ITEMS), spark.createDataFrame([("s", "used", "knowledge_key", "capital lisboa")], HISTORY)).collect()
    assert {x["position"] for x in found} == set(range(6000)) and {x["code"] for x in found} == {"KNOWLEDGE_REPEATED"}


def test_plain_texts_take_the_short_way_to_the_same(spark):
    r = random.Random(6)
    bits = ["a", "B", " ", "  ", "|", "<", ">", "é", "É", ":", "-", "?", ".", "\t", "\n", " ", "Falso", "verdadeiro ou falso", "Adivinha: ", "9"]
    texts = [None, "", " ", *("".join(r.choice(bits[:1] * 3 + bits) for _ in range(r.randrange(1, 12))) for _ in range(3000))]
    x, f = F.col("x"), F.col("f")
    body = keys.without_label(F.trim(text.strip_tags(F.coalesce(x, F.lit("")))))
    parts = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"\|"), text.normalize), lambda p: p != "")
    bare = text.tokens(F.trim(F.regexp_replace(F.regexp_replace(text.strip_accents(F.lower(x)), r"[^a-z0-9\s-]", " "), r"\s+", " ")))
    pairs = [(text.normalize_plain_first(x), text.normalize(x)), (keys.for_repetition(x, f), F.when(f == "VERDADEIRO_FALSO", keys.without_true_false(body)).otherwise(body)), (keys.parts_of(x), F.when(F.size(parts) >= 3, parts)), (repetition.words(x), bare)]
    df = spark.createDataFrame([(t, k) for t in texts for k in ("VERDADEIRO_FALSO", "")], "x string, f string")
    assert df.filter(~F.array(*[a.eqNullSafe(b) for a, b in pairs]).eqNullSafe(F.array(*[F.lit(True)] * 4))).limit(3).collect() == []
