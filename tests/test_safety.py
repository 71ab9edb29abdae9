"""Content safety by joins, rewriting in one pass, and the Portuguese normaliser, against plain loops."""

import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import portuguese, rewrite, substrings
from tessera.operators import safety

RULES = [
    ("word", "feio", "block", None), ("word", "tolo", "rewrite", "amigo"), ("word", "má", "block", None), ("word", "cu", "block", None), ("word", "gato", "allow_context", None),
    ("phrase", "muito mau", "block", None), ("phrase", "que tolice", "rewrite", "que pena"), ("phrase", "a b", "block", None), ("word", "", "block", None), ("phrase", "!!", "block", None),
]
SCHEMA = "kind string, term string, severity string, replacement string"


def plain(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c))


def slow_matches(x: str) -> set[tuple[str, str]]:
    raw = plain(x.lower())
    for a, b in zip("@401!35$7", "aaoiiesst", strict=True):
        raw = raw.replace(a, b)
    spaced = re.sub(r"[^a-z0-9]+", " ", raw).strip()
    compact = spaced.replace(" ", "")
    runs, now = [], ""
    for t in [*spaced.split(" "), "--"]:
        if len(t) == 1:
            now += t
        else:
            runs += [now] if len(now) >= 2 else []
            now = ""
    found = set()
    for kind, term, _, _ in RULES:
        form = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", plain(term.lower()))).strip()
        key = form.replace(" ", "")
        if not key:
            continue
        if kind == "phrase":
            hit = (len(key) >= 5 and key in compact) or form in spaced
        else:
            flexible = r"[\s.\-_@*0-9]*".join(key)
            hit = re.search(rf"(?<![a-z0-9à-ÿ]){flexible}(?![a-z0-9à-ÿ])", x.lower()) is not None or key in runs
            hit = hit or ((compact == key or (term.lower() == key and key in spaced.split(" "))) if len(key) <= 3 else key in spaced.split(" "))
        if hit:
            found.add((kind, term))
    return found


def test_matches_equal_a_loop_over_all_rules(spark):
    rng = random.Random(3)
    bits = ["feio", "FEIO", "f e i o", "f.e.i.o", "fe-io", "f31o", "feioso", "ofeio", "féio", "feio2", "2feio", "tolo", "t0l0", "to lo", "má", "ma", "m a", "cu", "c-u", "cuco", "gato", "muito", "mau", "muitomau",
            "que tolice", "quetolices", "a b", "a", "b", "c", "ç", "1", "!", ".", "-", "<", ">", "casa", "é"]
    texts = ["", "cu", "c u", "m á", *("".join(rng.choice(bits) + rng.choice([" ", " ", "", "\n", "  ", ", "]) for _ in range(rng.randint(1, 7))) for _ in range(1500))]
    texts.append("casa " * 3000 + "mui" + " " * 5000 + "to mau " + "x" * 9000 + " f e i o")  # over several pieces
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9999, None)], "id long, body string").withColumn("key", F.lit("clash"))
    rules = spark.createDataFrame([*RULES, RULES[0]], SCHEMA)
    got = {}
    rows = safety.matches(df, rules, "id", "body").collect()
    for r in rows:
        got.setdefault(r["id"], set()).add((r["kind"], r["term"]))
    assert len(rows) == sum(map(len, got.values()))
    for i, t in enumerate(texts):
        assert got.get(i, set()) == slow_matches(t), t
    assert 9999 not in got
    assert safety.matches(df.limit(0), rules, "id", "body").count() == 0 and safety.matches(df, rules.limit(0), "id", "body").count() == 0


def test_more_rules_leave_the_plan_as_it_is_and_large_tables_are_not_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(1, "palavraehbb e mais um termo bc aqui"), (2, "nada")], "id long, body string")
    spelled = F.concat(F.lit("palavra"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))
    few, many = (spark.range(n).select(F.lit("word").alias("kind"), spelled.alias("term"), F.lit("block").alias("severity"), F.lit(None).cast("string").alias("replacement")) for n in (2, 5000))
    lines = [len(safety.matches(df, r, "id", "body")._jdf.queryExecution().optimizedPlan().toString().splitlines()) for r in (few, many)]
    assert lines[0] == lines[1]
    found = safety.matches(df, many, "id", "body").collect()
    assert {(r["id"], r["term"]) for r in found} == {(1, "palavraehbb")}
    monkeypatch.setattr(safety, "BROADCAST", 1)
    shuffled = safety.matches(df, many, "id", "body")
    assert "hint=(strategy=broadcast)" not in shuffled._jdf.queryExecution().optimizedPlan().toString() and shuffled.collect() == found


def test_sanitizing_rewrites_blocks_and_says_what_is_left(spark):
    rules = spark.createDataFrame(RULES + [("word", "anao", "rewrite", None)], SCHEMA)
    texts = {1: "Que tolo és, TOLO, Tolo, t.o.l.o!", 2: "um tolo feio", 3: "QUE  TOLICE disse", 4: "limpo", 5: "um gato", 6: "na anatomia, um gato", 7: "anao e tolo", 8: None, 9: ""}
    df = spark.createDataFrame(list(texts.items()), "id long, body string")
    got = {r["id"]: (r["body"], r["action"]) for r in safety.sanitized(df, rules, "id", "body").collect()}
    assert got[1] == ("Que amigo és, AMIGO, Amigo, amigo!", "rewrite")
    assert got[2] == (texts[2], "blocked") and got[3] == ("QUE PENA disse", "rewrite") and got[4] == ("limpo", "ok")
    assert got[5] == (texts[5], "reformulate")  # to be seen to, and nothing says what to write
    assert got[6] == (texts[6], "ok") and got[7] == ("anao e amigo", "reformulate") and got[8] == (None, "ok") and got[9] == ("", "ok")


def test_dictionary_takes_the_longest_entry_and_keeps_the_case(spark):
    entries = {f"palavra{k}": f"termo{k}" for k in range(100)} | {"nova york": "nova iorque", "nova": "recente", "irã": "irão"}
    cases = {"Nova York, NOVA YORK e nova york": "Nova iorque, NOVA IORQUE e nova iorque", "NOVA casa Nova": "RECENTE casa Recente", "palavra7 palavra70x Palavra99": "termo7 palavra70x Termo99",
             "Irãs IRÃ, irã.": "Irãs IRÃO, irão.", "": "", "a\x01b nova": "ab recente"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "x string, want string")
    got = df.select("want", rewrite.by_dictionary(F.col("x"), entries).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_portuguese_of_records(spark):
    df = spark.createDataFrame([("  Voce  NAO viu o Aviao de Moscow ", None, ["ja", " ", None, "acao"]), (None, "so  maes", None)], "fact string, statement string, clues array<string>")
    got = portuguese.normalized_record(df).collect()
    assert got[0]["fact"] == "Você NÃO viu o Avião de Moscovo" and got[0]["statement"] == "" and got[0]["clues"] == ["já", "ação"]
    assert got[1]["fact"] == "" and got[1]["statement"] == "só maes" and got[1]["clues"] == []


def test_texts_are_cut_in_one_pass_and_only_what_may_be_a_term_is_left(spark):
    text = "zyx " * 500 + "um feio"
    df, rules = spark.createDataFrame([(1, text)], "id long, body string"), spark.createDataFrame(RULES, SCHEMA)
    plan = safety.matches(df, rules, "id", "body")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") <= 1 and plan.count("MapInArrow") == 1  # a row for each letter was made before


def test_stretches_of_texts_over_many_blocks_equal_a_loop(monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 7)
    rng = random.Random(5)
    terms = {substrings.STRICT: ["abca", "bcab2", "a" * 12], substrings.LOOSE: ["ab", "abc"], substrings.INSIDE: ["abcab", "cabcabcabcab", "bbbbb"], substrings.SPACED: ["a b", "ab"]}
    pairs = [(how, t) for how, ts in terms.items() for t in ts] + [(b, t[:n]) for b, n in zip(substrings.BEGIN, safety.SEEDS, strict=True) for t in terms[substrings.INSIDE] if len(t) >= n]
    held = np.zeros(1 << 16, bool)
    for how, t in pairs:
        made = pa.RecordBatch.from_arrays([pa.array([how], pa.int8()), pa.array([t])], ["how", "key"])
        held[next(substrings.buckets(16)(iter([made]))).column(0).to_numpy()] = True
    texts = [None, "", *("".join(rng.choice("aaabbbccc2 .,á") for _ in range(rng.randrange(60))) for _ in range(300))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["row_key", "x"])
    run = substrings.stretches(held, 16, {how: sorted({len(t) for t in ts}) for how, ts in terms.items()}, safety.SEEDS, safety.LOOKALIKES)
    got = [r for b in run(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(got) == len(set(got))
    for i, x in enumerate(texts):
        spaced = re.sub("[^a-z0-9]+", " ", plain(x or "")).strip()
        compact = spaced.replace(" ", "")
        want = {(i, substrings.STRICT, w) for w in spaced.split(" ") if w in terms[substrings.STRICT]}
        for t in [*terms[substrings.STRICT], *terms[substrings.LOOSE]]:
            how = substrings.STRICT if len(t) > substrings.SHORT else substrings.LOOSE
            spelled = t.isalpha() and re.search(rf"(?<![a-z0-9à-ÿ]){r'[\s.\-_@*0-9]*'.join(t)}(?![a-z0-9à-ÿ])", x or "")
            if spelled or t in (s.replace(" ", "") for s in re.findall(r"(?<!\S)\S(?: \S)+(?!\S)", spaced)) or (compact == t and len(t) <= substrings.SHORT):
                want.add((i, how, t))
        want |= {(i, substrings.INSIDE, t) for t in terms[substrings.INSIDE] if t in compact} | {(i, substrings.SPACED, t) for t in terms[substrings.SPACED] if t in spaced}
        known = {(how, t) for how, ts in terms.items() for t in ts}
        assert {r for r in got if r[0] == i and r[1:] in known} == want, x


def test_letters_are_unmasked_as_by_columns(spark):
    unmasked, standing = substrings._tables(safety.LOOKALIKES)
    points = [c for c in range(1, 0x2400) if c != 0x130]
    for r in spark.createDataFrame([(c, chr(c)) for c in points], "c int, x string").select("c", safety.unmasked(F.concat(F.lit("a"), "x", F.lit("a"))).alias("u"), F.lower("x").alias("low")).collect():
        code = int(unmasked[min(r["c"], len(unmasked) - 1)])
        assert r["u"] == "a" + ("" if code == 255 else substrings.LETTERS[code - 1] if code else " ") + "a", r
        stands = int(standing[min(r["c"], len(standing) - 1)])
        assert (1 <= stands <= 26) == bool(re.fullmatch("[a-z]", r["low"])) and (stands == 28) == bool(re.fullmatch("[à-ÿ]", r["low"])), r
