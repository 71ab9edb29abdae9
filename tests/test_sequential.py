"""Passes whose state is the last kept record, against the plain loop."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import sequential

WORDS = [f"word{k}" for k in range(8)]


def loop(rows, threshold=0.72):
    """The pass as it is said: a dictionary of the last record kept of each key."""
    last, kept = {}, set()
    for i, key, text in rows:
        words = frozenset(w for w in (text or "").split() if len(w) > 2)
        held = last.get(key)
        if held and words and len(words & held) / len(words | held) >= threshold:
            continue
        last[key] = words
        kept.add(i)
    return kept


def some(n, seed, keys):
    r = random.Random(seed)
    return [(k, r.choice(keys), r.choice([None, "", *[" ".join(r.sample(WORDS, r.choice([3, 6, 7, 8]))) for _ in range(14)]])) for k in range(n)]


@pytest.mark.parametrize("stretch", [8, 64, 4096])
def test_equals_the_loop(spark, monkeypatch, stretch):
    monkeypatch.setattr(sequential, "STRETCH", stretch)
    rows = some(400, 1, ["hot"] * 5 + ["a", "b", None])
    df = spark.createDataFrame(rows, "i long, k string, x string").withColumns({"row": F.lit("own"), "kept": F.lit("old"), "words": F.lit("own"), "at": F.lit(1)}).repartition(3)
    found = sequential.unlike_last(df, F.col("k"), ["i"], F.col("x"))
    assert {r["i"] for r in found.filter("kept").collect()} == loop(rows)
    assert found.filter("`row` = 'own' AND words = 'own' AND at = 1").count() == len(rows)


def test_ten_thousand_records_of_one_key(spark, monkeypatch):
    """Twenty stretches: pointers are doubled five times and once more to see that nothing is added."""
    monkeypatch.setattr(sequential, "STRETCH", 512)
    rows = [(k, "hot", t) for k, _, t in some(10_000, 2, ["x"])]
    rounds = []
    real = sequential.cut
    monkeypatch.setattr(sequential, "cut", lambda df: (rounds.append(df.columns), real(df))[1])
    found = sequential.unlike_last(spark.createDataFrame(rows, "i long, k string, x string"), F.col("k"), ["i"], F.col("x"))
    assert {r["i"] for r in found.filter("kept").collect()} == loop(rows)
    assert rounds.count(["node"]) <= 8


def test_stretches_that_are_skipped_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(sequential, "STRETCH", 32)
    same, other = " ".join(WORDS), "quite another text"
    rows = [(k, "hot", same) for k in range(300)] + [(300 + k, "hot", other) for k in range(70)] + [(370 + k, "hot", same) for k in range(200)]
    for part in (rows, rows[:200], []):
        found = sequential.unlike_last(spark.createDataFrame(part, "i long, k string, x string"), F.col("k"), ["i"], F.col("x"))
        assert {r["i"] for r in found.filter("kept").collect()} == loop(part)
