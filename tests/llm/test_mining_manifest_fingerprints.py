"""Hard negatives, Merkle manifests and piecewise fingerprints against brute force on small tables that hold nulls, empty
and long texts, ties, repeated rows, empty tables and columns with clashing names."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle, piecewise, vafile

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"
CLASHES = ["tree", "size", "at", "digest", "held", "node", "nodes", "run", "kept", "proof", "of", "content", "number", "key_0", "leaf", "altered", "key", "chunk", "last", "to", "id", "value", "anchor", "row_no", "cells", "block", "share", "more"]


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 9))) for _ in range(n))


def documents() -> list[tuple]:
    texts = [None, "", "a", "AB", "é ñ 日本", "aaaa" * 5000, "ab" * 4000, words(1, 30_000), "Same Text", "Same Text"] + [words(k, 5 + k * 3).title() for k in range(90)]
    rows = [(k * 7 % 1013 - 20, t, "en" if k % 3 else None, "hot" if k % 2 else [None, "b", "a", "é", ""][k % 5], len(t or "")) for k, t in enumerate(texts)]
    return [*rows, rows[30], rows[30], (None, None, None, None, None), (None, "no id", "en", "lone", 5), (7000, "X", "en", None, None)]


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).withColumns({n: F.lit("own") for n in CLASHES}).cache()


# --- Merkle manifest ---------------------------------------------------------------------------------------------


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_by_hand(values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def root_by_hand(nodes: list[str], width: int) -> tuple[str, list[str]]:
    """The top over some nodes and each one's siblings, all joined."""
    proofs, at = [""] * len(nodes), list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // width * width : p // width * width + width]
            proofs[k] += "".join(run[: p % width] + run[p % width + 1 :])
        nodes = [sha("".join(nodes[k : k + width])) for k in range(0, len(nodes), width)]
        at = [p // width for p in at]
    return nodes[0], proofs


def manifest_by_hand(rows: list[tuple], width: int) -> Counter:
    trees: dict = {}
    for doc_id, text, lang, source, n in rows:
        trees.setdefault(source, []).append((doc_id, leaf_by_hand((doc_id, source, lang, n, text))))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    tops, inner = [], {}
    for s in order:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        top, inner[s] = root_by_hand([x[1] for x in trees[s]], width)
        tops.append(top)
    root, outer = root_by_hand(tops, width)
    return Counter((d, s, h, tops[k], root, sha(p + outer[k])) for k, s in enumerate(order) for (d, h), p in zip(trees[s], inner[s], strict=True))


@pytest.mark.parametrize("width", [2, 16])
def test_manifest_equals_plain_trees(docs, rows, width):
    found = merkle.verified(merkle.manifest(docs, merkle.lower_cased(docs), width=width)).withColumn("of", merkle.proof_digest(F.col("proof"))).collect()
    assert Counter((r["doc_id"], r["source"], r["leaf"], r["subroot"], r["root"], r["of"]) for r in found) == manifest_by_hand(rows, width)
    import zlib

    for r in found:
        text = {(x[0], x[3]): x[1] for x in rows}[r["doc_id"], r["source"]]
        picked = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        changed = picked and text is not None and any("A" <= c <= "Z" for c in text)
        assert r["verified"] == (not changed)
        assert (r["altered"] is not None) == picked


def test_manifest_of_few_rows(spark):
    def root(rows):
        return [(r["leaf"], r["subroot"], r["root"], len(r["proof"])) for r in merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()]

    assert root([]) == []
    (one,) = root([(1, "t", "en", "a", 1)])
    assert one == (leaf_by_hand((1, "a", "en", 1, "t")),) * 3 + (0,)
    two = root([(1, "t", "en", "a", 1), (2, "t", "en", "b", 1)])
    assert {x[3] for x in two} == {1} and {x[2] for x in two} == {sha(leaf_by_hand((1, "a", "en", 1, "t")) + leaf_by_hand((2, "b", "en", 1, "t")))}
    # a run of one is hashed alone
    many = root([(k, "t", "en", "a", 1) for k in range(17)])
    leaves = [leaf_by_hand((k, "a", "en", 1, "t")) for k in range(17)]
    assert {x[2] for x in many} == {sha(sha("".join(leaves[:16])) + sha(leaves[16]))} and {x[3] for x in many} == {2}


# --- piecewise fingerprints --------------------------------------------------------------------------------------


def fingerprint_by_hand(text: str) -> str:
    """The same hashes, a byte at a time."""
    data, mask = text.encode(), (1 << 64) - 1

    def triggers(block):
        out = []
        for i in range(len(data)):
            window = [data[i - k] if i >= k else 0 for k in range(7)]
            sums = sum(b * (8 - k) for k, b in enumerate(window))
            shifted = 0
            for k, b in enumerate(window):
                shifted ^= (b << (5 * k)) & 0xFFFFFFFF
            if ((sums + shifted) & 0xFFFFFFFF) % block == block - 1:
                out.append(i)
        return out

    def letters(ends, most):
        out, start = "", 0
        for stop in [e + 1 for e in ends[: most - 1]] + [len(data)]:
            if stop > start:
                h = sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(data[start:stop])) & mask
                h ^= h >> 29
                out += piecewise.ALPHABET[((h * 0xBF58476D1CE4E5B9) & mask) >> 58]
            start = max(start, stop)
        return out

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and len(triggers(block)) + 1 < 32:
        block //= 2
    return f"{block}:{letters(triggers(block), 64)}:{letters(triggers(2 * block), 32)}"


def distance_by_hand(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (0 if x == y else 2)))
    return row[-1]


def test_fingerprints_equal_the_plain_loop():
    for text in ["", "a", "ab", "aaaa" * 300, "ab" * 500, "日本語" * 100, words(5, 40), words(6, 700)]:
        assert piecewise.fingerprint_of(text) == fingerprint_by_hand(text)


def test_likeness_is_edit_distance():
    r = random.Random(4)
    for _ in range(300):
        a = "".join(r.choice("abc") for _ in range(r.randrange(0, 64)))
        b = "".join(r.choice("abc") for _ in range(r.randrange(0, 64)))
        assert len(a) + len(b) - 2 * piecewise.common_length(a, b) == distance_by_hand(a, b)
    one, two = "3:abcdefghij:abcde", "6:abcdefghiX:Y"
    assert piecewise.likeness_of(one, one) == 1 and piecewise.likeness_of(one, "12:abcdefghij:abcde") == 0
    assert piecewise.likeness_of(two, "3:q:abcdefghij") == piecewise.likeness_of("3:q:abcdefghij", two) == 0.9
    assert piecewise.likeness_of("3:abcdWWefgh:a", "3:abcdVVefgh:b") == 0  # never five in a row
    assert piecewise.likeness_of("3::", "3:abcdef:abc") == 0


def test_small_edits_stay_alike():
    text = words(8, 2000)
    mark = piecewise.fingerprint_of(text)
    for k in range(10):
        at = k * 997 % len(text)
        assert piecewise.likeness_of(mark, piecewise.fingerprint_of(text[:at] + "inserted words " + text[at + 3 :])) > 0.85
    assert piecewise.likeness_of(mark, piecewise.fingerprint_of(words(9, 2000))) < 0.1


@pytest.mark.parametrize("cuts", [1, 8, 4000])
def test_next_documents_equal_the_plain_loop(spark, docs, rows, cuts, monkeypatch):
    monkeypatch.setattr(piecewise, "groups", lambda _: cuts)
    # copies with an id follow each other, so any order among them gives the same rows
    found = piecewise.compare_with_next(docs).collect()
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), piecewise._order_key(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("k")).collect()
    order = sorted(keyed, key=lambda r: r["k"])
    assert [r["doc_id"] for r in order] == sorted((x[0] for x in rows), key=lambda i: (i is not None, i or 0))
    expected = Counter()
    for k, (doc_id, text, _) in enumerate(order):
        following = order[(k + 1) % len(order)]["text"]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[: min(half, len(following))]
        marks = [piecewise.fingerprint_of(t) for t in (text, edited, following)]
        expected[doc_id, len(text), sha(edited), marks[0], marks[1], piecewise.likeness_of(marks[0], marks[1]), piecewise.likeness_of(marks[0], marks[2])] += 1
    assert Counter(map(tuple, found)) == expected


def test_next_of_one_row_and_of_none(spark):
    assert piecewise.compare_with_next(spark.createDataFrame([], DOCS)).collect() == []
    (one,) = piecewise.compare_with_next(spark.createDataFrame([(3, "abcd", None, None, 4)], DOCS)).collect()
    assert (one["edited_sha256"], one["near_next"], one["doc_id"]) == (sha("abab"), 1.0, 3)
    marked = spark.createDataFrame([("x y z",), (None,)], "t string").select(piecewise.fingerprint("t").alias("a")).select("a", piecewise.likeness("a", "a").alias("l"), piecewise.likeness("a", F.lit(None).cast("string")).alias("n")).collect()
    assert [(r["l"], r["n"]) for r in marked] == [(1.0, 0.0)] * 2 and marked[1]["a"] == "3::"


# --- hard negatives ----------------------------------------------------------------------------------------------


def vectors(n: int = 260, dims: int = 6) -> list[tuple]:
    r = np.random.default_rng(5)
    centers = r.normal(size=(4, dims))
    rows = [(k, (centers[k % 4] + r.normal(size=dims) * 0.6).astype(np.float32).tolist(), int(r.integers(0, 3))) for k in range(n)]
    rows += [(500 + k, rows[10][1], k % 3) for k in range(40)]  # ties
    rows += [(700, [0.0] * dims, 1), (710, [0.0] * dims, 2), (800, [1000.0] * dims, 0), (801, [-1000.0] * dims, 1), rows[20], rows[20], (20, rows[20][1], 2)]
    rows += [(None, rows[30][1], 1), (None, rows[30][1], 2), (900, None, 1), (910, rows[0][1], None), (920, [], 0), (930, [math.nan] * dims, 0), (940, [math.inf] * dims, 0), (950, [None] * dims, 0), (960, [1e30] * dims, 0), (970, [1.0] * (dims - 1), 0)]
    return rows


def negatives_by_hand(rows: list[tuple], dims: int, anchors) -> Counter:
    good = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if c is not None and v and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < 1e18 for x in v)]
    out: Counter = Counter()
    late = lambda i: math.inf if i is None else i
    for a, (i, v, c) in enumerate(good):
        if i is None or not anchors(i):
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), j, d) for b, (j, w, d) in enumerate(good) if b != a]
        scored.sort(key=lambda s: (-s[0], late(s[1])))
        for score, j, _ in [s for s in scored if s[2] == c][:5]:
            inside = [s for s in scored if s[2] != c and 80 * score <= 100 * s[0] <= 100 * score][:5]
            out.update((i, j, k, s[1], score, s[0]) for k, s in enumerate(inside, 1))
    return out


@pytest.mark.parametrize("block_rows,block_anchors", [(8192, 1024), (40, 7)])
def test_mined_negatives_equal_brute_force(spark, monkeypatch, block_rows, block_anchors):
    monkeypatch.setattr(vafile, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(vafile, "BLOCK_ANCHORS", block_anchors)
    monkeypatch.setattr(vafile, "SAMPLE", 50)
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3).withColumns({n: F.lit("own") for n in CLASHES})
    found = vafile.mine(df, F.col("vec_id") % 10 == 0)
    expected = negatives_by_hand(rows, 6, lambda i: i % 10 == 0)
    assert Counter(map(tuple, found.collect())) == expected and sum(expected.values()) > 100
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_mining_few_rows(spark):
    assert vafile.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 2 == 0).collect() == []
    assert vafile.mine(spark.createDataFrame([(2, [1.0], 1)], VECTORS), F.col("vec_id") % 2 == 0).collect() == []
    found = vafile.mine(spark.createDataFrame([(2, [1.0], 1), (3, [1.0], 1), (5, [0.9], 0), (6, [0.5], 0)], VECTORS), F.col("vec_id") == 2).collect()
    assert [tuple(r) for r in found] == [(2, 3, 1, 5, 65536, 256 * 230)]


def test_bounds_hold_and_leave_most_rows_unscored():
    r = np.random.default_rng(1)
    x = np.floor(256 * r.normal(size=(4000, 64)) / 8).astype(np.int64)
    first, last = vafile.edges_of(x[:500], x.min(0), x.max(0))
    cells = vafile.cells_of(x, first)
    places = cells.astype(np.int32) + np.arange(64, dtype=np.int32) * vafile.CELLS
    low, high = vafile.Bounds(x[0], first, last)(places)
    scores = x @ x[0]
    assert (low <= scores).all() and (scores <= high).all()
    assert (high[1:] >= np.partition(low[1:], -5)[-5]).sum() < 400
    assert ((np.take_along_axis(first, cells.T.astype(int), 1).T <= x) & (x <= np.take_along_axis(last, cells.T.astype(int), 1).T)).all()
