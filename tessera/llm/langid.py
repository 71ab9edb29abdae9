"""Language identification with error-correcting output codes over character n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import give_back, text_slices

#: Hashed n-grams of one to three characters of the lower-cased text go to so many places each.
PLACES = 1 << 14
ORDERS = (1, 2, 3)
FEATURES = PLACES * len(ORDERS)
#: Learned from at most so many labelled documents, an equal share for each language, those with the least hash of the id.
SAMPLE = 20_000
#: A language's share is this at least, however many languages there are.
LEAST_SHARE = 100
#: The sampled texts are summed in so many tasks.
SPREAD = 16
#: A learned code is searched for among so many seeded draws.
CODE_DRAWS = 64
UNKNOWN = "und"
#: A prediction is ambiguous if the second-best language is within this factor of the best one's probability.
AMBIGUOUS = 3.0


@lru_cache(1)
def _classes() -> np.ndarray:
    """Code points by use: 0 for what is no letter, else a folded letter's code point."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low[0])
    return table


def _grams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(feature numbers, counts) of a text, or None if it has no letter. Runs of what is no letter count as one gap."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _classes()[points]
    if not x.any():
        return None
    keep = x > 0
    keep[1:] |= x[:-1] > 0  # the first non-letter after a letter stands for the gap
    x = x[keep].astype(np.uint64)
    x = np.concatenate([np.zeros(1, np.uint64), x]) if x[0] else x
    found, h = [], np.zeros(len(x), np.uint64)
    for k, order in enumerate(ORDERS):
        n = len(x) - order + 1
        if n <= 0:
            break
        h = h[:n] * np.uint64(1_000_003) + x[order - 1 :] + np.uint64(1)
        place = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)).astype(np.int64)
        found.append(place + k * PLACES)
    counts = np.bincount(np.concatenate(found), minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at, counts[at]


def code(languages: int) -> np.ndarray:
    """Codewords of +1 and -1, a row for each language: all distinct splits up to five languages, else the draw of
    12 log2(languages) columns with the greatest distance between rows."""
    if languages <= 1:
        return np.ones((languages, 1), np.int8)
    if languages <= 5:
        splits = np.arange(1, 1 << (languages - 1))  # the first language is always +1, so no split comes twice
        bits = np.stack([np.zeros_like(splits)] + [(splits >> k) & 1 for k in range(languages - 1)])
        return (1 - 2 * bits).astype(np.int8)
    length = int(np.ceil(12 * np.log2(languages)))
    best, least = None, -1
    for seed in range(CODE_DRAWS):
        draw = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (languages, length))
        same = np.abs(draw.astype(int).sum(0)) == languages
        draw[0, same] *= -1  # a column must split the languages
        apart = ((length - draw.astype(int) @ draw.T.astype(int)) // 2)[~np.eye(languages, dtype=bool)].min()
        if apart > least:
            best, least = draw, apart
    return best


@dataclass
class Model:
    """Languages in code-point order, their codewords, and for each bit a linear n-gram classifier."""

    languages: list[str]
    codewords: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits, float32
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding

    def margins(self, text: str) -> np.ndarray | None:
        """Mean log-odds a gram for each bit; None without a letter."""
        if (found := _grams(text)) is None:
            return None
        at, n = found
        return n @ self.weights[at] / n.sum() + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, ambiguous). Each codeword's loss is the trusted sum of the logistic losses of its
        bits; the nearest codeword wins, the first in code-point order on a tie."""
        m = self.margins(text) if text else None
        if m is None or not self.languages:
            return UNKNOWN, 0.0, True
        loss = np.logaddexp(0.0, -self.codewords * (SHARPNESS * m)) @ self.trust
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        second = p[order[1]] if len(p) > 1 else 0.0
        return self.languages[order[0]], float(min(1.0, p[order[0]])), bool(p[order[0]] < AMBIGUOUS * second)


#: Margins are means over grams of one text; this brings them to the scale of log-odds.
SHARPNESS = 12.0


def _sample(docs: DataFrame, most: int) -> DataFrame:
    """The ids of a language's rows with the least hashes, as many for each language.

    Rows are first cut to the ranges of hashes that hold them, by counts of 256 ranges a language, so that what is
    ranked is a small part of a large language."""
    rows = docs.select("doc_id", "lang").withColumn("_hash", F.xxhash64("doc_id", F.lit(11))).withColumn("_range", F.shiftright("_hash", 56))
    counts = rows.groupBy("lang", "_range").agg(F.count(F.lit(1)).alias("_n"))
    share = max(most // max(1, counts.select("lang").distinct().count()), LEAST_SHARE)
    before = F.sum("_n").over(W.partitionBy("lang").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    needed = counts.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < share).select("lang", "_range")
    ranked = rows.join(F.broadcast(needed), ["lang", "_range"]).withColumn("_at", F.row_number().over(W.partitionBy("lang").orderBy("_hash", "doc_id")))
    return ranked.filter(F.col("_at") <= share).select("doc_id")


def language_profiles(docs: DataFrame, most: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, how many documents each has, mean gram shares of each) from (doc_id, text, lang) rows with a
    language. At most `most` rows are used, or LEAST_SHARE a language if that is more. A language's profile weighs every document alike, so that a few very long
    ones do not rule it; what reaches the driver is one row of FEATURES numbers a language and partition."""
    picked = F.broadcast(_sample(docs, most).distinct())

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                if text and (found := _grams(text)) is not None:
                    at, k = found
                    sums.setdefault(lang, np.zeros(FEATURES))[at] += k / k.sum()
                    n[lang] = n.get(lang, 0) + 1
        langs = sorted(sums)
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array([n[x] for x in langs], pa.int64()), pa.array([sums[x].astype("<f4").tobytes() for x in langs], pa.binary())], names=["lang", "n", "sums"])

    def total(rows):
        sums = np.sum([np.frombuffer(b, "<f4").astype(float) for b in sorted(rows.column("sums").to_pylist())], axis=0)
        return pa.table({"lang": rows.column("lang").slice(0, 1), "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64()), "sums": pa.array([sums.astype("<f4").tobytes()], pa.binary())})

    chosen = docs.select("doc_id", "text", "lang").join(picked, "doc_id", "left_semi").repartition(SPREAD, "doc_id").sortWithinPartitions("doc_id", "lang", "text")
    parts = chosen.select("text", "lang").mapInArrow(add, "lang string, n bigint, sums binary")
    rows = sorted(parts.groupBy("lang").applyInArrow(total, "lang string, n bigint, sums binary").collect(), key=lambda r: r["lang"])
    return [r["lang"] for r in rows], np.array([r["n"] for r in rows], float), np.array([np.frombuffer(r["sums"], "<f4").astype(float) for r in rows]).reshape(len(rows), FEATURES)


def fit(docs: DataFrame, most: int = SAMPLE) -> Model:
    """A model from the rows of (doc_id, text, lang) with a language; without any, it answers `und`."""
    languages, n, sums = language_profiles(docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()), most)
    words = code(len(languages))
    bits = words.shape[1]
    weights, bias = np.zeros((FEATURES, bits), np.float32), np.zeros(bits)
    for b in range(bits) if len(languages) > 1 else []:
        sides = []
        for side in (1, -1):
            rows = words[:, b] == side
            share = (sums[rows] / n[rows, None]).mean(0) + 1e-6  # each language counts alike
            sides.append(np.log(share / share.sum()))
        weights[:, b] = sides[0] - sides[1]
    trust = np.ones(bits)
    if len(languages) > 1:
        # centre each bit between the languages of its two sides and trust it by how far they stand apart
        mean = (sums / sums.sum(1, keepdims=True)) @ weights
        low = np.array([mean[words[:, b] == 1, b].min() for b in range(bits)])
        high = np.array([mean[words[:, b] == -1, b].max() for b in range(bits)])
        bias = -(low + high) / 2
        trust = np.maximum(low - high, 0.05)
        trust /= trust.sum() / bits
    return Model(languages, words.astype(float), weights, bias, trust)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `lang_pred`, `score` (0 to 1) and `ambiguous`, from the text alone.

    Null and empty texts and texts without a letter are `und` with score 0, and so is every text where no language was
    learned. Texts are read whole. Equal texts and repeated rows fare alike; of equally near languages the first in
    code-point order wins; an empty table stays empty. Earlier columns of these names are replaced, all others stay. The model's size is fixed by its parameters and the number of languages; it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double,ambiguous:boolean>")
    def guess(column: pa.Array) -> pa.Array:
        found = []
        for _, part in text_slices(column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())):
            found += [shared.value.predict(t.decode()) for t in part.to_pylist()]
        give_back()
        cols = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.bool_()), strict=True)], names=["lang", "score", "ambiguous"])

    added = ("lang_pred", "score", "ambiguous")
    kept = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c not in added])
    found = docs.select(kept.alias("row"), guess(docs["text"]).alias("guess"))
    return found.select("row.*", *[F.col("guess")[kind].alias(c) for c, kind in zip(added, ("lang", "score", "ambiguous"), strict=True)])


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
