"""Quality rules: text statistics, and an ordered list of threshold conjunctions learned from labelled documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, ngram_hashes, text_slices, word_hashes

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: The statistics: the first five are the contract's, the others serve the learned rules.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "distinct_rate", "top_word_rate", "short_word_rate", "long_word_rate", "line_words")
#: At most so many labelled rows are learned from; which ones, a hash of the id decides.
SAMPLE = 20_000
STATS = "struct<" + ",".join([f"{c}:bigint" for c in COUNTS] + [f"{c}:double" for c in RATES]) + ">"


def _line_counts(text: str) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines), len(lines) - len(set(lines))


def _repeat_words(words: np.ndarray) -> int:
    """Words that lie in a window of WINDOW words which the text holds twice or more."""
    grams = ngram_hashes(words, WINDOW)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _rows(texts: pa.Array) -> list[tuple]:
    hashes, first, starts, ends = word_hashes(texts)
    lengths = ends - starts
    out = []
    for k, raw in enumerate(texts.to_pylist()):
        text = raw.decode()
        words = hashes[first[k] : first[k + 1]]
        n = len(words)
        chars = len(text) - sum(map(text.count, SPACES))
        symbols = sum(map(text.count, SYMBOLS))
        lines, dup_lines = _line_counts(text)
        repeats = _repeat_words(words)
        bytes_ = np.frombuffer(raw, np.uint8)
        per_char, per_word = max(chars, 1), max(n, 1)
        upper = int(((bytes_ >= 65) & (bytes_ <= 90)).sum())
        digits = int(((bytes_ >= 48) & (bytes_ <= 57)).sum())
        marks = sum(map(text.count, "!?"))
        counts = np.unique(words, return_counts=True)[1] if n else np.zeros(1, np.int64)
        size = lengths[first[k] : first[k + 1]]
        out.append((n, chars, symbols, dup_lines, repeats, chars / per_word, symbols / per_char, dup_lines / max(lines, 1), repeats / per_word, upper / per_char, digits / per_char, marks / per_char, (len(counts) if n else 0) / per_word, counts.max() / per_word, float((size <= 2).sum()) / per_word, float((size >= 20).sum()) / per_word, n / max(lines, 1)))
    return out


def statistics(text: Column) -> Column:
    """A struct of the statistics of a whole text; null counts as empty, and an empty text has zeros."""

    @F.arrow_udf(STATS)
    def stats(texts: pa.Array) -> pa.Array:
        whole = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
        rows = [r for _, part in text_slices(whole) for r in _rows(part)]
        del whole
        give_back()
        columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(COUNTS) + len(RATES))
        kinds = [pa.int64()] * len(COUNTS) + [pa.float64()] * len(RATES)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*COUNTS, *RATES])

    return stats(text)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self, stats: Column) -> Column:
        return stats[self.feature] >= F.lit(self.threshold) if self.above else stats[self.feature] < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best_condition(x: dict[str, np.ndarray], y: np.ndarray, inside: np.ndarray, cuts: int) -> Condition | None:
    """The threshold with the greatest information gain for the positives inside, in the manner of FOIL."""
    p0, n0 = int(y[inside].sum()), int((~y[inside]).sum())
    base = np.log2(p0 / (p0 + n0))
    best, found = 1e-9, None
    for feature, values in x.items():
        v, t = values[inside], y[inside]
        points = np.unique(np.quantile(v, np.linspace(0, 1, cuts + 1)[1:-1], method="nearest"))
        order = np.argsort(v, kind="stable")
        pos = np.concatenate([[0], np.cumsum(t[order])])
        at = np.searchsorted(v[order], points, "left")  # rows below each point
        for above in (True, False):
            p = p0 - pos[at] if above else pos[at]
            n = (len(v) - at if above else at) - p
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1)) - base), -1.0)
            if len(gain) and gain.max() > best:
                best, found = float(gain.max()), Condition(feature, above, float(points[int(gain.argmax())]))
    return found


def learn(x: dict[str, np.ndarray], reject: np.ndarray, prune: np.ndarray, *, least_precision: float = 0.95, least_cover: int = 5, most_rules: int = 16, most_conditions: int = 4, cuts: int = 64) -> list[Rule]:
    """Sequential covering: grow a conjunction on the growing rows, prune it on the others, keep it if it is precise
    there, set aside what it covers, and go on until no rule is precise enough."""
    y = reject.astype(bool)
    left = np.ones(len(y), bool)
    rules: list[Rule] = []
    while len(rules) < most_rules:
        grow, hold = left & ~prune, left & prune
        if y[grow].sum() < least_cover:
            break
        inside, rule = grow.copy(), ()
        while len(rule) < most_conditions and (~y[inside]).any():
            if (c := _best_condition(x, y, inside, cuts)) is None:
                break
            rule += (c,)
            inside &= c.holds(x)
        if not rule:
            break

        def worth(r: Rule, rows: np.ndarray = hold) -> float:
            hit = _covers(r, x, len(y)) & rows
            p, n = int(y[hit].sum()), int((~y[hit]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _covers(rule, x, len(y)) & left
        held = hit & hold
        precise = lambda rows: rows.any() and y[rows].mean() >= least_precision
        if hit.sum() < least_cover or not precise(hit) or (held.any() and not precise(held)):
            break
        rules.append(rule)
        left &= ~hit
    return rules


def labelled_sample(labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> DataFrame:
    """(doc_id, label, fold) of at most `most` labelled rows, those with the least hash of the id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("_label"))
    return known.withColumn("_hash", F.xxhash64("doc_id", F.lit(5))).orderBy("_hash", "_label").limit(most).select("doc_id", "_label", (F.pmod("_hash", F.lit(3)) == 0).alias("_prune"))


def learn_rules(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[Rule]:
    """The rules of a bounded labelled sample; what is broadcast and collected is bounded by `most`. No labels, no rules."""
    sample = F.broadcast(labelled_sample(labels, most=most))
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select(statistics(F.col("text")).alias("s"), "_label", "_prune").select("s.*", "_label", "_prune").toArrow()
    if not rows.num_rows:
        return []
    x = {c: rows[c].to_numpy().astype(float) for c in (*COUNTS, *RATES)}
    order = np.lexsort([rows["_label"].to_numpy(), *x.values()])  # the same rules however the rows arrive
    return learn({c: v[order] for c, v in x.items()}, rows["_label"].to_numpy()[order] == 0, rows["_prune"].to_numpy(zero_copy_only=False)[order])


def verdict(stats: Column, rules: list[Rule]) -> Column:
    """The first rule that holds, as text; null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        held = F.lit(True)
        for c in rule:
            held = held & c.column(stats)
        out = F.when(held, F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])


def judged(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(row, stats, base_failed, rule, kept) of every row of docs, of which `row` holds all columns, whatever their
    names; `rule` is the learned rule that rejects it, or null.

    Every row is judged by its own whole text: null and empty texts fail the base rule, equal texts and repeated rows
    fare alike, and without usable labels only the base rule holds. An empty table gives no rows. Labels without an id
    or a value teach nothing; ids with several labels teach each of them."""
    rules = learn_rules(docs, labels, most)
    found = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), statistics(docs["text"]).alias("stats"))
    stats = F.col("stats")
    found = found.select("row", "stats", base_failed(stats).alias("base_failed"), verdict(stats, rules).alias("rule"))
    return found.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
