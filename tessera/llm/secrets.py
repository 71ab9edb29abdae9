"""Secret scans: three fixed shapes, and a randomness test battery for everything else that looks encoded."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, strings, text_slices

# The kinds of secrets with a fixed shape, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_VALUE = 8
# A run that is long enough is matched as a whole, so the lower bounds stand in the patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: What the battery looks at: maximal runs of this length over the characters of the usual encodings.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Encodings from the narrowest alphabet up; symbols in the order of their values.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", DIGITS + "abcdef"),
    ("hex", DIGITS + "ABCDEF"),
    ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER),
    ("base36", DIGITS + UPPER),
    ("base62", DIGITS + UPPER + LOWER),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
)
#: A token stays a candidate if randomness is not rejected at this level.
ALPHA = 0.01
#: Chance that two neighbouring characters of ordinary text (names, slugs, numbered words) differ in class.
CHANGE = 0.15
#: What is known of ordinary text before any is read: how often letters come, in thousandths of a percent of all letters
#: (English; others are near), counted as so many letters.
LETTERS = dict(zip(LOWER, (8167, 1492, 2782, 4253, 12702, 2228, 2015, 6094, 6966, 153, 772, 4025, 2406, 6749, 7507, 1929, 95, 5987, 6327, 9056, 2758, 978, 2360, 150, 1974, 74), strict=True))
PRIOR_LETTERS = 2000
#: Letters of ordinary text are drawn evenly with this chance, so that a rare pair of letters alone shows little.
EVEN = 0.1
#: Decimal logarithm of a character's share in its class, letters apart.
SHARES = dict.fromkeys(DIGITS, -1.0) | dict.fromkeys("+/-_", -math.log10(4))
#: False-discovery rate among the tokens reported as random.
FDR = 0.01
#: Evidence is kept in tenths of a decade, up to this many.
BINS = 3000

SPAN = "struct<start:bigint,rank:int,stop:bigint,kind:string>"


def _normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_squared_tail(x: float, df: int) -> float:
    """Upper tail by the Wilson-Hilferty cube root."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(core: str, alphabet: str) -> float:
    """Fisher's combination of three p-values under the hypothesis that `core` is uniform over `alphabet`:
    chi-squared over equal slices of the alphabet, runs above and below its middle, serial correlation at lag 1."""
    k, n = len(alphabet), len(core)
    place = {c: i for i, c in enumerate(alphabet)}
    x = [place[c] for c in core]
    slices = min(k, max(2, n // 5))
    share = [0.0] * slices
    for i in range(k):
        share[i * slices // k] += 1 / k
    seen = [0] * slices
    for v in x:
        seen[v * slices // k] += 1
    chi = _chi_squared_tail(sum((o - n * e) ** 2 / (n * e) for o, e in zip(seen, share, strict=True)), slices - 1)
    above = [v * 2 >= k for v in x]
    high = sum(above)
    low = n - high
    if high and low:
        runs = 1 + sum(a != b for a, b in zip(above, above[1:], strict=False))
        mean = 1 + 2 * high * low / n
        var = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
        p_runs = _normal_two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    middle, spread = (k - 1) / 2, (k * k - 1) / 12
    lag = sum((a - middle) * (b - middle) for a, b in zip(x, x[1:], strict=False)) / spread
    p_serial = _normal_two_sided(lag / math.sqrt(n - 1))
    half = -sum(math.log(max(p, 1e-300)) for p in (chi, p_runs, p_serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


@dataclass
class Text:
    """Ordinary text as a null hypothesis: a character's class stays but for CHANGE, and letters follow each other as
    they do in the corpus. Logarithms are decimal."""

    letter: np.ndarray  # of each letter's share
    pair: np.ndarray  # of how much more often a letter comes after another than its share says

    @staticmethod
    def of(counts: np.ndarray) -> Text:
        """From 27 x 26 counts of a letter (a to z) after a letter or, in the last row, after anything else."""
        prior = np.array([LETTERS[c] for c in LOWER], float)
        prior /= prior.sum()
        total = counts.sum(0) + PRIOR_LETTERS * prior
        share = (1 - EVEN) * total / total.sum() + EVEN / 26
        after = counts[:26] + PRIOR_LETTERS * prior
        after = (1 - EVEN) * after / after.sum(1, keepdims=True) + EVEN / 26
        return Text(np.log10(share), np.log10(after / share))

    def uniformity(self, core: str, k: int) -> float:
        """Evidence of the composition: the logarithm of the ratio of even shares in the encoding to ordinary ones."""
        ordinary = sum(SHARES.get(c, 0.0) if not c.isalpha() else float(self.letter[ord(c.lower()) - 97]) for c in core)
        return len(core) * (math.log10(4) - math.log10(k)) - ordinary

    def runs(self, core: str) -> float:
        """Evidence of the runs of classes: that of classes which do not heed each other against ones that stay."""
        kinds = [_class(c) for c in core]
        changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
        stays = len(core) - 1 - changes
        return -changes * math.log10(4 * CHANGE / 3) - stays * math.log10(4 * (1 - CHANGE))

    def serial(self, core: str) -> float:
        """Evidence of the pairs of neighbouring letters: that of letters which do not heed each other."""
        x = [ord(c.lower()) - 97 if c.isalpha() else -1 for c in core]
        return -sum(float(self.pair[a, b]) for a, b in zip(x, x[1:], strict=False) if a >= 0 and b >= 0)

    def evidence(self, core: str, alphabet: str, p: float) -> int:
        """Tenths of decades of evidence against ordinary text, from the battery alone: the evidence of its three
        statistics, whose sum is the likelihood ratio of even characters of the encoding to ordinary text, lowered by
        the p-value of evenness and by the number of encodings, of which the fitting one is picked.

        Under ordinary text a ratio of r or more has a probability of 1 / r at most, at every length and for every
        encoding, and whatever the other tokens are; so 1 / ratio serves as a p-value."""
        ratio = self.uniformity(core, len(alphabet)) + self.runs(core) + self.serial(core)
        return max(0, min(BINS, int(10 * (ratio + math.log10(max(p, 1e-300)) - math.log10(len(ENCODINGS))))))


class Judge(dict):
    """(encoding, p-value of evenness, evidence against text) of candidates, each judged once; None for mere numbers."""

    def __init__(self, text: Text):
        super().__init__()
        self.text = text

    def __missing__(self, token: str) -> tuple[str, float, int] | None:
        core = token.rstrip("=")
        letters, found = set(core), None
        if any(c.isalpha() for c in letters):
            for name, alphabet in ENCODINGS:
                if letters <= set(alphabet):
                    p = randomness(core, alphabet)
                    found = f"random-{name}", p, self.text.evidence(core, alphabet, p)
                    break
        if len(self) < 1 << 14:
            self[token] = found
        return found


_FOLD = np.full(256, 26, np.uint16)
_FOLD[97:123] = _FOLD[65:91] = np.arange(26)


def ordinary_text(docs: DataFrame) -> Text:
    """The null hypothesis from all texts of (text): how often letters follow each other, a table of 27 x 26 counts."""

    def count(batches):
        total = np.zeros(27 * 27, np.int64)
        for batch in batches:
            whole = batch.column(0).cast(pa.large_string()).fill_null("").cast(pa.large_binary())
            for _, part in text_slices(whole):
                for t in part:
                    x = _FOLD[np.frombuffer(t.as_buffer(), np.uint8)] if len(t.as_buffer()) else np.zeros(0, np.uint16)
                    total += np.bincount(np.concatenate([[26], x[:-1]]).astype(np.int32) * 27 + x if len(x) else [], minlength=27 * 27).astype(np.int64)
            del batch, whole
            give_back()
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["place", "n"])

    rows = docs.select("text").mapInArrow(count, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()  # 729 rows at most
    counts = np.zeros(27 * 27)
    for r in rows:
        counts[r["place"]] = r["n"]
    return Text.of(counts.reshape(27, 27)[:, :26])


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int, str]], judge: Judge) -> list[tuple[int, int, str, float, int]]:
    """(start, end, encoding, p-value, evidence) of the tokens that no base span touches."""
    out = []
    ends = max((b[2] for b in base), default=0)
    for m in CANDIDATE.finditer(text):
        if m.start() < ends and any(b[0] < m.end() and m.start() < b[2] for b in base):
            continue
        if (found := judge[m.group()]) is not None:
            out.append((m.start(), m.end(), *found))
    return out


@dataclass
class Rule:
    """What a corpus tells of ordinary text, and the evidence from which a token is reported."""

    text: Text
    level: int
    alpha: float = ALPHA

    def spans(self, text: str, judge: Judge) -> list[tuple[int, int, int, str]]:
        """The base spans, and the tokens that pass the battery and reach the level of evidence, in order."""
        base = base_spans(text)
        return sorted(base + [(s, 3, e, name) for s, e, name, p, score in candidates(text, base, judge) if p >= self.alpha and score >= self.level])


def evidence_column(text: Column, ordinary: Text) -> Column:
    """The evidence of every candidate of a text."""

    @F.arrow_udf("array<int>")
    def scores(texts: pa.Array) -> pa.Array:
        judge = Judge(ordinary)
        out = pa.array([[c[4] for c in candidates(t, base_spans(t), judge)] for t in strings(texts)], pa.list_(pa.int32()))
        give_back()
        return out

    return scores(text)


def learn(docs: DataFrame, fdr: float = FDR, alpha: float = ALPHA) -> Rule:
    """The rule for a corpus: ordinary text is learned from all of it, and the Benjamini-Hochberg rule over all its
    candidates sets the least evidence at which a token is reported.

    What reaches the driver is a table of letter pairs and a histogram of at most BINS + 1 rows. With no candidates, or
    none that stands out, the level is above every possible value."""
    text = ordinary_text(docs)
    rows = docs.select(F.explode(evidence_column(F.col("text"), text)).alias("evidence")).groupBy("evidence").count().collect()
    total, above, level = sum(r["count"] for r in rows), 0, BINS + 1
    for r in sorted(rows, key=lambda r: -r["evidence"]):
        above += r["count"]
        if 10 ** (-r["evidence"] / 10) <= fdr * above / total:
            level = r["evidence"]
    return Rule(text, level, alpha)


def find(text: Column, rule: Rule) -> Column:
    """All spans of a text, as an array of structs."""

    @F.arrow_udf(f"array<{SPAN}>")
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("stop", pa.int64()), ("kind", pa.string())]))
        judge = Judge(rule.text)
        out = []
        for t in strings(texts):
            out.append([{"start": s, "rank": r, "stop": e, "kind": k} for s, r, e, k in rule.spans(t, judge)])
        give_back()
        return pa.array(out, kind)

    return spans(text)


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """docs with the column `secrets`: the spans of secrets in code points, end exclusive, by start and kind. Kinds of
    the fixed shapes are KINDS; what the battery adds is called random- and the encoding.

    Null and empty texts have none; very long ones are scanned whole. The same token is judged alike wherever it
    stands, and repeated rows fare alike. An empty table stays empty. An earlier column of that name is replaced; all
    others stay."""
    return docs.withColumn("secrets", find(F.col("text"), learn(docs.select("text"), fdr)))


def _masked(text: str, spans: list[tuple[int, int, int, str]], mark: str) -> str:
    parts, at = [], 0
    for start, _, stop, _ in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, stop)
    return "".join([*parts, text[at:]])


def mask(docs: DataFrame, mark: str = "<secret>", fdr: float = FDR, alpha: float = ALPHA) -> DataFrame:
    """docs with every secret of the text replaced by a mark and n_chars, where there is one, counted anew. Spans that
    touch share a mark.

    Null texts stay null and empty ones empty; repeated rows fare alike; an empty table stays empty; all other columns
    are left as they are, whatever their names."""
    rule = learn(docs.select("text"), fdr, alpha)

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        known, judge = texts.is_valid().to_pylist(), Judge(rule.text)
        out = pa.array([_masked(t, rule.spans(t, judge), mark) if there else None for t, there in zip(strings(texts), known, strict=True)], pa.string())
        give_back()
        return out

    found = docs.withColumn("text", masked("text"))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found
