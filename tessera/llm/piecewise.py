"""Document fingerprints by context-triggered piecewise hashing."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from tessera.llm.common import give_back, groups, partitions

#: A piece ends where the rolling hash of this many bytes triggers.
WINDOW = 7
#: Block sizes are LEAST times powers of two; the first signature aims at LENGTH characters, the second at half.
LEAST, LENGTH = 3, 64
#: Signatures without this many characters in a row in common are unlike, however many they share here and there.
COMMON = 5
#: Candidates drawn for each chunk's first row; more make chunks more even.
OVERSAMPLE = 8
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)


def rolling(raw: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the last seven bytes at each place: two weighted sums and a shifted exclusive or."""
    n = len(raw)
    padded = np.zeros(n + WINDOW - 1, np.uint32)
    padded[WINDOW - 1 :] = raw
    sums, shifted = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for age in range(WINDOW):
        byte = padded[WINDOW - 1 - age : WINDOW - 1 - age + n]
        sums += byte * np.uint32(1 + WINDOW - age)
        shifted ^= byte << np.uint32(5 * age)
    return sums + shifted


def _signature(prefix: np.ndarray, ends: np.ndarray, most: int) -> str:
    """A letter for each piece: all that ends at a trigger, and what is left. From the last letter but one on, the rest
    of the text is one piece, so the whole text counts however often it triggers."""
    n = len(prefix) - 1
    stops = ends[: most - 1] + 1
    if n and (not len(stops) or stops[-1] < n):
        stops = np.append(stops, n)
    starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
    back = np.array([pow(_INVERSE, int(s), 1 << 64) for s in starts], np.uint64)
    h = (prefix[stops] - prefix[starts]) * back  # the polynomial over a piece's own bytes, wherever it stands
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return _LETTERS[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint_of(text: str) -> str:
    """block size:signature:signature at twice the block size. The block size follows from the length in bytes and is
    halved while the text triggers too rarely for half a signature."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, block = len(raw), LEAST
    while block * LENGTH < n:
        block *= 2
    h = rolling(raw)
    power = np.full(n + 1, _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    while True:
        ends = np.flatnonzero(h % np.uint32(block) == block - 1)
        if block == LEAST or len(ends) + 1 >= LENGTH // 2:
            break
        block //= 2
    rarer = ends[h[ends] % np.uint32(2 * block) == 2 * block - 1]  # what triggers at twice the size triggers here too
    return f"{block}:{_signature(prefix, ends, LENGTH)}:{_signature(prefix, rarer, LENGTH // 2)}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a whole row of the table at a time as the bits of one number."""
    full = (1 << len(a)) - 1
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    """1 less the edit distance (a letter put in or taken out costs 1, replaced 2) over the letters of both."""
    # long runs of one letter tell of repetition, not of content
    a, b = (re.sub(r"(.)\1{3,}", r"\1\1\1", x) for x in (a, b))
    run = min(COMMON, len(a), len(b))
    if not run or not {a[k : k + run] for k in range(len(a) - run + 1)} & {b[k : k + run] for k in range(len(b) - run + 1)}:
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness_of(a: str, b: str) -> float:
    """0 to 1: the best of the signatures of equal block size; 1 for equal fingerprints, 0 where no size is shared."""
    if a == b:
        return 1.0
    size_a, first_a, second_a = a.split(":")
    size_b, first_b, second_b = b.split(":")
    x, y = int(size_a), int(size_b)
    if x == y:
        return max(_alike(first_a, first_b), _alike(second_a, second_b))
    if x == 2 * y:
        return _alike(first_a, second_b)
    return _alike(second_a, first_b) if y == 2 * x else 0.0


@F.pandas_udf(StringType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """The fingerprint of a text, null as empty; equal texts have equal ones."""
    return texts.fillna("").map(fingerprint_of)


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two fingerprints; a null one is like nothing."""
    return pd.Series([likeness_of(x, y) if isinstance(x, str) and isinstance(y, str) else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def _order_key(doc_id: Column, text: Column) -> Column:
    """A string that sorts as (doc_id, text's hash) does, nulls first."""
    digits = F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("1"), digits), F.lit("0")), F.lpad(F.hex(F.xxhash64(text)), 16, "0"))


def with_next(docs: DataFrame) -> DataFrame:
    """(chunk, last, key, doc_id, text) by chunk in ascending doc_id, such that the row after each is in its chunk.

    The order is cut at keys of rows drawn by hash, so a cut is itself the first row of its chunk: every row knows its
    chunk, and whether it has to be sent to the chunk before as well, whose end it closes (`last`; the first row of all
    closes the last chunk). Texts are dealt out once. The cuts are a bounded number for each chunk, and there are as
    many chunks as groups."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", _order_key(F.col("doc_id"), F.col("text")))
    n, least = keyed.agg(F.count(F.lit(1)), F.min("key")).first()
    chunks = groups(docs.sparkSession)
    every = max(1, n // (chunks * OVERSAMPLE))
    drawn = keyed.filter(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(every)) == 0).select("key").distinct().orderBy("key").collect()
    cuts = sorted({least or "", *[r[0] for r in drawn][:: max(1, len(drawn) // chunks)]})
    begins = np.array([c.encode() for c in cuts], "S33")

    @F.arrow_udf("array<struct<chunk:int,last:boolean>>")
    def places(keys: pa.Array) -> pa.Array:
        raw = np.array(keys.cast(pa.binary()).to_pylist(), "S33")
        chunk = np.searchsorted(begins, raw, "right") - 1
        first = begins[chunk] == raw
        before = (chunk - 1) % len(begins)
        count = 1 + first.astype(np.int32)
        offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        own = offsets[:-1]
        to, last = np.empty(offsets[-1], np.int32), np.zeros(offsets[-1], bool)
        to[own], to[own[first] + 1], last[own[first] + 1] = chunk, before[first], True
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(to), pa.array(last)], names=["chunk", "last"]))

    sent = keyed.select("doc_id", "text", "key", F.explode(places("key")).alias("to")).select(F.col("to.chunk").alias("chunk"), F.col("to.last").alias("last"), "key", "doc_id", "text")
    return sent.repartition(partitions(docs.sparkSession), "chunk").sortWithinPartitions("chunk", "last", "key")


def edited_text(text: str, following: str) -> str:
    """The last half of a text, rounded down, replaced by as much of the beginning of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """COMPARED for every row of docs: its fingerprint, that of its edited text and how alike it is to this and to the
    fingerprint of the next document.

    Documents follow each other by ascending doc_id, null ids first, equal ids by a hash of the text; after the last
    comes the first. Null texts are empty; equal texts have equal fingerprints and likeness 1; an empty text is like
    empty ones only; repeated rows follow each other; one row follows itself; an empty table has no rows. A long text
    counts whole. Other columns are not looked at. Rows stream by in order: a task holds two texts and a batch."""

    def compare(batches):
        held = mark = None  # the row before, which waits for its next
        for batch in batches:
            out = []
            # one text at a time is a Python string
            for chunk, last, doc_id, text in zip(batch.column(0), batch.column(1), batch.column(3), batch.column(4), strict=True):
                place, closing, whole = chunk.as_py(), last.as_py(), text.as_py()
                if closing and mark == (place, True):
                    continue  # a row that closes a chunk more than once is repeated there
                now = (doc_id.as_py(), whole, fingerprint_of(whole))
                if held is not None and mark == (place, False):
                    out.append(_compared(held, now))
                held, mark = now, (place, closing)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
            del batch, out
            give_back()

    return with_next(docs).mapInArrow(compare, COMPARED)


_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in COMPARED.split(", "))])


def _compared(row: tuple, following: tuple) -> dict:
    doc_id, text, own = row
    edited = edited_text(text, following[1])
    other = own if edited == text else fingerprint_of(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    values = (doc_id, len(text), digest, own, other, likeness_of(own, other), likeness_of(own, following[2]))
    return dict(zip(_SCHEMA.names, values, strict=True))
