"""BPE encoding by a table of distinct words, and decoding by a join of ids with pieces."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import give_back, packed, partitions, unpacked

# Fixed value: the token pattern of the byte-level pre-tokenizer; letters, by far the most frequent, are tried first.
PATTERN = regex.compile(r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters whose class is the same in every Unicode version; a text with others is split by the library itself.
SETTLED = regex.compile("[\\x00-՗Ḁ-⁯₠-₿℀-⅏←-⋿─-⛿　-ゖ゠-ヿ一-龥가-힣\U0001f300-\U0001f5ff]*+")
#: Texts of Latin letters only are cut by the same pattern with its classes written out, which is faster.
LATIN = re.compile("[\x00-\u017f]*+")
_L, _N, _S = "a-zA-Z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u017f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe", "\\t-\\r \\x85\\xa0"
LATIN_PATTERN = re.compile(rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: How many words a worker keeps encoded (about 100 MB); half of them, the longest unused, go when it is full.
CACHE_WORDS = 500_000


def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.characters = _byte_characters()
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        kind = stored["pre_tokenizer"] or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or stored.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        self.special = {x["content"]: x["id"] for x in stored["added_tokens"]}
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.vocabulary = stored["model"]["vocab"]

    def words(self, text: str) -> list[str]:
        """The words of a text, end to end: the pre-tokenizer's tokens, and special tokens as words of their own."""
        if self.splitter is None:
            return self._plain_words(text)
        parts = self.splitter.split(text)
        if len(parts) == 1:
            return self._plain_words(text)
        out = []
        for k, part in enumerate(parts):
            out += [part] if k % 2 else self._plain_words(part) if part else []
        return out

    def _plain_words(self, text: str) -> list[str]:
        if LATIN.fullmatch(text):
            return LATIN_PATTERN.findall(text)
        if SETTLED.fullmatch(text):
            return PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def encode_word(self, word: str) -> bytes:
        """A word's ids as little-endian unsigned 32-bit integers."""
        if word in self.special:
            ids = [self.special[word]]
        else:
            ids = [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.characters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all pieces end to end, where each id's piece begins, with a closing total)."""
        raw = {c: b for b, c in self.characters.items()}
        out = [b""] * (max([*self.vocabulary.values(), *self.special.values()]) + 1)
        for piece, k in self.vocabulary.items():
            out[k] = bytes(raw[c] for c in piece)
        for piece, k in self.special.items():
            out[k] = piece.encode()
        return np.frombuffer(b"".join(out), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in out])])


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class WordCache(dict):
    """Words encoded on first sight. When it is half full the words so far become the older half, of which those that
    come again are taken over; so frequent words stay and a worker's memory is bounded."""

    def __init__(self, of: Vocabulary):
        super().__init__()
        self.of = of
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS // 2:
            self.older = dict(self)
            self.clear()
        found = self[word] = self.older.get(word) or self.of.encode_word(word)
        return found


@lru_cache(2)
def word_cache(path: str) -> WordCache:
    return WordCache(vocabulary(path))


def encoded(text: str, path: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers, by way of the worker's cache."""
    return b"".join(map(word_cache(path).__getitem__, vocabulary(path).words(text)))


def _texts(rows: pa.Table | None) -> list[str]:
    return [] if rows is None else [t or "" for t in rows.column("text").to_pylist()]


def framed(parts: list[bytes]) -> bytes:
    """Byte strings in one compressed block: their number and lengths, then the bytes."""
    head = np.array([len(parts), *map(len, parts)], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unframed(block: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = (4 * (n + 1) + np.cumsum(np.frombuffer(raw, "<u4", n, 4))).tolist()
    return [raw[a:b] for a, b in zip([4 * (n + 1), *ends], ends, strict=False)]


class _Numbers(dict):
    """Numbers words in the order in which they are first seen."""

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        return found


def _by_slot(words: dict[str, int] | set[str], slots: int) -> list[list[bytes]]:
    """Distinct words by slot of the word table, sorted in each."""
    out: list[list[bytes]] = [[] for _ in range(slots)]
    for w in words:
        raw = w.encode()
        out[zlib.crc32(raw) % slots].append(raw)
    for x in out:
        x.sort()
    return out


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with the column `ids` (array<int>): the ids of the whole text, as the library gives them.

    Documents are dealt into groups by id and text. Each group sends its distinct words to the word table, dealt by a
    checksum of the word; there every word is encoded once however many groups ask, and its ids go back to each of
    them; the group then joins ids to its words by position. A word in a third of all texts is one row for each group,
    so no task grows with its frequency. Null and empty texts have no ids; repeated rows are rows of their own; an empty
    table stays empty; a column named `ids` is replaced, all others stay."""
    return _by_word_table(docs, path, lambda flat, offsets, marks: [_lists(flat, offsets)], {"ids": "array<int>"})


def encode_checked(docs: DataFrame, path: str) -> DataFrame:
    """docs with `ids` as `encode` gives them and `round_trip`: whether decoding them gives the text again (null counts
    as empty). Of the decoded text nothing is sent anywhere."""

    def checked(flat: np.ndarray, offsets: np.ndarray, marks: list[bytes]) -> list[pa.Array]:
        same = [_mark(t) == m for t, m in zip(_decoded(flat, offsets, path), marks, strict=True)]
        return [_lists(flat, offsets), pa.array(same, pa.bool_())]

    return _by_word_table(docs, path, checked, {"ids": "array<int>", "round_trip": "boolean"})


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """docs with `n_tokens`, `ids_sha256` and `decoded_sha256`: what `encode` gives and the text that `decode` makes of
    it, as digests taken where the ids are joined, so that neither is sent anywhere. Rows fare as under `encode`;
    columns of these names are replaced."""

    def digests(flat: np.ndarray, offsets: np.ndarray, marks: list[bytes]) -> list[pa.Array]:
        decoded = [hashlib.sha256(t.encode()).hexdigest() for t in _decoded(flat, offsets, path)]
        return [pa.array(np.diff(offsets), pa.int64()), pa.array(_digests(flat, offsets), pa.string()), pa.array(decoded, pa.string())]

    return _by_word_table(docs, path, digests, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})


def _mark(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))


def _by_word_table(docs: DataFrame, path: str, made, columns: dict[str, str]) -> DataFrame:
    """docs with the columns that `made(flat ids, offsets, digests of the texts)` gives for each group of documents.

    Groups travel as compressed blocks, and a group asks for its distinct words only: a row for each word and document
    would shuffle several times the input (the README has figures)."""
    n = 2 * partitions(docs.sparkSession)
    docs = docs.drop(*columns)
    names = docs.columns
    rows = packed(docs, F.pmod(F.xxhash64(F.col("doc_id"), F.xxhash64("text")), F.lit(n)).cast("int"), n)

    def ask(key, blocks):
        of, seen = vocabulary(path), set()
        for t in _texts(unpacked(blocks)):
            seen.update(of.words(t))
        asked = [(k, framed(x)) for k, x in enumerate(_by_slot(seen, n)) if x]
        del seen
        give_back()
        return pa.table({"slot": pa.array([k for k, _ in asked], pa.int32()), "gid": pa.array([key[0].as_py()] * len(asked), pa.int32()), "words": pa.array([x for _, x in asked], pa.binary())})

    def answer(key, asked):
        of, table, out = vocabulary(path), {}, []
        for block in asked.column("words"):
            words = unframed(block.as_py())
            for w in words:
                if w not in table:
                    table[w] = of.encode_word(w.decode())
            out.append(framed([table[w] for w in words]))
        del table
        give_back()
        return pa.table({"gid": asked.column("gid"), "slot": asked.column("slot"), "ids": pa.array(out, pa.binary())})

    def join(blocks, answers):
        of, numbers = vocabulary(path), _Numbers()
        found = unpacked(blocks)
        placed, marks = [], []
        for t in _texts(found):
            placed.append(np.array(list(map(numbers.__getitem__, of.words(t))), np.int32))
            marks.append(_mark(t))
        by_slot, table = _by_slot(numbers, n), [b""] * len(numbers)
        for slot, ids in zip(answers.column("slot").to_pylist(), answers.column("ids"), strict=True):
            for w, got in zip(by_slot[slot], unframed(ids.as_py()), strict=True):
                table[numbers[w.decode()]] = got
        del numbers, by_slot
        joined = [b"".join(map(table.__getitem__, at.tolist())) for at in placed]
        del placed, table
        offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in joined])])
        more = made(np.frombuffer(b"".join(joined), "<u4"), offsets, marks)
        del joined
        give_back()
        return pa.table([*([] if found is None else found.columns), *more], names=[*(names if found is not None else []), *columns])

    words = rows.groupBy("gid").applyInArrow(ask, "slot int, gid int, words binary")
    answers = words.groupBy("slot").applyInArrow(answer, "gid int, slot int, ids binary")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{c} {kind}" for c, kind in columns.items())])
    return rows.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(join, schema)


def _flat(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, where each row's begin, with a closing total)."""
    values = ids.flatten().to_numpy(zero_copy_only=False)
    return values, np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in ids])]) if ids.null_count else ids.offsets.to_numpy() - ids.offsets[0].as_py()


def _decoded(values: np.ndarray, offsets: np.ndarray, path: str):
    """The text of each run of ids: ids are joined to their pieces by position in the table of pieces."""
    blob, begins = _pieces(path)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        parts = []
        for k in range(a, b, 1 << 17):
            some = values[k : min(b, k + (1 << 17))].astype(np.int64)
            some = some[(some >= 0) & (some < len(begins) - 1)]
            length = begins[some + 1] - begins[some]
            ends = np.cumsum(length)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[some] - ends + length, length)
            parts.append(blob[at].tobytes())
        yield b"".join(parts).decode("utf-8", "replace")


def decode(ids: Column, path: str) -> Column:
    """The text of an array of ids: each id is joined to its piece and the pieces' bytes are read as UTF-8, with the
    replacement character for what is not UTF-8. The table of pieces has a row for each id of the vocabulary file, so
    its size is fixed. Null ids give an empty text; ids outside the vocabulary give nothing."""

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array(list(_decoded(*_flat(column), path)), pa.string())

    return text(ids)


@lru_cache(2)
def _pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    return vocabulary(path).pieces()


def _digests(values: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw = np.ascontiguousarray(values, "<u4").view(np.uint8)
    return [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def digest(ids: Column) -> Column:
    """SHA-256 in lowercase hex of ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("string")
    def sha(column: pa.Array) -> pa.Array:
        return pa.array(_digests(*_flat(column)), pa.string())

    return sha(ids)
