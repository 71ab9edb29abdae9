"""Token-id files: each document a zstandard frame of its own under one shared dictionary, with an offset index.

A folder holds `dictionary-<sha256>.bin`, `part-00000.tok`, ... in ascending order of doc_id, and `manifest.json`,
written last. A part is

    magic (8 bytes) | sha256 of the dictionary (32) | bytes of an id, 2 or 4 (8)
    frames, end to end
    doc ids (i64 each) | 1 where the doc id is null (u8 each) | ids of each (u32) | where each frame begins (u64)
    where the index begins (u64) | documents (u64) | ids (u64) | magic

so one document is read with the index and a single range of bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encoded, vocabulary
from tessera.llm.common import partitions

MAGIC = b"TSRTOK\x00\x01"
HEAD, TAIL = 48, 32
#: The dictionary is trained on at most so many documents of at most so many characters, those with the least hash of
#: the id: short documents are what it is for.
SAMPLE, SAMPLE_CHARS = 2_000, 8_192
DICTIONARY_BYTES = 1 << 16
LEVEL = 3


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _put(uri: str, data: bytes) -> None:
    """Write under another name and move: a file is whole or not there, and a retried task may write it again."""
    store, path = _filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(temporary := f"{path}.{uuid.uuid4().hex}") as out:
        out.write(data)
    store.move(temporary, path)


def _get(uri: str) -> bytes:
    store, path = _filesystem(uri)
    with store.open_input_stream(path) as f:
        return f.read()


def _encoded(text: str | None, path: str, end: bytes) -> bytes:
    return encoded(text or "", path) + end


def _narrow(ids: bytes, width: int) -> bytes:
    return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if width == 2 else ids


def train_dictionary(docs: DataFrame, path: str, end: bytes, width: int, most: int = SAMPLE) -> bytes:
    """A dictionary from serialized id arrays of a bounded sample; too small a sample is itself the dictionary."""
    picked = docs.select("doc_id").filter("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(most).distinct()
    rows = docs.join(F.broadcast(picked), "doc_id", "left_semi").select("doc_id", "text").filter(F.length("text").between(1, SAMPLE_CHARS)).dropDuplicates(["doc_id"]).collect()
    samples = sorted(_narrow(_encoded(r["text"], path, end), width) for r in rows)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


class _Part:
    """One part being written, frame by frame; only its index is kept in memory."""

    def __init__(self, uri: str, sha: bytes, width: int):
        self.store, self.path = _filesystem(uri)
        self.store.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.store.open_output_stream(self.temporary)
        self.out.write(MAGIC + sha + width.to_bytes(8, "little"))
        self.at, self.docs, self.counts, self.begins = HEAD, [], [], []

    def add(self, doc: int | None, count: int, frame: bytes) -> None:
        self.docs.append(doc)
        self.counts.append(count)
        self.begins.append(self.at)
        self.out.write(frame)
        self.at += len(frame)

    def close(self) -> tuple[int, int, int]:
        index = np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array([d is None for d in self.docs], "u1").tobytes() + np.array(self.counts, "<u4").tobytes() + np.array(self.begins, "<u8").tobytes()
        total = sum(self.counts)
        self.out.write(index + np.array([self.at, len(self.docs), total], "<u8").tobytes() + MAGIC)
        self.out.close()
        self.store.move(self.temporary, self.path)
        return len(self.docs), total, self.at + len(index) + TAIL


def write(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> dict:
    """Encode (doc_id, text) with a vocabulary file and write token files in ascending order of doc_id, nulls first.

    Each document's ids end with `end_id`; null and empty texts are just that; repeated ids keep all their rows, by
    text. Rows are range partitioned, one part each, so the number of parts is spark.sql.shuffle.partitions; an empty
    table gives parts without documents. Returns the manifest."""
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()
    width = 2 if max(max(vocabulary(path).vocabulary.values()), end_id, *vocabulary(path).special.values(), 0) < 1 << 16 else 4
    docs = docs.select("doc_id", "text")
    raw = train_dictionary(docs, path, end, width)
    sha = hashlib.sha256(raw).digest()
    _put(f"{folder}/dictionary-{sha.hex()}.bin", raw)

    def write_part(batches):
        number = TaskContext.get().partitionId()
        part = _Part(f"{folder}/part-{number:05d}.tok", sha, width)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(_get(f"{folder}/dictionary-{sha.hex()}.bin")))
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = _encoded(text.as_py(), path, end)
                part.add(doc, len(ids) // 4, compressor.compress(_narrow(ids, width)))
        n, total, size = part.close()
        yield pa.record_batch([pa.array([number], pa.int32()), pa.array([n], pa.int64()), pa.array([total], pa.int64()), pa.array([size], pa.int64())], names=["part", "docs", "ids", "bytes"])

    ordered = docs.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    parts, start = [], 0
    for r in sorted(ordered.mapInArrow(write_part, "part int, docs bigint, ids bigint, bytes bigint").collect()):  # a row a part
        parts.append({"file": f"part-{r['part']:05d}.tok", "docs": r["docs"], "ids": r["ids"], "bytes": r["bytes"], "start": start})
        start += r["ids"]
    manifest = {"dictionary": sha.hex(), "width": width, "ids": start, "parts": parts}
    _put(f"{folder}/manifest.json", json.dumps(manifest).encode())
    return manifest


class Reader:
    """Reads one part: the index first, then any document by its place."""

    def __init__(self, folder: str, file: str, dictionary: bytes | None = None):
        store, path = _filesystem(f"{folder}/{file}")
        self.file = store.open_input_file(path)
        size = self.file.size()
        head, tail = self.file.read_at(HEAD, 0), self.file.read_at(TAIL, size - TAIL)
        if head[:8] != MAGIC or tail[24:] != MAGIC:
            raise ValueError(f"{file} is not a whole token file")
        sha, self.width = head[8:40], head[40]
        begin, n, self.ids = (int(x) for x in np.frombuffer(tail[:24], "<u8"))
        raw = _get(f"{folder}/dictionary-{sha.hex()}.bin") if dictionary is None else dictionary
        if hashlib.sha256(raw).digest() != sha:
            raise ValueError(f"{file} was written with another dictionary")
        self.decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)) if raw else zstandard.ZstdDecompressor()
        index = self.file.read_at(21 * n, begin)
        self.docs = np.frombuffer(index, "<i8", n)
        self.null = np.frombuffer(index, "u1", n, 8 * n).astype(bool)
        self.counts = np.frombuffer(index, "<u4", n, 9 * n)
        self.begins = np.append(np.frombuffer(index, "<u8", n, 13 * n), np.uint64(begin)).astype(np.int64)

    def names(self, a: int, b: int) -> pa.Array:
        return pa.array(self.docs[a:b], pa.int64(), mask=self.null[a:b])

    def document(self, place: int) -> np.ndarray:
        frame = self.file.read_at(int(self.begins[place + 1] - self.begins[place]), int(self.begins[place]))
        return np.frombuffer(self.decompressor.decompress(frame), f"<u{self.width}")

    def find(self, doc_id: int) -> np.ndarray:
        """The ids of a document; places are in order of doc_id, after the nulls."""
        nulls = int(self.null.sum())
        place = nulls + int(np.searchsorted(self.docs[nulls:], doc_id))
        if place >= len(self.docs) or self.docs[place] != doc_id:
            raise KeyError(doc_id)
        return self.document(place)

    def blocks(self, most: int = 1 << 20):
        """(first place, flat ids, counts) of runs of documents of about `most` ids."""
        a = 0
        while a < len(self.docs):
            b, n = a, 0
            while b < len(self.docs) and (b == a or n + self.counts[b] <= most):
                n += int(self.counts[b])
                b += 1
            yield a, np.concatenate([self.document(k) for k in range(a, b)]), self.counts[a:b].astype(np.int64)
            a = b


def _each_part(spark: SparkSession, folder: str, made, schema: str) -> DataFrame:
    """What `made(reader, start)` yields for each part of a folder."""
    manifest = json.loads(_get(f"{folder}/manifest.json"))

    def read_parts(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from made(Reader(folder, file), start)

    files = [(p["file"], p["start"]) for p in manifest["parts"]]
    return spark.createDataFrame(files, "file string, start bigint").repartition(max(1, len(files))).mapInArrow(read_parts, schema)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document of a folder of token files; start counts the ids of all before it."""

    def made(reader: Reader, start: int):
        for a, ids, counts in reader.blocks():
            ends = np.cumsum(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.record_batch([reader.names(a, a + len(counts)), pa.array(start + ends - counts), lists], names=["doc_id", "start", "ids"])
            start += int(ends[-1])

    return _each_part(spark, folder, made, "doc_id bigint, start bigint, ids array<int>")


def summary(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its frame: the crc32 is that of its ids as
    little-endian unsigned 32-bit integers."""

    def made(reader: Reader, start: int):
        for a, ids, counts in reader.blocks():
            ends = np.cumsum(counts)
            raw = memoryview(ids.astype("<u4").view(np.uint8))
            sums = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            yield pa.record_batch([reader.names(a, a + len(counts)), pa.array(start + ends - counts), pa.array(counts), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
            start += int(ends[-1])

    return _each_part(spark, folder, made, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def find(folder: str, doc_id: int) -> np.ndarray:
    """The ids of one document by its id, from the index of the part that can hold it and one range of bytes."""
    for part in json.loads(_get(f"{folder}/manifest.json"))["parts"]:
        if part["docs"]:
            reader = Reader(folder, part["file"])
            if not reader.null[-1] and reader.docs[-1] >= doc_id:
                return reader.find(doc_id)
    raise KeyError(doc_id)
