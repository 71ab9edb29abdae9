"""Helpers that the corpus operators share: shared storage, word hashing and Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Two unrelated 64-bit keys for rows that have to be dealt over many groups.
GROUPS_PER_PARTITION = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where that is unset, a session whose tasks
    run in the driver's own process gets a temporary one; on a cluster there is no folder to guess."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs nothing upstream."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return memory that a finished batch or group held to the system, since a worker goes on to other stages.

    From the first call on, Arrow takes its memory from the C library, whose freed pages can be given back."""
    pa.default_memory_pool().release_unused()
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)  # only where the C library has it


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups(spark: SparkSession) -> int:
    """Into how many groups rows are dealt for grouped-map stages; a group's size is input / groups, so raise
    spark.sql.shuffle.partitions with the input."""
    return GROUPS_PER_PARTITION * partitions(spark)


def bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, 1 << 16)
        _powers = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, _BASE_INVERSE))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (a large_binary array) in order.

    Returns (hash of each word, first word of each text with a closing total, start byte of each word within the
    array's buffer, end byte). A word's hash is the polynomial over its bytes, taken from prefix sums, so the whole
    buffer is hashed without a loop over words."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    text_starts = at[:-1][at[:-1] < len(raw)]
    begins[text_starts] = inside[text_starts]
    starts = np.flatnonzero(begins)
    ends = np.empty_like(starts)
    if len(starts):
        # a word ends at the next space, or where the next text begins
        stops = ~inside
        stops[text_starts[text_starts > 0]] = True
        stop_at = np.append(np.flatnonzero(stops), len(raw))
        ends[:] = stop_at[np.searchsorted(stop_at, starts + 1)]
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inverse[starts])
    first = np.searchsorted(starts, at)
    return h, first, starts + offsets[0], ends + offsets[0]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words that start at each word; the last n - 1 places have no n-gram and are left out."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out *= _BASE
        out += words[k : k + count]
    return mix(out)


def strings(texts: pa.Array, most: int = 1 << 20):
    """The texts one after the other, null as empty, of which few are Python strings at a time."""
    for _, part in text_slices(texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary()), most):
        yield from part.cast(pa.large_string()).to_pylist()


def text_slices(texts: pa.Array, most: int = 1 << 20):
    """Cut an array of texts into runs of about `most` bytes, to bound the memory of what is made from each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, texts.slice(a, b - a)
        a = b


def packed(df: DataFrame, group: Column, n: int) -> DataFrame:
    """df as (gid, block): rows of one group, as far as they come in one batch, in one compressed Arrow record batch.

    Text shrinks to a third on its way through the exchange that a grouped stage needs; `unpacked` is the way back.
    Several stages that group the same packed frame by gid share one exchange."""
    names = df.columns
    schema = to_arrow_schema(df.schema)

    def pack(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            gid = batch.column(len(names)).to_numpy()
            order = np.argsort(gid, kind="stable")
            cuts = np.flatnonzero(np.diff(gid[order])) + 1
            blocks, gids = [], []
            for part in np.split(order, cuts) if len(order) else []:
                rows = pa.record_batch([batch.column(i).take(pa.array(part)).cast(schema.field(i).type) for i in range(len(names))], schema=schema)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, schema, options=options) as writer:
                    writer.write_batch(rows)
                blocks.append(sink.getvalue().to_pybytes())
                gids.append(int(gid[part[0]]))
            yield pa.record_batch([pa.array(gids, pa.int32()), pa.array(blocks, pa.binary())], names=["gid", "block"])
            del batch, blocks
            give_back()

    keyed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], group.alias("gid"))
    return keyed.mapInArrow(pack, "gid int, block binary")


def unpacked(blocks: pa.Table) -> pa.Table | None:
    """The rows of a group's blocks in one table, in an order that depends on the rows only; None if there are none."""
    raw = sorted(b.as_py() for b in blocks.column("block"))
    if not raw:
        return None
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in raw])


def runs(batches, keys: int):
    """Tables of whole runs of rows that agree in the first `keys` columns, from batches sorted by them.

    Yields (table, where each run begins, with a closing total); only the last run of a batch is held back."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        begins = _run_begins(now, keys)
        if len(begins) > 1:
            yield now.slice(0, begins[-1]), begins
            held = now.slice(begins[-1])
        else:
            held = now
    if held is not None and held.num_rows:
        yield held, np.append(_run_begins(held, keys), held.num_rows)


def _run_begins(rows: pa.Table, keys: int) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for k in range(keys):
        x = rows.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def pairs_in_runs(begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs i < j that lie in one run."""
    sizes = np.diff(begins)
    ahead = np.repeat(begins[1:], sizes) - np.arange(begins[0], begins[-1]) - 1  # how many follow in the same run
    i = np.repeat(np.arange(begins[0], begins[-1]), ahead)
    step = np.arange(len(i)) - np.repeat(np.cumsum(ahead) - ahead, ahead)
    return i, i + 1 + step


def in_cells(rows: DataFrame, count: Column, key: Column, most: int) -> DataFrame:
    """Rows of groups with the columns `cell_a`, `cell_b` and `part`.

    A group of `count` rows is cut by `key` into parts of about `most`, and each row is sent to every pair of parts that
    holds its own, so that each pair of rows of a group meets in exactly one cell (rows of different parts) or in the
    cell of their own part. Small groups, nearly all, are one cell."""
    parts = F.ceil(count / F.lit(most)).cast("int")
    cut = rows.withColumn("_parts", parts).withColumn("part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return cut.withColumn("cell_a", F.least("part", "_other")).withColumn("cell_b", F.greatest("part", "_other")).drop("_parts", "_other")
