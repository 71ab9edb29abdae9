"""N-gram Jaccard join with Bayesian candidate pruning."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, in_cells, materialise, mix, ngram_hashes, pairs_in_runs, partitions, release, runs, text_slices, word_hashes
from tessera.llm.components import connected_components, join_named, local_labels, named_components

WORDS = 5
THRESHOLD = 0.8
#: 32 bands of 4 MinHash values: a pair at the threshold shares no band with probability (1 - 0.8^4)^32 = 5e-8.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Thresholds at which a pair shares no band with a probability above this are refused.
MISS = 1e-6
#: Bands of the first round; pairs it has joined are not looked for in the others.
FIRST = 4
#: A pair is dropped once the posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-9
STEP = 16
#: Rows of a cell's part in which pairs are looked for, and in which they are verified; larger buckets and containers
#: are cut into cells.
CELL, VERIFIED = 256, 1024

_RANDOM = np.random.default_rng(41)
_FACTORS = (_RANDOM.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFTS = _RANDOM.integers(0, 1 << 32, HASHES, np.uint32)[:, None]


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The sorted set of hashes of n consecutive words; a shorter text is one shingle, an empty one has none."""
    if 0 < len(words) < n:
        return ngram_hashes(words, len(words))
    return np.unique(ngram_hashes(words, n))


def text_shingles(texts: pa.Array):
    """The shingle set of each text in turn."""
    for _, part in text_slices(texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())):
        hashes, first, _, _ = word_hashes(part)
        for k in range(len(part)):
            yield shingles(hashes[first[k] : first[k + 1]])


def minhashes(found: np.ndarray) -> np.ndarray:
    x = (mix(found) >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, x.shape[1], 2048):
        np.minimum(out, (x[:, a : a + 2048] * _FACTORS + _SHIFTS).min(axis=1), out=out)
    return out


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _band_keys(values: np.ndarray) -> np.ndarray:
    v = values.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        h = mix(h ^ v[:, k]) + np.uint64(k)
    return h.view(np.int64)


@lru_cache(8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For each number of values compared (in steps) the least number of agreements with which a pair goes on.

    With a uniform prior on the similarity s, values of one byte agree with probability s + (1 - s) / 256; the
    posterior probability of s >= threshold is summed over a grid."""
    s = (np.arange(20_000) + 0.5) / 20_000
    agree = s + (1 - s) / 256
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        need = n + 1
        for m in range(n, -1, -1):
            log = m * np.log(agree) + (n - m) * np.log1p(-agree)
            w = np.exp(log - log.max())
            if w[s >= threshold].sum() / w.sum() < tolerance:
                break
            need = m
        out.append(need)
    return np.array(out)


def prune(sketches: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose posterior stays above the tolerance after each STEP values compared."""
    need = least_matches(threshold, tolerance)
    matches = np.zeros(len(i), np.int32)
    for k, least in enumerate(need):
        columns = slice(k * STEP, (k + 1) * STEP)
        matches += (sketches[i, columns] == sketches[j, columns]).sum(axis=1)
        on = matches >= least
        i, j, matches = i[on], j[on], matches[on]
        if not len(i):
            break
    return i, j


def _text_key() -> list:
    """Two hashes of a text, which tell the rows of one id apart."""
    return [F.xxhash64("text").alias("text_a"), F.xxhash64(F.lit(1), "text").alias("text_b")]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_a, text_b, set_key, n, sketch, keys) of (doc_id, text): two hashes of the text, a digest of the
    shingle set, its size, MinHash values cut to a byte each, and the keys of the bands."""

    def sign(batches):
        for batch in batches:
            keys, sizes, sketches, bands = [], [], [], []
            for found in text_shingles(batch.column(1)):
                values = minhashes(found)
                keys.append(digest(found))
                sizes.append(len(found))
                sketches.append((values & np.uint32(0xFF)).astype(np.uint8).tobytes())
                bands.append(_band_keys(values))
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), lists]
            yield pa.record_batch(columns, names=["doc_id", "text_a", "text_b", "set_key", "n", "sketch", "keys"])
            del batch, bands, flat, lists, columns
            give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *_text_key()).mapInArrow(sign, f"doc_id {kind}, text_a bigint, text_b bigint, set_key binary, n bigint, sketch binary, keys array<bigint>")


def _buckets(rows: DataFrame) -> DataFrame:
    """(key, members) of the buckets of (key, class_id, group) with several groups, one of those with the same members.

    Members are told by the sums of both signed halves of their hashes: repeated ids do not cancel out, and sums of 32
    bits in 64 hold two thousand million members whatever the hashes are, and far more as these fall to both sides."""
    hashed = F.xxhash64("class_id")
    high, low = F.shiftright(hashed, 32), F.shiftright(F.shiftleft(hashed, 32), 32)
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum(high).alias("mark_high"), F.sum(low).alias("mark_low"), F.min("group").alias("low"), F.max("group").alias("high"))
    return buckets.filter(F.col("low") != F.col("high")).groupBy("members", "mark_high", "mark_low").agg(F.min("key").alias("key")).select("key", "members")


def _candidates(classes: DataFrame, first: int, last: int, groups: DataFrame | None, threshold: float, tolerance: float) -> DataFrame:
    """Edges (a, b) that join the pairs of classes which share one of the bands and are not pruned.

    groups: (class_id, group) of an earlier round; only buckets with several groups are looked at, and in them only
    pairs of different groups. Buckets with the same members as another are looked at once."""
    known = classes.withColumn("group", F.col("class_id")) if groups is None else classes.join(groups, "class_id", "left").withColumn("group", F.coalesce("group", "class_id"))
    rows = known.select(F.explode(F.slice("keys", first + 1, last - first)).alias("key"), "class_id", "group")
    buckets = materialise(_buckets(rows), "buckets")
    held = buckets.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    live = materialise(join_named(rows, buckets.withColumn("held", F.col("members")), "key", "held", held), "bucket-members")
    release(classes.sparkSession)
    placed = _place(live, groups is not None).join(classes.select("class_id", "sketch").hint("merge"), "class_id")
    columns = ["key", "cell_a", "cell_b", "part", "class_id", "group", "sketch"]
    cells = placed.select(columns).repartition(partitions(classes.sparkSession), "key", "cell_a", "cell_b").sortWithinPartitions("key", "cell_a", "cell_b")

    def compare(batches):
        for table, begins in runs(batches, 3):
            part, ids, group = (table.column(c).to_numpy() for c in ("part", "class_id", "group"))
            own = table.column("cell_a").to_numpy() == table.column("cell_b").to_numpy()
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
            for a, b in _pieces(begins):
                i, j = pairs_in_runs(begins[a : b + 1])
                on = (own[i] | (part[i] != part[j])) & (group[i] != group[j])
                i, j = prune(sketches, i[on], j[on], threshold, tolerance)
                yield _star(ids, i, j)

    return cells.mapInArrow(compare, "a bigint, b bigint")


def _place(live: DataFrame, grouped: bool) -> DataFrame:
    """Members of buckets with the cell and part in which each pair of different groups meets once.

    Where groups are known, a bucket's largest one need not be compared with itself: it is only cut into parts, and the
    other members are sent to each of them, so that a group of many copies and a few strays costs a row a copy."""
    if not grouped:
        return in_cells(live, F.col("members"), F.col("class_id"), CELL)
    largest = live.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "group")).alias("most"), F.sum("n").alias("held"))
    told = join_named(live, materialise(largest, "largest-groups"), "key", "held", live.count()).withColumn("parts", F.ceil(F.col("most.n") / F.lit(CELL)).cast("int"))
    inside = F.col("group") == F.col("most.group")
    rest = told.filter(~inside)
    columns = ["key", "class_id", "group"]
    own = told.filter(inside).select(*columns, F.pmod(F.xxhash64("class_id"), "parts").cast("int").alias("part")).withColumns({"cell_a": F.col("part"), "cell_b": F.lit(-1)})
    sent = rest.select(*columns, F.lit(-1).alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("cell_a")).withColumn("cell_b", F.lit(-1))
    among = in_cells(rest.withColumn("others", F.col("members") - F.col("most.n")).filter("others > 1"), F.col("others"), F.col("class_id"), CELL)
    names = [*columns, "part", "cell_a", "cell_b"]
    return own.select(names).unionByName(sent.select(names)).unionByName(among.select(names))


def _pieces(begins: np.ndarray, most: int = 1 << 20):
    """Cut runs into stretches with about `most` pairs."""
    pairs = np.cumsum(np.diff(begins) ** 2 // 2)
    a = 0
    while a < len(pairs):
        b = max(a + 1, int(np.searchsorted(pairs, (pairs[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _star(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """For linked rows, an edge from each id to the least id of its part of the links."""
    nodes, at = np.unique(np.concatenate([ids[i], ids[j]]), return_inverse=True)
    label = local_labels(len(nodes), at[: len(i)], at[len(i) :]) if len(nodes) else np.zeros(0, np.int64)
    return pa.record_batch([pa.array(nodes, pa.int64()), pa.array(nodes[label], pa.int64())], names=["a", "b"])


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets, from blocks of their incidence matrix."""
    k = len(sets)
    out = np.zeros((k, k), np.int32)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    shared = np.bincount(at, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[at]
    column, owner = place[at[keep]], owner[keep]
    wide = 4096
    for a in range(0, int(shared.sum()), wide):
        here = (column >= a) & (column < a + wide)
        block = np.zeros((k, min(wide, int(shared.sum()) - a)), np.float32)
        block[owner[here], column[here] - a] = 1
        out += (block @ block.T).astype(np.int32)
    return out


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of some pairs of sets: one by one if they are few, else all at once."""
    if len(i) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    return _intersections(sets)[i, j].astype(np.int64)


def _survivors(sketches: np.ndarray, part: np.ndarray | None, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a cell that are not pruned; with `part`, those of rows of different parts."""
    k, found = len(sketches), []
    step = max(1, (1 << 18) // k)
    for a in range(0, k, step):
        i = np.repeat(np.arange(a, min(a + step, k)), k)
        j = np.tile(np.arange(k), min(a + step, k) - a)
        on = i < j if part is None else (i < j) & (part[i] != part[j])
        found.append(prune(sketches, i[on], j[on], threshold, tolerance))
    return tuple(np.concatenate([f[side] for f in found]) for side in (0, 1))


def _verified(rows: pa.Table, begins: np.ndarray, threshold: float, tolerance: float) -> pa.RecordBatch:
    """(class_id, links, label): the links within each cell, weighted by the sizes of the classes. Pairs are compared
    by their MinHash values first; those that are not pruned are verified on the sets."""
    ids, part, size = (rows.column(c).to_numpy() for c in ("class_id", "part", "size"))
    own = rows.column("cell_a").to_numpy() == rows.column("cell_b").to_numpy()
    blobs, values = rows.column("shingles"), rows.column("sketch")
    out: list[pa.RecordBatch] = []
    names = ["class_id", "links", "label"]
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        _, first = np.unique(ids[a:b], return_index=True)  # repeated rows of one class count once
        at = first + a
        if len(at) < 2:
            continue
        sketches = np.frombuffer(b"".join(values[int(k)].as_py() for k in at), np.uint8).reshape(-1, HASHES)
        i, j = _survivors(sketches, None if own[a] else part[at], threshold, tolerance)
        used, places = np.unique(np.concatenate([i, j]), return_inverse=True)
        if not len(used):
            continue
        at, i, j = at[used], places[: len(i)], places[len(i) :]
        sets = [np.frombuffer(blobs[int(k)].as_py(), np.uint64) for k in at]
        n = np.array([len(s) for s in sets])
        common = _common(sets, i, j)
        linked = common >= threshold * (n[i] + n[j] - common) - 1e-9
        i, j = i[linked], j[linked]
        if len(i):
            label = local_labels(len(at), i, j)
            links = np.bincount(i, size[at[j]], len(at)) + np.bincount(j, size[at[i]], len(at))
            some = np.unique(np.concatenate([i, j]))
            out.append(pa.record_batch([pa.array(x, pa.int64()) for x in (ids[at[some]], links[some].astype(np.int64), ids[at[label[some]]])], names=names))
    empty = pa.record_batch([pa.array([], pa.int64())] * 3, names=names)
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else empty


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_links, group_id, kept) of every row of (doc_id, text).

    Documents with one set of five-word shingles are a class; class_id is its least doc_id. Classes that share a MinHash
    band are compared value by value and dropped when it becomes improbable that they reach the threshold; what is
    left joins classes into containers, whose pairs are compared in the same way and, unless dropped, verified on the
    shingle sets. n_links counts the other documents at or above the threshold, copies included; group_id is the least
    doc_id reachable by links, and kept says whether that is the row's own.

    Texts of one to four words are one shingle. Null and empty texts, and rows without an id, link with nothing. Rows
    that share an id count as that many documents: each has the class, links and group of its own text, whatever the
    others hold. Other columns are not looked at. An empty table gives no rows. A threshold that the bands cannot serve
    is refused."""
    return _linked(docs, threshold, tolerance).select("doc_id", "class_id", "n_links", "group_id", "kept")


def _linked(docs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """What `near_duplicates` returns, with the hashes of the text."""
    if not 0 < threshold <= 1 or (1 - threshold**ROWS) ** BANDS > MISS:
        raise ValueError(f"at a threshold of {threshold} the bands miss more than {MISS} of the pairs" if 0 < threshold <= 1 else f"{threshold} is no threshold")
    spark = docs.sparkSession
    signed = materialise(signatures(docs), "signatures")
    sound = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    # classes have numbers of their own, since several may have the same least id; they are settled once written
    sets = signed.filter(sound).groupBy("set_key").agg(F.min("doc_id").cast("long").alias("least_id"), F.count(F.lit(1)).alias("size"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"))
    classes = materialise(sets.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    release(spark)

    edges = materialise(_candidates(classes, 0, FIRST, None, threshold, tolerance), "candidates")
    groups = connected_components(edges).select(F.col("node").alias("class_id"), F.col("component").alias("group"))
    more = _candidates(classes, FIRST, BANDS, groups, threshold, tolerance)
    edges = materialise(groups.select(F.col("class_id").alias("a"), F.col("group").alias("b")).unionByName(more), "candidates")
    containers = connected_components(edges).select(F.col("node").alias("class_id"), F.col("component").alias("container"))
    release(spark)

    sizes = containers.groupBy("container").agg(F.count(F.lit(1)).alias("members"), F.count(F.lit(1)).alias("held"))
    members = join_named(containers, sizes, "container", "held", containers.count()).join(classes.select("class_id", "least_id", "set_key", "size", "sketch"), "class_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("least_id"), "text").join(materialise(members, "members").hint("merge"), "least_id")
    carried = ["container", "members", "class_id", "size", "sketch"]

    def expand(batches):
        for batch in batches:
            found = list(text_shingles(batch.column("text")))
            keep = [k for k, (s, key) in enumerate(zip(found, batch.column("set_key").to_pylist(), strict=True)) if digest(s) == key]
            kept = batch.select(carried).take(pa.array(keep, pa.int64()))
            yield pa.record_batch([*kept.columns, pa.array([found[k].tobytes() for k in keep], pa.binary())], names=[*carried, "shingles"])

    filled = texts.mapInArrow(expand, "container bigint, members bigint, class_id bigint, size bigint, sketch binary, shingles binary")
    cells = in_cells(filled, F.col("members"), F.col("class_id"), VERIFIED).select("container", "cell_a", "cell_b", "part", "class_id", "size", "sketch", "shingles")
    cells = cells.repartition(partitions(spark), "container", "cell_a", "cell_b").sortWithinPartitions("container", "cell_a", "cell_b")

    def verify(batches):
        for table, begins in runs(batches, 3):
            yield _verified(table, begins, threshold, tolerance)
            del table
            give_back()

    found = materialise(cells.mapInArrow(verify, "class_id bigint, links bigint, label bigint"), "links")
    release(spark)
    links = found.groupBy("class_id").agg(F.sum("links").alias("others"))
    final = named_components(found.select(F.col("class_id").alias("a"), F.col("label").alias("b")), classes.select(F.col("class_id").alias("node"), F.col("least_id").alias("name")))
    by_class = classes.select("set_key", "class_id", "least_id", "size").join(links, "class_id", "left").join(final.select(F.col("node").alias("class_id"), F.col("name").alias("group_id")), "class_id", "left")
    by_class = by_class.select("set_key", "least_id", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("group_id", "least_id").alias("group_id"))
    key = F.when(sound, F.col("set_key"))
    out = signed.select("doc_id", "text_a", "text_b", key.alias("set_key")).join(by_class, "set_key", "left")
    group = F.coalesce("group_id", "doc_id")
    return out.select("doc_id", "text_a", "text_b", F.coalesce("least_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), group.alias("group_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """docs, with all their columns, without the rows of which a near-duplicate with a smaller id is there: of each group
    the rows with its least id stay. Of rows that share an id, each goes or stays by its own text; rows without an id
    or without words stay. An empty table stays empty."""
    gone = _linked(docs.select("doc_id", "text"), threshold, tolerance).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_a").alias("gone_a"), F.col("text_b").alias("gone_b")).distinct()
    gone = materialise(gone, "duplicates")
    same = (docs["doc_id"] == gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_a"]) & (F.xxhash64(F.lit(1), docs["text"]) == gone["gone_b"])
    return docs.join(gone.hint("merge"), same, "left_anti")  # rows to drop grow with the documents
