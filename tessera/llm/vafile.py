"""Hard negatives by a vector-approximation file: bounds of scores from cells, exact scores only where they can matter."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialise, partitions

#: Cells of a dimension; a row's cells take a byte each.
CELLS = 64
#: Edges of cells are quantiles of at most so many rows, those with the least hash; every row is then put into cells.
SAMPLE = 10_000
#: Components are multiplied by this and rounded down to integers, on which all scores are exact.
SCALE = 256
#: Rows and anchors of one comparison, on average; both sides of it are in memory together.
BLOCK_ROWS, BLOCK_ANCHORS = 8192, 1024
#: Integers of components lie within this, so that a score of up to 2,048 components fits in 64 bits.
LARGEST, DIMENSIONS = 1 << 26, 2048


def usable(vector, label):
    """Whether a row takes part: label and vector there, all components there, finite and small enough."""
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(LARGEST // SCALE)))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & (F.size(vector) <= DIMENSIONS) & sound, F.lit(False))


def edges_of(sample: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) integer of each cell of each dimension: cut at quantiles of the sample, and out to the least
    and the greatest of all rows. Cells that no integer can fall into have no width and are never named."""
    cuts = np.floor(np.quantile(sample, np.arange(1, cells) / cells, axis=0)).astype(np.int64).T  # a dimension a row
    first = np.hstack([low[:, None], np.clip(cuts + 1, low[:, None], high[:, None] + 1)])
    last = np.hstack([first[:, 1:] - 1, high[:, None]])
    return first, np.maximum(last, first)


def cells_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The cell of each component: the last whose least integer it reaches."""
    out = np.empty(values.shape, np.uint8)
    for d in range(values.shape[1]):
        out[:, d] = np.searchsorted(first[d], values[:, d], "right") - 1
    return out


class Bounds:
    """Lower and upper bounds of the scores of one anchor with rows given by their cells."""

    def __init__(self, anchor: np.ndarray, first: np.ndarray, last: np.ndarray):
        ends = anchor[:, None] * first, anchor[:, None] * last
        self.low, self.high = np.minimum(*ends).ravel(), np.maximum(*ends).ravel()

    def __call__(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """places: for each row, where its cells stand in the tables."""
        return np.take(self.low, places).sum(axis=1), np.take(self.high, places).sum(axis=1)


def _first(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """The first `most` by descending score, then ascending id, null ids (the largest number) last."""
    return np.lexsort((ids, -scores))[:most]


def nearest(anchor: np.ndarray, bounds: Bounds, values: np.ndarray, places: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the first `most` rows. Scored exactly are those whose upper bound reaches the `most`-th lower."""
    low, high = bounds(places)
    at = np.arange(len(ids)) if len(ids) <= most else np.flatnonzero(high >= np.partition(low, -most)[-most])
    scores = values[at] @ anchor
    best = _first(scores, ids[at], most)
    return at[best], scores[best]


def in_windows(anchor: np.ndarray, bounds: Bounds, values: np.ndarray, places: np.ndarray, ids: np.ndarray, tops: np.ndarray, percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) that hold the first `most` rows of each window percent * top <= 100 * score <= 100 * top.

    A row is a candidate of a window that its bounds meet, unless `most` rows certainly inside have lower bounds above
    its upper bound; only candidates are scored."""
    low, high = bounds(places)
    floors = -((-percent * tops) // 100)
    candidates = np.zeros(len(ids), bool)
    for floor, top in zip(floors, tops, strict=True):
        meets = (high >= floor) & (low <= top)
        sure = low[meets & (low >= floor) & (high <= top)]
        if len(sure) > most:
            meets &= high >= np.partition(sure, -most)[-most]
        candidates |= meets
    at = np.flatnonzero(candidates)
    scores = values[at] @ anchor
    chosen = set()
    for floor, top in zip(floors, tops, strict=True):
        inside = np.flatnonzero((scores >= floor) & (scores <= top))
        chosen.update(inside[_first(scores[inside], ids[at[inside]], most)].tolist())
    kept = np.array(sorted(chosen), np.int64)
    return at[kept], scores[kept]


def _matrix(column: pa.ChunkedArray, n: int, kind: type) -> np.ndarray:
    chunks = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(chunks).astype(kind).reshape(-1, n) if chunks else np.zeros((0, n), kind)


class _Block:
    """The rows of one comparison by label: values, places in the tables, ids for ties, and row numbers."""

    def __init__(self, rows: pa.Table, n: int):
        label = rows.column("label").to_numpy()
        order = np.argsort(label, kind="stable")
        self.label, self.row = label[order], rows.column("row_no").to_numpy()[order]
        self.id = rows.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()[order]
        self.value = _matrix(rows.column("value"), n, np.int64)[order]
        cells = np.frombuffer(b"".join(rows.column("cells").to_pylist()), np.uint8).reshape(-1, n)[order]
        self.places = cells.astype(np.int32) + np.arange(n, dtype=np.int32) * CELLS

    def of(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label, "left")), int(np.searchsorted(self.label, label, "right"))


def approximated(rows: DataFrame, n: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """rows with `cells`, and the least and greatest integer of each cell."""
    ends = rows.select(F.posexplode("value").alias("d", "x")).groupBy("d").agg(F.min("x"), F.max("x")).orderBy("d").collect()  # a row a dimension
    low, high = (np.array([r[k] for r in ends], np.int64) for k in (1, 2))
    sample = rows.select("value", "row_no").orderBy(F.xxhash64("value", F.lit(3)), "row_no").limit(SAMPLE).collect()
    first, last = edges_of(np.array([r["value"] for r in sample], np.int64), low, high)

    @F.arrow_udf("binary")
    def cells(values: pa.Array) -> pa.Array:
        found = cells_of(_matrix(pa.chunked_array([values]), n, np.int64), first)
        return pa.array([c.tobytes() for c in found], pa.binary())

    return rows.withColumn("cells", cells("value")), first, last


def mine(vectors: DataFrame, anchors, positives: int = 5, negatives: int = 5, percent: int = 80, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that meet `anchors`, a
    condition on id_col.

    Scores are integer inner products of the components times SCALE, rounded down. An anchor's positives are its first
    other rows of the same label; the negatives of each are the first rows of another label whose score lies between
    `percent` hundredths of the positive's score and that score. First means by descending score, then ascending id,
    null ids last. Rows of a null label, a null or empty vector or with components that are null, not finite or from
    2^18 on in size take no part, nor do vectors of another length than most (the shorter if two lengths tie). Rows that
    share an id are rows of their own, repeated rows too: an anchor is not its own positive, but its copy is. A positive
    of negative score has no window, one of score 0 the negatives of score 0. An empty table has no rows. Other columns
    are not looked at.

    Rows and anchors are dealt out in blocks, each pair of which is one task of bounded size: rows are compared by their
    cells, whose bounds are looked up in two tables an anchor, and scored exactly where they can matter. The blocks'
    first rows are ranked by Spark."""
    spark = vectors.sparkSession
    sound = vectors.filter(usable(F.col(vector_col), F.col(label_col)))
    value = F.transform(F.col(vector_col), lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    rows = sound.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), value.alias("value"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    # row numbers are settled once written, so that rows that share an id can be told apart
    rows = materialise(rows.withColumn("row_no", F.monotonically_increasing_id()), "mining-rows")
    lengths = rows.groupBy(F.size("value").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    n = lengths["n"]
    rows, first, last = approximated(rows.filter(F.size("value") == n), n)
    count, asked = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    blocks = max(partitions(spark), math.ceil(count / BLOCK_ROWS))
    shares = max(1, math.ceil(asked / BLOCK_ANCHORS))
    deal = lambda n, seed: F.pmod(F.xxhash64("row_no", F.lit(seed)), F.lit(n)).cast("int")
    # a block of rows goes to every share of the anchors, and a share of the anchors to every block of rows
    stored = materialise(rows.select("row_no", "id", "label", "value", "cells", "anchor", deal(blocks, 11).alias("block")), "mining-cells")
    sent = stored.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    asking = stored.filter("anchor").select("row_no", "id", "label", "value", deal(shares, 13).alias("share"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    schema = pa.schema([("anchor_row", pa.int64()), ("row_no", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
    found = "anchor_row long, row_no long, id long, score long"

    def answers(rows: pa.Table, asked: pa.Table, ask) -> pa.Table:
        """What `ask` finds in the block for each anchor: (rows, scores)."""
        if not rows.num_rows or not asked.num_rows:
            return schema.empty_table()
        block, out = _Block(rows, n), []
        for anchor, row, label, more in zip(_matrix(asked.column("value"), n, np.int64), asked.column("row_no").to_pylist(), asked.column("label").to_pylist(), asked.column("more").to_pylist(), strict=True):
            at, scores = ask(block, anchor, row, label, more)
            ids = pa.array(block.id[at], mask=block.id[at] == np.iinfo(np.int64).max)
            out.append(pa.table([pa.array(np.full(len(at), row)), pa.array(block.row[at]), ids, pa.array(scores)], schema=schema))
        return pa.concat_tables(out).combine_chunks()

    def same_label(block: _Block, anchor: np.ndarray, row: int, label: int, _) -> tuple[np.ndarray, np.ndarray]:
        a, b = block.of(label)
        at, scores = nearest(anchor, Bounds(anchor, first, last), block.value[a:b], block.places[a:b], block.id[a:b], positives + 1)
        other = block.row[a + at] != row
        return (a + at)[other], scores[other]

    def other_label(block: _Block, anchor: np.ndarray, row: int, label: int, tops: list) -> tuple[np.ndarray, np.ndarray]:
        a, b = block.of(label)
        rest = np.r_[0:a, b : len(block.label)]
        at, scores = in_windows(anchor, Bounds(anchor, first, last), block.value[rest], block.places[rest], block.id[rest], np.array(tops, np.int64), percent, negatives)
        return rest[at], scores

    def positive(rows: pa.Table, asked: pa.Table) -> pa.Table:
        return answers(rows, asked, same_label)

    def negative(rows: pa.Table, asked: pa.Table) -> pa.Table:
        return answers(rows, asked, other_label)

    def compared(asking: DataFrame, by) -> DataFrame:
        asking = asking.select(*[F.col(c).alias(c) for c in ("row_no", "label", "value", "more", "share")], everywhere)  # columns of its own
        return sent.select("block", "share", "row_no", "id", "label", "value", "cells").groupBy("block", "share").cogroup(asking.groupBy("block", "share")).applyInArrow(by, found)

    best = W.partitionBy("anchor_row").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row_no")
    near = compared(asking.withColumn("more", F.lit(None).cast("array<long>")), positive)
    near = materialise(near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives), "mining-positives")
    # a window is a positive's score; equal ones are asked for once
    tops = near.filter("score >= 0").groupBy(F.col("anchor_row").alias("row_no")).agg(F.collect_set("score").alias("more"))
    far = compared(asking.join(tops, "row_no"), negative)
    far = far.select("anchor_row", F.col("row_no").alias("negative_row"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.join(asking.select(F.col("row_no").alias("anchor_row"), F.col("id").alias("anchor_id")), "anchor_row")
    near = near.select("anchor_row", "anchor_id", F.col("row_no").alias("positive_row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    inside = (F.lit(percent) * F.col("positive_score") <= 100 * F.col("negative_score")) & (F.col("negative_score") <= F.col("positive_score"))
    ranked = W.partitionBy("anchor_row", "positive_row").orderBy(F.desc("negative_score"), F.col("negative_id").asc_nulls_last(), "negative_row")
    mined = near.join(materialise(far, "mining-negatives"), "anchor_row").filter(inside).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= negatives)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
