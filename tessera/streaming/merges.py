"""Streams that change stored rows: keyed merges that a replayed batch leaves as they are, and limits with keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Keys are dealt over so many parts; a batch rewrites those that it touches.
PARTS = 64

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    """(batch, part, version) of the batches that are settled; None before the first."""
    try:
        return spark.read.schema("part int, version long, batch long").parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _versions(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """The newest settled batch and, of each part, the batch that wrote it last: a row a part at most."""
    commits = _commits(spark, path)
    newest = commits.agg(F.max("batch")).first()[0] if commits is not None else None
    if newest is None:
        return -1, {}
    return newest, {r["part"]: r["version"] for r in commits.filter((F.col("batch") == newest) & (F.col("part") >= 0)).collect()}


def _read(spark: SparkSession, path: str, schema, versions: dict[int, int]) -> DataFrame:
    if not versions:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/rows/version={v}/part={p}" for p, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*folders)


def merged_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of a merged table as of its newest settled batch; none before the first."""
    return _read(spark, path, schema, _versions(spark, path)[1])


def settle(spark: SparkSession, path: str, batch_id: int, versions: dict[int, int]) -> None:
    """Record that a batch is in the table: one small file, written last. A batch of no rows is settled by a mark."""
    rows = [(p, v) for p, v in sorted(versions.items())] or [(-1, -1)]
    spark.createDataFrame(rows, "part int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch_id}")


def merge_batch(batch: DataFrame, batch_id: int, path: str, keys: list[str], merge: Merge, parts: int = PARTS) -> None:
    """Merge one batch into the table at path: `merge` takes stored rows and new rows and gives one row for each key.

    Rows are dealt over parts by their key. The batch writes the parts that it touches to a folder of its own, from what
    batches before it have settled, and settles itself last. So a batch that is run again after it was cut off writes
    the same rows again, and one that was settled already is passed over."""
    spark = batch.sparkSession
    newest, versions = _versions(spark, path)
    if batch_id <= newest:
        return
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    new = batch.withColumn("part", part).persist()
    touched = [r["part"] for r in new.select("part").distinct().collect()]  # bounded by the number of parts
    if touched:
        old = _read(spark, path, batch.schema, {p: v for p, v in versions.items() if p in touched})
        merged = merge(old, new.drop("part")).select(*batch.columns).withColumn("part", part)
        merged.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows/version={batch_id}")
    new.unpersist()
    settle(spark, path, batch_id, versions | dict.fromkeys(touched, batch_id))


def merge_stream(rows: DataFrame, path: str, keys: list[str], merge: Merge, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Run a stream over what there is and merge each of its batches into the table at path."""
    return rows.writeStream.foreachBatch(partial(merge_batch, path=path, keys=keys, merge=merge, parts=parts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- limits --------------------------------------------------------------------------------------------------------------

JUDGED = "client string, id long, ts timestamp, allowed boolean"
#: Times, in microseconds, of requests allowed lately, and the requests that wait for the watermark.
LATELY = "allowed array<bigint>, waiting_ts array<bigint>, waiting_id array<bigint>"


def judge(allowed: list[int], requests: list[tuple[int, int]], most: int, span: int) -> tuple[list[int], list[bool]]:
    """(times allowed lately, verdicts) of requests (time, id) in order: one is allowed if fewer than `most` were allowed
    in the `span` before it. Refused requests do not count against later ones."""
    lately, verdicts = list(allowed), []
    for ts, _ in requests:
        lately = [t for t in lately[-most:] if ts - t < span]
        verdicts.append(len(lately) < most)
        if verdicts[-1]:
            lately.append(ts)
    return lately[-most:], verdicts


def limited(requests: DataFrame, most: int, seconds: int = 60, delay: str = "2 minutes") -> DataFrame:
    """JUDGED for a stream of requests (client, id, ts): whether each is within the limit of its client.

    Requests are judged in the order of their times (equal ones by id) once the watermark has passed them, whatever order
    they came in; later ones are dropped by the watermark. A client's state is at most `most` times and what waits within
    the delay, and is removed when the last allowed request is out of the span. Requests without a client are those of
    the empty one; null times are dropped."""
    span = seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        allowed, times, ids = ([*x] for x in state.get) if state.exists else ([], [], [])
        for part in batches:
            times += [t.value // 1000 for t in part["ts"]]
            ids += [int(i) for i in part["id"]]
        passed = state.getCurrentWatermarkMs() * 1000
        waiting = sorted(zip(times, ids, strict=True))
        due = [r for r in waiting if r[0] <= passed]
        waiting = waiting[len(due) :]
        allowed, verdicts = judge(allowed, due, most, span)
        allowed = [t for t in allowed if passed - t < span]
        if waiting or allowed:
            state.update((allowed, [t for t, _ in waiting], [i for _, i in waiting]))
            wake = waiting[0][0] if waiting else allowed[-1] + span
            state.setTimeoutTimestamp(max(wake // 1000 + 1, passed // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"client": [key[0]] * len(due), "id": [i for _, i in due], "ts": pd.to_datetime([t for t, _ in due], unit="us"), "allowed": verdicts})

    rows = requests.filter("ts IS NOT NULL").select(F.coalesce("client", F.lit("")).alias("client"), F.col("id").cast("long").alias("id"), "ts")
    return rows.withWatermark("ts", delay).groupBy("client").applyInPandasWithState(step, JUDGED, LATELY, "append", GroupStateTimeout.EventTimeTimeout)
