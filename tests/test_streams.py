"""Streams that merge into stored rows and limits with keyed state, against batch answers and plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import merges

ROWS = "k string, n long, top long"


def add(old, new):
    return old.unionByName(new).groupBy("k").agg(F.sum("n").cast("long").alias("n"), F.max("top").alias("top"))


def source(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/in/batch={k}")
    return lambda: spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def batch(df, batch_id, path, merge=add):
    merges.merge_batch(df.groupBy("k").agg(F.sum("n").cast("long").alias("n"), F.max("top").alias("top")), batch_id, path, ["k"], merge, 4)


def state(spark, path):
    return sorted((tuple(r) for r in merges.merged_table(spark, path, ROWS).collect()), key=str)


@pytest.fixture
def batches():
    r = random.Random(1)
    return [[(r.choice(["a", "b", "c", "d", "e", None]), r.randrange(9), r.randrange(99)) for _ in range(n)] for n in (20, 1, 30)]


def test_a_run_cut_off_before_it_settles_gives_the_same_table(spark, tmp_path, batches, monkeypatch):
    stream = source(spark, tmp_path, batches)

    def run(path, checkpoint):
        stream().writeStream.foreachBatch(lambda df, i: batch(df, i, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run(f"{tmp_path}/whole", f"{tmp_path}/c1")
    real, died = merges.settle, []

    def dies(spark_, path, batch_id, versions):
        if batch_id == 1 and not died:
            died.append(batch_id)
            raise RuntimeError("killed after the rows were written")
        real(spark_, path, batch_id, versions)

    monkeypatch.setattr(merges, "settle", dies)
    with pytest.raises(Exception, match="killed"):
        run(f"{tmp_path}/cut", f"{tmp_path}/c2")
    before = state(spark, f"{tmp_path}/cut")
    run(f"{tmp_path}/cut", f"{tmp_path}/c2")
    assert died == [1] and before != state(spark, f"{tmp_path}/cut")
    expected = {}
    for k, n, top in (r for b in batches for r in b):
        held = expected.get(k, (0, 0))
        expected[k] = (held[0] + n, max(held[1], top))
    for path in ("whole", "cut"):
        assert {k: (n, top) for k, n, top in map(tuple, merges.merged_table(spark, f"{tmp_path}/{path}", ROWS).collect())} == expected


def test_settled_and_empty_batches_change_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert state(spark, path) == []
    batch(spark.createDataFrame([], ROWS), 0, path)
    assert state(spark, path) == []
    one = spark.createDataFrame([("a", 2, 5), ("b", 1, 1)], ROWS)
    batch(one, 1, path)
    batch(one, 1, path)
    batch(one, 0, path)
    assert state(spark, path) == [("a", 2, 5), ("b", 1, 1)]
    batch(spark.createDataFrame([], ROWS), 2, path)
    batch(spark.createDataFrame([("a", 3, 4)], ROWS), 3, path)
    assert state(spark, path) == [("a", 5, 5), ("b", 1, 1)]


def allowed_by_hand(requests, most, seconds):
    """The log of each client: refused requests are not written to it."""
    logs, out = {}, {}
    for client, k, ts in sorted(requests, key=lambda r: (r[2], r[1])):
        log = [t for t in logs.get(client, []) if (ts - t).total_seconds() < seconds]
        out[client, k] = len(log) < most
        logs[client] = [*log, ts] if out[client, k] else log
    return out


def test_limits_in_any_order_within_the_delay(spark, tmp_path):
    r, start = random.Random(3), datetime(2024, 1, 1)
    requests = [(r.choice(["hot"] * 6 + ["a", "b", ""]), k, start + timedelta(seconds=k * 0.5 + r.randrange(0, 8))) for k in range(1500)]
    late = sorted(requests, key=lambda x: x[2] + timedelta(seconds=r.randrange(0, 20)))
    for k in range(0, 1500, 300):
        spark.createDataFrame(late[k : k + 300], "client string, id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("client string, id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    judged = merges.limited(stream, 5, 10, "30 seconds")
    judged.writeStream.format("memory").queryName("judged").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    found = {(x["client"], x["id"]): x["allowed"] for x in spark.table("judged").collect()}
    expected = allowed_by_hand(requests, 5, 10)
    end = max(x[2] for x in requests) - timedelta(seconds=30)
    assert found == {key: v for key, v in expected.items() if start + (requests[key[1]][2] - start) <= end}
    assert 100 < sum(found.values()) < len(found) - 100


def test_what_a_client_leaves_behind_is_bounded():
    lately = []
    for k in range(1000):
        lately, verdicts = merges.judge(lately, [(k * 10, k)], 7, 1000)
        assert len(lately) <= 7
    assert merges.judge([], [(0, 1), (0, 2), (0, 3), (999, 4), (1000, 5)], 2, 1000)[1] == [True, True, False, False, True]
