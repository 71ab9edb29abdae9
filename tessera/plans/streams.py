"""Queries that run as streams over the driver's events, in batches, to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lineage import shared_folder
from tessera.operators import usage
from tessera.plans import adapters as a
from tessera.plans.catalogue import ROLLUP
from tessera.plans.registry import query
from tessera.streaming import merges

#: The limit of the query below: requests of a user within a span of seconds, and how late they may come.
MOST, SPAN, DELAY_HOURS = 2, 6 * 3600, 12


def event_stream(spark: SparkSession, sf_dir: str, folder: str, files: int) -> DataFrame:
    """The events as a stream of so many batches."""
    events = a.table(spark, sf_dir, "events")
    events.repartition(files).write.parquet(f"{folder}/events")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")


@query(ROLLUP + "SELECT * FROM roll")
def merged_usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage buckets as they stand after a stream of calls was merged into them batch by batch."""
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    keys = ["bucket_start", "provider", "model"]

    calls = a.calls_of(event_stream(spark, sf_dir, folder, 3))
    schema = usage.rollup(a.usage_calls(spark, sf_dir), 5).schema

    def each(batch: DataFrame, batch_id: int) -> None:
        merges.merge_batch(usage.rollup(batch, 5).select(*schema.names), batch_id, f"{folder}/usage", keys, usage.merge_rollups, 8)

    calls.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return merges.merged_table(spark, f"{folder}/usage", schema)


@query(f"""
WITH RECURSIVE e AS (
  SELECT user_id::VARCHAR AS client, event_id AS id, epoch_us(ts::TIMESTAMP) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts::TIMESTAMP, event_id) AS pos FROM events
), walk(client, pos, id, us, held, allowed) AS (
  SELECT client, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, []::BIGINT[], NULL::BOOLEAN FROM e WHERE pos = 1
  UNION ALL
  SELECT client, pos, id, us, CASE WHEN len(lately) < {MOST} THEN list_append(lately, us) ELSE lately END, len(lately) < {MOST}
  FROM (SELECT e.client, e.pos, e.id, e.us, list_filter(w.held, lambda t: e.us - t < {SPAN * 1_000_000}) AS lately FROM walk w JOIN e ON e.client = w.client AND e.pos = w.pos + 1)
)
SELECT client, count(*) AS requests, count(*) FILTER (allowed) AS allowed FROM walk
WHERE pos > 0 AND us <= (SELECT max(us) FROM e) - {DELAY_HOURS * 3_600_000_000} GROUP BY client
""")
def limited_requests_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each user, as far as the watermark passed them, and how many were within the limit."""
    folder = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    events = a.table(spark, sf_dir, "events")
    # one batch: files are read in no order of time, and what comes later than the delay would be dropped
    events.write.parquet(f"{folder}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events")
    requests = stream.select(F.col("user_id").cast("string").alias("client"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    judged = merges.limited(requests, MOST, SPAN, f"{DELAY_HOURS} hours")
    judged.writeStream.format("parquet").option("path", f"{folder}/judged").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(merges.JUDGED).parquet(f"{folder}/judged")
    return found.groupBy("client").agg(F.count(F.lit(1)).alias("requests"), F.count(F.when(F.col("allowed"), 1)).alias("allowed"))
