"""The manual review queue: what enters it from telemetry, its counts by issue code, and its merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.numbers import count_where
from tessera.functions.text import question_hash, strip_tags
from tessera.operators.items import only_difficulty
from tessera.operators.telemetry import is_open

def wanted(codes: Column, issue_code: str | None = None) -> Column:
    """Whether a rejected event belongs in the queue: by a code, or else because only its difficulty was wrong."""
    return F.array_contains(codes, issue_code) if issue_code else only_difficulty(codes)


def candidates(events: DataFrame, reviewed: DataFrame, issue_code: str | None = None) -> DataFrame:
    """events with `reason`: queued (the first of each content hash), already_reviewed or skipped."""
    q, a = F.trim(strip_tags(F.coalesce("question_text", F.lit("")))), F.trim(strip_tags(F.coalesce("answer_text", F.lit(""))))
    fit = wanted(F.col("issue_codes"), issue_code) & (q != "") & (a != "")
    known = reviewed.select("question_hash").distinct().withColumn("_known", F.lit(True))
    rows = events.withColumn("_fit", F.coalesce(fit, F.lit(False))).withColumn("question_hash", question_hash(F.col("question_text"), F.col("answer_text")))
    first = F.row_number().over(W.partitionBy("question_hash").orderBy(F.col("_fit").desc(), F.col("ts").desc(), "id"))
    reason = F.when(~F.col("_fit"), "skipped").when(F.col("_known"), "already_reviewed").when(F.col("_first") > 1, "skipped").otherwise("queued")
    return rows.join(known, "question_hash", "left").withColumn("_first", first).withColumn("reason", reason).drop("_fit", "_known", "_first")


def merge_queue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """The queue after new entries by hash: pending ones are updated, decided ones stay, unknown ones are added."""
    decided = queue.filter("status <> 'pending'").select("question_hash")
    fresh = new.join(decided, "question_hash", "left_anti")
    kept = queue.join(fresh.select("question_hash"), "question_hash", "left_anti")
    return kept.unionByName(fresh.withColumn("status", F.lit("pending")), allowMissingColumns=True)


def codes(rows: DataFrame, condition: Column | None = None, name: str = "count") -> DataFrame:
    chosen = rows if condition is None else rows.filter(condition)
    return chosen.select(F.explode("issue_codes").alias("code")).filter("code <> ''").groupBy("code").agg(F.count(F.lit(1)).alias(name))


def code_options(pending: DataFrame, rejected: DataFrame) -> DataFrame:
    """(code, pending, telemetry, telemetry_open, difficulty_import): four counts side by side, zero where a code has none."""
    parts = [codes(pending, name="pending"), codes(rejected, name="telemetry"), codes(is_open(rejected, pending), name="telemetry_open"), codes(rejected, only_difficulty(F.col("issue_codes")), "difficulty_import")]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "code", "full_outer")
    return out.fillna(0)


def stats(queue: DataFrame) -> DataFrame:
    n = lambda s: count_where(F.col("status") == s).alias(s)
    return queue.agg(F.count(F.lit(1)).alias("total"), n("pending"), n("approved"), n("rejected"))


def corrections(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """(field, ai_value, human_value) of the fields in which a person's version differs."""
    entries = [F.struct(F.lit(k).alias("field"), before[k].cast("string").alias("ai_value"), after[k].cast("string").alias("human_value")) for k in before]
    return F.filter(F.array(*entries), lambda e: ~e["ai_value"].eqNullSafe(e["human_value"]))
