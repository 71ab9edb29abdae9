"""Diagnosis of reported items from the issues that the rules find: problems, verdict, severity, confidence and action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numbers import half_up
from tessera.operators.knowledge import lookup

# What a code says by its name (the first that fits), how bad that is, and what players' complaints mean.
BY_CODE = (
    (r"^FACT_|FACTUAL_|AI_REJECT|OUTDATED|CONTENT_BLOCKED", "factual_error"),
    (r"^PT_", "pt_pt"),
    (r"AMBIGU|MULTIPLE_ANSWER|MULTIPLE_CORRECT|MC_MULTIPLE|ANSWER_AMBIGUOUS", "ambiguity"),
    (r"STRUCTURE_|MISSING_|INSUFFICIENT|INCOMPLETE", "incomplete"),
)
OTHER = "bad_formulation"
SEVERITY = {"factual_error": "high", "ambiguity": "high", "bad_formulation": "medium", "incomplete": "medium", "pt_pt": "medium", "valid": "low"}
RANK = {"low": 1, "medium": 2, "high": 3}
COMPLAINTS = {"wrong_answer": "factual_error", "confusing": "ambiguity", "multiple_correct": "ambiguity", "bad_options": "bad_formulation", "portuguese": "pt_pt", "outdated": "factual_error", "wrong_category": "bad_formulation", "repeated": "bad_formulation", "other": "bad_formulation"}
LOW_QUALITY, MANY_PROBLEMS, SURE = 55, 3, 70


#: Fixed value: the code of an issue that has none.
UNSPECIFIED = "UNSPECIFIED"


def category_of(code: Column) -> Column:
    name, out = F.upper(F.coalesce(code, F.lit(""))), F.lit(OTHER)
    for pattern, category in reversed(BY_CODE):
        out = F.when(name.rlike(pattern), category).otherwise(out)
    return out


def problems(issues: Column) -> Column:
    """(category, code, severity, message) of issues, each code once, in their order. An issue without a code goes by its
    message, one without either is unspecified."""
    named = lambda x: F.nullif(x, F.lit(""))
    told = F.transform(issues, lambda i: F.struct(F.coalesce(named(i["code"]), named(i["message"]), F.lit(UNSPECIFIED)).alias("code"), i["message"].alias("message")))
    first = F.filter(told, lambda i, at: F.array_position(F.transform(told, lambda y: y["code"]), i["code"]) == at + 1)
    return F.transform(first, lambda i: F.struct(category_of(i["code"]).alias("category"), i["code"].alias("code"), lookup(category_of(i["code"]), SEVERITY, "medium").alias("severity"), i["message"].alias("message")))


def primary(found: Column) -> Column:
    """The category of the worst problem, the first among equals; valid without any."""
    ranked = F.transform(found, lambda p, at: F.struct((-lookup(p["severity"], RANK, 2)).alias("rank"), at.alias("at"), p["category"].alias("category")))
    return F.coalesce(F.array_min(ranked)["category"], F.lit("valid"))


def severity(verdict: Column, quality: Column, found: Column) -> Column:
    plain = F.when(F.size(found) >= MANY_PROBLEMS, "high").otherwise(lookup(verdict, SEVERITY, "medium"))
    return F.when(verdict == "valid", "low").when(verdict.isin("factual_error", "ambiguity"), F.when(quality < LOW_QUALITY, "high").otherwise("medium")).otherwise(plain)


def confidence(verdict: Column, issues: Column, complaint: Column) -> Column:
    """(confidence, aligns): how sure a verdict is in the light of the player's complaint, and whether both agree (null
    where the player named no kind)."""
    n, told = F.size(issues), lookup(complaint, COMPLAINTS, "")
    fine = F.when(F.coalesce(complaint, F.lit("")).isin("", "suggestion"), F.struct(F.lit(93).alias("confidence"), F.lit(True).alias("aligns"))).otherwise(F.struct(F.lit(38).alias("confidence"), F.lit(False).alias("aligns")))
    same = F.struct(F.least(F.lit(98), 84 + F.least(n, F.lit(4)) * 3).alias("confidence"), F.lit(True).alias("aligns"))
    silent = F.struct(F.least(F.lit(90), 72 + F.least(n, F.lit(5)) * 3).alias("confidence"), F.lit(None).cast("boolean").alias("aligns"))
    apart = F.struct(F.greatest(F.lit(45), 62 + F.least(n, F.lit(3)) * 2).alias("confidence"), F.lit(False).alias("aligns"))
    return F.when(n == 0, fine).when(told == verdict, same).when(told == "", silent).otherwise(apart)


def action(verdict: Column, sure: Column, aligns: Column, complaint: Column) -> Column:
    fine = F.when(sure >= SURE, "validate").otherwise("review")
    doubtful = (F.coalesce(complaint, F.lit("")) == "suggestion") | (F.coalesce(~aligns, F.lit(False)) & (sure < 55))
    return F.when(verdict == "valid", fine).when(doubtful, "review").otherwise("correct")


def diagnose(reports: DataFrame) -> DataFrame:
    """reports of (issue_type, quality, issues) with problems, verdict, severity, confidence, aligns and action; reports of
    the site itself are left out."""
    asked = reports.filter(~F.coalesce("issue_type", F.lit("")).startswith("site_"))
    out = asked.withColumn("problems", problems(F.col("issues"))).withColumn("verdict", primary(F.col("problems")))
    out = out.withColumn("severity", severity(F.col("verdict"), F.col("quality"), F.col("problems"))).withColumn("_c", confidence(F.col("verdict"), F.col("issues"), F.col("issue_type")))
    out = out.withColumns({"confidence": F.col("_c")["confidence"], "aligns": F.col("_c")["aligns"]}).drop("_c")
    return out.withColumn("action", action(F.col("verdict"), F.col("confidence"), F.col("aligns"), F.col("issue_type")))


def statistics(diagnosed: DataFrame, codes: int = 8) -> DataFrame:
    """(dimension, value, count): diagnoses, those that agree and disagree with the player, open ones with problems, the
    mean quality; by verdict, by complaint, and the most frequent codes."""
    lone = lambda name: F.struct(F.lit(name).alias("dimension"), F.lit("").alias("value"))
    keyed = lambda name, c: F.struct(F.lit(name).alias("dimension"), c.alias("value"))
    entries = F.array_compact(F.array(
        lone("diagnosed"),
        F.when(F.col("aligns"), lone("aligns")),
        F.when(~F.col("aligns"), lone("mismatches")),
        F.when((F.col("status") == "open") & (F.col("verdict") != "valid"), lone("open_with_problems")),
        keyed("verdict", F.col("verdict")),
        F.when(F.coalesce("issue_type", F.lit("")) != "", keyed("complaint", F.col("issue_type"))),
    ))
    named = F.transform("issues", lambda i: keyed("code", i["code"]))
    counted = diagnosed.select(F.explode(F.concat(entries, named)).alias("e")).groupBy("e.dimension", "e.value").agg(F.count(F.lit(1)).alias("count"))
    top = counted.filter("dimension = 'code'").orderBy(F.col("count").desc(), "value").limit(codes)
    mean = diagnosed.agg(F.lit("mean_quality").alias("dimension"), F.lit("").alias("value"), half_up(F.avg("quality")).cast("long").alias("count")).filter("count IS NOT NULL")
    return counted.filter("dimension <> 'code'").unionByName(top).unionByName(mean)
