"""What follows from the issues of items (scores, overrides), repetition, content safety, rules mined from evaluations and
reports. The rules themselves are in `tessera.operators.items`."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.numbers import count_where
from tessera.operators import items
from tessera.operators.items import ISSUE

# The points of each layer, and the thresholds of repetition and rule mining.
LAYERS = {"structural": 10, "format": 12, "age": 12, "difficulty": 8, "category": 8, "ptPt": 10, "semantic": 15, "repetition": 13, "mcOptions": 12}
REPEATED_TEXT, REPEATED_LAST = 0.55, 8
MEDIUM_EVIDENCE, HIGH_EVIDENCE = 3, 8


def has_layer(found: Column, layer: str) -> Column:
    return F.exists(found, lambda i: i["layer"] == layer)


def layer_scores(found: Column) -> Column:
    """Points of each layer: all of them if it has no issue, none otherwise."""
    return F.map_from_arrays(F.array(*[F.lit(k) for k in LAYERS]), F.array(*[F.when(has_layer(found, layer), 0).otherwise(points) for layer, points in LAYERS.items()]))


def score(found: Column) -> Column:
    """0 for an incomplete item, else the sum of its layers' points."""
    total = F.lit(0)
    for layer, points in LAYERS.items():
        total = total + F.when(has_layer(found, layer), 0).otherwise(points)
    return F.when(F.exists(found, lambda i: i["code"] == "STRUCTURE_INCOMPLETE"), 0).otherwise(total)


def only_difficulty(found: Column) -> Column:
    return items.only_difficulty(F.transform(found, lambda i: i["code"]))


def drop_overridden(judged: DataFrame, overrides: DataFrame, column: str = "issues", key: str = "id") -> DataFrame:
    """judged items with the issues that no override matches; an override's null code, message, age or format matches all.

    An override says in `mask` which of the four it names; for each of the masks in use there is an equi-join on what
    those name, so nothing has to be small enough to be broadcast."""
    parts = {"code": F.col("i.code"), "message": F.col("i.message"), "age_band": F.col("age_band"), "format": F.col("format")}
    bits = [F.when(F.col(c).isNotNull(), 1 << k).otherwise(0) for k, c in enumerate(parts)]
    named = overrides.select(*parts, sum(bits[1:], bits[0]).alias("mask"))
    masks = sorted(r["mask"] for r in named.select("mask").distinct().collect())  # sixteen at most
    each = judged.select(key, "age_band", "format", F.posexplode(column).alias("pos", "i"))
    for mask in masks:
        keys = [c for k, c in enumerate(parts) if mask >> k & 1]
        chosen = named.filter(F.col("mask") == mask).select(*[F.col(c).alias(f"o_{c}") for c in keys], F.lit(1).alias("o_any")).distinct()
        same = F.lit(1) == F.col("o_any")
        for c in keys:
            same = same & (parts[c] == F.col(f"o_{c}"))
        each = each.join(chosen, same, "left_anti") if keys else each.limit(0)
    kept = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "i"))), lambda x: x["i"]).alias("_kept"))
    return judged.join(kept, key, "left").withColumn(column, F.coalesce("_kept", F.array().cast(f"array<{ISSUE}>"))).drop("_kept")


def repeated_texts(asked: DataFrame, question: str = "question", part: str = "session", order: str = "position") -> DataFrame:
    """asked with `repeats`: whether a question is similar to one of the last eight of its session."""
    words = text.tokens(text.normalize_key(F.col(question)))
    recent = F.collect_list("_words").over(W.partitionBy(part).orderBy(order).rowsBetween(-REPEATED_LAST, -1))
    held = asked.withColumn("_words", words).withColumn("_recent", recent)
    return held.withColumn("repeats", F.exists("_recent", lambda w: text.jaccard(w, F.col("_words")) >= REPEATED_TEXT)).drop("_words", "_recent")


def rotate_options(options: Column, answer: Column, position: Column) -> Column:
    """Options with the answer at a position, the others in their order."""
    others = F.filter(options, lambda o: text.normalize(o) != text.normalize(answer))
    at = F.pmod(position, F.size(others) + 1).cast("int")
    return F.concat(F.slice(others, F.lit(1), at), F.array(answer), F.slice(others, at + 1, F.size(others)))


# --- content safety --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SafetyRule:
    term: str
    severity: str
    kind: str = "word"  # word, phrase or pattern
    replacement: str | None = None


def safety_matches(x: Column, rules: Sequence[SafetyRule], educational: str | None = None) -> Column:
    """(term, severity) of the rules that a text breaks, seen through look-alikes, spacing and spelled-out words.

    A rule of severity allow_context holds only where the educational pattern does not."""
    spaced = F.concat(F.lit(" "), text.undisguise(x), F.lit(" "))
    spelled = text.spelled_out(x)
    found = []
    for r in rules:
        key = "".join(c for c in r.term.lower() if c.isalnum() or c == " ")
        if r.kind == "pattern":
            hit = x.rlike(r.term)
        elif r.kind == "phrase":
            hit = spaced.contains(f" {key} ")
        else:
            hit = spaced.contains(f" {key} ") | F.array_contains(spelled, key)
        if r.severity == "allow_context" and educational:
            hit = hit & ~x.rlike(educational)
        found.append(F.when(hit, F.struct(F.lit(r.term).alias("term"), F.lit(r.severity).alias("severity"))))
    return F.array_compact(F.array(*found))


def sanitize(x: Column, rules: Sequence[SafetyRule]) -> Column:
    """(text, action): rewritten where rules say what to write instead, blocked where another rule still holds."""
    out = x
    for r in rules:
        if r.replacement is not None:
            out = F.regexp_replace(out, rf"(?i)(?<![\p{{L}}\p{{N}}]){r.term}(?![\p{{L}}\p{{N}}])", r.replacement)
    left = F.size(F.filter(safety_matches(out, rules), lambda m: m["severity"] == "block")) > 0
    return F.struct(F.when(left, F.lit(None)).otherwise(out).alias("text"), F.when(left, "block").when(out != x, "rewrite").otherwise("ok").alias("action"))


# --- evaluations -----------------------------------------------------------------------------------------------


def layer_outcome(engine: Column, human: Column, most: Column) -> Column:
    """How an engine's points for a layer compare with a person's."""
    return (
        F.when(engine.isNull() | human.isNull() | (most == 0), "unknown")
        .when(F.abs(engine - human) <= 1, "ok")
        .when((human / most <= 0.6) & (engine / most >= 0.8), "motor-high")
        .when((engine / most <= 0.6) & (human / most >= 0.8), "motor-low")
        .otherwise("warn")
    )


def layer_matrix(engine: Column, human: Column) -> Column:
    """Of each layer that either side gives points for: (layer, engine, human, most, result); a person who says nothing
    of a layer agrees with the engine."""
    rows = []
    for layer, most in LAYERS.items():
        motor, said = (F.try_element_at(m, F.lit(layer)).cast("double") for m in (engine, human))
        person = F.coalesce(said, motor)
        row = F.struct(F.lit(layer).alias("layer"), motor.alias("engine"), person.alias("human"), F.lit(most).alias("most"), layer_outcome(motor, person, F.lit(most)).alias("result"))
        rows.append(F.when(motor.isNotNull() | said.isNotNull(), row))
    return F.array_compact(F.array(*rows))


def rules_by_category(rules: DataFrame) -> DataFrame:
    """(group, rules, evidence) of active rules by the category of their scope: rules of layers are `motor`, those
    without a category `*`; in each the high ones first, then by evidence and confidence."""
    group = F.when(F.col("type") == "layer", "motor").otherwise(F.coalesce(text.nullif_empty(F.trim("category")), F.lit("*")))
    kept = rules.filter(F.coalesce("active", F.lit(True)) & (F.col("type") != "quality")).withColumn("group", group)
    order = F.struct((F.col("level") != "high").alias("low"), (-F.col("evidence")).alias("e"), (-F.col("confidence")).alias("c"), F.col("rule_key").alias("rule_key"))
    return kept.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["rule_key"]).alias("rules"), F.sum("evidence").alias("evidence"))


def derive_rules(evaluations: DataFrame, medium: int = MEDIUM_EVIDENCE, high: int = HIGH_EVIDENCE) -> DataFrame:
    """(rule_key, type, evidence, confidence, level) from (id, age, format, issues, field_errors, engine_layers,
    human_layers): keys for issues, corrected fields and layers, kept with enough evidence."""
    age, format_ = F.coalesce("age", F.lit("*")), F.coalesce("format", F.lit("*"))
    entry = lambda kind, key: F.struct(F.lit(kind).alias("type"), key.alias("rule_key"))
    none = F.array().cast("array<struct<type:string,rule_key:string>>")
    choice = lambda i: F.when(i.startswith("mc-") & (format_ != "*"), format_).otherwise("*")
    issue_keys = F.transform("issues", lambda i: entry("issue", F.concat_ws("|", F.lit("issue"), age, choice(i), i)))
    arrow = lambda e: F.concat(e["ai_value"], F.lit("->"), e["human_value"])

    def field_keys(e: Column) -> Column:
        before, after = e["ai_value"].try_cast("double"), e["human_value"].try_cast("double")
        return F.array_compact(F.array(
            F.when((e["field"] == "difficulty") & (before != after), entry("difficulty", F.concat_ws("|", F.lit("difficulty"), age, arrow(e)))),
            F.when((e["field"] == "difficulty") & (after < before), entry("difficulty", F.concat_ws("|", F.lit("difficulty-cap"), age))),
            F.when(e["field"] == "category", entry("category", F.concat_ws("|", F.lit("category"), arrow(e)))),
            F.when(e["field"] == "format", entry("format", F.concat_ws("|", F.lit("format"), age, arrow(e)))),
        ))

    fields = F.flatten(F.transform("field_errors", field_keys))
    layers = []
    for layer, most in LAYERS.items():
        motor = F.try_element_at("engine_layers", F.lit(layer)).cast("double")
        outcome = layer_outcome(motor, F.coalesce(F.try_element_at("human_layers", F.lit(layer)).cast("double"), motor), F.lit(most))
        for result, name in (("motor-high", "layer-over"), ("motor-low", "layer-under")):
            layers.append(F.when(outcome == result, entry("layer", F.concat_ws("|", F.lit(name), F.lit(layer), age))))
    keys = F.concat(F.coalesce(issue_keys, none), F.coalesce(fields, none), F.array_compact(F.array(*layers)))
    each = evaluations.select("id", F.explode(keys).alias("k")).select("id", "k.type", "k.rule_key")
    counted = each.groupBy("rule_key").agg(F.count(F.lit(1)).alias("evidence"), F.min_by("type", "id").alias("type")).filter(F.col("evidence") >= medium)
    confidence = F.least(F.lit(0.99), F.floor((F.lit(0.42) + F.col("evidence") * F.lit(0.055)) * 100 + 0.5) / 100)
    return counted.withColumns({"confidence": confidence, "level": F.when(F.col("evidence") >= high, "high").otherwise("medium")})


def report_stats(reports: DataFrame) -> DataFrame:
    """(dimension, value, count) of reports by status, issue, age band, device and category, and of distinct reporters."""
    dims = ("status", "issue_type", "age_band", "device_type", "category_name")
    each = reports.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit("")).alias("value")) for d in dims])).alias("x"))
    counts = each.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("count"))
    return counts.unionByName(reports.agg(F.lit("reporters").alias("dimension"), F.lit("").alias("value"), F.countDistinct("reporter_id").alias("count")))


def filter_reports(reports: DataFrame, status: str | None = None, issue_type: str | None = None, first_day: str | None = None, last_day: str | None = None, search: str | None = None, zone: str = "Europe/Lisbon") -> DataFrame:
    """Reports that pass every filter given; days are local ones, the search is a substring over all texts."""
    from tessera.functions.localtime import day_end, day_start

    for column, value in (("status", status), ("issue_type", issue_type)):
        if value:
            reports = reports.filter(F.col(column) == value)
    if first_day:
        reports = reports.filter(F.col("received_at") >= day_start(F.lit(first_day), zone))
    if last_day:
        reports = reports.filter(F.col("received_at") < day_end(F.lit(last_day), zone))
    if search:
        fields = [c for c in ("report_id", "issue_type", "category_name", "question_text", "comment", "suggestion", "question_hash") if c in reports.columns]
        reports = reports.filter(F.lower(F.concat_ws(" ", *fields)).contains(search.lower()))
    return reports


def hash_sets(reports: DataFrame) -> DataFrame:
    """(question_hash, open, resolved, cancelled) of reported hashes."""
    any_ = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False)).alias(s)
    return reports.filter("question_hash <> ''").groupBy("question_hash").agg(any_("open"), any_("resolved"), any_("cancelled"), count_where(F.lit(True)).alias("reports"))
