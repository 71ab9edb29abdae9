"""Whether an item repeats what its session had before it, or what was reported: an as-of join of each item with the
history as it stood then, without collecting histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import keys
from tessera.functions.lineage import written
from tessera.functions.text import jaccard, normalize_plain_first, strip_accents, tokens

# How many questions back similar ones are looked for, from which similarity, and the issues by code.
LAST, SIMILAR_QUESTION = 8, 0.55
#: Sessions are looked through in stretches of so many places, so that a long one is no task.
STRETCH = 1024
MESSAGES = {
    "KNOWLEDGE_ID_REPEATED": "facto do repositório já usado recentemente (knowledgeId)",
    "KNOWLEDGE_REPEATED": "conhecimento já testado recentemente (knowledgeKey)",
    "KNOWLEDGE_REPORTED": "facto reportado — só pode voltar após correcção",
    "QUESTION_REPORTED": "pergunta reportada — só pode voltar após correcção",
    "QUESTION_SIMILAR": "pergunta semelhante a uma recente",
    "ANSWER_REPEATED": "resposta já usada recentemente",
}
TRUE_FALSE = ("verdadeiro", "falso")
#: Kinds of stored history, besides the items themselves: what was used before the session began, and what is blocked.
USED, BLOCKED = "used", "blocked"


def words(x: Column) -> Column:
    """Distinct words of more than two characters, without marks."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(strip_accents(F.lower(x)), r"[^a-z0-9\s-]", " "), r"\s+", " "))
    return tokens(F.when(~x.rlike("[^A-Za-z0-9 -]|  "), F.trim(F.lower(x))).otherwise(bare))


def _once(rows: DataFrame, of: list[str], **made: Column) -> DataFrame:
    """The distinct values of columns with what is made of them: texts come often, and are worked on once."""
    return written(rows.select(*of).distinct().select(*of, *[c.alias(name) for name, c in made.items()]))


def _with(rows: DataFrame, forms: DataFrame, of: list[str]) -> DataFrame:
    there = forms.withColumnsRenamed({c: f"{c}_there" for c in of})
    same = F.col(of[0]).eqNullSafe(F.col(f"{of[0]}_there"))
    for c in of[1:]:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_there"))
    return rows.join(there, same).drop(*[f"{c}_there" for c in of])


def _seen_before(items: DataFrame, value: str, earlier: DataFrame | None = None) -> DataFrame:
    """(session, position) of the items whose value an earlier item of the session has, or the history of (session,
    value). The first place of each value is worked out by an aggregation, so a value that fills a session is no task."""
    held = items.filter(F.coalesce(F.col(value), F.lit("")) != "").select("session", "position", F.col(value).alias("value"))
    first = held.groupBy("session", "value").agg(F.min("position").alias("first"))
    if earlier is not None:
        first = first.unionByName(earlier.select("session", "value").distinct().withColumn("first", F.lit(None).cast("long")))
        first = first.groupBy("session", "value").agg(F.when(F.count("first") < F.count(F.lit(1)), F.lit(-1)).otherwise(F.min("first")).alias("first"))
    return held.join(first, ["session", "value"]).filter(F.col("first") < F.col("position")).select("session", "position")


def _grams(x: Column) -> Column:
    """All runs of one to three characters of a text."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.array(*[F.substring(x, i, F.lit(n)) for n in (1, 2, 3)]))))


def _asked_and_told(parts: Column, free: Column) -> tuple[Column, Column]:
    """Join keys by which any knowledge key, given by its parts and as a free one, meets a free one: two keys can only match
    if what one asks for is among what the other tells. Structured keys ask for free ones that hold their entity; free ones
    ask by their words, and for those that hold them."""
    tag = lambda kind, x: F.transform(x, lambda v: F.concat(F.lit(kind), v))
    head = lambda x: F.array(F.substring(x, 1, 3))
    asked = F.when(parts.isNotNull(), tag("g:", head(F.element_at(parts, 2)))).otherwise(F.concat(tag("w:", tokens(free)), tag("g:", head(free))))
    told = F.concat(tag("w:", tokens(free)), tag("g:", _grams(free)))
    return asked, told


def _known_before(items: DataFrame, earlier: DataFrame) -> DataFrame:
    """(session, position) of the items without a record whose knowledge key matches an earlier one of the session.

    Each distinct key of a session counts with its first place. Structured keys match by entity and concept, so their first
    place is that of the pair, by an aggregation; free ones meet others through join keys and are then compared. An item is
    out if the least first place of the keys that match its own lies before it."""
    keyed = items.filter(F.coalesce("knowledge_key", F.lit("")) != "").select("session", "position", "knowledge_id", F.col("knowledge_key").alias("key"))
    classes = keyed.groupBy("session", "key").agg(F.min("position").alias("first")).unionByName(earlier.select("session", F.col("value").alias("key"), F.lit(-1).cast("long").alias("first")))
    classes = classes.groupBy("session", "key").agg(F.min("first").alias("first"))
    classes = written(classes)
    classes = _with(classes, _once(classes, ["key"], parts=keys.parts_of(F.col("key")), free=normalize_plain_first(F.col("key"))), ["key"])
    pair = [F.element_at("parts", 2).alias("entity"), F.element_at("parts", 3).alias("concept")]
    structured = classes.filter(F.col("parts").isNotNull()).select("session", "key", "first", *pair)
    by_pair = structured.groupBy("session", "entity", "concept").agg(F.min("first").alias("least"))
    paired = structured.join(by_pair, ["session", "entity", "concept"]).select("session", "key", F.col("least").alias("first"))

    asked, told = _asked_and_told(F.col("parts"), F.col("free"))
    side = lambda x, by: [F.struct("key", "first", "parts", "free").alias(x), F.explode(by).alias("by")]
    loose = classes.filter(F.col("parts").isNull())
    met = classes.select("session", *side("a", asked)).join(loose.select("session", *side("b", told)), ["session", "by"]).select("session", "a", "b").distinct()
    match = met.filter((F.col("a.key") == F.col("b.key")) | keys.forms_match(F.col("a.parts"), F.col("a.free"), F.col("b.parts"), F.col("b.free")))
    both = match.select("session", F.col("a.key").alias("key"), F.col("b.first").alias("first")).unionByName(match.select("session", F.col("b.key").alias("key"), F.col("a.first").alias("first")))
    least = both.unionByName(paired).groupBy("session", "key").agg(F.min("first").alias("first"))
    return keyed.filter(F.coalesce("knowledge_id", F.lit("")) == "").join(least, ["session", "key"]).filter(F.col("first") < F.col("position")).select("session", "position")


def _similar_before(items: DataFrame) -> DataFrame:
    """(session, position) of the items with a similar question among the last of their session, by place."""
    told = items.select("session", "position", "words").filter(F.size("words") > 0)
    # each stretch also gets the last of the one before it, only to be looked back at
    own = F.floor(F.col("position") / STRETCH)
    held = F.when(F.pmod("position", F.lit(STRETCH)) >= STRETCH - LAST, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = told.withColumn("stretch", F.explode(held))
    before = F.collect_list("words").over(W.partitionBy("session", "stretch").orderBy("position").rangeBetween(-LAST, -1))
    mine = dealt.withColumn("before", before).filter(F.col("stretch") == own)
    return mine.filter(F.exists("before", lambda b: jaccard(F.col("words"), b) >= SIMILAR_QUESTION)).select("session", "position").distinct()


def repetition_issues(items: DataFrame, history: DataFrame) -> DataFrame:
    """(session, position, code, message) of the items that repeat something, each code once.

    items: (session, position, question, answer, format, knowledge_id, knowledge_key, question_hash), a position being an
    item's place in its session, counted without gaps. history: (session, kind, field, value) of what was used before the
    session (kind `used`, fields knowledge_id, knowledge_key and answer) and of what must not come back (kind `blocked`,
    fields knowledge_id, question_hash and question, the latter as `normalize` gives it); a null session of what is
    blocked stands for all sessions. An item with a record is told by its id, one without by its key; true-or-false items
    and answers are not looked for among the answers. Null and empty values repeat nothing; rows that share a place are
    told the same; an empty table has no rows. Other columns are not looked at."""
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rows = items.select("session", F.col("position").cast("long").alias("position"), "question", "answer", F.coalesce("format", F.lit("")).alias("format"), trimmed(F.col("knowledge_id")).alias("knowledge_id"), "knowledge_key", trimmed(F.col("question_hash")).alias("question_hash"))
    rows = written(rows)  # read by every check below
    asked = _once(rows, ["question", "format"], asked=keys.for_repetition(F.col("question"), F.col("format")))
    asked = written(asked.select("question", "format", normalize_plain_first(F.col("asked")).alias("_norm"), words(F.col("asked")).alias("words")))
    told = _with(rows, asked, ["question", "format"])
    answered = _with(rows, _once(rows, ["answer"], normal=normalize_plain_first(F.col("answer"))), ["answer"])
    skip = (F.col("format") == "VERDADEIRO_FALSO") | F.col("normal").isin(*TRUE_FALSE)
    answered = answered.select("session", "position", F.when(~skip, F.col("normal")).alias("_answer"))
    of = lambda kind, field: history.filter((F.col("kind") == kind) & (F.col("field") == field) & (F.trim("value") != "")).select("session", F.trim("value").alias("value"))

    def blocked(column: str, field: str, rows: DataFrame = rows) -> DataFrame:
        held = of(BLOCKED, field).distinct()
        mine = rows.join(held.filter("session IS NOT NULL").withColumnRenamed("value", column), ["session", column], "left_semi")
        everyone = rows.join(held.filter("session IS NULL").select(F.col("value").alias(column)), column, "left_semi")
        return mine.select("session", "position").unionByName(everyone.select("session", "position"))

    answers = of(USED, "answer").select("session", normalize_plain_first(F.col("value")).alias("value")).filter(~F.col("value").isin(*TRUE_FALSE))
    parts = [
        ("KNOWLEDGE_ID_REPEATED", _seen_before(rows, "knowledge_id", of(USED, "knowledge_id"))),
        ("KNOWLEDGE_REPEATED", _known_before(rows, of(USED, "knowledge_key"))),
        ("KNOWLEDGE_REPORTED", blocked("knowledge_id", "knowledge_id")),
        ("QUESTION_REPORTED", blocked("question_hash", "question_hash").unionByName(blocked("_norm", "question", told))),
        ("QUESTION_SIMILAR", _similar_before(told)),
        ("ANSWER_REPEATED", _seen_before(answered, "_answer", answers)),
    ]
    out = None
    for code, found in parts:
        part = found.select("session", "position", F.lit(code).alias("code"))
        out = part if out is None else out.unionByName(part)
    messages = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return out.distinct().withColumn("message", messages[F.col("code")])
