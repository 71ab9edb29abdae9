"""The repository of knowledge records: look-ups and pages, changes as keyed merges, inventories, and the import queue.

Changes take tables and return them; where a change can fail, each request comes back with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.localtime import ZONE, bucket_key, day_key, exclusive_end, hour_key, instant
from tessera.functions.numbers import count_where
from tessera.functions.text import clip, nullif_empty, question_hash, squeeze, strip_accents, strip_tags
from tessera.operators.bank import AGE_BANDS, CATEGORIES, recently_played, valid_options

# The names of the categories in the order of their numbers, the longest reason, the sizes of pages, what
# stands for the source of a record that is gone, and the reasons of corrections.
CATEGORY_NAMES = (
    *("Conhecimentos Gerais", "Geografia", "História", "Ciência", "Natureza", "Espaço", "Matemática e Lógica", "Literatura", "Português", "Arte"),
    *("Cinema e Séries", "Música", "Moda", "Gastronomia", "Desporto", "Jogos", "Tecnologia", "Culturas do Mundo", "Transportes", "Adivinhas e Curiosidades"),
)
REASON_CHARS, PAGE, PAGE_MOST, SEARCH_MOST = 400, 50, 200, 500
GONE = "(facto removido)"
PLACEHOLDERS = r"(?i)^devido ao tamanho da resposta|^sem informa|^sem resposta$|^ver na transcri"


def category_number(name: Column) -> Column:
    """A category's number by its name; null for others."""
    at = F.array_position(F.array(*[F.lit(n) for n in CATEGORY_NAMES]), F.trim(F.coalesce(name, F.lit(""))))
    return F.when(at > 0, at.cast("int"))


def as_json(record: DataFrame) -> Column:
    """A record as JSON, under the names that clients know."""
    names = {"knowledge_id": "knowledgeId", "category_n": "category", "topic": "topic", "fact": "fact", "answer": "answer", "source": "source", "source_id": "sourceId", "source_url": "sourceUrl", "confidence": "confidence", "priority_pt": "priorityPt", "age_bands": "ageBands", "allowed_formats": "allowedFormats", "is_active": "isActive", "superseded_by": "supersededBy"}
    fields = [F.col(c).alias(name) for c, name in names.items() if c in record.columns]
    return F.to_json(F.struct(*fields, (~F.col("is_active")).alias("blocked")))


def matches_context(age_band: str | None, format_: str | None = None) -> Column:
    """Whether an active record fits an age band and a format; without an age band none does."""
    if not age_band:
        return F.lit(False)
    fits = F.col("is_active") & F.array_contains("age_bands", age_band)
    return F.coalesce(fits & F.array_contains("allowed_formats", format_) if format_ else fits, F.lit(False))


def _current() -> Column:
    return F.coalesce("is_active", F.lit(False)) & F.col("superseded_by").isNull()


def get(records: DataFrame, knowledge_id: str | None) -> DataFrame:
    """The active record of an id that nothing supersedes."""
    return records.filter(_current() & (F.col("knowledge_id") == (knowledge_id or "").strip()))


def page(records: DataFrame, category: int, topic: str | None = None, format_: str | None = None, age_band: str | None = None, least_confidence: float = 0.85, most: int = PAGE, skip: int = 0) -> DataFrame:
    """A page of current records of a category, the last changed first, then by id; none outside the known categories."""
    rows = records.filter(_current() & (F.col("category_n") == category) & (F.col("confidence") >= least_confidence) & F.lit(1 <= category <= CATEGORIES))
    if topic:
        rows = rows.filter(F.col("topic") == topic)
    if age_band:
        rows = rows.filter(matches_context(age_band, format_))
    if format_:
        rows = rows.filter(matches_context(age_band or AGE_BANDS[0], format_))
    return rows.orderBy(F.col("updated_at").desc(), "knowledge_id").offset(max(skip, 0)).limit(min(max(most, 1), PAGE_MOST))


def search(records: DataFrame, plays: DataFrame, as_of: str, query: str = "", knowledge_id: str = "", category: int | None = None, topic: str = "", source: str = "", active: bool | None = None, created_from: str = "", created_to: str = "", most: int = PAGE, skip: int = 0) -> DataFrame:
    """Records that pass every filter given, newest first, with `in_quarantine`; without any filter there are none.

    The query is a part of id, fact or answer, without regard to case; times are local ones, of which the last second,
    minute, hour or day is still in."""
    given = [knowledge_id, query, topic, source, created_from, created_to]
    rows = records if any(given) or category else records.limit(0)
    part = lambda c, x: F.contains(F.lower(c), F.lit(x.lower()))
    if knowledge_id:
        rows = rows.filter(F.col("knowledge_id") == knowledge_id)
    elif query:
        rows = rows.filter(part("knowledge_id", query) | part("fact", query) | part("answer", query))
    for column, value in (("topic", topic), ("source", source)):
        if value:
            rows = rows.filter(part(column, value))
    if category:
        rows = rows.filter(F.col("category_n") == category)
    if active is not None:
        rows = rows.filter(F.col("is_active") == active)
    if created_from:
        rows = rows.filter(F.col("created_at") >= instant(F.lit(created_from)))
    if created_to:
        rows = rows.filter(F.col("created_at") < exclusive_end(F.lit(created_to)))
    listed = rows.orderBy(F.col("created_at").desc(), F.col("knowledge_id").desc()).offset(max(skip, 0)).limit(min(max(most, 1), SEARCH_MOST))
    resting = recently_played(plays, as_of, "knowledge_id").withColumn("in_quarantine", F.lit(True))
    return listed.join(resting, "knowledge_id", "left").fillna(False, ["in_quarantine"])


# --- changes -----------------------------------------------------------------------------------------------------


def _latest(requests: DataFrame, key: str, order: str) -> DataFrame:
    at = F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))
    return requests.withColumn("_at", at).filter("_at = 1").drop("_at")


def disable(records: DataFrame, requests: DataFrame, order: str = "position") -> DataFrame:
    """records after requests of (knowledge_id, reason): off, with the reason, cut to its length, unless it is empty. Of
    several requests for a record the last counts."""
    last = _latest(requests.filter("knowledge_id <> ''"), "knowledge_id", order)
    asked = last.select("knowledge_id", nullif_empty(clip(F.col("reason"), REASON_CHARS)).alias("_why"), F.lit(True).alias("_hit"))
    joined = records.join(asked, "knowledge_id", "left")
    return joined.withColumns({"is_active": F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("is_active")), "disabled_reason": F.coalesce("_why", "disabled_reason")}).select(*records.columns)


def supersede(records: DataFrame, requests: DataFrame, order: str = "position") -> DataFrame:
    """records after requests of (knowledge_id, superseded_by, deactivate); a null deactivate counts as true."""
    sound = requests.select(F.trim("knowledge_id").alias("knowledge_id"), F.trim("superseded_by").alias("_by"), F.coalesce("deactivate", F.lit(True)).alias("_off"), order).filter("knowledge_id <> '' AND _by <> ''")
    joined = records.join(_latest(sound, "knowledge_id", order).drop(order), "knowledge_id", "left")
    off = F.coalesce("_off", F.lit(False))
    return joined.withColumns({"superseded_by": F.coalesce("_by", "superseded_by"), "is_active": F.when(off, F.lit(False)).otherwise(F.col("is_active"))}).select(*records.columns)


def delete(records: DataFrame, bank: DataFrame, plays: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, bank, plays) without some records, the items made from them and the plays of either."""
    gone = ids.select(F.trim("knowledge_id").alias("knowledge_id")).filter("knowledge_id <> ''").distinct()
    return tuple(t.join(gone, "knowledge_id", "left_anti") for t in (records, bank, plays))


def record_plays(plays: DataFrame, shown: DataFrame) -> DataFrame:
    """plays with those of shown items (question_hash, knowledge_id, played_at); without a hash there is no play."""
    rows = shown.select(F.trim("question_hash").alias("question_hash"), nullif_empty(F.trim("knowledge_id")).alias("knowledge_id"), "played_at")
    return plays.select("question_hash", "knowledge_id", "played_at").unionByName(rows.filter("question_hash <> ''"))


def record_used(plays: DataFrame, used: DataFrame) -> DataFrame:
    """plays with those of facts (knowledge_id, session_id, played_at) that were used without an item: the hash is made
    from the id and, where there is one, the session."""
    fact, session = F.trim("knowledge_id"), clip(F.col("session_id"), 64)
    name = F.concat(F.lit("kid:"), fact, F.when(session != "", F.concat(F.lit(":"), session)).otherwise(F.lit("")))
    return record_plays(plays, used.filter(fact != "").select(name.alias("question_hash"), "knowledge_id", "played_at"))


def correct_reported(bank: DataFrame, blocked: DataFrame, facts: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(bank, blocked, facts, outcomes) after corrections of reported items.

    A correction has old_hash and the columns of a bank row. Its `reason` is missing_fields, hash_unchanged, not_blocked,
    missing_options, new_hash_blocked or corrected. What is corrected leaves the bank and the blocked hashes under its
    old hash and enters the bank under its new one, and its fact is active again."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    lacking = blank("old_hash") | blank("question_hash") | blank("category_n") | blank("age_band") | blank("question") | blank("correct_answer")
    shut = blocked.select("question_hash").distinct()
    marked = corrections.join(shut.select(F.col("question_hash").alias("_old"), F.lit(True).alias("_held")), F.trim("old_hash") == F.col("_old"), "left")
    marked = marked.join(shut.select(F.col("question_hash").alias("_new"), F.lit(True).alias("_shut")), F.trim("question_hash") == F.col("_new"), "left")
    reason = (
        F.when(lacking, "missing_fields")
        .when(F.trim("old_hash") == F.trim("question_hash"), "hash_unchanged")
        .when(F.col("_held").isNull(), "not_blocked")
        .when(~valid_options(F.col("options"), F.col("format"), F.col("correct_answer")), "missing_options")
        .when(F.col("_shut"), "new_hash_blocked")
        .otherwise("corrected")
    )
    outcomes = marked.withColumn("reason", reason).drop("_old", "_held", "_new", "_shut")
    done = outcomes.filter("reason = 'corrected'")
    old = done.select(F.trim("old_hash").alias("question_hash")).distinct()
    rows = done.withColumns({"question_hash": F.trim("question_hash"), "is_reported": F.lit(False), "source": F.coalesce(nullif_empty(F.trim("source")), F.lit("corrected"))}).select(*bank.columns)
    again = done.select(nullif_empty(F.trim("knowledge_id")).alias("knowledge_id")).filter("knowledge_id IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
    active = facts.join(again, "knowledge_id", "left").withColumn("is_active", F.coalesce("_hit", "is_active")).select(*facts.columns)
    return bank.join(old, "question_hash", "left_anti").unionByName(rows), blocked.join(old, "question_hash", "left_anti"), active, outcomes


def purge_invalid(bank: DataFrame) -> DataFrame:
    """The bank without unreported items whose options are not valid."""
    return bank.filter(F.coalesce("is_reported", F.lit(False)) | valid_options(F.col("options"), F.col("format"), F.col("correct_answer")))


def backfill_difficulty(bank: DataFrame) -> DataFrame:
    """Unreported items with a missing difficulty taken from the estimate, and a missing map by age band made from the
    difficulty for each band of the item."""
    open_ = ~F.coalesce("is_reported", F.lit(False))
    level = F.when(open_ & F.col("difficulty").isNull() & F.col("estimated_difficulty").between(1, 5), F.col("estimated_difficulty")).otherwise(F.col("difficulty"))
    bands = F.filter(F.when(F.size("age_bands") > 0, F.col("age_bands")).otherwise(F.array("age_band")), lambda b: b.isin(*AGE_BANDS))
    made = F.map_from_entries(F.transform(F.array_distinct(bands), lambda b: F.struct(b, level)))
    empty = F.coalesce(F.size("difficulty_by_age_band"), F.lit(-1)) <= 0
    return bank.withColumn("difficulty_by_age_band", F.when(open_ & empty & level.between(1, 5) & (F.size(bands) > 0), made).otherwise(F.col("difficulty_by_age_band"))).withColumn("difficulty", level)


def taxonomy_patch(categories: Column, ages: Column) -> Column:
    """(category_ns, age_bands, category_n, age_band): sorted distinct categories, distinct ages, and the first of each."""
    cats = F.array_sort(F.array_distinct(F.filter(categories, lambda c: c.between(1, CATEGORIES))))
    bands = F.array_distinct(F.filter(ages, lambda a: a.isin(*AGE_BANDS)))
    return F.struct(cats.alias("category_ns"), bands.alias("age_bands"), F.try_element_at(cats, F.lit(1)).alias("category_n"), F.try_element_at(bands, F.lit(1)).alias("age_band"))


# --- the import queue and the way into the bank ---------------------------------------------------------------------


def mark_imported(queue: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    hit = ids.select("queue_id").distinct().withColumn("_hit", F.lit(True))
    joined = queue.join(hit, "queue_id", "left")
    return joined.withColumns({"status": F.when(F.col("_hit"), "imported").otherwise(F.col("status")), "imported_at": F.when(F.col("_hit"), F.to_timestamp(F.lit(at))).otherwise(F.col("imported_at"))}).select(*queue.columns)


def reset_imported(queue: DataFrame) -> DataFrame:
    done = F.col("status") == "imported"
    return queue.withColumns({"imported_at": F.when(done, F.lit(None)).otherwise(F.col("imported_at")), "status": F.when(done, "pending").otherwise(F.col("status"))})


def placeholder(answer: Column) -> Column:
    """Whether an answer is none, or a remark that there is none."""
    a = F.trim(F.coalesce(answer, F.lit("")))
    return (a == "") | a.rlike(PLACEHOLDERS)


def bank_items(facts: DataFrame, age_band: str, options: DataFrame, source: str = "repository-replenish") -> DataFrame:
    """Riddles of the bank made from facts for an age band; options: (knowledge_id, options). A fact without a usable
    answer or without four options gives none."""
    rows = facts.join(options, "knowledge_id").filter(~placeholder(F.col("answer")) & (F.trim("fact") != "") & (F.size("options") == 4))
    q, a = F.trim(strip_tags(F.col("fact"))), F.trim(strip_tags(F.col("answer")))
    key = question_hash(q, a, F.lit(age_band))
    return rows.select(F.lit(CATEGORIES).alias("category_n"), F.lit(age_band).alias("age_band"), q.alias("question"), a.alias("correct_answer"), key.alias("question_hash"), "options", F.lit("ADIVINHA").alias("format"), F.lit(source).alias("source"), "knowledge_id", "source_id", "confidence")


def fallback_options(answer: Column, pool: Column, seed: int = 0) -> Column:
    """The answer and three of a pool of others, in an order that depends on the answer and the seed; null if the pool
    has not three."""
    key = lambda x: strip_accents(F.lower(F.trim(x)))
    others = F.filter(pool, lambda p: key(p) != key(answer))
    drawn = F.transform(F.slice(F.array_sort(F.transform(others, lambda p: F.struct(F.xxhash64(answer, p, F.lit(seed)).alias("r"), p.alias("p")))), 1, 3), lambda x: x["p"])
    placed = F.transform(F.array_sort(F.transform(F.concat(F.array(answer), drawn), lambda p: F.struct(F.xxhash64(p, answer, F.lit(seed + 1)).alias("r"), p.alias("p")))), lambda x: x["p"])
    return F.when(F.size(drawn) == 3, placed)


def replenish(bank: DataFrame, blocked: DataFrame, facts: DataFrame, age_band: str, pool: Column, most: int = 50, seed: int = 0) -> DataFrame:
    """(question_hash, knowledge_id, reason) of riddles made from facts that the bank lacks for an age band."""
    from tessera.operators.bank import classify_import, unmaterialised

    left = unmaterialised(facts, bank, age_band).orderBy(F.coalesce("priority_pt", F.lit(50)).desc(), "knowledge_id").limit(most)
    options = left.select("knowledge_id", fallback_options(squeeze(F.col("answer")), pool, seed).alias("options"))
    items = bank_items(left, age_band, options).withColumn("position", F.col("knowledge_id"))
    return classify_import(items, bank, blocked).select("question_hash", "knowledge_id", "reason")


# --- inventories -------------------------------------------------------------------------------------------------------


def inventory(records: DataFrame, bank: DataFrame, as_of: str, zone: str = ZONE) -> DataFrame:
    """(grain, key, source, category_n, topic, active, inactive, total) of the repository.

    Grains: all; category_topic (active ones); source; source_topic; day, hour (the last 24 hours) and minute (buckets of
    five in the last six hours), by local time of creation and source; bank (items, and as active those made from a
    record) and bank_source (items by the source of their record). One pass over the records feeds all of theirs: each is
    sent to the groups it counts in, and counts are combined before the shuffle."""
    now = F.to_timestamp(F.lit(as_of))
    on = F.coalesce("is_active", F.lit(False))
    none, number = F.lit(None).cast("string"), F.lit(None).cast("int")
    cell = lambda grain, key=none, source=none, category=number, topic=none: F.struct(F.lit(grain).alias("grain"), key.alias("key"), source.alias("source"), category.alias("category_n"), topic.alias("topic"))
    source, category, topic, made = F.col("source"), F.col("category_n").cast("int"), F.col("topic"), F.col("created_at")
    cells = F.array_compact(F.array(
        cell("all"),
        F.when(on, cell("category_topic", none, none, category, topic)),
        cell("source", none, source),
        cell("source_topic", none, source, category, topic),
        cell("day", day_key(made, zone), source),
        F.when(made >= now - F.expr("INTERVAL 24 HOURS"), cell("hour", hour_key(made, zone), source)),
        F.when(made >= now - F.expr("INTERVAL 6 HOURS"), cell("minute", bucket_key(made, 5, zone), source)),
    ))
    columns = ["grain", "key", "source", "category_n", "topic"]
    tally = [count_where(F.col("on")).alias("active"), count_where(~F.col("on")).alias("inactive"), F.count(F.lit(1)).alias("total")]
    own = records.select(on.alias("on"), F.explode(cells).alias("c")).select("on", "c.*").groupBy(*columns).agg(*tally)
    linked = bank.select((F.trim(F.coalesce("knowledge_id", F.lit(""))) != "").alias("on"), "knowledge_id")
    whole = linked.groupBy(cell("bank").alias("c")).agg(*tally).select("c.*", "active", "inactive", "total")
    known = records.select("knowledge_id", F.col("source").alias("s"))
    by_source = linked.filter("on").join(known, "knowledge_id", "left").groupBy(cell("bank_source", none, F.coalesce("s", F.lit(GONE))).alias("c")).agg(*tally).select("c.*", "active", "inactive", "total")
    return own.unionByName(whole).unionByName(by_source)


def room_stats(rooms: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: open rooms, those in play and in the lobby, and rooms, games, multiplayer and single games in all."""
    r = rooms.agg(count_where(F.col("status").isin("lobby", "playing")).alias("open_rooms"), count_where(F.col("status") == "playing").alias("playing"), count_where(F.col("status") == "lobby").alias("lobby"), F.count(F.lit(1)).alias("total_rooms"))
    m = matches.agg(F.count(F.lit(1)).alias("total_games"), count_where(F.col("mode") == "multiplayer").alias("multiplayer_games"), count_where(F.col("mode") == "single").alias("single_games"))
    return r.crossJoin(F.broadcast(m))  # a row each


