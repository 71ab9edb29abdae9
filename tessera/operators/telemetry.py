"""Generation telemetry: normalising events, outcome summaries, issue details, provider ranking and delivery shares.

An event is (id, ts, outcome, category, format_id, source, provider, model, attempt, game_mode, issue_codes,
issue_messages, question_hash, validated_at, validated_edited, dismissed_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.numbers import clamp, count_where, ratio

# Fixed values of the event model.
OUTCOMES = ("accepted", "rejected", "parse_error", "api_error")
REPOSITORY_SOURCES = ("repository", "repo-direct", "repo-ai")
AI_SOURCES = ("ai", "bank-replenish", "repo-ai")
NON_AI_TARGET = 0.95
MAX_CODES = 12
NEWEST_ACCEPTED, NEWEST_REVIEWABLE = 10_000, 2_500


def is_non_ai(source: Column) -> Column:
    return ~F.coalesce(source, F.lit("ai")).isin("ai", "repo-ai")


def is_repository(source: Column) -> Column:
    return F.coalesce(source, F.lit("")).isin(*REPOSITORY_SOURCES)


def is_ai_provider_event(source: Column, provider: Column) -> Column:
    return F.coalesce(source, F.lit("ai")).isin(*AI_SOURCES) & (F.trim(F.coalesce(provider, F.lit(""))) != "")


def normalize_events(events: DataFrame) -> DataFrame:
    """Outcomes outside the known ones become unknown, texts are clipped, lists hold at most twelve entries."""
    known = F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise("unknown")
    listed = lambda c: F.slice(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: text.clip(x, 200)), lambda x: x != ""), 1, MAX_CODES)
    return events.withColumns({"outcome": known, "source": F.coalesce(text.nullif_empty(text.clip(F.col("source"), 16)), F.lit("ai")), "provider": text.clip(F.col("provider"), 24), "model": text.clip(F.col("model"), 48), "issue_codes": listed("issue_codes"), "issue_messages": listed("issue_messages")})


def stats_input(events: DataFrame, accepted: int = NEWEST_ACCEPTED, reviewable: int = NEWEST_REVIEWABLE) -> DataFrame:
    """What statistics are computed on: the newest accepted events and the newest reviewable ones, each to its cap, once
    an id. Events of other outcomes are left out. The caps are the feature; each kind is ranked on its
    own, the tasks keeping no more than the cap."""
    newest = lambda kept, cap: events.filter(kept).orderBy(F.col("ts").desc(), F.col("id")).limit(cap)
    return newest(F.col("outcome") == "accepted", accepted).unionByName(newest(F.col("outcome").isin(*OUTCOMES[1:]), reviewable)).dropDuplicates(["id"])


def trim(events: DataFrame, most: int, ts: str = "ts", key: str = "id") -> DataFrame:
    """The newest `most` events, of equally old ones those with the least key: the retention of an append-only log.

    The last one to stay is found by a distributed top-k; then every event is held against it where it lies, so that
    nothing but its time and key is sent anywhere. Events without a time are the oldest."""
    dated = F.coalesce(F.col(ts).cast("timestamp"), F.timestamp_seconds(F.lit(-(1 << 40))))
    newest = events.select(dated.alias("cut_ts"), F.col(key).alias("cut_key")).orderBy(F.col("cut_ts").desc(), "cut_key").limit(most)
    last = newest.groupBy("cut_ts").agg(F.max("cut_key").alias("cut_key")).orderBy("cut_ts").limit(1)
    stays = (dated > F.col("cut_ts")) | ((dated == F.col("cut_ts")) & (F.col(key) <= F.col("cut_key")))
    return events.join(F.broadcast(last), stays, "left_semi")


def clear(events: DataFrame) -> DataFrame:
    """The log after it was emptied: its columns and no rows."""
    return events.limit(0)


def with_columns(rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """rows of an older or newer schema with just the wanted columns, cast to their types; missing ones are null."""
    return rows.select(*[(F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)).alias(c) for c, kind in wanted.items()])


def to_rows(events: DataFrame) -> DataFrame:
    """Normalised events as they are stored: empty texts are null, numbers are whole."""
    plain = lambda c: text.nullif_empty(F.col(c)).alias(c)
    whole = lambda c: F.floor(F.col(c) + 0.5).cast("int").alias(c)
    return events.select("id", F.col("ts").alias("event_ts"), "outcome", "category", plain("format_id"), whole("attempt"), "issue_codes", "issue_messages", plain("provider"), plain("model"), "source", F.coalesce(text.nullif_empty(F.col("game_mode")), F.lit("local")).alias("game_mode"))


def from_rows(rows: DataFrame) -> DataFrame:
    """Stored rows as events: null texts are empty, a missing source is ai and a missing mode local."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    return rows.select("id", F.col("event_ts").alias("ts"), "outcome", "category", empty("format_id"), "attempt", listed("issue_codes"), listed("issue_messages"), empty("provider"), empty("model"), F.coalesce("source", F.lit("ai")).alias("source"), F.coalesce("game_mode", F.lit("local")).alias("game_mode"))


def _outcomes() -> list[Column]:
    n = lambda o: count_where(F.col("outcome") == o)
    return [F.count(F.lit(1)).alias("total"), n("accepted").alias("accepted"), n("rejected").alias("rejected"), n("parse_error").alias("parse_errors"), n("api_error").alias("api_errors")]


def summary(events: DataFrame) -> DataFrame:
    """One row of counts and rates over all events."""
    accepted = F.col("outcome") == "accepted"
    ai = accepted & (F.col("source") == "ai") & F.col("attempt").isNotNull()
    total = events.agg(
        *_outcomes(),
        count_where(F.col("validated_at").isNotNull()).alias("validated"),
        count_where(F.col("validated_at").isNotNull() & F.col("validated_edited")).alias("validated_edited"),
        count_where(F.col("validated_at").isNotNull() & ~F.col("validated_edited")).alias("validated_as_is"),
        count_where(F.col("dismissed_at").isNotNull()).alias("dismissed"),
        count_where(accepted & is_repository(F.col("source"))).alias("repository_accepted"),
        count_where(accepted & F.col("source").isin("repo-direct", "repository")).alias("_direct"),
        count_where(accepted & (F.col("source") == "bank")).alias("_bank"),
        count_where(accepted & is_non_ai(F.col("source"))).alias("_non_ai"),
        F.sum(F.when(ai, F.col("attempt"))).alias("_attempts"),
        count_where(ai).alias("_ai"),
    )
    failed = F.col("rejected") + F.col("parse_errors") + F.col("api_errors")
    rated = total.withColumns({
        "acceptance_rate": ratio(F.col("accepted"), F.col("total")),
        "rejection_rate": ratio(failed, F.col("total")),
        "repository_share": ratio(F.col("repository_accepted"), F.col("accepted")),
        "repo_direct_share": ratio(F.col("_direct"), F.col("repository_accepted")),
        "bank_share": ratio(F.col("_bank"), F.col("accepted")),
        "non_ai_share": ratio(F.col("_non_ai"), F.col("accepted")),
        "ai_avg_attempts": ratio(F.col("_attempts"), F.col("_ai"), None),
    })
    return rated.drop("_direct", "_bank", "_non_ai", "_attempts", "_ai")


#: Dimensions of `by_dimension`: what each row counts under, and which outcomes count as rejected there.
DIMENSIONS = ("category", "format", "game_mode", "source", "provider", "model", "attempt", "issue_code")


def by_dimension(events: DataFrame) -> DataFrame:
    """(dimension, value, total, accepted, rejected, parse_errors, api_errors) of all dimensions in one pass: each event
    is sent to the values it counts under, and the counts are combined before the shuffle."""
    ai = is_ai_provider_event(F.col("source"), F.col("provider"))
    attempt = F.when((F.col("outcome") == "accepted") & F.col("attempt").isNotNull(), clamp(F.round("attempt"), 1, 10).cast("int").cast("string"))
    single = {
        "category": F.col("category").cast("string"),
        "format": text.nullif_empty(F.col("format_id")),
        "game_mode": F.coalesce(text.nullif_empty(F.col("game_mode")), F.lit("local")),
        "source": F.coalesce(text.nullif_empty(F.col("source")), F.lit("ai")),
        "provider": F.when(ai, F.col("provider")),
        "model": text.nullif_empty(F.col("model")),
        "attempt": attempt,
    }
    entries = F.filter(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in single.items()]), lambda x: x["value"].isNotNull())
    codes = F.transform(F.coalesce(F.col("issue_codes"), F.array().cast("array<string>")), lambda c: F.struct(F.lit("issue_code").alias("dimension"), c.alias("value")))
    return events.select("outcome", F.explode(F.concat(entries, codes)).alias("x")).groupBy("x.dimension", "x.value").agg(*_outcomes())


def is_open(events: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Reviewable events that are neither dismissed nor validated and whose content is not already pending review."""
    left = events.filter(F.col("outcome").isin(*OUTCOMES[1:]) & F.col("dismissed_at").isNull() & F.col("validated_at").isNull())
    return left if pending is None else left.join(pending.select("question_hash").distinct(), "question_hash", "left_anti")


def issue_details(events: DataFrame, pending: DataFrame | None = None, recent: int = 10) -> DataFrame:
    """Per issue code: counts by state, a sample message, the last occurrence and the newest open ones."""
    open_ids = is_open(events, pending).select("id", F.lit(True).alias("open"))
    message = F.coalesce(F.try_element_at("issue_messages", F.col("pos") + 1), F.try_element_at("issue_messages", F.lit(1)), F.lit(""))
    each = events.select("*", F.posexplode("issue_codes").alias("pos", "code")).withColumn("message", message).join(open_ids, "id", "left")
    done = F.col("validated_at").isNotNull()
    counted = each.groupBy("code").agg(
        F.count(F.lit(1)).alias("count"),
        count_where(done).alias("validated"),
        count_where(done & F.col("validated_edited")).alias("validated_edited"),
        count_where(done & ~F.col("validated_edited")).alias("validated_as_is"),
        count_where(F.col("dismissed_at").isNotNull()).alias("dismissed"),
        count_where(F.col("open")).alias("open"),
        F.min_by("message", F.when(F.col("message") != "", F.struct("ts", "id", "pos"))).alias("sample_message"),
        F.max(F.struct("ts", "id")).alias("last"),
    )
    at = F.row_number().over(W.partitionBy("code").orderBy(F.col("ts").desc(), F.col("id").desc(), F.col("pos").desc()))
    newest = each.filter("open").select("code", "ts", "id", "pos").withColumn("at", at).filter(F.col("at") <= recent)
    lists = newest.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("recent_open"))
    return counted.join(lists, "code", "left")


def provider_ranking(events: DataFrame, support: int = 3) -> DataFrame:
    """Providers by acceptance rate, then mean attempts (99 without any), then size; `best` marks the first one with
    enough events."""
    counted = F.col("attempt").isNotNull() & F.col("outcome").isin("accepted", "rejected", "parse_error")
    ai = events.filter(is_ai_provider_event(F.col("source"), F.col("provider")))
    rows = ai.groupBy("provider").agg(*_outcomes(), F.sum(F.when(counted, F.col("attempt"))).alias("attempt_sum"), count_where(counted).alias("attempt_count"))
    failed = F.col("rejected") + F.col("parse_errors") + F.col("api_errors")
    rated = rows.withColumns({"acceptance_rate": ratio(F.col("accepted"), F.col("total")), "rejection_rate": ratio(failed, F.col("total")), "avg_attempts": ratio(F.col("attempt_sum"), F.col("attempt_count"), None)})
    order = [F.col("acceptance_rate").desc(), F.coalesce("avg_attempts", F.lit(99.0)), F.col("total").desc(), F.col("provider")]
    everything = W.partitionBy(F.lit(1))
    ranked = rated.withColumn("rank", F.row_number().over(everything.orderBy(*order)))
    first = F.min(F.when(F.col("total") >= support, F.col("rank"))).over(everything)
    return ranked.withColumn("best", F.coalesce(F.col("rank") == first, F.lit(False)))


def category_delivery(events: DataFrame, target: float = NON_AI_TARGET) -> DataFrame:
    """Per category: where accepted items came from, and whether enough of them came without AI. free_form_share is that
    of source ai."""
    source = F.coalesce("source", F.lit("ai"))
    rows = events.filter("outcome = 'accepted' AND category IS NOT NULL").groupBy("category").agg(
        F.count(F.lit(1)).alias("accepted"),
        count_where(is_non_ai(source)).alias("non_ai"),
        count_where(is_repository(source)).alias("repository"),
        count_where(source == "ai").alias("free_form"),
        count_where(source == "bank").alias("bank"),
    )
    shares = {f"{c}_share": ratio(F.col(c), F.col("accepted")) for c in ("non_ai", "repository", "free_form", "bank")}
    return rows.withColumns(shares).withColumn("meets_target", F.col("non_ai_share") >= target)


def edited(before_question: Column, before_answer: Column, before_options: Column, question: Column, answer: Column, options: Column) -> Column:
    """Whether an item was changed before it was accepted; null if there is nothing to compare with."""
    known = (F.coalesce(before_question, F.lit("")) != "") & (F.coalesce(before_answer, F.lit("")) != "") & (F.coalesce(question, F.lit("")) != "")
    same = F.trim(before_question).eqNullSafe(F.trim(question)) & F.trim(before_answer).eqNullSafe(F.trim(answer)) & before_options.eqNullSafe(options)
    return F.when(known, ~same)


def review_actions(events: DataFrame) -> DataFrame:
    """(at, kind, category, issue_codes): an event gives an action for its validation and one for its dismissal."""
    kind = F.when(F.col("validated_edited"), "edited").when(~F.col("validated_edited"), "as_is").otherwise("accepted")
    both = F.array(F.struct(F.col("validated_at").alias("at"), kind.alias("kind")), F.struct(F.col("dismissed_at").alias("at"), F.lit("dismissed").alias("kind")))
    each = events.select("category", "issue_codes", F.explode(F.filter(both, lambda x: x["at"].isNotNull())).alias("x"))
    return each.select("x.at", "x.kind", "category", F.filter("issue_codes", lambda c: c != "").alias("issue_codes"))


def review_filter(actions: DataFrame, category: int | None = None, issue_code: str | None = None) -> DataFrame:
    if category is not None:
        actions = actions.filter(F.col("category") == category)
    return actions if not issue_code else actions.filter(F.array_contains("issue_codes", issue_code))


def review_filter_options(actions: DataFrame) -> DataFrame:
    """(dimension, value, count) of the categories and issue codes that actions have."""
    cats = actions.filter("category IS NOT NULL").groupBy(F.col("category").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count")).select(F.lit("category").alias("dimension"), "value", "count")
    codes = actions.select(F.explode("issue_codes").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("count")).select(F.lit("issue_code").alias("dimension"), "value", "count")
    return cats.unionByName(codes)


def review_filter_keys(actions: DataFrame) -> DataFrame:
    """Distinct (category, code) pairs; a category without codes has the empty one."""
    codes = F.when(F.size("issue_codes") > 0, F.col("issue_codes")).otherwise(F.array(F.lit("")))
    return actions.filter("category IS NOT NULL").select("category", F.explode(codes).alias("code")).distinct()
