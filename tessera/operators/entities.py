"""What entities of a knowledge base say of records that name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import places
from tessera.functions.lineage import cut
from tessera.functions.text import nullif_empty, strip_accents

#: An entity is hot with more than this many of a thousand answers, so there are at most as many hot ones; the answers of
#: a hot one go to this many slots, in each of which its texts stand.
HOT_SHARE, SLOTS = 1, 64
# How long a word has to be to count, and how many of an answer's words confirm it.
WORD, ENOUGH = 4, 2


def plain(x: Column) -> Column:
    """Lower case without accents, all but a-z and digits to single spaces; null is the empty string."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(F.coalesce(x, F.lit("")))), "[^a-z0-9]+", " "))


def named(*fields: Column) -> Column:
    """The first entity number that one of the fields names, or null."""
    return F.coalesce(*[nullif_empty(F.upper(F.regexp_extract(F.coalesce(f, F.lit("")), r"(?i)(?<![A-Za-z0-9_])(Q\d+)(?![A-Za-z0-9_])", 1))) for f in fields])


def texts(documents: DataFrame) -> DataFrame:
    """(qid, texts, broken) of entity documents (id, labels, descriptions, aliases), each a JSON object by language whose
    values are texts, objects with a value, or lists of either. What is null or no object holds no text, and one that does
    not parse is named in `broken`; rows of one id are parts of one entity; rows without an id go."""
    kind = lambda v: F.schema_of_variant(v)
    read = lambda v: F.when(kind(v) == "STRING", F.variant_get(v, "$", "string")).when(kind(v).startswith("OBJECT"), F.try_variant_get(v, "$.value", "string"))
    listed = lambda v: F.when(kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    none = F.array().cast("array<string>")
    held, broken = [], []
    for c in ("labels", "descriptions", "aliases"):
        parsed = F.try_parse_json(F.col(c))
        bag = F.try_variant_get(parsed, "$", "map<string,variant>")
        held.append(F.coalesce(F.flatten(F.transform(F.map_values(bag), lambda v: F.transform(listed(v), read))), none))
        broken.append(F.when(F.col(c).isNotNull() & parsed.isNull(), c))
    each = documents.filter("id IS NOT NULL").select(F.upper(F.trim("id")).alias("qid"), F.filter(F.concat(*held), lambda t: F.trim(t) != "").alias("t"), F.array_compact(F.array(*broken)).alias("b"))
    return each.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("texts"), F.array_distinct(F.flatten(F.collect_list("b"))).alias("broken"))


def _verdict(answer: Column, held: Column) -> Column:
    """Whether a text is or holds the answer, or is held by it, or enough of its words stand in the texts (words that the
    answer repeats count as often)."""
    words = F.filter(F.split(answer, " "), lambda w: F.length(w) >= WORD)
    there = F.filter(words, lambda w: F.exists(held, lambda t: t.contains(w)))
    return F.exists(held, lambda t: t.contains(answer) | answer.contains(t)) | ((F.size(words) > 0) & (F.size(there) >= F.least(F.lit(ENOUGH), F.size(words))))


def supported(records: DataFrame, entities: DataFrame) -> DataFrame:
    """records (answer, source, source_id, source_url, format) with `qid` and `outcome`: matched or contradiction, or why
    nothing was checked: not_applicable (another source, or a riddle), true_false, no_qid, no_entity, no_answer,
    empty_entity. Earlier columns of these names are replaced; nulls are empty; repeated rows stay; of entities, rows
    (qid, texts), one each.

    Answers are judged once for each entity and plain form, however many records give them. The answers of hot entities are
    dealt to slots, to each of which their texts go, so no entity has all of its answers in one task; an entity's own texts
    are one document of the source. Nothing is paired with single texts, and no text is shuffled for an answer."""
    fields = [F.col(c) for c in ("source_id", "source_url", "source")]
    qid, answer = named(*fields), plain(places.canonical(F.col("answer")))
    applies = (qid.isNotNull() | F.lower(F.concat_ws(" ", *fields)).contains("wikidata")) & (F.upper(F.trim(F.coalesce("format", F.lit("")))) != "ADIVINHA")
    given = records.drop("qid", "outcome")
    rows = given.select(F.struct(*[given[f"`{c}`"] for c in given.columns]).alias("row"), qid.alias("qid"), answer.alias("plain"), applies.alias("applies"))
    outcome = F.when(~F.col("applies"), "not_applicable").when(F.col("plain").isin("verdadeiro", "falso"), "true_false").when(F.col("qid").isNull(), "no_qid")

    asked = cut(rows.filter(outcome.isNull()).groupBy("qid", "plain").agg(F.count(F.lit(1)).alias("n")))
    total = asked.count()
    hot = F.broadcast(asked.groupBy("qid").count().filter(F.col("count") * 1000 > total * HOT_SHARE).select("qid", F.lit(True).alias("hot")))
    slot = F.when(F.col("hot"), F.pmod(F.xxhash64("plain"), F.lit(SLOTS))).otherwise(F.lit(0).cast("long"))
    dealt = asked.select("qid", "plain").join(hot, "qid", "left").select("qid", "plain", slot.alias("slot"))
    forms = F.array_distinct(F.filter(F.transform("texts", lambda t: plain(places.canonical(t))), lambda t: t != ""))
    slots = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    known = entities.select(F.col("qid"), forms.alias("forms")).join(hot, "qid", "left").select("qid", "forms", slots.alias("slot"))
    met = dealt.join(known, ["qid", "slot"], "left")
    judged = F.when(F.col("forms").isNull(), "no_entity").when(F.col("plain") == "", "no_answer").when(F.size("forms") == 0, "empty_entity").when(_verdict(F.col("plain"), F.col("forms")), "matched").otherwise("contradiction")
    verdicts = met.select(F.col("qid").alias("v_qid"), F.col("plain").alias("v_plain"), judged.alias("verdict"))
    # rows back to their verdicts by entity and answer; a frequent pair is a hot key, which the verdicts' copies spread
    copies, copy = 16, F.pmod(F.monotonically_increasing_id(), F.lit(16))
    often = F.broadcast(asked.filter(F.col("n") * 1000 > F.greatest(F.lit(asked.agg(F.sum("n")).first()[0] or 0), F.lit(1)) * HOT_SHARE).select(F.col("qid").alias("o_qid"), F.col("plain").alias("o_plain"), F.lit(True).alias("often")))
    spread = rows.join(often, (F.col("qid") == F.col("o_qid")) & (F.col("plain") == F.col("o_plain")), "left").withColumn("copy", F.when(F.col("often"), copy).otherwise(F.lit(0).cast("long")))
    many = F.explode(F.when(F.col("often"), F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    told = verdicts.join(often, (F.col("v_qid") == F.col("o_qid")) & (F.col("v_plain") == F.col("o_plain")), "left").select("v_qid", "v_plain", "verdict", many.alias("v_copy"))
    done = spread.join(told, (F.col("qid") == F.col("v_qid")) & (F.col("plain") == F.col("v_plain")) & (F.col("copy") == F.col("v_copy")), "left")
    return done.select("row.*", "qid", F.coalesce(outcome, F.col("verdict")).alias("outcome"))
