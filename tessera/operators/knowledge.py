"""Knowledge records: identity, duplicates, keepers, rejection memory, policy and imports.

A record is (knowledge_id, category_n, topic, fact, answer, source, source_id, source_url, confidence, priority_pt,
age_bands, allowed_formats, clues, is_active, superseded_by, metadata map).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.functions.numbers import count_where
from tessera.functions.text import jaccard, normalize_key, nullif_empty, strip_accents, squeeze, tokens

SIMILAR, CELL = 0.72, 1000  # similar token sets; about how many records with one token set lie together
# How far each source is trusted when one of several duplicates is kept, the tiers of ids, the sources
# that a category allows, the least confidence by category and format, and the words in which reasons are given.
SOURCE_RANK = {"MemóriaMedia": 100, "manual": 80, "Biblioteca Nacional": 74, "Ditos.pt": 70, "Ciência Viva": 70, "RTP Ensina": 68, "Pumpkin.pt": 60, "Arquivo.pt": 58, "Brinca Comigo": 55, "Santander Salto": 50, "Wikidata": 45, "Quero Bolsa": 40, "sample": 10}
OTHER_SOURCE = 30
ID_TIERS = (("-cur-b5[0-9]-", 90), ("-cur-wd-", 62), ("-rtp-", 64), ("-cv-", 66), ("-arq-", 60), ("-bnp-", 68), ("-mm-", 85), ("-web-", 50), ("-adv-daily-", 45), ("-cur-daily-", 35), ("-sample-", 10))
OTHER_TIER = 30
ALLOWED_SOURCES = {20: ("memoriamedia", "memoria media", "giacometti", "ditos", "manual", "sample", "rtp", "ciencia viva", "museu", "unesco", "wikidata", "academia", "bnp", "biblioteca nacional", "folclore", "pumpkin", "santander", "brinca", "quero bolsa", "curadoria", "repositorio")}
LEAST_CONFIDENCE = {(20, "ADIVINHA"): 0.9}
DEFAULT_CONFIDENCE, TRUSTED_CONFIDENCE = 0.85, 0.92
REASONS = {"exact_fact": "mesmo texto", "similar_fact": "texto parecido", "exact_answer": "mesma resposta", "similar_answer": "resposta parecida", "exact_answer_fact": "mesma resposta e mesmo texto", "similar_answer_fact": "mesma resposta e texto parecido", "same_capital": "mesma capital do país"}
RIDDLES, CURIOSITIES = "adivinha tradicional", "curiosidade surpreendente"


def lookup(x: Column, table: dict, other) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), x), F.lit(other))


def entity(source_id: Column, source_url: Column, qid: Column) -> Column:
    """The first entity number Q... of a record's source fields, or the empty string."""
    blob = F.concat_ws(" ", source_id, source_url, qid)
    return F.upper(F.regexp_extract(blob, r"(?i)(?<![a-z0-9_])(Q\d+)(?![a-z0-9_])", 1))


def id_tier(knowledge_id: Column) -> Column:
    out = F.lit(OTHER_TIER)
    for pattern, tier in reversed(ID_TIERS):
        out = F.when(knowledge_id.rlike(pattern), tier).otherwise(out)
    return out


def keeper_score(source: Column, knowledge_id: Column, priority: Column) -> Column:
    return lookup(source, SOURCE_RANK, OTHER_SOURCE) * 1000 + id_tier(knowledge_id) * 10 + F.coalesce(priority, F.lit(0))


def keepers(groups: DataFrame, key: list[str], score: str = "score", id_col: str = "knowledge_id") -> DataFrame:
    """rows with `keeper`: the id of greatest score, then the least one, in each group."""
    return groups.withColumn("keeper", F.first(id_col).over(W.partitionBy(*key).orderBy(F.col(score).desc(), F.col(id_col))))


def exact_groups(records: DataFrame, key: Column, id_col: str = "knowledge_id") -> DataFrame:
    """(key, ids, n) of keys that several records have; empty keys count for nothing."""
    keyed = records.withColumn("key", key).filter("key <> ''")
    return keyed.groupBy("key").agg(F.array_sort(F.collect_list(id_col)).alias("ids"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def _worded(rows: DataFrame, text: Column, block: Column, *columns: str | Column) -> DataFrame:
    """rows with `block` and `key`, the sorted distinct tokens of a normalized text as one string; none without tokens."""
    return rows.select(*columns, block.alias("block"), F.array_join(F.array_sort(tokens(text)), " ").alias("key")).filter("key <> ''")


def similar_sets(keys: DataFrame, threshold: float = SIMILAR, against: DataFrame | None = None) -> DataFrame:
    """(block, x, y, similarity) of distinct (block, key), as `_worded` writes them, that are similar: of keys with x
    before y, or x of keys and y of `against`, which may be equal.

    Two sets reach the threshold only if they share one of their rarest tokens: as many as could be missing, and one.
    Pairs are looked for through those and verified on the sets. The first token that two sets share must leave enough
    words after it on either side, which rules out most pairs before they are made distinct."""
    words = lambda df: df.select("block", "key", F.size(F.split("key", " ")).alias("n"), F.explode(F.split("key", " ")).alias("word"))
    rare = words(keys if against is None else keys.unionByName(against)).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(W.partitionBy("block", "key").orderBy("df", "word"))

    def prefix(side: DataFrame, x: str) -> DataFrame:
        ranked = words(side).join(rare, "word").withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
        return ranked.select("block", F.col("key").alias(x), "word", F.col("n").alias(f"n_{x}"), (F.col("n") - F.col("rank")).alias(f"after_{x}"))

    sized = F.least("n_x", "n_y") >= F.greatest("n_x", "n_y") * threshold
    enough = 1 + F.least("after_x", "after_y") >= (F.col("n_x") + F.col("n_y")) * (threshold / (1 + threshold)) - 1e-9
    once = F.col("x") < F.col("y") if against is None else F.lit(True)
    found = prefix(keys, "x").join(prefix(keys if against is None else against, "y"), ["block", "word"]).filter(sized & enough & once).select("block", "x", "y").distinct()
    return found.withColumn("similarity", jaccard(F.split("x", " "), F.split("y", " "))).filter(F.col("similarity") >= threshold)


def similar_pairs(records: DataFrame, text: str, id_col: str = "knowledge_id", threshold: float = SIMILAR, block: str | None = None) -> DataFrame:
    """(a, b, similarity) with a before b of records whose token sets are similar, within equal blocks if one is given.

    Sets are compared once, however many records have them. The records of a set lie in cells of about `CELL`; pairs of
    cells are dealt out, and each writes the pairs of its records, so that a set of many records is no single task."""
    rows = cut(_worded(records, normalize_key(F.col(text)), F.col(block) if block else F.lit(""), F.col(id_col).alias("id")))
    large = rows.groupBy("block", "key").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("cells")).filter("cells > 1")
    cell = F.coalesce(F.pmod(F.xxhash64("id"), F.col("cells")), F.lit(0))
    cells = cut(rows.join(large, ["block", "key"], "left").groupBy("block", "key", cell.alias("cell")).agg(F.collect_list("id").alias("ids")))
    one, other = (cells.select("block", F.col("key").alias(x), F.col("cell").alias(f"cell_{x}"), F.col("ids").alias(f"ids_{x}")) for x in "xy")
    apart = similar_sets(cells.select("block", "key").distinct(), threshold).join(one, ["block", "x"]).join(other, ["block", "y"])
    alike = one.join(other.withColumn("x", F.col("y")), ["block", "x"]).filter("cell_x <= cell_y").withColumn("similarity", F.lit(1.0))
    both = apart.unionByName(alike).repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "y", "cell_x", "cell_y")
    each = both.select("similarity", ((F.col("x") == F.col("y")) & (F.col("cell_x") == F.col("cell_y"))).alias("own"), "ids_y", F.explode("ids_x").alias("i"))
    each = each.select("similarity", "own", "i", F.explode("ids_y").alias("j")).filter("i < j OR (i > j AND NOT own)")
    return each.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "similarity")


def first_come(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, seed) of a greedy pass in order of id: a record that is not yet taken becomes a seed and takes all later
    records it is paired with.

    So a record is a seed if no earlier neighbour is one, and belongs to its first neighbouring seed otherwise. That is
    settled in rounds over all records at once: whoever has no open or chosen earlier neighbour is chosen, whoever has
    a chosen one is taken. The rounds needed follow the longest chain of neighbours, not the number of records. Records
    without neighbours are seeds at once, and a round keeps only the pairs of records that are open."""
    known = ids.select("id").distinct()
    inside = lambda p, open_: p.join(open_.select(F.col("id").alias("a")), "a", "left_semi").join(open_.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    edges = cut(inside(pairs.select("a", "b").distinct(), known))
    paired = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    waiting, open_ = edges, cut(paired)
    seeds, members = [known.join(open_, "id", "left_anti").select("id", F.col("id").alias("seed"))], []
    while not open_.isEmpty():
        chosen = cut(open_.join(waiting.select(F.col("b").alias("id")), "id", "left_anti"))
        taken = cut(waiting.join(chosen.select(F.col("id").alias("a")), "a", "left_semi").groupBy("b").agg(F.min("a").alias("seed")).select(F.col("b").alias("id"), "seed"))
        seeds.append(chosen.select("id", F.col("id").alias("seed")))
        members.append(taken)
        open_ = cut(open_.join(chosen, "id", "left_anti").join(taken, "id", "left_anti"))
        waiting = cut(inside(waiting, open_))
    out = seeds[0]
    for part in seeds[1:] + members:
        out = out.unionByName(part)
    # a record taken in a later round may have an earlier seed that was chosen before: the least one counts
    everyone = edges.join(out.filter("id = seed").select(F.col("id").alias("a")), "a", "left_semi").groupBy("b").agg(F.min("a").alias("first"))
    return out.join(everyone.select(F.col("b").alias("id"), "first"), "id", "left").select("id", F.when(F.col("id") == F.col("seed"), F.col("seed")).otherwise(F.coalesce("first", "seed")).alias("seed"))


def similar_clusters(records: DataFrame, text: str, id_col: str = "knowledge_id", entity_col: str | None = None, threshold: float = SIMILAR) -> DataFrame:
    """(id, seed) of greedy clusters with several members; records of different known entities are never joined.

    Records with the same tokens and entity are neighbours and have the same neighbours, so only the first of them takes
    part in the pass, and the others share its seed."""
    entity_ = F.coalesce(F.col(entity_col), F.lit("")) if entity_col else F.lit("")
    rows = cut(_worded(records, normalize_key(F.col(text)), F.lit(""), F.col(id_col).alias("id"), entity_.alias("e")))
    first = cut(rows.groupBy("block", "key", "e").agg(F.min("id").alias("id")))
    sets = similar_sets(first.select("block", "key").distinct(), threshold).select("x", "y")
    one, other = (first.select(F.col("key").alias(x), F.col("e").alias(f"e_{x}"), F.col("id").alias(f"id_{x}")) for x in "xy")
    near = sets.join(one, "x").join(other, "y").filter("e_x = '' OR e_y = '' OR e_x = e_y")
    same = one.filter("e_x = ''").join(other.filter("e_y <> ''").withColumn("x", F.col("y")), "x")
    pairs = near.select("id_x", "id_y").unionByName(same.select("id_x", "id_y")).select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))
    seeds = first_come(first.select("id"), pairs)
    found = rows.join(first.withColumnRenamed("id", "_first"), ["block", "key", "e"]).join(seeds.withColumnRenamed("id", "_first"), "_first").select("id", "seed")
    several = found.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed")
    return found.join(several, "seed", "left_semi").select("id", "seed")


def dedupe_plan(records: DataFrame, riddles: bool = False, curiosities: bool = True) -> DataFrame:
    """(knowledge_id, keeper, reason, topic, source) of active records to disable; the first reason counts.

    Curiosities: equal texts, then similar ones among those whose text is unique. Riddles: equal answers."""
    active = records.filter(F.coalesce("is_active", F.lit(True)))
    scored = active.withColumn("score", keeper_score(F.col("source"), F.col("knowledge_id"), F.col("priority_pt")))
    parts = []

    def exact(topic: str, column: str, reason: str) -> None:
        rows = scored.filter(F.col("topic") == topic).withColumn("key", normalize_key(F.col(column))).filter("key <> ''")
        parts.append(keepers(rows, ["key"]).filter("knowledge_id <> keeper").withColumn("reason", F.lit(reason)))

    if curiosities:
        exact(CURIOSITIES, "fact", "exact_fact")
        rows = scored.filter(F.col("topic") == CURIOSITIES).withColumn("key", normalize_key(F.col("fact"))).filter("key <> ''")
        alone = rows.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("key"))).filter("_n = 1").drop("_n").withColumn("_entity", entity(F.col("source_id"), F.col("source_url"), F.try_element_at("metadata", F.lit("qid"))))
        clusters = similar_clusters(alone, "fact", entity_col="_entity").withColumnRenamed("id", "knowledge_id")
        parts.append(keepers(alone.join(clusters, "knowledge_id"), ["seed"]).filter("knowledge_id <> keeper").withColumn("reason", F.lit("similar_fact")))
    if riddles:
        exact(RIDDLES, "answer", "exact_answer")
    columns = ["knowledge_id", "keeper", "reason", "topic", "source"]
    out = None
    for k, part in enumerate(parts):
        row = part.select(*columns, F.lit(k).alias("_step"))
        out = row if out is None else out.unionByName(row)
    first = F.row_number().over(W.partitionBy("knowledge_id").orderBy("_step"))
    return out.withColumn("_at", first).filter("_at = 1").select(*columns)


def disabled_reason(reason: Column, keeper: Column) -> Column:
    why = lookup(reason, REASONS, "duplicado")
    tail = F.when(F.coalesce(keeper, F.lit("")) != "", F.concat(F.lit(" — mantido "), keeper)).otherwise("")
    return F.concat(F.lit("Duplicado ("), why, F.lit(")"), tail)


def is_geography(topic: Column) -> Column:
    t = normalize_key(topic)
    return t.contains("geografia") | t.contains("capital")


def duplicates_of_existing(new: DataFrame, existing: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(knowledge_id, reason, duplicate_of) of new records that repeat an active existing one.

    Rules in order: equal text, same capital of the same country (geography), similar text (curiosities, unless of
    different entities), equal answer with equal or similar text (riddles). Joins are on the normalized text, on
    country and answer, and on shared rare tokens within a topic. Of existing records that a new one meets by the same
    key the first is all that counts, so only that one is joined."""
    wide = lambda df, p: df.select(F.col("knowledge_id").alias(f"{p}id"), F.col("topic").alias(f"{p}topic"), normalize_key(F.col("fact")).alias(f"{p}fact"), normalize_key(F.col("answer")).alias(f"{p}answer"), entity(F.col("source_id"), F.col("source_url"), F.try_element_at("metadata", F.lit("qid"))).alias(f"{p}entity"), is_geography(F.col("topic")).alias(f"{p}geo"))
    n, e = cut(wide(new, "n_")), cut(wide(existing.filter(F.coalesce("is_active", F.lit(True))), "e_"))
    same_topic = (F.col("n_topic") == F.col("e_topic")) | (F.col("n_geo") & F.col("e_geo"))
    texts = e.filter("e_fact <> ''").groupBy("e_fact", "e_topic", "e_geo", "e_id").agg(F.collect_set("e_answer").alias("e_answers"))
    texts = texts.groupBy("e_fact", "e_topic", "e_geo").agg(F.min_by("e_answers", "e_id").alias("e_answers"), F.min("e_id").alias("e_id"))
    exact = n.join(texts, F.col("n_fact") == F.col("e_fact")).filter(same_topic)
    exact = exact.select("n_id", "e_id", F.when((F.col("n_topic") == RIDDLES) & F.array_contains("e_answers", F.col("n_answer")), "exact_answer_fact").otherwise("exact_fact").alias("reason"), F.lit(0).alias("rule"))
    places = e.filter("e_geo AND e_entity <> '' AND e_answer <> ''").groupBy("e_entity", "e_answer").agg(F.min("e_id").alias("e_id"))
    capital = n.filter("n_geo").join(places, (F.col("n_entity") == F.col("e_entity")) & (F.col("n_answer") == F.col("e_answer")))
    capital = capital.select("n_id", "e_id", F.lit("same_capital").alias("reason"), F.lit(1).alias("rule"))
    # what similar records must share besides: riddles the answer; curiosities nothing if either has no entity, else that
    answered = lambda p: F.array(F.concat(F.lit("answer "), f"{p}answer"))
    named = lambda p: F.concat(F.lit("entity "), f"{p}entity")
    wanted = F.when(F.col("n_topic") == RIDDLES, answered("n_")).when(F.col("n_entity") == "", F.array(F.lit("any"))).otherwise(F.array(F.lit("entity "), named("n_")))
    offered = F.when(F.col("e_topic") == RIDDLES, answered("e_")).otherwise(F.array(F.lit("any"), named("e_")))
    asked = _worded(n.filter(F.col("n_topic").isin(RIDDLES, CURIOSITIES)), F.col("n_fact"), F.col("n_topic"), "n_id", F.explode(wanted).alias("shared"))
    told = _worded(e.filter(F.col("e_topic").isin(RIDDLES, CURIOSITIES)), F.col("e_fact"), F.col("e_topic"), "e_id", F.explode(offered).alias("shared"))
    told = cut(told.groupBy("block", "key", "shared").agg(F.min("e_id").alias("e_id")))
    sets = similar_sets(asked.select("block", "key").distinct(), threshold, told.select("block", "key").distinct())
    firsts = sets.join(told.withColumnRenamed("key", "y"), ["block", "y"]).groupBy("block", F.col("x").alias("key"), "shared").agg(F.min("e_id").alias("e_id"))
    near = asked.join(firsts, ["block", "key", "shared"])
    near = near.select("n_id", "e_id", F.when(F.col("block") == RIDDLES, "similar_answer_fact").otherwise("similar_fact").alias("reason"), F.lit(2).alias("rule"))
    hits = exact.unionByName(capital).unionByName(near)
    first = hits.groupBy("n_id").agg(F.min(F.struct("rule", "e_id", "reason")).alias("x"))
    return first.select(F.col("n_id").alias("knowledge_id"), F.col("x.reason").alias("reason"), F.col("x.e_id").alias("duplicate_of"))


def accept_new(new: DataFrame, existing: DataFrame, order: str = "knowledge_id", threshold: float = SIMILAR) -> DataFrame:
    """new with `accepted`: records are taken in order, and each one taken is a peer for those after it.

    Whoever repeats an existing record is out; among the others the greedy pass of `first_come` decides, over pairs
    with equal texts or similar ones in a topic. Records of a topic with equal texts, or curiosities with equal tokens, are
    neighbours and have the same neighbours, so only the first of them can be taken, and the pass is over those."""
    out = duplicates_of_existing(new, existing, threshold).select("knowledge_id")
    at = F.struct(F.col(order), F.col("knowledge_id")).cast("string") if order != "knowledge_id" else F.col("knowledge_id")
    text = normalize_key(F.col("fact"))
    words = F.when(F.col("topic") == CURIOSITIES, F.array_join(F.array_sort(tokens(F.col("text"))), " "))
    left = new.join(out, "knowledge_id", "left_anti").select("knowledge_id", at.alias("_order"), "topic", text.alias("text")).withColumn("key", nullif_empty(words))
    left = cut(left.withColumn("text", F.when(F.col("key").isNull() & F.col("topic").isNotNull(), nullif_empty(F.col("text")))))
    alone = left.filter("key IS NULL AND text IS NULL").select("_order")
    first = cut(left.filter("key IS NOT NULL OR text IS NOT NULL").groupBy("topic", "key", "text").agg(F.min("_order").alias("_order")))
    sets = first.filter("key IS NOT NULL").select("key", F.col("_order"))
    similar = similar_sets(sets.select(F.lit("").alias("block"), "key"), threshold)
    pairs = similar.join(sets.toDF("x", "ox"), "x").join(sets.toDF("y", "oy"), "y").select(F.least("ox", "oy").alias("a"), F.greatest("ox", "oy").alias("b"))
    kept = first_come(first.select(F.col("_order").alias("id")), pairs).filter("id = seed").select(F.col("id").alias("_order")).unionByName(alone)
    taken = left.join(kept, "_order", "left_semi").select("knowledge_id", F.lit(True).alias("accepted")).distinct()
    return new.join(taken, "knowledge_id", "left").fillna(False, ["accepted"])


# --- rejections, policy, imports -------------------------------------------------------------------------------


def property_key(metadata: Column, knowledge_id: Column) -> Column:
    told = F.lower(F.trim(F.try_element_at(metadata, F.lit("factKey"))))
    tail = F.lower(F.regexp_extract(knowledge_id, r"(?i)-([a-z][a-z0-9]+)$", 1))
    return F.coalesce(nullif_empty(told), F.when(knowledge_id.rlike(r"(?i)-capital-q\d+"), "capital"), tail)


def rejection_reasons(records: DataFrame, rejections: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """records with `rejection`: same_id, same_source, same_fact, same_property, similar_fact or null, in that order.

    records and rejections have (knowledge_id, source, source_id, qid, fact_key, fact). Four left joins on keys; the last
    rule is asked only of records that none of the others rejects, once for each entity and token set."""
    fact_hash = normalize_key(F.col("fact"))
    base = records.withColumn("_fact", fact_hash)

    def known(*columns: Column, mark: str) -> DataFrame:
        rows = rejections.select(*columns)
        for c in rows.columns:
            rows = rows.filter(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
        return rows.distinct().withColumn(mark, F.lit(True))

    out = base.join(known(F.col("knowledge_id"), mark="_id"), "knowledge_id", "left")
    out = out.join(known(F.col("source"), F.col("source_id"), mark="_source"), ["source", "source_id"], "left")
    out = out.join(known(fact_hash.alias("_fact"), mark="_same"), "_fact", "left")
    out = out.join(known(F.col("qid"), F.col("fact_key"), mark="_property"), ["qid", "fact_key"], "left")
    reason = F.when(F.col("_id"), "same_id").when(F.col("_source"), "same_source").when(F.col("_same"), "same_fact").when(F.col("_property"), "same_property")
    out = cut(out.select(*records.columns, reason.alias("_found"), "_fact"))
    asked = _worded(out.filter("_found IS NULL AND qid <> ''"), F.col("_fact"), F.col("qid")).distinct()
    told = _worded(rejections.filter("qid <> ''"), fact_hash, F.col("qid")).distinct()
    near = similar_sets(asked, threshold, told).select(F.col("block").alias("qid"), F.col("x").alias("_key")).distinct().withColumn("_near", F.lit(True))
    key = F.when(F.col("_found").isNull() & (F.col("qid") != ""), nullif_empty(F.array_join(F.array_sort(tokens(F.col("_fact"))), " ")))
    joined = out.withColumn("_key", key).join(near, ["qid", "_key"], "left")
    return joined.withColumn("rejection", F.coalesce("_found", F.when(F.col("_near"), "similar_fact"))).select(*records.columns, "rejection")


def least_confidence(category: Column, format_: Column) -> Column:
    out = F.lit(DEFAULT_CONFIDENCE)
    for (c, f), v in LEAST_CONFIDENCE.items():
        out = F.when((category == c) & (F.upper(F.trim(format_)) == f), v).otherwise(out)
    return out


def policy(category: Column, format_: Column, source: Column, confidence: Column, is_active: Column, superseded_by: Column) -> Column:
    """Why a record may not be used: blocked_or_superseded, confidence_below_minimum, source_not_allowed, or null."""
    key = squeeze(strip_accents(F.lower(F.coalesce(source, F.lit("")))))
    allowed = F.lit(False)
    for c, names in ALLOWED_SOURCES.items():
        listed = F.lit(False)
        for name in names:
            listed = listed | key.contains(name)
        allowed = allowed | ((category == c) & listed)
    sure = F.coalesce(confidence, F.lit(0.0))
    blocked = ~F.coalesce(is_active, F.lit(True)) | (F.trim(F.coalesce(superseded_by, F.lit(""))) != "")
    return F.when(blocked, "blocked_or_superseded").when(sure < least_confidence(category, format_), "confidence_below_minimum").when((key == "") | ~(allowed | (sure >= TRUSTED_CONFIDENCE)), "source_not_allowed")


def missing_fields(category: Column, id_: Column, topic: Column, fact: Column, answer: Column, source: Column, source_id: Column, ages: Column, formats: Column, clues: Column) -> Column:
    """Names of fields that a record to import lacks or has out of range."""
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    none = lambda x: F.coalesce(F.size(x), F.lit(-1)) <= 0
    tests = [("knowledge_id", blank(id_)), ("category_n", ~F.coalesce(category.between(1, 20), F.lit(False))), ("topic", blank(topic)), ("fact", blank(fact)), ("answer", blank(answer)), ("source", blank(source)), ("source_id", blank(source_id)), ("age_bands", none(ages)), ("allowed_formats", none(formats)), ("clues", F.coalesce(F.array_contains(formats, "ADIVINHA"), F.lit(False)) & (F.coalesce(F.size(clues), F.lit(0)) < 2))]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))


def import_batch(items: DataFrame, records: DataFrame, order: str = "position") -> DataFrame:
    """items with `outcome`: updated or inserted by id (the last of a batch counts, earlier ones are superseded), or
    skipped where another record has the same source and source id."""
    last = F.row_number().over(W.partitionBy("knowledge_id").orderBy(F.col(order).desc()))
    taken = records.select("source", "source_id", F.col("knowledge_id").alias("_owner")).dropDuplicates(["source", "source_id"])
    known = records.select("knowledge_id").distinct().withColumn("_known", F.lit(True))
    rows = items.withColumn("_last", last).join(taken, ["source", "source_id"], "left").join(known, "knowledge_id", "left")
    outcome = F.when(F.col("_last") > 1, "superseded").when(F.col("_owner").isNotNull() & (F.col("_owner") != F.col("knowledge_id")), "skipped").when(F.col("_known"), "updated").otherwise("inserted")
    return rows.withColumn("outcome", outcome).select(*items.columns, "outcome")


def queue_summary(queue: DataFrame) -> DataFrame:
    n = lambda s: count_where(F.col("status") == s).alias(s)
    return queue.agg(F.count(F.lit(1)).alias("total"), n("pending"), n("imported"), n("rejected"))


def spread_by_kind(records: DataFrame, kind: str, order: str, most: int) -> DataFrame:
    """Up to `most` records, in turn from each kind.

    A kind gives `most` records at most, which is said right above their ranking, so that each task keeps no more of a
    kind before anything is shuffled."""
    turn = F.row_number().over(W.partitionBy(kind).orderBy(order))
    head = records.withColumn("_turn", turn).filter(F.col("_turn") <= most)
    return head.withColumn("_first", F.min(order).over(W.partitionBy(kind))).orderBy("_turn", "_first", order).limit(most).drop("_turn", "_first")


def pick_for_today(items: DataFrame, bands: tuple[str, ...] = ("6-9", "10-15", "15+"), order: str = "position") -> DataFrame:
    """One pending item for each age band in turn, none twice; a loop over the three bands."""
    left, out = items.filter("status = 'pending'"), None
    for band in bands:
        one = cut(left.filter(F.array_contains("age_bands", band)).orderBy(order).limit(1).withColumn("for_band", F.lit(band)))
        out = one if out is None else out.unionByName(one)
        left = left.join(one.select("queue_id"), "queue_id", "left_anti")
    return out
