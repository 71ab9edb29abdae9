"""Queries over texts: content safety by joins, rewriting, and what entities say of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import portuguese
from tessera.operators import entities, safety
from tessera.plans import adapters as a
from tessera.plans.registry import query

#: Stands for the educational context in the queries, as the driver's texts hold none.
TAUGHT = "(tionth|ementa)"


def benchmark_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark, and its pairs of neighbours, as rules; what they ask for goes by their length."""
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda w: w != "")
    held = a.table(spark, sf_dir, "benchmark").select(words.alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda k: F.concat_ws(" ", F.try_element_at("w", k), F.try_element_at("w", k + 1)))
    each = held.select(F.explode("w").alias("term"), F.lit("word").alias("kind")).unionByName(held.filter(F.size("w") > 1).select(F.explode(pairs).alias("term"), F.lit("phrase").alias("kind")))
    n = F.length("term") % 4
    return each.distinct().select("kind", "term", F.when(n == 0, "block").when(n == 1, "allow_context").otherwise("rewrite").alias("severity"), F.when(n > 1, F.reverse("term")).alias("replacement"))


BETWEEN = r"\s.\-_@*0-9"
SAFETY = rf"""
WITH b AS (SELECT list_filter(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM benchmark),
r AS (
  SELECT DISTINCT kind, term, replace(term, ' ', '') AS compact, ['block', 'allow_context', 'rewrite', 'rewrite'][length(term) % 4 + 1] AS severity FROM (
    SELECT 'word' AS kind, unnest(w) AS term FROM b UNION ALL SELECT 'phrase', unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM b)
), d AS (
  SELECT doc_id, trim(regexp_replace(translate(strip_accents(lower(coalesce(text, ''))), '@401!35$7', 'aaoiiesst'), '[^a-z0-9]+', ' ', 'g')) AS spaced, coalesce(regexp_matches(lower(text), '{TAUGHT}'), FALSE) AS taught,
    -- where words begin and end, and nothing of what may stand between letters
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower(coalesce(text, '')), '<>', '||'), '([a-z]+)', '<\1>', 'g'), '([0-9à-ÿ])<', '\1', 'g'), '>([0-9à-ÿ])', '\1', 'g'), '[{BETWEEN}]+', '', 'g') AS marked FROM documents
), k AS (SELECT doc_id, spaced, replace(spaced, ' ', '') AS compact, taught, list_distinct(string_split(spaced, ' ')) AS words, marked, translate(marked, '<>', '') AS bare,
  list_transform(regexp_extract_all(regexp_replace(spaced, '[a-z0-9]{{2,}}', '-', 'g'), '[a-z0-9]( [a-z0-9])+'), lambda s: replace(s, ' ', '')) AS singles FROM d
), plain AS (SELECT DISTINCT doc_id, unnest(list_concat(words, singles)) AS w FROM k),
found AS (
  SELECT doc_id, kind, term, severity FROM k JOIN r ON kind = 'phrase' AND ((length(r.compact) >= 5 AND contains(k.compact, r.compact)) OR contains(k.spaced, r.term))
  UNION SELECT doc_id, kind, term, severity FROM plain JOIN r ON kind = 'word' AND r.term = plain.w
  UNION SELECT doc_id, kind, term, severity FROM k JOIN r ON kind = 'word' AND length(k.compact) <= 3 AND k.compact = r.term
  UNION SELECT doc_id, kind, term, severity FROM k JOIN r ON kind = 'word' AND NOT list_contains(words, r.term) AND contains(k.bare, r.term)
    AND regexp_matches(k.marked, '<' || list_aggregate(string_split(r.term, ''), 'string_agg', '[<>]*') || '>')
)
"""


@query(SAFETY + """
SELECT doc_id, count(*) AS found, count(*) FILTER (kind = 'phrase') AS phrases, count(*) FILTER (severity = 'block') AS blocks, sum(length(term))::BIGINT AS letters,
  count(*) FILTER (severity <> 'allow_context' OR NOT taught) AS actionable FROM found JOIN k USING (doc_id) GROUP BY doc_id
""")
def unsafe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents hold of the benchmark's words and pairs of words, were they unsafe."""
    documents = a.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = safety.matches(documents, benchmark_rules(spark, sf_dir), "doc_id", "text")
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    held = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"), count(F.col("kind") == "phrase", "phrases"), count(F.col("severity") == "block", "blocks"), F.sum(F.length("term")).alias("letters"), count(F.col("severity") == "allow_context", "excused"))
    # as `safety.actionable` tells, by counts: what was found of a text is many times its row
    taught = safety.taught(documents, "doc_id", "text", TAUGHT).withColumn("taught", F.lit(True))
    return held.join(taught, "doc_id", "left").select("doc_id", "found", "phrases", "blocks", "letters", (F.col("found") - F.when(F.col("taught"), F.col("excused")).otherwise(0)).alias("actionable"))


#: (kind, term, severity, replacement) of what the parts' names are held against.
NAME_RULES = [("word", "widget", "rewrite", "engenho"), ("word", "bolt", "block", None), ("phrase", "red ring", "rewrite", "anel"), ("word", "small", "allow_context", None), ("word", "gear", "reformulate", None)]


@query("""
WITH t AS (SELECT p_partkey, p_name AS n, [upper(p_name), p_name, upper(left(p_name, 1)) || substr(p_name, 2)][p_partkey % 3 + 1] || CASE WHEN p_partkey % 5 = 0 THEN ', etimologia' ELSE '' END AS x FROM part)
SELECT p_partkey, CASE WHEN action = 'blocked' THEN x ELSE replace(replace(replace(replace(replace(x, 'RED RING', 'ANEL'), 'Red ring', 'Anel'), 'red ring', 'anel'), 'WIDGET', 'ENGENHO'), 'widget', 'engenho') END AS name, action
FROM (SELECT *, CASE WHEN n LIKE '% bolt' OR n LIKE 'bolt %' THEN 'blocked' WHEN n LIKE 'small %' OR n LIKE '% gear' THEN 'reformulate' WHEN n LIKE '% widget' OR n = 'red ring' THEN 'rewrite' ELSE 'ok' END AS action FROM t)
""")
def sanitized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' names in capitals, as they are or with one capital, sanitized."""
    k, n = F.col("p_partkey"), F.col("p_name")
    capital = F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, 2, 1000))
    told = F.concat(F.when(k % 3 == 0, F.upper(n)).when(k % 3 == 1, n).otherwise(capital), F.when(k % 5 == 0, ", etimologia").otherwise(""))
    rules = spark.createDataFrame(NAME_RULES, "kind string, term string, severity string, replacement string")
    return safety.sanitized(a.table(spark, sf_dir, "part").select("p_partkey", told.alias("name")), rules, "p_partkey", "name")


@query("""
SELECT p_partkey, ['Já vi ', 'NÃO há ', 'De Moscovo a ', 'a criança e '][p_partkey % 4 + 1] || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' em Nova Iorque' ELSE '' END AS fact,
  CASE WHEN p_partkey % 2 = 0 THEN ['Irão', 'pão'] ELSE [] END AS clues FROM part
""")
def portuguese_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    fact = F.concat(a._pick(("Ja  vi ", "NAO há ", " De Moscou a ", "a crianca e "), k % 4), F.col("p_name"), F.when(k % 3 == 0, " em  New York ").otherwise(""))
    clues = F.when(k % 2 == 0, F.array(F.lit("Iran "), F.lit(" "), F.lit("pao")))
    return portuguese.normalized_record(a.table(spark, sf_dir, "part").select("p_partkey", fact.alias("fact"), clues.alias("clues")))


def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by their number's last digits as entities of JSON, which name parts, brands and types in every way that labels
    come; every ninth is empty, one is no JSON."""
    p, n = a.table(spark, sf_dir, "part"), F.col("p_partkey") % 97
    told = p.groupBy(n.alias("n")).agg(F.array_sort(F.collect_set("p_name")).alias("names"), F.min("p_brand").alias("brand"), F.min("p_type").alias("type"))
    bag = lambda **langs: F.to_json(F.struct(*[c.alias(k) for k, c in langs.items()]))
    value = lambda c: F.struct(c.alias("value"))
    labels = F.when(F.col("n") % 9 > 0, bag(pt=F.element_at("names", 1), en=value(F.concat(F.lit("The "), F.element_at("names", 1)))))
    aliases = F.when(F.col("n") == 5, "{broken").when(F.col("n") % 9 > 0, bag(pt=F.slice("names", 2, 3), en=F.array(value(F.concat_ws(" ", "type", F.lit("grande"))))))
    return told.select(F.concat(F.lit("Q"), F.col("n").cast("string")).alias("id"), labels.alias("labels"), F.when(F.col("n") % 9 > 0, bag(en=F.lower("brand"))).alias("descriptions"), aliases.alias("aliases"))


@query("""
WITH named AS (SELECT DISTINCT p_partkey % 97 AS n, p_name FROM part), listed AS (SELECT n, list(p_name ORDER BY p_name) AS names FROM named GROUP BY n),
e AS (SELECT p_partkey % 97 AS n, min(p_brand) AS brand, min(p_type) AS type FROM part GROUP BY 1),
plain AS (
  SELECT n, list_transform(list_concat([names[1], 'the ' || names[1], lower(replace(brand, '#', ' '))], CASE WHEN n = 5 THEN [] ELSE list_concat(names[2:4], [lower(type) || ' grande']) END), lambda t: lower(t)) AS texts
  FROM listed JOIN e USING (n) WHERE n % 9 > 0
), r AS (
  SELECT p_partkey AS k, p_partkey % 101 AS n, p_partkey % 8 AS kind, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN 'o grande ' || p_name WHEN 2 THEN 'verdadeiro' WHEN 3 THEN lower(p_type) || ' nada' WHEN 4 THEN '' ELSE lower(replace(p_brand, '#', ' ')) END AS answer FROM part
), t AS (SELECT *, list_filter(string_split(answer, ' '), lambda w: length(w) >= 4) AS tokens FROM r LEFT JOIN plain USING (n)),
j AS (SELECT *, list_bool_or(list_transform(texts, lambda x: contains(x, answer) OR contains(answer, x))) OR (len(tokens) > 0 AND len(list_filter(tokens, lambda w: list_bool_or(list_transform(texts, lambda x: contains(x, w))))) >= least(2, len(tokens))) AS held FROM t)
SELECT k AS p_partkey, CASE WHEN kind IN (0, 1) THEN 'not_applicable' WHEN answer = 'verdadeiro' THEN 'true_false' WHEN kind = 2 THEN 'no_qid' WHEN n >= 97 THEN 'no_entity' WHEN answer = '' THEN 'no_answer' WHEN texts IS NULL THEN 'empty_entity'
  WHEN held THEN 'matched' ELSE 'contradiction' END AS outcome FROM j
""")
def supported_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether entities confirm the parts' answers; some parts are riddles, of another source or name no entity."""
    k, name = F.col("p_partkey"), F.col("p_name")
    kind, q = k % 8, F.concat(F.lit("Q"), (k % 101).cast("string"))
    brand = F.replace("p_brand", F.lit("#"), F.lit(" "))
    answer = F.when(k % 6 == 0, F.upper(name)).when(k % 6 == 1, F.concat(F.lit("Ó grande, "), name)).when(k % 6 == 2, "VERDADEIRO").when(k % 6 == 3, F.concat("p_type", F.lit(" nada"))).when(k % 6 == 4, "?").otherwise(brand)
    rows = a.table(spark, sf_dir, "part").select(
        "p_partkey",
        answer.alias("answer"),
        F.when(kind == 0, "manual").otherwise("Wikidata").alias("source"),
        F.when(~kind.isin(0, 2, 3), F.lower(q)).alias("source_id"),
        F.when(kind == 3, F.concat(F.lit("https://www.wikidata.org/wiki/"), q)).alias("source_url"),
        F.when(kind == 1, "adivinha").otherwise("RESPOSTA_DIRETA").alias("format"),
    )
    return entities.supported(rows, entities.texts(entity_documents(spark, sf_dir))).select("p_partkey", "outcome")
