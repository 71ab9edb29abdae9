"""Knowledge keys: structured ones (domain|entity|concept|relation) and free ones, and when two of them match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import NOT_PLAIN, jaccard, normalize, strip_accents, strip_tags, tokens


def structured_key(domain: Column, entity: Column, concept: Column, relation: Column) -> Column:
    """The key, or null without entity or concept."""
    parts = [normalize(x) for x in (entity, concept, relation)]
    return F.when((parts[0] != "") & (parts[1] != ""), F.concat_ws("|", F.coalesce(domain, F.lit("geral")), *parts))


def parts_of(key: Column) -> Column:
    """The non-empty parts of a structured key, or null if there are fewer than three."""
    split = F.split(F.coalesce(key, F.lit("")), r"\|")
    told = F.when(~key.rlike(NOT_PLAIN), F.transform(split, lambda p: F.trim(F.lower(p)))).otherwise(F.transform(split, normalize))
    found = F.filter(told, lambda p: p != "")
    return F.when(F.size(found) >= 3, found)


def _free_match(a: Column, b: Column, threshold: float) -> Column:
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long_ = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    similar = jaccard(tokens(a), tokens(b)) >= threshold
    one_word = ~short.contains(" ") & (F.length(short) >= 4)
    return (a != "") & (b != "") & ((a == b) | (F.contains(long_, short) & ~one_word) | similar)


def _free_in_structured(free: Column, parts: Column) -> Column:
    entity, concept = F.element_at(parts, 2), F.element_at(parts, 3)
    return (free != "") & ((free == entity) | (free == F.concat_ws(" ", concept, entity)) | (F.contains(free, entity) & F.contains(free, concept)))


def keys_match(a: Column, b: Column, threshold: float = 0.42) -> Column:
    """Structured keys match by entity and concept, a free one matches a structured one that it names, and free ones
    match if they are equal, contain each other (a single word does not count) or share enough words."""
    return forms_match(parts_of(a), normalize(a), parts_of(b), normalize(b), threshold)


def forms_match(pa: Column, na: Column, pb: Column, nb: Column, threshold: float = 0.42) -> Column:
    """As `keys_match`, of keys whose parts and normalized texts are at hand."""
    both = (F.element_at(pa, 2) == F.element_at(pb, 2)) & (F.element_at(pa, 3) == F.element_at(pb, 3))
    return F.when(pa.isNotNull() & pb.isNotNull(), both).when(pa.isNotNull(), _free_in_structured(nb, pa)).when(pb.isNotNull(), _free_in_structured(na, pb)).otherwise(_free_match(na, nb, threshold))


#: Words that say nothing of what a question is about, and the labels that questions begin with.
STOPWORDS = (
    *("qual", "quais", "que", "quem", "como", "onde", "quando", "porque", "porquê", "o", "a", "os", "as", "um", "uma", "uns", "umas", "de", "do", "da", "dos", "das"),
    *("em", "no", "na", "nos", "nas", "por", "para", "com", "sem", "sobre", "entre", "ser", "são", "foi", "foram", "está", "estão", "mais", "menos", "muito", "nome"),
    *("chama", "significa", "país", "pais", "cidade", "planeta", "verdadeiro", "falso", "tipo"),
)
LABEL = r"(?iu)^(curiosidade|adivinha|completa|quem é|o que é):\s*"


def without_label(x: Column) -> Column:
    """A question without the label of its format in front."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), LABEL, ""))


def for_repetition(question: Column, format_: Column) -> Column:
    """The part of a question in which repetitions are looked for."""
    body = without_label(F.trim(strip_tags(F.coalesce(question, F.lit("")))))
    whole = F.when(format_ == "VERDADEIRO_FALSO", without_true_false(body)).otherwise(body)
    bare = ~question.rlike("[^A-Za-z0-9 ]") & ~F.contains(F.lower(question), F.lit("falso"))  # no tag, label or closing question
    return F.when(bare, F.trim(question)).otherwise(whole)


def riddle_line(x: Column) -> Column:
    """A line of folklore without the collector's remarks."""
    for pattern in (r"(?iu)\s*\(Nota:\s*o informante não disse a solução\.?\)\s*", r"(?iu)^adivinha oral\s*", r"(?iu)\s*[-–—]?\s*Tamb[eé]m n[aã]o sei.*$", r"(?iu)\s*O que [eé]\?\s*$"):
        x = F.regexp_replace(x, pattern, "")
    return F.trim(x)


def _telling(x: Column) -> Column:
    plain = F.regexp_replace(strip_accents(F.lower(x)), r"[^a-z0-9\s-]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def knowledge_key(question: Column, answer: Column) -> Column:
    """What an item asks for, as a free key: a statement for true-or-false items, the answer if it is short, with a hint
    of the question where the answer alone is not enough, else the telling words of both."""
    a, q = F.trim(strip_tags(F.coalesce(answer, F.lit("")))), without_label(F.trim(strip_tags(F.coalesce(question, F.lit("")))))
    key, told, asked = normalize(a), _telling(a), _telling(q)
    short = F.size(told) <= 3
    both = F.slice(F.array_distinct(F.concat(told, F.slice(asked, 1, 3))), 1, 5)
    place = F.trim(F.concat_ws(" ", F.coalesce(F.try_element_at(told, F.lit(1)), key), F.array_join(F.slice(asked, 1, 2), " ")))
    core = F.array_join(both, " ")
    return (
        F.when(key.isin("verdadeiro", "falso"), F.substring(normalize(without_true_false(q)), 1, 80))
        .when(short & q.rlike(r"(?iu)\bcapital\b"), F.concat(F.lit("capital "), key))
        .when(short & q.rlike(r"(?iu)\b(planeta|rio|montanha|oceano|país|pais)\b"), place)
        .when((F.size(told) <= 2) & (F.length(key) >= 3), key)
        .when(core != "", core)
        .when(key != "", key)
        .otherwise(F.substring(normalize(q), 1, 60))
    )


def without_true_false(x: Column) -> Column:
    """A statement without the closing question whether it is true or false."""
    return F.trim(F.regexp_replace(x, r"(?i)\s*\.?\s*verdadeiro\s+ou\s+falso\s*\??\s*$", ""))


def game_question_id(x: Column) -> Column:
    """(category, age_band, hash) of an id like rmq-3-10-15-1abc; null if it is none or the category is out of range."""
    pattern = r"^rmq-(\d{1,2})-(6-9|10-15|15\+)-([a-z0-9]+)$"
    part = lambda k: F.regexp_extract(F.trim(x), pattern, k)
    category = part(1).try_cast("int")
    return F.when(category.between(1, 20), F.struct(category.alias("category"), part(2).alias("age_band"), part(3).alias("hash")))


def bank_search_keys(query: Column, hash_: Column) -> Column:
    """(query, hash, category, age_band) to search the bank by: an id of the game in place of the query, or of the hash
    where there is no query, says all but the query."""
    q, h = F.trim(F.coalesce(query, F.lit(""))), F.trim(F.coalesce(hash_, F.lit("")))
    told, other = game_question_id(q), game_question_id(h)
    by = lambda x, left: F.struct(left.alias("query"), x["hash"].alias("hash"), x["category"].alias("category"), x["age_band"].alias("age_band"))
    plain = F.struct(q.alias("query"), h.alias("hash"), F.lit(None).cast("int").alias("category"), F.lit("").alias("age_band"))
    return F.when(told.isNotNull(), by(told, F.lit(""))).when((q == "") & other.isNotNull(), by(other, q)).otherwise(plain)
