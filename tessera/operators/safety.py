"""Content safety with its rules as a table: stretches of texts that hash like a term meet the terms by a join, so the plan
does not grow with the rules and a text is never held against each of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, StringType, StructField, StructType

from tessera.functions import rewrite, substrings
from tessera.functions.lineage import cut
from tessera.functions.text import strip_accents

#: Rules are broadcast while their terms have fewer characters than this, each rule counted as 64 more; beyond it the keys
#: are shuffled.
BROADCAST = 16_000_000
#: Phrases of fewer letters than the first seed need their spaces; others are looked for by as many of their first letters
#: as the seeds have, one after the other.
SEEDS = (5, 10)
#: Which hashes terms have is told by a table of at most two to this power places; more terms only leave more to the join.
MOST_BITS = 24

# Look-alikes and their letters; what may stand between the letters of a word; from where on short words
# count inside a text; what makes a text an educational one.
LOOKALIKES = ("@401!35$7", "aaoiiesst")
BETWEEN, LETTER = r"\s.\-_@*0-9", "a-z0-9à-ÿ"
SHORT = substrings.SHORT
EDUCATIONAL = (
    r"(?<![A-Za-z0-9_])(hist[oó]ri|histor|cient[ií]fi|ciencia|significa|etimolog|origem (?:da palavra|do termo)|na idade|no s[eé]culo|seculo|antigamente|termo m[eé]dico|anatomia|educativ|lingu[ií]st|"
    r"era chamad|chamava-se|designava|defini[cç][aã]o|voc[aá]bulo|sentido (?:da palavra|do termo)|em portugu[eê]s antigo)(?![A-Za-z0-9_])"
)


def unmasked(x: Column) -> Column:
    """Look-alikes to letters, accents off, all but a-z and digits to single spaces."""
    plain = F.translate(strip_accents(F.lower(F.coalesce(x, F.lit("")))), *LOOKALIKES)
    return F.trim(F.regexp_replace(plain, r"[^a-z0-9]+", " "))


def _term(x: Column) -> Column:
    return F.regexp_replace(strip_accents(F.lower(F.coalesce(x, F.lit("")))), r"[^a-z0-9\s]", " ")


def prepared(rules: DataFrame) -> DataFrame:
    """rules (kind word or phrase, term, severity, replacement) with the forms that are compared; those without a letter
    or digit, and of another kind, are left out. Of rules of one kind and term the first by severity stays."""
    spaced = F.trim(F.regexp_replace(_term(F.col("term")), r"\s+", " "))
    # of accents and marks in short words only those forms count that have none
    bare = F.lower("term") == F.replace(spaced, F.lit(" "), F.lit(""))
    formed = rules.filter(F.col("kind").isin("word", "phrase")).select("kind", "term", "severity", "replacement", spaced.alias("spaced"), F.replace(spaced, F.lit(" "), F.lit("")).alias("compact"), bare.alias("bare")).filter("compact <> ''")
    return formed.groupBy("kind", "term").agg(F.min_by(F.struct("severity", "replacement", "spaced", "compact", "bare"), F.struct("severity", "replacement")).alias("r")).select("kind", "term", "r.*")


def _forms(ready: DataFrame) -> DataFrame:
    """(how, key, rule): what a stretch of a text has to be, by how it came about, to break a rule."""
    word, phrase = F.col("kind") == "word", F.col("kind") == "phrase"
    form = lambda how, when, key: F.when(when, F.struct(F.lit(how).cast("tinyint").alias("how"), F.col(key).alias("key")))
    forms = F.array(
        form(substrings.STRICT, word & ((F.length("compact") > SHORT) | F.col("bare")), "compact"),
        form(substrings.LOOSE, word & (F.length("compact") <= SHORT), "compact"),
        form(substrings.INSIDE, phrase & (F.length("compact") >= SEEDS[0]), "compact"),
        form(substrings.SPACED, phrase & (F.length("compact") < SEEDS[0]), "spaced"),  # with their spaces
    )
    return ready.select("rule", F.explode(F.array_compact(forms)).alias("form")).select("form.*", "rule")


def _terms(forms: DataFrame) -> DataFrame:
    """(how, key) of all forms and of the seeds that those which stand anywhere begin with."""
    inside = forms.filter(F.col("how") == substrings.INSIDE)
    begins = [inside.filter(F.length("key") >= n).select(F.lit(how).cast("tinyint").alias("how"), F.substring("key", 1, n).alias("key")) for how, n in zip(substrings.BEGIN, SEEDS, strict=True)]
    return forms.select("how", "key").unionByName(begins[0]).unionByName(begins[1])


def _small(df: DataFrame, held: int) -> DataFrame:
    return F.broadcast(df) if held <= BROADCAST else df


def matches(texts: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, term, severity, replacement) of the rules that the texts break, each once.

    Rules are rows (kind, term, severity, replacement). A phrase is broken where its letters stand in the text's letters,
    spaces or not (with them if it has fewer than five); a word where it stands alone, or is spelled out by letters with
    blanks, digits or marks between them; look-alikes are seen through but for the latter. Characters of a word other than
    letters and digits do not count.

    Rows that share a key are one text's parts; a null text breaks nothing, rows with a null key are found under null; an
    empty table of either gives none. Texts are not shuffled, only what was found is, while the rules are small enough to
    be broadcast (`BROADCAST`, measured); beyond it, the keys of the texts are."""
    ready = cut(prepared(rules).withColumn("rule", F.monotonically_increasing_id()))  # numbers are settled once written
    held = ready.agg(F.sum(F.length("compact") + F.length("spaced") + F.length("term") + F.length(F.coalesce("replacement", F.lit(""))) + 64)).first()[0] or 0
    forms = _forms(ready)
    lengths: dict[int, list[int]] = {}
    count = 0
    for r in forms.groupBy("how", F.length("key").alias("n")).count().orderBy("how", "n").collect():
        lengths.setdefault(r["how"], []).append(r["n"])
        count += r["count"]
    bits = min(max(count.bit_length() + 6, 16), MOST_BITS)
    taken = np.zeros(1 << bits, bool)
    taken[_terms(forms).mapInArrow(substrings.buckets(bits), "bucket long").distinct().toArrow().column(0).to_numpy()] = True

    given = texts.select(F.col(f"`{key}`").alias("row_key"), F.col(f"`{text}`").cast("string").alias("x"))
    schema = StructType([given.schema["row_key"], StructField("how", ByteType()), StructField("key", StringType())])
    met = given.mapInArrow(substrings.stretches(taken, bits, lengths, SEEDS, LOOKALIKES), schema)
    found = met.join(_small(forms, held), ["how", "key"]).select("row_key", "rule").distinct()
    return found.join(_small(ready.select("rule", "kind", "term", "severity", "replacement"), held), "rule").select(F.col("row_key").alias(key), "kind", "term", "severity", "replacement")


def taught(texts: DataFrame, key: str, text: str, educational: str = EDUCATIONAL) -> DataFrame:
    """(key) of the educational texts, each once."""
    return texts.filter(F.col(f"`{text}`").rlike(f"(?i){educational}")).select(F.col(f"`{key}`").alias(key)).distinct()


def actionable(found: DataFrame, texts: DataFrame, key: str, text: str, educational: str = EDUCATIONAL) -> DataFrame:
    """What was found without the rules that an educational text may break (severity allow_context)."""
    return found.join(taught(texts, key, text, educational).withColumnRenamed(key, "taught_key"), F.col(key).eqNullSafe(F.col("taught_key")) & (F.col("severity") == "allow_context"), "left_anti")


def _pattern() -> Column:
    """Of a prepared rule: its letters with what may stand between them, or its words with what has to."""
    letters = F.array_join(F.filter(F.split("compact", ""), lambda c: c != ""), f"[{BETWEEN}]*")
    words = F.replace(F.col("spaced"), F.lit(" "), F.lit(f"[{BETWEEN}]+"))
    return F.concat(F.lit(f"(?i)(?<![{LETTER}])"), F.when(F.col("kind") == "word", letters).otherwise(words), F.lit(f"(?![{LETTER}])"))


def sanitized(texts: DataFrame, rules: DataFrame, key: str, text: str, educational: str = EDUCATIONAL) -> DataFrame:
    """(key, text, action) of texts with unique keys: ok if nothing is found; blocked, as they are, if a rule says so;
    rewritten by the rules found that say what to write, phrases first and longer ones before shorter, and then rewrite if
    nothing is left, else reformulate. A null text is ok and stays null; texts with a null key are judged together."""
    given = texts.select(F.col(f"`{key}`").alias("row_key"), F.col(f"`{text}`").alias("x"))
    found = actionable(matches(given, rules, "row_key", "x"), given, "row_key", "x", educational)
    forms = prepared(rules).select("kind", "term", _pattern().alias("pattern"))
    rank = F.struct((F.col("kind") == "word").alias("word"), (-F.length("term")).alias("length"), F.col("term").alias("term"), F.col("pattern").alias("pattern"), F.col("replacement").alias("written"))
    steps = F.array_sort(F.collect_list(F.when((F.col("severity") == "rewrite") & F.col("replacement").isNotNull(), rank)))
    by_text = found.join(forms, ["kind", "term"]).groupBy("row_key").agg(F.bool_or(F.col("severity") == "block").alias("blocked"), steps.alias("steps"))
    by_text = by_text.withColumnRenamed("row_key", "found_key")
    judged = given.join(by_text, F.col("row_key").eqNullSafe(F.col("found_key")), "left")
    written = F.aggregate("steps", F.col("x"), lambda t, s: rewrite.replace_matches(t, s["pattern"], lambda m: rewrite.like_case(s["written"], m)))
    judged = cut(judged.select("row_key", F.when(F.col("steps").isNotNull() & ~F.col("blocked"), written).otherwise(F.col("x")).alias("x"), F.when(F.col("blocked"), "blocked").when(F.col("steps").isNotNull(), "rewrite").otherwise("ok").alias("action")))
    again = judged.filter("action = 'rewrite'").select("row_key", "x")
    left = actionable(matches(again, rules, "row_key", "x"), again, "row_key", "x", educational).select(F.col("row_key").alias("left_key")).distinct().withColumn("left", F.lit(True))
    done = judged.join(left, F.col("row_key").eqNullSafe(F.col("left_key")), "left")
    return done.select(F.col("row_key").alias(key), F.col("x").alias(text), F.when((F.col("action") == "rewrite") & F.col("left").isNotNull(), "reformulate").otherwise(F.col("action")).alias("action"))
