"""Text functions as Column expressions; all of them stay inside code generation."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(1)
def _plain_letters() -> tuple[str, str]:
    """Accented Latin, Greek and Cyrillic letters and what is left of each without its marks."""
    source, target = [], []
    for c in (*range(0xC0, 0x500), *range(0x1E00, 0x2000)):
        base = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))
        if len(base) == 1 and base != chr(c):
            source.append(chr(c))
            target.append(base)
    return "".join(source), "".join(target)


def strip_accents(x: Column) -> Column:
    """Letters without their marks: composed letters by a table, combining marks dropped."""
    source, target = _plain_letters()
    return F.regexp_replace(F.translate(x, source, target), r"[̀-ͯ]", "")


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[\s ]+", " "))


def strip_tags(x: Column, by: str = "") -> Column:
    return F.regexp_replace(x, "<[^>]*>", by)


def normalize(x: Column) -> Column:
    """Accents off, lower case, tags to spaces, white space squeezed; null is the empty string."""
    return squeeze(strip_tags(F.lower(strip_accents(F.coalesce(x, F.lit("")))), " "))


#: What texts hold that are not plain: to those of ASCII with single blanks and no tags, `normalize` does little.
NOT_PLAIN = r"[^!-;=-~ ]|  "


def normalize_plain_first(x: Column) -> Column:
    """As `normalize`, a fraction of the work where a text is plain."""
    return F.when(~x.rlike(NOT_PLAIN), F.trim(F.lower(x))).otherwise(normalize(x))


def normalize_key(x: Column) -> Column:
    """As `normalize`, and everything but letters and digits becomes a space."""
    return squeeze(F.regexp_replace(F.lower(strip_accents(F.coalesce(x, F.lit("")))), r"[^\p{L}\p{N}\s]", " "))


#: The named entities that markup in the sources uses, with what they stand for.
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def decode_entities(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for name, char in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def strip_html(x: Column) -> Column:
    """Readable text of markup: scripts and styles go, blocks end lines, other tags are spaces, entities are decoded."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)\s*>", "\n")
    x = decode_entities(strip_tags(x, " "))
    x = F.regexp_replace(x, r"[ \t\r\f ]+", " ")
    return F.regexp_replace(F.regexp_replace(x, r" ?\n[ \n]*", "\n"), r"^\s+|\s+$", "")


def tidy(x: Column) -> Column:
    """Smart quotes and dashes to plain ones, no-break spaces to spaces, control characters away."""
    return squeeze(F.regexp_replace(F.translate(x, "‘’“”–— ", "''\"\"-- "), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))


def clip(x: Column, most: int) -> Column:
    return F.substring(F.trim(F.coalesce(x, F.lit(""))), 1, most)


def nullif_empty(x: Column) -> Column:
    return F.when(x != "", x)


def tokens(x: Column, longer_than: int = 2) -> Column:
    """Distinct words of a normalized text that are longer than so many characters."""
    return F.array_distinct(F.filter(F.split(x, " "), lambda t: F.length(t) > longer_than))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def fnv1a_base36(x: Column) -> Column:
    """32-bit FNV-1a over the code points of a text, in base 36."""
    points = F.transform(F.split(F.coalesce(x, F.lit("")), ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(F.filter(points, lambda p: p > 0), F.lit(2166136261).cast("long"), lambda h, p: (h.bitwiseXOR(p) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def question_hash(question: Column, answer: Column, age_band: Column | None = None, tags: bool = True) -> Column:
    """Key of an item: question and answer, without tags unless they are kept, and the age band where it is part of it."""
    parts = [F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))]
    if tags:
        parts = [strip_tags(p) for p in parts]
    parts = [F.trim(p) for p in parts] + ([F.coalesce(age_band, F.lit(""))] if age_band is not None else [])
    return fnv1a_base36(F.concat_ws("|", *parts))


def squash_repeats(x: Column) -> Column:
    """Runs of three or more of one character shrink to two."""
    return F.regexp_replace(x, r"(.)\1{2,}", "$1$1")


def option_key(x: Column) -> Column:
    return squash_repeats(normalize(x))


def years(x: Column) -> Column:
    """Whole numbers from 100 to 2999 that stand alone in a text."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"(?<![\d.,])([1-9]\d{2}|[12]\d{3})(?![\d])"), F.lit(1)), lambda y: y.cast("int"))


#: Look-alikes that stand for letters in disguised words.
LOOKALIKES = ("0134578@$!", "oieastbasi")


def undisguise(x: Column) -> Column:
    """Look-alike characters to letters, everything else to single spaces."""
    plain = F.translate(F.lower(strip_accents(F.coalesce(x, F.lit("")))), *LOOKALIKES)
    return squeeze(F.regexp_replace(plain, r"[^a-z]+", " "))


def compact(x: Column) -> Column:
    return F.replace(undisguise(x), F.lit(" "), F.lit(""))


def spelled_out(x: Column) -> Column:
    """Words that runs of single letters spell ("a b c" gives abc), from undisguised text."""
    runs = F.regexp_extract_all(F.concat(F.lit(" "), undisguise(x), F.lit(" ")), F.lit(r"(?<= )((?:[a-z] ){2,}[a-z])(?= )"), F.lit(1))
    return F.transform(runs, lambda r: F.replace(r, F.lit(" "), F.lit("")))


def let(x: Column, of) -> Column:
    """of(x) with x worked out once, however often `of` uses it."""
    return F.element_at(F.transform(F.array(x), of), 1)


def first_sentences(x: Column, most: int = 240) -> Column:
    """The first two sentences, cut at a word if they are longer than `most` characters."""
    both = lambda t: F.coalesce(nullif_empty(F.regexp_extract(t, r"^(.+?[.!?](?:\s+.+?[.!?])?)(?=\s|$)", 1)), t)
    cut = lambda t: F.when(F.length(t) <= most, t).otherwise(F.regexp_replace(F.substring(t, 1, most), r"\s+\S*$", ""))
    return let(let(squeeze(x), both), cut)


def display_name(player: Column, nickname: Column) -> Column:
    """A nickname, or else a name from the last four characters of the id."""
    nick = F.trim(F.coalesce(nickname, F.lit("")))
    usable = (nick != "") & ~nick.isin("{}", "[object Object]")
    name = F.when(F.length(F.trim(player)) >= 4, F.concat(F.lit("Jogador "), F.upper(F.right(F.trim(player), F.lit(4))))).otherwise(F.lit("Jogador"))
    return F.when(usable, nick).otherwise(name)
