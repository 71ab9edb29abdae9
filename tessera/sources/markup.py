"""Parsers of collected documents: HTML pages, RSS, Dublin Core, archive indexes, entity bindings and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import decode_entities, first_sentences, squeeze, strip_html, tidy

#: Lengths of usable titles and leads, and the characters of a lead in Portuguese.
TITLE_LENGTHS, LEAD_LENGTHS, FACT_LENGTHS = (8, 140), (40, 600), (40, 320)
ACCENTS = "[áàâãéêíóôõúçÁÀÂÃÉÊÍÓÔÕÚÇ]"


def tag(block: Column, name: str) -> Column:
    """Text of the first element of a name, decoded and without markup."""
    return squeeze(strip_html(decode_entities(F.regexp_extract(block, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>", 1))))


def tags(block: Column, name: str) -> Column:
    found = F.regexp_extract_all(block, F.lit(rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: squeeze(strip_html(decode_entities(x)))), lambda x: x != "")


def links(html: Column) -> Column:
    """Distinct link targets in their order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href=[\"']([^\"'#]+)"), F.lit(1)))


def charset(head: Column, content_type: Column | None = None) -> Column:
    """The declared character set: of the content type, the XML prolog or a meta element; else UTF-8."""
    told = F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=[\"']?([\w-]+)", 1) if content_type is not None else F.lit("")
    first = F.substring(head, 1, 1600)
    prolog = F.regexp_extract(first, r"(?i)<\?xml[^>]*encoding=[\"']([\w-]+)", 1)
    meta = F.regexp_extract(first, r"(?i)<meta[^>]*charset=[\"']?([\w-]+)", 1)
    return F.lower(F.coalesce(*[F.when(x != "", x) for x in (told, prolog, meta)], F.lit("utf-8")))


def _western() -> tuple[str, str]:
    """The control characters of Latin-1 and what the Western code page has in their places."""
    pairs = [(chr(b), bytes([b]).decode("windows-1252", "ignore")) for b in range(0x80, 0xA0)]
    known = [(a, b) for a, b in pairs if b]
    return "".join(a for a, _ in known), "".join(b for _, b in known)


def decode_bytes(content: Column) -> Column:
    """Text of a binary column: as UTF-8 if it is, else as the Western code page."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.translate(F.decode(content, "iso-8859-1"), *_western()))


def usable_title(title: Column) -> Column:
    t = F.trim(title)
    return F.length(t).between(*TITLE_LENGTHS) & ~t.contains("�")


def usable_lead(lead: Column, accents: bool = True) -> Column:
    t = F.trim(lead)
    ok = F.length(t).between(*LEAD_LENGTHS) & ~t.contains("�") & t.rlike(r"\p{L}")
    return ok & t.rlike(ACCENTS) if accents else ok


def lead(html: Column, accents: bool = True) -> Column:
    """The first paragraph that can serve as one, in one or two sentences; null if there is none."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    paragraphs = F.transform(tags(plain, "p"), lambda p: squeeze(F.regexp_replace(p, r"\[\s*\d+\s*\]", "")))
    return first_sentences(F.try_element_at(F.filter(paragraphs, lambda p: usable_lead(p, accents)), F.lit(1)))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host without www, no fragment, no tracking parameters, no closing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"(?i)([?&])(utm_[a-z]+|fbclid|gclid)=[^&]*", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[?&]+$", ""), r"([?&])&+", "$1")
    host = F.lower(F.regexp_extract(bare, r"^([a-zA-Z]+://[^/?]*)", 1))
    rest = F.substr(bare, F.length(host) + 1)
    return F.concat(F.regexp_replace(host, r"://www\.", "://"), F.regexp_replace(rest, "/$", ""))


def pages(df: DataFrame, html: str = "html") -> DataFrame:
    """df with title, text, links and lead of its pages."""
    h = F.col(html)
    return df.withColumns({"title": tag(h, "title"), "text": tidy(strip_html(h)), "links": links(h), "lead": lead(h, accents=False)})


def rss_items(df: DataFrame, xml: str) -> DataFrame:
    """One row an item with title and link: (title, link, description, guid, date)."""
    block = F.explode(F.regexp_extract_all(xml, F.lit(r"(?is)(<item\b.*?</item>)"), F.lit(1))).alias("item")
    item = F.col("item")
    kept = [c for c in df.columns if c != xml]
    date = F.when(tag(item, "pubDate") != "", tag(item, "pubDate")).otherwise(tag(item, "dc:date"))
    rows = df.select(*kept, block).select(*kept, tag(item, "title").alias("title"), tag(item, "link").alias("link"), tag(item, "description").alias("description"), tag(item, "guid").alias("guid"), date.alias("date"))
    return rows.filter("title <> '' AND link <> ''")


def dublin_core(df: DataFrame, xml: str) -> DataFrame:
    """Catalogue records with their lists of values; error answers and records without a number are dropped."""
    x = F.col(xml)
    lists = {name: tags(x, f"dc:{name}") for name in ("title", "creator", "date", "language", "type", "identifier")}
    number = F.regexp_extract(F.regexp_extract(x, r"(?i)<identifier>([^<]+)</identifier>", 1), r"/(\d+)\s*$", 1)
    return df.filter(~x.rlike(r"(?i)<error[\s>]")).withColumn("bib_id", number).withColumns(lists).filter("bib_id <> ''").drop(xml)


def archive_index(df: DataFrame, text: str) -> DataFrame:
    """(timestamp, url, digest) of JSON lines; lines that are cut off are skipped."""
    line = F.explode(F.split(text, r"\n+")).alias("line")
    row = F.from_json("line", "timestamp string, url string, digest string", {"mode": "PERMISSIVE"})
    return df.select(line).filter(F.trim("line").startswith("{")).select(row.alias("r")).select("r.*").filter("timestamp IS NOT NULL AND url IS NOT NULL")


def bindings(df: DataFrame, json: str) -> DataFrame:
    """One row a binding of a query answer, as a map of its values."""
    kind = "struct<results:struct<bindings:array<map<string,struct<value:string>>>>>"
    return df.select(F.explode(F.from_json(json, kind)["results"]["bindings"]).alias("b")).select(F.transform_values("b", lambda _, v: v["value"]).alias("binding"))


def entities(rows: DataFrame, key: str = "qid") -> DataFrame:
    """Bindings of one entity in one row: (qid, label, values), the values distinct and sorted."""
    b = F.col("binding")
    named = rows.select(F.regexp_extract(F.try_element_at(b, F.lit("item")), r"(Q\d+)$", 1).alias(key), F.try_element_at(b, F.lit("itemLabel")).alias("label"), F.try_element_at(b, F.lit("value")).alias("value"))
    return named.filter(F.col(key) != "").groupBy(key).agg(F.min("label").alias("label"), F.array_sort(F.collect_set("value")).alias("values"))


def queue_file(spark, path: str) -> DataFrame:
    """Items of a seed file {"items": [...]}, with their position."""
    return spark.read.option("multiLine", True).json(path).select(F.posexplode("items").alias("position", "item")).select("position", "item.*")


def merge_stores(*stores: DataFrame, key: str = "question_hash") -> DataFrame:
    """Rows of several stores once a key, the first store's first; columns that a store lacks are null."""
    from pyspark.sql import Window as W

    out = None
    for k, s in enumerate(stores):
        part = s.withColumn("_store", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    first = F.row_number().over(W.partitionBy(key).orderBy("_store"))
    return out.withColumn("_at", first).filter("_at = 1").drop("_at", "_store")


# --- lists of riddles on web pages --------------------------------------------------------------------------------

#: How each kind of page writes question and answer (two groups), and the least length of a question.
#: Numbered lists with the answer on a line of its own, questions with "Resposta:", and structured data.
LISTS = {
    "numbered": (r"(?:^|\n)\s*\d+\.\s+([\s\S]*?)\n\s*([A-ZÀ-Ú][^\n.]{1,80})\.", 15),
    "answered": (r"(?i)([^\n?]{12,}\?)\s*\n\s*Resposta:\s*([^\n.]+)", 12),
    "structured": (r'"@type":"Question","name":"((?:\\.|[^"\\])*)","text":"(?:\\.|[^"\\])*","inLanguage":"pt-PT","acceptedAnswer":\{"@type":"Answer","text":"((?:\\.|[^"\\])*)"\}', 10),
}


def riddle_list(df: DataFrame, html: str, kind: str) -> DataFrame:
    """df with one row for each (question, answer) of a page that lists riddles in one of the known ways."""
    pattern, least = LISTS[kind]
    text = F.col(html) if kind == "structured" else strip_html(F.col(html))
    both = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    plain = lambda x: squeeze(F.replace(F.replace(x, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit(" ")))
    kept = [c for c in df.columns if c != html]
    rows = df.select(*kept, F.explode(F.arrays_zip(both(1).alias("q"), both(2).alias("a"))).alias("x"))
    rows = rows.select(*kept, plain(F.col("x.q")).alias("question"), plain(F.col("x.a")).alias("answer"))
    return rows.filter((F.length("question") >= least) & (F.col("answer") != "") & ~F.lower("question").isin("resposta"))


def catalogue_ids(html: Column) -> Column:
    """Distinct record numbers of a catalogue's list of hits, in their order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)[?&]bib(?:id)?=(\d+)"), F.lit(1)))


def usable_label(label: Column) -> Column:
    """Whether a label names something: 3 to 80 characters, a letter, no number of an entity and no brackets."""
    t = F.trim(F.coalesce(label, F.lit("")))
    return F.length(t).between(3, 80) & ~t.rlike(r"(?i)^Q\d+$") & ~t.rlike(r"[()]") & t.rlike("(?iu)[a-záàâãéêíóôõúç]")


def holds_words(text: Column, words: Column) -> Column:
    """Whether a text holds one of some words (of two letters or more); without any it does."""
    from tessera.functions.text import normalize_key

    sought = F.filter(F.transform(words, normalize_key), lambda w: F.length(w) >= 2)
    return (F.size(sought) == 0) | F.exists(sought, lambda w: F.contains(normalize_key(text), w))


def search_score(label: Column, classes: Column, word: Column) -> Column:
    """How well an entity answers a search: by its classes, its whole label, the label's start or a part of it."""
    w, name = F.lower(F.trim(word)), F.lower(F.trim(F.coalesce(label, F.lit(""))))
    hit = F.exists(classes, lambda c: F.lower(F.trim(c)) == w)
    begins = F.startswith(name, F.concat(w, F.lit(" "))) | F.startswith(name, F.concat(w, F.lit("-")))
    return F.when((w == "") | (name == ""), 0).when(hit & (name != w), 90).when(name == w, 80).when(begins, 40).when(F.contains(name, w), 15).otherwise(5)
