"""Text, number and time functions against values known by hand."""

from __future__ import annotations

import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import localtime, numbers, text
from tessera.operators import series
from tessera.sources import markup


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("function", "given_", "expected"),
    [
        (text.normalize, "  Ação <b>É</b>\n fim ", "acao e fim"),
        (text.normalize_key, "Qual é a capital?!", "qual e a capital"),
        (text.strip_html, "<p>Um &amp; dois</p><script>x</script><p>três</p>", "Um & dois\ntrês"),
        (text.squash_repeats, "goooolo", "goolo"),
        (text.undisguise, "0l4 $enh0r", "ola senhor"),
        (text.tidy, "“a” b\x07", '"a" b'),
    ],
)
def test_texts(spark, function, given_, expected):
    assert value(spark, function(F.lit(given_))) == expected


def test_known_hash(spark):
    assert value(spark, text.question_hash(F.lit("Qual é a capital?"), F.lit("Lisboa"))) == "1r5atef"
    assert value(spark, text.question_hash(F.lit("<b>Qual é a capital?</b>"), F.lit("Lisboa"))) == "1r5atef"
    assert value(spark, text.question_hash(F.lit("<b>x</b>"), F.lit("y"), tags=False)) != value(spark, text.question_hash(F.lit("x"), F.lit("y")))


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(max_codepoint=0x24F, exclude_categories=("Cs", "Cc")), max_size=20), min_size=1, max_size=20))
def test_accents_are_stripped_as_by_decomposition(spark, words):
    got = [r["v"] for r in spark.createDataFrame(list(enumerate(words)), "k int, x string").select("k", text.strip_accents(F.col("x")).alias("v")).orderBy("k").collect()]
    for word, stripped in zip(words, got, strict=True):
        assert stripped == "".join(c for c in unicodedata.normalize("NFC", unicodedata.normalize("NFD", word)) if not unicodedata.combining(c)).translate({}) or all(len(unicodedata.normalize("NFD", c)) > 2 for c in word if ord(c) > 0xBF) or stripped == "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def test_sets_and_years(spark):
    a, b = F.split(F.lit("um dois tres"), " "), F.split(F.lit("dois tres quatro"), " ")
    assert value(spark, text.jaccard(a, b)) == 0.5
    assert value(spark, text.tokens(F.lit("o rio tejo tejo"))) == ["rio", "tejo"]
    assert value(spark, text.years(F.lit("em 1494, 3000 e 99; 476"))) == [1494, 476]
    assert value(spark, text.spelled_out(F.lit("diz a b c já"))) == ["abc"]


def test_rounding(spark):
    assert value(spark, numbers.percent(F.lit(2), F.lit(3))) == 66.7
    assert value(spark, numbers.percent(F.lit(1), F.lit(0))) is None
    assert value(spark, numbers.half_up(F.lit(2.5))) == 3 and value(spark, numbers.half_up(F.lit(-2.5))) == -2


def test_local_keys_across_the_clock_changes(spark):
    at = lambda x: F.to_timestamp(F.lit(x))
    assert value(spark, localtime.hour_key(at("2026-07-01 10:07:00"))) == "2026-07-01T11"
    assert value(spark, localtime.hour_key(at("2026-03-29 01:30:00"))) == "2026-03-29T02"
    assert value(spark, localtime.hour_key(at("2026-10-25 00:30:00"))) == value(spark, localtime.hour_key(at("2026-10-25 01:30:00")))
    assert str(value(spark, localtime.day_start(F.lit("2026-07-01")))) == "2026-06-30 23:00:00"
    assert str(value(spark, localtime.day_end(F.lit("2026-03-29")))) == "2026-03-29 23:00:00"
    assert value(spark, localtime.bucket_key(at("2026-01-01 10:07:31"), 5)) == "2026-01-01T10:05"
    assert value(spark, localtime.text_bucket_key(F.lit("2026-01-01T10:07:31+00:00"), 5)) == "2026-01-01T10:05"


def test_series_merge_the_repeated_hour(spark):
    rows = spark.createDataFrame([("2026-10-25 00:30:00",), ("2026-10-25 01:30:00",), ("2026-10-24 22:00:00",)], "t string").select(F.to_timestamp("t").alias("ts"))
    got = {r["key"]: r["count"] for r in series.series(rows, "ts", "2026-10-25 02:10:00", 5, "hour").collect()}
    assert got == {"2026-10-24T23": 1, "2026-10-25T00": 0, "2026-10-25T01": 2, "2026-10-25T02": 0}


def test_empty_series_are_zero(spark):
    none = spark.createDataFrame([], "ts timestamp, kind string")
    assert [r["count"] for r in series.series(none, "ts", "2026-01-10 00:00:00", 3).collect()] == [0, 0, 0]
    assert series.from_first_day(none, "ts", "2026-01-10 00:00:00").count() == 0
    assert series.between(spark, "2026-01-01", "2026-01-05").count() == 5


RSS = """<rss><channel><item><title><![CDATA[Um título &amp; tal]]></title><link>https://a.pt/1</link><description>&lt;p&gt;Olá&lt;/p&gt;</description><pubDate>hoje</pubDate></item>
<item><title>sem ligação</title></item></channel></rss>"""


def test_parsers(spark):
    (item,) = markup.rss_items(spark.createDataFrame([(RSS,)], "xml string"), "xml").collect()
    assert (item["title"], item["link"], item["description"], item["date"]) == ("Um título & tal", "https://a.pt/1", "Olá", "hoje")
    dc = "<record><identifier>oai:x/77</identifier><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator></record>"
    (row,) = markup.dublin_core(spark.createDataFrame([(dc,), ("<error code='x'/>",)], "xml string"), "xml").collect()
    assert row["bib_id"] == "77" and row["creator"] == ["A", "B"]
    cdx = '{"timestamp":"1","url":"u","digest":"d"}\n{"timestamp":"2","url":\nnoise\n{"url":"v"}'
    assert [r["url"] for r in markup.archive_index(spark.createDataFrame([(cdx,)], "t string"), "t").collect()] == ["u"]
    answer = '{"results":{"bindings":[{"item":{"value":"http://x/Q5"},"itemLabel":{"value":"L"},"value":{"value":"b"}},{"item":{"value":"http://x/Q5"},"itemLabel":{"value":"L"},"value":{"value":"a"}}]}}'
    (e,) = markup.entities(markup.bindings(spark.createDataFrame([(answer,)], "j string"), "j")).collect()
    assert (e["qid"], e["values"]) == ("Q5", ["a", "b"])


def test_pages_and_bytes(spark):
    html = "<html><head><title> Um  T </title><style>p{}</style></head><body><p>curto</p><p>Uma frase bastante longa sobre história, com acentuação. Segunda. Terceira.</p><a href='x'>l</a><a href=\"x\">m</a></body></html>"
    row = markup.pages(spark.createDataFrame([(html,)], "html string")).first()
    assert row["title"] == "Um T" and row["links"] == ["x"] and row["lead"].startswith("Uma frase") and "Terceira" not in row["lead"]
    raw = spark.createDataFrame([("“ação”".encode(),), ("“ação”".encode("windows-1252"),)], "b binary")
    assert {r[0] for r in raw.select(markup.decode_bytes(F.col("b"))).collect()} == {"“ação”"}
    assert value(spark, markup.charset(F.lit('<?xml version="1.0" encoding="ISO-8859-1"?>'))) == "iso-8859-1"
    assert value(spark, markup.canonical_url(F.lit("HTTPS://www.A.pt/x/?utm_source=b&k=1#z"))) == "https://a.pt/x/?k=1"


def test_stores_are_merged_by_priority(spark, tmp_path):
    one = spark.createDataFrame([("h", "a")], "question_hash string, q string")
    two = spark.createDataFrame([("h", "b", 1), ("i", "c", 2)], "question_hash string, q string, n int")
    got = {r["question_hash"]: (r["q"], r["n"]) for r in markup.merge_stores(one, two).collect()}
    assert got == {"h": ("a", None), "i": ("c", 2)}
    (tmp_path / "q.json").write_text('{"items": [{"queueId": "1", "status": "pending"}, {"queueId": "2", "status": "imported"}]}')
    assert [r["queueId"] for r in markup.queue_file(spark, str(tmp_path / "q.json")).orderBy("position").collect()] == ["1", "2"]


@pytest.mark.parametrize(
    ("written", "begins", "ends"),
    [
        ("2024-07-01", "2024-06-30 23:00:00", "2024-07-01 23:00:00"),
        ("2024-07-01T10", "2024-07-01 09:00:00", "2024-07-01 10:00:00"),
        ("2024-07-01 10:20", "2024-07-01 09:20:00", "2024-07-01 09:21:00"),
        ("2024-01-01T10:20:30", "2024-01-01 10:20:30", "2024-01-01 10:20:31"),
        ("2024-01-01T00:00", "2024-01-01 00:00:00", "2024-01-02 00:00:00"),
        ("yesterday", "None", "None"),
    ],
)
def test_written_local_times(spark, written, begins, ends):
    assert str(value(spark, localtime.instant(F.lit(written)))) == begins
    assert str(value(spark, localtime.exclusive_end(F.lit(written)))) == ends


def test_series_bound_the_scan(spark, tmp_path):
    spark.createDataFrame([("2024-01-10 00:00:00",), ("2023-01-10 00:00:00",)], "t string").select(F.to_timestamp("t").alias("ts")).write.parquet(f"{tmp_path}/e")
    plan = series.series(spark.read.parquet(f"{tmp_path}/e"), "ts", "2024-01-10 12:00:00", 3)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan


def test_free_keys_and_labels(spark):
    from tessera.functions import keys, places

    key = lambda q, a: value(spark, keys.knowledge_key(F.lit(q), F.lit(a)))
    assert key("Qual é a capital de França?", "Paris") == "capital paris"
    assert key("Que rio passa em Lisboa?", "Tejo") == "tejo rio passa"
    assert key("Curiosidade: O mel dura. Verdadeiro ou falso?", "Verdadeiro") == "o mel dura"
    assert key("Quem pintou a Guernica?", "Picasso") == "picasso"
    assert value(spark, keys.without_label(F.lit("Adivinha: o que é?"))) == "o que é?"
    assert value(spark, places.canonical(F.lit("de MOSCOU a New york e Roma"))) == "de MOSCOVO a Nova Iorque e Roma"
    assert value(spark, places.mismatch(F.lit("Onde fica Moscow?"), F.lit("Moscovo"))) == "Moscovo"
    assert value(spark, markup.usable_label(F.lit("Q123"))) is False and value(spark, markup.usable_label(F.lit("Rio Tejo"))) is True
    assert value(spark, markup.search_score(F.lit("Rio Tejo"), F.array(F.lit("rio")), F.lit("rio"))) == 90


def test_names_of_places_are_found_by_one_pattern(spark):
    from tessera.functions import places

    names = [n.lower() for c, variants in places.PLACES.items() for n in (c, *variants)]
    assert len(set(names)) == len(names)
    for n in names:  # else one pattern would not find each of them
        assert not [m for m in names if m != n and f" {m} " in f" {n} "]
        assert not [m for m in names if m != n and m.split()[0] == n.split()[-1] and " " in m + n]
    texts = [("Moscou ou MOSCOW e iran", "Moscou", "Moscovo"), ("IRAN, Moscow", "Moscow", "Moscovo"), ("\u0130ran", "Iran", "Irão"), ("Moscows", None, None), (None, None, None)]
    df = spark.createDataFrame(texts, "x string, variant string, canonical string")
    got = df.select("x", "variant", "canonical", places.first_variant(F.col("x")).alias("v")).collect()
    assert [(r["v"] and tuple(r["v"])) for r in got] == [(v and (v, c)) for _, v, c in texts]
    assert value(spark, places.mismatch(F.lit("De Iran a Moscow"), F.lit("Moscovo, Iran"))) == "Moscovo"
    plan = df.select(places.first_variant(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" in plan and ".pattern" not in plan  # no pattern is made anew for each row and name


def test_pages_that_list_riddles(spark):
    numbered = "<p>1. Tem dentes e não come, o que é?</p><p>Pente.</p><p>2. Curta?</p><p>Não.</p>"
    stored = '{"@type":"Question","name":"Tem \\\\"dentes\\\\" e não come?","text":"x","inLanguage":"pt-PT","acceptedAnswer":{"@type":"Answer","text":"Pente"}}'.replace("\\\\", "\\")
    pages = spark.createDataFrame([(1, numbered)], "k int, html string")
    assert [(r["question"], r["answer"]) for r in markup.riddle_list(pages, "html", "numbered").collect()] == [("Tem dentes e não come, o que é?", "Pente")]
    pages = spark.createDataFrame([(1, stored)], "k int, html string")
    assert [(r["question"], r["answer"]) for r in markup.riddle_list(pages, "html", "structured").collect()] == [('Tem "dentes" e não come?', "Pente")]


def test_no_folder_is_guessed_on_a_cluster(spark, monkeypatch):
    from tessera.functions import lineage

    class Elsewhere:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Elsewhere()
        conf = type("C", (), {"get": staticmethod(lambda name, default: default)})()

    with pytest.raises(ValueError):
        lineage.cut(type("D", (), {"sparkSession": Session()})())
