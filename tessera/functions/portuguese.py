"""European Portuguese as imports are to have it: missing accents of common words, and place names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import places, rewrite
from tessera.functions.text import nullif_empty, squeeze

#: Words without their accents, and with them.
WORDS = {
    "voce": "você", "nao": "não", "tambem": "também", "ja": "já", "so": "só", "acao": "ação", "coracao": "coração", "situacao": "situação", "informacao": "informação",
    "aviao": "avião", "pao": "pão", "arvore": "árvore", "ninguem": "ninguém", "alem": "além", "portugues": "português", "alemao": "alemão", "frances": "francês",
    "ingles": "inglês", "oculos": "óculos", "tenis": "ténis", "lampada": "lâmpada", "acucar": "açúcar", "chocolate": "chocolate", "crianca": "criança",
    "criancas": "crianças", "mae": "mãe",
}


def normalized(x: Column) -> Column:
    """White space squeezed, words and place names as they are written in Portugal; null is the empty string."""
    return rewrite.by_dictionary(squeeze(F.coalesce(x, F.lit(""))), WORDS | places.spellings())


def normalized_record(records: DataFrame) -> DataFrame:
    """records with fact, answer, topic, statement and clues normalized, as far as they have them: what is null or blank
    is the empty string, empty clues go and null ones are an empty list. An empty table stays empty."""
    found = {c: normalized(F.col(c)) for c in ("fact", "answer", "topic", "statement") if c in records.columns}
    if "clues" in records.columns:
        found["clues"] = F.coalesce(F.filter(F.transform("clues", normalized), lambda c: nullif_empty(c).isNotNull()), F.array().cast("array<string>"))
    return records.withColumns(found)
