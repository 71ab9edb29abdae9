"""Place names: other spellings and the European Portuguese one."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import rewrite

#: Names as they are to be written, each with the spellings that stand for it elsewhere.
PLACES = {
    "Bagdade": ("Baguedade", "Bagdá", "Bagdad"),
    "Moscovo": ("Moscou", "Moscow"),
    "Teerão": ("Teerã", "Teheran", "Tehran"),
    "Riade": ("Riad", "Riyadh"),
    "Nova Iorque": ("Nova York", "New York"),
    "Pequim": ("Beijing", "Peking"),
    "Banguecoque": ("Bangcoc", "Bangkok"),
    "Tóquio": ("Tokyo",),
    "Quioto": ("Kyoto",),
    "Seul": ("Seoul",),
    "Pionguiangue": ("Pyongyang",),
    "Bombaim": ("Mumbai", "Bombay"),
    "Calcutá": ("Kolkata", "Calcutta"),
    "Meca": ("Mecca",),
    "Istambul": ("Istanbul",),
    "Argel": ("Algiers",),
    "Tunes": ("Tunis",),
    "Telavive": ("Tel Aviv", "Telaviv"),
    "Montevideu": ("Montevideo",),
    "Camberra": ("Canberra",),
    "Hanói": ("Hanoi",),
    "Saigão": ("Saigon",),
    "Cantão": ("Canton", "Guangzhou"),
    "Osaca": ("Osaka",),
    "Beirute": ("Beirut",),
    "Damasco": ("Damascus",),
    "Jerusalém": ("Jerusalem",),
    "Irão": ("Irã", "Iran"),
    "Egipto": ("Egito", "Egypt"),
    "Vietname": ("Vietnã", "Vietnam"),
    "Quénia": ("Quênia", "Kenya"),
    "Roménia": ("Romênia", "Romania"),
    "Polónia": ("Polônia", "Poland"),
    "Estónia": ("Estônia", "Estonia"),
    "Letónia": ("Letônia", "Latvia"),
    "Eslovénia": ("Eslovênia", "Slovenia"),
    "Arménia": ("Armênia", "Armenia"),
    "Mónaco": ("Mônaco",),
    "Zimbabué": ("Zimbábue", "Zimbabwe"),
    "Usbequistão": ("Uzbequistão", "Uzbekistan"),
    "Bangladeche": ("Bangladesh",),
    "Catar": ("Qatar",),
    "Chéquia": ("Czechia", "Czech Republic"),
    "Cabo Verde": ("Cape Verde",),
    "Costa do Marfim": ("Ivory Coast",),
    "Coreia do Sul": ("South Korea",),
    "Coreia do Norte": ("North Korea",),
    "Estados Unidos": ("United States",),
    "Reino Unido": ("United Kingdom",),
    "Países Baixos": ("Holland",),
    "Mianmar": ("Myanmar", "Burma"),
    "Essuatíni": ("Eswatini", "Swaziland"),
    "Iraque": ("Iraq",),
}


def _spellings() -> Iterator[tuple[str, str]]:
    for canonical, variants in PLACES.items():
        for variant in variants:
            yield variant, canonical


def _holds_any(x: Column) -> Column:
    """One pattern for all spellings, which rules most texts out at once."""
    return x.rlike(f"(?iu)({'|'.join(re.escape(v) for v, _ in _spellings())})")


def spellings() -> dict[str, str]:
    """Other spellings and the names that they stand for."""
    return dict(_spellings())


def canonical(x: Column) -> Column:
    """A text with every other spelling replaced, longer ones first, in the case of what stood there."""
    return F.when(_holds_any(x), rewrite.by_dictionary(x, spellings())).otherwise(x)


def _fold(x: Column) -> Column:
    """Text under which all spellings are equal that patterns without regard to case take for one."""
    return F.lower(F.upper(F.translate(x, "İ", "I")))


def _used(x: Column, rows: list[tuple[str, str]]) -> Column:
    """The (at, variant, canonical) of a table of spellings that a text holds, in the order of the table, the first of each
    place. One pattern finds them all, since no name holds another as a word or begins with what another ends with."""
    names = sorted((re.escape(v) for v, _ in rows), key=lambda v: (-len(v), v))
    found = F.regexp_extract_all(x, F.lit(f"(?iu){rewrite.LEFT}({'|'.join(names)}){rewrite.RIGHT}"), F.lit(1))
    entry = [F.struct(F.lit(k).alias("at"), F.lit(v).alias("variant"), F.lit(c).alias("canonical")) for k, (v, c) in enumerate(rows)]
    table = F.map_from_arrays(F.array(*[_fold(F.lit(v)) for v, _ in rows]), F.array(*entry))
    held = F.array_sort(F.array_distinct(F.transform(found, lambda m: F.try_element_at(table, _fold(m)))))
    none = F.array().cast("array<struct<at:int,variant:string,canonical:string>>")
    return F.aggregate(held, none, lambda kept, v: F.when(F.exists(kept, lambda k: k["canonical"] == v["canonical"]), kept).otherwise(F.concat(kept, F.array(v))))


def first_variant(x: Column) -> Column:
    """(variant, canonical) of the first name of the table that a text spells otherwise; null if there is none."""
    found = F.transform(_used(x, list(_spellings())), lambda v: F.struct(v["variant"].alias("variant"), v["canonical"].alias("canonical")))
    return F.when(_holds_any(x), F.try_element_at(found, F.lit(1)))


def mismatch(question: Column, answer: Column) -> Column:
    """The name that question and answer spell in two ways, or null."""
    rows = [(n, c) for c, variants in PLACES.items() for n in (c, *variants)]
    asked, told = _used(question, rows), _used(answer, rows)
    apart = F.filter(asked, lambda v: F.exists(told, lambda w: (w["canonical"] == v["canonical"]) & (w["variant"] != v["variant"])))
    return F.when(_holds_any(question) | _holds_any(answer), F.try_element_at(apart, F.lit(1))["canonical"])
