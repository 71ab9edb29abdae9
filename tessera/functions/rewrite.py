"""Replacing words of a text in one pass, in the case of what they replace."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands around matches while a text is taken apart; texts lose it.
MARK = "\x01"
LEFT, RIGHT = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def like_case(written: Column, match: Column) -> Column:
    """written in capitals where the match is, with a capital where the match has one, else as it is."""
    first = F.substring(match, 1, 1)
    capital = F.concat(F.upper(F.substring(written, 1, 1)), F.substring(written, 2, 1_000_000))
    return F.when(match == F.upper(match), F.upper(written)).when(first == F.upper(first), capital).otherwise(written)


def replace_matches(x: Column, pattern: Column | str, written: Callable[[Column], Column]) -> Column:
    """x with every match of the pattern as `written` has it; what was written is not looked at again. Null stays null."""
    marked = F.regexp_replace(F.replace(x, F.lit(MARK), F.lit("")), pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    return F.array_join(F.transform(F.split(marked, MARK, -1), lambda p, i: F.when(i % 2 == 1, written(p)).otherwise(p)), "")


def by_dictionary(x: Column, entries: Mapping[str, str]) -> Column:
    """x with each entry that stands in it as a word, or words, in any case, replaced in the case of what stood there. At
    each place the longest entry counts; one pass, whatever the number of entries. Null stays null."""
    known = {k.lower(): v for k, v in entries.items()}
    pattern = f"(?iu){LEFT}(?:{'|'.join(re.escape(k) for k in sorted(known, key=lambda k: (-len(k), k)))}){RIGHT}"
    table = F.map_from_arrays(F.array(*[F.lit(k) for k in known]), F.array(*[F.lit(v) for v in known.values()]))
    return replace_matches(x, pattern, lambda m: F.coalesce(like_case(F.try_element_at(table, F.lower(m)), m), m)) if known else x
