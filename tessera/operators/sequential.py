"""Sequential passes whose state is the last record that was kept, without walking through a key in one task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.lineage import cut
from tessera.functions.text import normalize_key, strip_html, tokens

SIMILAR = 0.72
#: Records are walked through in stretches of this many, each in one task: a power of two.
STRETCH = 4096

_POINTERS = "at long, next long, terminal long, first boolean"
_LANDINGS = "terminal long, landing long"


def _alike(a: frozenset, b: frozenset, threshold: float) -> bool:
    common = len(a & b)
    return bool(a) and bool(b) and common / (len(a) + len(b) - common) >= threshold


def _pointers(rows: list[tuple[int, str, frozenset]], threshold: float) -> list[tuple[int, int | None, int, bool]]:
    """(at, next, terminal, first) of a stretch's records: the next of the same key that is not like this one, the last
    that following these leads to, and whether the record is its key's first here. Equal sets in a row have one answer."""
    n, out = len(rows), []
    ahead, last = [-1] * n, [0] * n
    for i in range(n - 1, -1, -1):
        _, key, words = rows[i]
        j = i + 1
        if j < n and rows[j][1:] == rows[i][1:] and words:
            j = ahead[j] if ahead[j] >= 0 else n
        while j < n and rows[j][1] == key and _alike(words, rows[j][2], threshold):
            j += 1
        ahead[i] = j if j < n and rows[j][1] == key else -1
        last[i] = last[ahead[i]] if ahead[i] >= 0 else i
    for i in range(n):
        out.append((rows[i][0], rows[ahead[i]][0] if ahead[i] >= 0 else None, rows[last[i]][0], i == 0 or rows[i - 1][1] != rows[i][1]))
    return out


def _sorted_rows(table: pa.Table) -> list[tuple[int, str, frozenset]]:
    return sorted(((at, key, frozenset(words)) for at, key, words in zip(*(table.column(c).to_pylist() for c in ("at", "key", "words")), strict=True)), key=lambda r: r[0])


def _fresh(df: DataFrame) -> DataFrame:
    """df with columns of its own, so that it can be joined to what it was made from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def unlike_last(records: DataFrame, key: Column, order: list[str], text: Column, threshold: float = SIMILAR) -> DataFrame:
    """records with `kept`: of each key, in order, the first record and every one that is not like the last one kept.

    Likeness is the Jaccard similarity of the texts' words. Records with a null key are a key of their own, with null or
    empty texts like nothing; of ties in order any may come first; an earlier column `kept` is replaced; an empty table
    stays empty.

    "The next record that is not like this one" is a pointer, and what is kept is what the pointers from a key's first
    record lead to. Records sorted by key and order are cut into stretches, whatever their keys, and each stretch finds
    its own pointers and where following them ends (its terminals, mostly one or two). A key within one stretch is done
    with that. For keys that go on, terminals look for their next record in the stretches that follow, and the terminals
    passed are found by pointer doubling: rounds grow with the logarithm of the number of stretches of a key."""
    spark = records.sparkSession
    plain = records.drop("kept")
    keyed = plain.select(F.struct(*[plain[f"`{c}`"] for c in plain.columns]).alias("row"), F.concat(F.when(key.isNull(), "0").otherwise("1"), F.coalesce(key.cast("string"), F.lit(""))).alias("key"), tokens(normalize_key(strip_html(text))).alias("words"), *[plain[f"`{c}`"].alias(f"order_{k}") for k, c in enumerate(order)])
    by = ["key", *[f"order_{k}" for k in range(len(order))]]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # places are settled once written; they ascend with key and order, and a place's stretch is its upper bits
    rows = cut(keyed.repartitionByRange(n, *by).sortWithinPartitions(*by).select("row", "key", "words", F.monotonically_increasing_id().alias("at")))
    rows = rows.withColumn("stretch", F.floor(F.col("at") / STRETCH).cast("long"))
    walked = rows.select("stretch", "at", "key", "words")

    def point(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([dict(zip(("at", "next", "terminal", "first"), r, strict=True)) for r in _pointers(_sorted_rows(table), threshold)], schema=_schema(_POINTERS))

    pointers = cut(walked.groupBy("stretch").applyInArrow(point, _POINTERS)).withColumn("stretch", F.floor(F.col("at") / STRETCH).cast("long"))
    spans = walked.groupBy("key").agg(F.min("stretch").alias("from"), F.max("stretch").alias("to"))
    starts = pointers.filter("first").join(walked.select("at", "key"), "at").join(spans, "key").filter(F.col("stretch") == F.col("from"))
    entries = starts.select("stretch", F.col("at").alias("entry"))
    going_on = cut(spans.filter(F.col("from") < F.col("to")).select("key", "from"))
    if not going_on.isEmpty():
        entries = entries.unionByName(_later_entries(walked.join(going_on, "key", "left_semi"), pointers, going_on, threshold))

    def mark(table: pa.Table, entered: pa.Table) -> pa.Table:
        ahead = dict(zip(table.column("at").to_pylist(), table.column("next").to_pylist(), strict=True))
        found = []
        for at in entered.column("entry").to_pylist():
            while at is not None:
                found.append(at)
                at = ahead[at]
        return pa.table({"at": pa.array(found, pa.int64())})

    kept = pointers.select("stretch", "at", "next").groupBy("stretch").cogroup(_fresh(entries).groupBy("stretch")).applyInArrow(mark, "at long").withColumn("kept", F.lit(True))
    return rows.select("row", "at").join(kept, "at", "left").select("row.*", F.coalesce("kept", F.lit(False)).alias("kept"))


def _later_entries(walked: DataFrame, pointers: DataFrame, going_on: DataFrame, threshold: float) -> DataFrame:
    """(stretch, entry) of the records by which keys of several stretches enter those after their first."""
    # the stretches of a key in order; a key of a billion records has some 250,000
    following = walked.select("key", "stretch").distinct().withColumn("then", F.lead("stretch").over(W.partitionBy("key").orderBy("stretch")))
    following = cut(following)
    ends = pointers.select(F.col("terminal").alias("at")).distinct().join(walked, "at").select(F.col("at").alias("terminal"), "key", F.col("words").alias("own"), "stretch")
    pending = cut(ends.join(following, ["key", "stretch"]).filter("then IS NOT NULL").select("terminal", "key", "own", F.col("then").alias("stretch")))

    def land(table: pa.Table, waiting: pa.Table) -> pa.Table:
        found, rows = [], _sorted_rows(table)
        for terminal, key, own in zip(*(waiting.column(c).to_pylist() for c in ("terminal", "key", "own")), strict=True):
            words = frozenset(own)
            found.append({"terminal": terminal, "landing": next((at for at, k, w in rows if k == key and not _alike(words, w, threshold)), None)})
        return pa.Table.from_pylist(found, schema=_schema(_LANDINGS))

    landings = None
    while not pending.isEmpty():  # one round, and one more for each whole stretch of records that are like a terminal
        found = cut(walked.groupBy("stretch").cogroup(_fresh(pending).groupBy("stretch")).applyInArrow(land, _LANDINGS))
        hit = found.filter("landing IS NOT NULL")
        landings = hit if landings is None else landings.unionByName(hit)
        rest = pending.join(hit.select("terminal"), "terminal", "left_anti").join(following, ["key", "stretch"]).filter("then IS NOT NULL")
        pending = cut(rest.select("terminal", "key", "own", F.col("then").alias("stretch")))
    # from terminal to terminal: through the record where the first one lands
    leads = pointers.select(F.col("at").alias("landing"), F.col("terminal").alias("to"))
    hops = cut(landings.join(leads, "landing").select(F.col("terminal").alias("from"), "to", "landing"))
    begun = pointers.filter("first").join(walked.select("at", "key"), "at").join(going_on, "key").filter(F.col("stretch") == F.col("from"))
    passed = cut(begun.select(F.col("terminal").alias("node")))
    jumps = hops.select("from", "to")
    while True:
        more = passed.join(jumps, F.col("node") == F.col("from")).select(F.col("to").alias("node"))
        grown = cut(passed.unionByName(more).distinct())
        if more.isEmpty():
            break
        passed = grown
        jumps = cut(jumps.join(jumps.select(F.col("from").alias("to"), F.col("to").alias("end")), "to").select("from", F.col("end").alias("to")))
    return passed.join(hops, F.col("node") == F.col("from")).select(F.floor(F.col("landing") / STRETCH).cast("long").alias("stretch"), F.col("landing").alias("entry"))
