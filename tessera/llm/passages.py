"""Substring dedup with repeated-phrase automata."""

from __future__ import annotations

from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import framed, unframed
from tessera.llm.common import give_back, ngram_hashes, packed, partitions, text_slices, unpacked, word_hashes

#: Words of a window, and of the phrase by which windows are found.
WINDOW, PHRASE = 13, 5
#: Windows of a segment at the most; longer runs are cut.
SEGMENT = 32


def _zip(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).tobytes())


def _unzip(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def anchors(words: np.ndarray) -> np.ndarray:
    """For each window of a text its anchor: the least hash of the phrases inside, with the lowest bit cleared.

    Equal windows have equal anchors, and neighbouring windows mostly share theirs, so one value stands for about five
    windows."""
    g = ngram_hashes(words, PHRASE) & ~np.uint64(1)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = g[:n].copy()
    for k in range(1, WINDOW - PHRASE + 1):
        np.minimum(out, g[k : k + n], out=out)
    return out


def _documents(rows: pa.Table | None):
    """(doc_id, raw text, word hashes) of the rows with an id."""
    if rows is None:
        return
    ids = rows.column("doc_id").to_pylist()
    for chunk_ids, part in _chunks(ids, rows.column("text")):
        hashes, first, _, _ = word_hashes(part)
        for k, doc in enumerate(chunk_ids):
            if doc is not None:
                yield doc, part, k, hashes[first[k] : first[k + 1]]


def _chunks(ids: list, texts: pa.ChunkedArray):
    whole = pa.concat_arrays([c.cast(pa.large_string()) for c in texts.chunks]).fill_null("").cast(pa.large_binary())
    for a, part in text_slices(whole):
        yield ids[a : a + len(part)], part


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of runs of equal values, at most SEGMENT long."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    ends = np.append(starts[1:], len(values))
    if (ends - starts).max() > SEGMENT:
        starts = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(starts, ends, strict=True)])
        ends = np.append(starts[1:], len(values))
    return starts, ends


def _group_anchors(rows: pa.Table | None) -> np.ndarray:
    """The distinct anchors of a group of documents; the lowest bit says whether several documents have it."""
    found, owner = [], []
    for doc, _, _, words in _documents(rows):
        x = np.unique(anchors(words))
        found.append(x)
        owner.append(np.full(len(x), doc, np.int64))
    if not found:
        return np.zeros(0, np.uint64)
    x, d = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((d, x))
    x, d = x[order], d[order]
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    last = np.append(begin[1:], len(x)) - 1
    return x[begin] | (d[begin] != d[last]).astype(np.uint64) if len(x) else x


def _slots(x: np.ndarray, n: int) -> np.ndarray:
    return ((x >> np.uint64(1)) % np.uint64(n)).astype(np.int64)


def _by_slot(x: np.ndarray, n: int):
    slot = _slots(x, n)
    order = np.argsort(slot, kind="stable")
    cuts = np.flatnonzero(np.diff(slot[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(slot[part[0]]), part


def _recurring(asked: list[np.ndarray]) -> list[np.ndarray]:
    """Of the anchors that groups of documents have, those that several documents have."""
    flat = np.concatenate(asked)
    value, several = flat & ~np.uint64(1), (flat & np.uint64(1)).astype(bool)
    names, at, n = np.unique(value, return_inverse=True, return_counts=True)
    many = n > 1
    many[at[several]] = True
    keep = many[at]
    ends = np.cumsum([len(x) for x in asked])
    return [value[a:b][keep[a:b]] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _segments(rows: pa.Table | None, recurring: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, anchors, places of the anchor's phrase, least ids, greatest ids) of the distinct segments of a group:
    runs of windows with one recurring anchor."""
    seen: dict[bytes, list] = {}
    for doc, part, k, words in _documents(rows):
        x = anchors(words)
        if not len(x):
            continue
        at = np.minimum(np.searchsorted(recurring, x), len(recurring) - 1)
        if not (hit := recurring[at] == x).any():
            continue
        starts, ends = _runs(x)
        keep = hit[starts]
        phrases = ngram_hashes(words, PHRASE) & ~np.uint64(1)
        text = part[k].as_py().split()
        for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
            segment = b" ".join(text[a : b + WINDOW - 1])
            if (known := seen.get(segment)) is None:
                seen[segment] = [int(x[a]), int(np.argmax(phrases[a : a + WINDOW - PHRASE + 1] == x[a])), doc, doc]
            elif doc < known[2]:
                known[2] = doc
            elif doc > known[3]:
                known[3] = doc
    texts = list(seen)
    columns = list(zip(*seen.values(), strict=True)) or [(), (), (), ()]
    return texts, np.array(columns[0], np.uint64), np.array(columns[1], np.int32), np.array(columns[2], np.int64), np.array(columns[3], np.int64)


class _Confirmed:
    """The windows of one slot: for each, the least and the greatest id of the documents that hold it, text by text."""

    def __init__(self) -> None:
        self.segments: dict[bytes, list] = {}
        self.windows: dict[bytes, list] = {}
        self.lows: dict[bytes, np.ndarray] = {}

    def add(self, segment: bytes, low: int, high: int) -> None:
        if (known := self.segments.get(segment)) is None:
            self.segments[segment] = [low, high]
        else:
            known[0], known[1] = min(known[0], low), max(known[1], high)

    def settle(self) -> None:
        for segment, (low, high) in self.segments.items():
            for w in _windows(segment):
                if (known := self.windows.get(w)) is None:
                    self.windows[w] = [low, high]
                else:
                    known[0], known[1] = min(known[0], low), max(known[1], high)
        for segment in self.segments:
            self.lows[segment] = np.array([self.windows[w][0] for w in _windows(segment)], np.int64)


def _windows(segment: bytes) -> list[bytes]:
    words = segment.split(b" ")
    n = len(words) - WINDOW + 1
    return [segment] if n == 1 else [b" ".join(words[k : k + WINDOW]) for k in range(n)]


def _passages(segment: bytes, place: int, low: np.ndarray, high: int):
    """(text, place of the phrase, least ids of its windows) of the runs of windows that a smaller document than the
    greatest one of a group holds."""
    held = low < high
    if not held.any():
        return
    words = segment.split(b" ")
    edges = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]]).astype(np.int8)))
    phrase = words[place : place + PHRASE]
    for a, b in edges.reshape(-1, 2).tolist():
        at = place
        while at < a or (words[at : at + PHRASE] != phrase and at < b):  # every window holds it, unless hashes collide
            at += 1
        yield b" ".join(words[a : b + WINDOW - 1]), at - a, low[a:b]


class _Automaton:
    """An Aho-Corasick automaton over the phrases of the passages that a group of documents can hold."""

    def __init__(self, texts: list[bytes], places: np.ndarray, lows: list[np.ndarray]):
        self.machine = ahocorasick.Automaton()
        phrases: dict[str, list] = {}
        for text, place, low in zip(texts, places.tolist(), lows, strict=True):
            words = text.split(b" ")
            before = len(b" ".join(words[:place])) + (place > 0)
            phrase = (b" " + b" ".join(words[place : place + PHRASE]) + b" ").decode("latin-1")
            phrases.setdefault(phrase, []).append((b" " + text + b" ", before, place, int(low.max()), low))
        for phrase, found in phrases.items():
            self.machine.add_word(phrase, (len(phrase), found))
        if phrases:
            self.machine.make_automaton()
        self.empty = not phrases

    def removed(self, joined: bytes, words: int, doc: int) -> np.ndarray | None:
        """Which words of a text, its words with a space around each, lie in a window that a smaller document holds."""
        if self.empty or words < WINDOW:
            return None
        spaces, edge = None, None
        for end, (length, found) in self.machine.iter(joined.decode("latin-1")):
            begin = end - length + 1
            for text, before, place, most, low in found:
                if begin >= before and joined.startswith(text, begin - before):
                    if edge is None:
                        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
                        edge = np.zeros(words + 1, np.int64)
                    word = int(np.searchsorted(spaces, begin)) - place
                    if most < doc:
                        edge[word] += 1
                        edge[word + len(low) + WINDOW - 1] -= 1
                    else:
                        for k in np.flatnonzero(low < doc).tolist():
                            edge[word + k] += 1
                            edge[word + k + WINDOW] -= 1
        return None if edge is None else np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with `n_words`, `n_removed` and `kept_text`: the words of each text, joined by one space, without those
    that lie in a window of 13 words which also starts in a document with a smaller id.

    Documents are dealt into groups. Each group sends the anchors of its windows to slots by value and learns which
    recur; of those it sends the segments of text to the slots, where their windows are confirmed word by word and the
    least document of each is found. The passages that recur come back to each group that holds them, which compiles
    its automaton over their phrases and streams its documents through it; a hit counts where the passage stands around
    it. A passage in a third of all documents is one row for each group at every step.

    Null and empty texts have no words. Rows without an id keep all words and make no others go; rows that share an id
    are one document to each other. An empty table gives no rows; columns of these three names are replaced."""
    n = partitions(docs.sparkSession)
    slots, deals = n, 4 * n
    docs = docs.drop("n_words", "n_removed", "kept_text")
    names = docs.columns
    rows = packed(docs, F.pmod(F.xxhash64(F.col("doc_id"), F.xxhash64("text")), F.lit(deals)).cast("int"), deals)

    def ask(key, blocks):
        found = _group_anchors(unpacked(blocks))
        out = [(k, key[0].as_py(), found[part].tobytes()) for k, part in _by_slot(found, slots)]
        return _table(out, ("slot", pa.int32()), ("gid", pa.int32()), ("anchors", pa.binary()))

    def recur(key, asked):
        found = _recurring([np.frombuffer(x, np.uint64) for x in asked.column("anchors").to_pylist()])
        out = [(g, x.tobytes()) for g, x in zip(asked.column("gid").to_pylist(), found, strict=True) if len(x)]
        return _table(out, ("gid", pa.int32()), ("anchors", pa.binary()))

    def send(blocks, answers):
        if not answers.num_rows or not blocks.num_rows:
            return _table([], ("slot", pa.int32()), ("gid", pa.int32()), *_SEGMENT_COLUMNS)
        recurring = np.sort(np.frombuffer(b"".join(answers.column("anchors").to_pylist()), np.uint64))
        texts, values, places, low, high = _segments(unpacked(blocks), recurring)
        gid = blocks.column("gid")[0].as_py()
        out = [(k, gid, framed([texts[i] for i in part.tolist()]), _zip(places[part]), _zip(low[part]), _zip(high[part])) for k, part in _by_slot(values, slots)]
        return _table(out, ("slot", pa.int32()), ("gid", pa.int32()), *_SEGMENT_COLUMNS)

    def confirm(key, sent):
        held = [(r["gid"], unframed(r["texts"]), _unzip(r["places"], "<i4"), _unzip(r["low"], "<i8"), _unzip(r["high"], "<i8")) for r in sent.to_pylist()]
        known = _Confirmed()
        for _, texts, _, low, high in held:
            for x in zip(texts, low.tolist(), high.tolist(), strict=True):
                known.add(*x)
        known.settle()
        out = []
        for gid, texts, places, _, high in held:
            found = [p for t, place, h in zip(texts, places.tolist(), high.tolist(), strict=True) for p in _passages(t, place, known.lows[t], h)]
            if found:
                passages, at, lows = zip(*found, strict=True)
                out.append((gid, framed(list(passages)), _zip(np.array(at, np.int32)), _zip(np.array([len(x) for x in lows], np.int32)), _zip(np.concatenate(lows))))
        del known, held
        give_back()
        return _table(out, ("gid", pa.int32()), *_PASSAGE_COLUMNS)

    def locate(blocks, passages):
        texts, places, lows = [], [np.zeros(0, np.int32)], []
        for r in passages.to_pylist():
            texts += unframed(r["texts"])
            places.append(_unzip(r["places"], "<i4"))
            lows += np.split(_unzip(r["low"], "<i8"), np.cumsum(_unzip(r["windows"], "<i4"))[:-1])
        machine = _Automaton(texts, np.concatenate(places), lows)
        found = unpacked(blocks)
        counts, removed, kept = [], [], []
        for doc, text in zip(found.column("doc_id"), found.column("text"), strict=True) if found is not None else []:
            words = (text.as_py() or "").encode().split()
            joined = b" " + b" ".join(words) + b" "
            gone = machine.removed(joined, len(words), doc.as_py()) if doc.is_valid else None
            counts.append(len(words))
            removed.append(0 if gone is None else int(gone.sum()))
            kept.append((joined[1:-1] if gone is None else b" ".join(compress(words, (~gone).tolist()))).decode())
        del machine, texts, lows
        give_back()
        more = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
        return pa.table([*([] if found is None else found.columns), *more], names=[*([] if found is None else names), "n_words", "n_removed", "kept_text"])

    asked = rows.groupBy("gid").applyInArrow(ask, "slot int, gid int, anchors binary")
    recurring = asked.groupBy("slot").applyInArrow(recur, "gid int, anchors binary")
    sent = rows.groupBy("gid").cogroup(recurring.groupBy("gid")).applyInArrow(send, "slot int, gid int, texts binary, places binary, low binary, high binary")
    passages = sent.groupBy("slot").applyInArrow(confirm, "gid int, texts binary, places binary, windows binary, low binary")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_words bigint, n_removed bigint, kept_text string"])
    return rows.groupBy("gid").cogroup(passages.groupBy("gid")).applyInArrow(locate, schema)


_SEGMENT_COLUMNS = (("texts", pa.binary()), ("places", pa.binary()), ("low", pa.binary()), ("high", pa.binary()))
_PASSAGE_COLUMNS = (("texts", pa.binary()), ("places", pa.binary()), ("windows", pa.binary()), ("low", pa.binary()))


def _table(rows: list[tuple], *columns: tuple[str, pa.DataType]) -> pa.Table:
    values = list(zip(*rows, strict=True)) or [()] * len(columns)
    return pa.table({name: pa.array(x, kind) for (name, kind), x in zip(columns, values, strict=True)})
