"""Stretches of texts that may be a term: texts become codes of letters, a rolling hash tells which stretches are looked
up, and those whose hash no term has are left out. What is given is met with the terms by a join, which settles it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.functions.text import _plain_letters

#: How a stretch came about: a word of the text, or letters that single ones or words in letters spell; the latter if they
#: are few; letters anywhere; letters and their spaces anywhere. The last two are beginnings by which letters anywhere are
#: looked for first.
STRICT, LOOSE, INSIDE, SPACED, *BEGIN = range(6)
#: So many letters are few.
SHORT = 3
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
#: Rows are taken together up to so many characters, and hashed as many at a time.
BLOCK = 1 << 18
#: Of the characters below this one some become letters, or are no break; none of those above does.
_LAST = 0x2200
_DROPPED = 255
_DIGIT, _ACCENTED, _BETWEEN = 27, 28, 29

_BASE = 0x9E3779B97F4A7C15
_MOST = BLOCK + 4096
_POWERS = np.full(_MOST + 1, _BASE, np.uint64)
_BACK = np.full(_MOST + 1, pow(_BASE, -1, 1 << 64), np.uint64)
_POWERS[0] = _BACK[0] = 1
np.multiply.accumulate(_POWERS, out=_POWERS)
np.multiply.accumulate(_BACK, out=_BACK)
_VALUES = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA0761D6478BD642F)
_KINDS = np.array([pow(0xBF58476D1CE4E5B9, 2 * k + 1, 1 << 64) for k in range(6)], np.uint64)
_BYTES = np.frombuffer(("?" + LETTERS).encode(), np.uint8)
_CODES = np.zeros(256, np.uint8)
_CODES[_BYTES[1:]] = np.arange(1, len(_BYTES))


def _tables(lookalikes: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each character: the code of the letter or digit that it is unmasked (0: none, it parts words); and as it stands,
    a letter's code, a digit, an accented letter, what may stand between letters, or 0."""
    plain, seen = dict(zip(*_plain_letters(), strict=True)), dict(zip(*lookalikes, strict=True))
    unmasked, standing = np.zeros(_LAST, np.uint8), np.zeros(_LAST, np.uint8)
    for c in range(_LAST):
        low = chr(c).lower()
        if len(low) > 1:  # the dotted capital I, which is taken apart beforehand
            continue
        bare = plain.get(low, low)
        bare = seen.get(bare, bare)
        unmasked[c] = _DROPPED if "̀" <= bare <= "ͯ" else LETTERS.find(bare) + 1 if bare != " " else 0
        if "a" <= low <= "z":
            standing[c] = ord(low) - 96
        elif "0" <= low <= "9":
            standing[c] = _DIGIT
        elif "à" <= low <= "ÿ":
            standing[c] = _ACCENTED
        elif low in " \t\n\x0b\f\r.-_@*":
            standing[c] = _BETWEEN
    return unmasked, standing


class _Codes:
    """Codes of letters with the rows that they are from, and hashes of the block last asked for."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray, most: int):
        self.codes, self.rows, self.most, self.lo, self.held = codes, rows, most, -1, None

    def block(self, lo: int) -> _Sums:
        if lo != self.lo:
            self.lo, self.held = lo, _Sums(self.codes[lo : lo + BLOCK + self.most])
        return self.held


class _Sums:
    """Hashes of any stretches of a block of codes."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.powers, self.back = _POWERS, _BACK
        if n > _MOST:  # terms longer than usual
            self.powers, self.back = (np.concatenate([x[:1], np.multiply.accumulate(np.full(n, x[1], np.uint64))]) for x in (_POWERS, _BACK))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[codes] * self.powers[:n], out=self.sums[1:])

    def of(self, at: np.ndarray, long: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + long] - self.sums[at]) * self.back[at]

    def each(self, long: int) -> np.ndarray:
        return (self.sums[long:] - self.sums[:-long]) * self.back[: len(self.sums) - long]


def _bucket(h: np.ndarray, how: int | np.ndarray, bits: int) -> np.ndarray:
    return ((h * _KINDS[how]) >> np.uint64(64 - bits)).view(np.int64)


def buckets(bits: int):
    """For mapInArrow: (bucket) of terms (how, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [k.encode() for k in batch.column(1).to_pylist()]
            how, sizes = batch.column(0).to_numpy(), np.array([len(k) for k in raw], np.int64)
            ends = np.cumsum(sizes)
            codes = _CODES[np.frombuffer(b"".join(raw), np.uint8)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bucket(_Sums(codes).of(ends - sizes, sizes), how, bits)))], ["bucket"])

    return run


def stretches(held: np.ndarray, bits: int, lengths: dict[int, list[int]], begins: tuple[int, int], lookalikes: tuple[str, str]):
    """For mapInArrow: (row_key, how, key) of texts (row_key, x): each stretch that may be a term, once for each row.

    held: whether a bucket has terms. lengths: how long the terms of each kind are. begins: by how many letters those that
    stand anywhere are looked for first, from the shorter to the longer."""
    tables = _tables(lookalikes)
    longest = {how: max(ns) for how, ns in lengths.items() if ns}
    word, most = max(longest.get(STRICT, 0), longest.get(LOOSE, 0)), max(longest.values(), default=0)

    def hits(x: _Codes, strict: bool, at: np.ndarray, long: np.ndarray) -> Iterator[tuple]:
        """Of stretches that begin at ascending places, those that may be words."""
        fits = long <= word
        at, long = at[fits], long[fits]
        for lo in range(0, len(x.codes), BLOCK):
            a, b = np.searchsorted(at, (lo, lo + BLOCK))
            if a < b:
                how = (LOOSE * (long[a:b] <= SHORT)).astype(np.int8) if not strict else np.full(b - a, STRICT, np.int8)
                may = held[_bucket(x.block(lo).of(at[a:b] - lo, long[a:b]), STRICT if strict else how, bits)]
                yield x, how[may], at[a:b][may], long[a:b][may]

    def anywhere(x: _Codes, ends: np.ndarray, how: int, seeded: bool) -> Iterator[tuple]:
        """Of stretches anywhere within a row, those that may be phrases."""
        for lo in range(0, len(x.codes) if how in longest else 0, BLOCK):
            sums, left = x.block(lo), ends[x.rows[lo : lo + BLOCK] + 1] - np.arange(lo, min(len(x.codes), lo + BLOCK))
            at = np.arange(len(left))
            for k, begin in enumerate(begins if seeded else (1,)):
                wanted = [n for n in lengths[how] if not seeded or (n >= begin and (k or n < begins[1]))]
                if seeded and not k:
                    at = np.flatnonzero(held[_bucket(sums.each(begin)[: len(left)], BEGIN[0], bits)]) if len(sums.sums) > begin else at[:0]
                elif seeded:
                    at = at[left[at] >= begin]
                    at = at[held[_bucket(sums.of(at, begin), BEGIN[1], bits)]]
                for n in wanted:
                    within = at[left[at] >= n]
                    may = within[held[_bucket(sums.of(within, n), how, bits)]] + lo
                    yield x, np.full(len(may), how, np.int8), may, np.full(len(may), n)

    def unmasked(points: np.ndarray, row: np.ndarray, count: int) -> Iterator[tuple]:
        u = tables[0][points]
        kept = u != _DROPPED
        u, row = u[kept], row[kept]
        letter = u > 0
        after = np.concatenate([[False], letter[:-1]])  # whether a letter stands before
        codes, rows = u[letter], row[letter]
        ends = np.searchsorted(rows, np.arange(count + 1))
        at = np.flatnonzero((letter & ~after)[letter])
        long = np.diff(np.append(at, len(codes)))
        x = _Codes(codes, rows, most)
        yield from hits(x, True, at, long)
        # words of single letters in a row
        one = np.concatenate([[False], long == 1, [False]])
        new = np.concatenate([[True], np.diff(rows[at]) != 0, [True]])
        first = np.flatnonzero(one[1:-1] & (~one[:-2] | new[:-1]))
        last = np.flatnonzero(one[1:-1] & (~one[2:] | new[1:]))
        yield from hits(x, False, at[first], np.where(last > first, last - first + 1, 1 << 40))
        sizes = np.diff(ends)
        whole = (sizes > 0) & (sizes <= SHORT)
        yield from hits(x, False, ends[:-1][whole], sizes[whole])
        yield from anywhere(x, ends, INSIDE, True)
        if SPACED in longest:
            spaced = letter | after
            codes, rows = np.where(letter, u, len(LETTERS))[spaced], row[spaced]
            yield from anywhere(_Codes(codes, rows, most), np.searchsorted(rows, np.arange(count + 1)), SPACED, False)

    def spelled(points: np.ndarray, row: np.ndarray) -> Iterator[tuple]:
        """Letters from where a word may begin to where one may end, over what may stand between letters."""
        k = tables[1][points]
        letter, solid = (k > 0) & (k < _DIGIT), (k > 0) & (k < _BETWEEN)
        x = _Codes(k[letter], row[letter], most)
        part = np.cumsum((k == 0) | (k == _ACCENTED), dtype=np.int32)[letter]
        begin = np.flatnonzero(~np.concatenate([[False], solid[:-1]])[letter])
        end = np.flatnonzero(~np.concatenate([solid[1:], [False]])[letter])
        stop = np.searchsorted(part, part[begin], "right")
        nth = np.searchsorted(end, begin)
        while True:
            inside = nth < len(end)
            begin, stop, nth = begin[inside], stop[inside], nth[inside]
            inside = (end[nth] < stop) & (end[nth] - begin < word)
            begin, stop, nth = begin[inside], stop[inside], nth[inside]
            if not len(begin):
                return
            yield from hits(x, False, begin, end[nth] - begin + 1)
            nth = nth + 1

    def found(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        points = np.frombuffer(("|".join(texts) + "|").encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.minimum(points, _LAST - 1)
        row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
        rows, hows, sizes, keys = [], [], [], []
        for source in (unmasked(points, row, len(texts)), spelled(points, row)):
            for x, how, at, long in source:
                if len(at):
                    begins_ = np.cumsum(long) - long
                    keys.append(_BYTES[x.codes[np.repeat(at - begins_, long) + np.arange(int(long.sum()))]])
                    rows.append(x.rows[at])
                    hows.append(how)
                    sizes.append(long)
        if not rows:
            return None
        row, how, offsets = np.concatenate(rows), np.concatenate(hows), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        strings = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.concatenate(keys))).dictionary_encode()
        number, names = strings.indices.to_numpy(), strings.dictionary
        once = np.unique((row.astype(np.int64) * 8 + how) * len(names) + number, return_index=True)[1]
        return row[once], how[once], pc.cast(names.take(pa.array(number[once])), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.cast(batch.column(1), pa.large_binary())
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < len(sizes):
                hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:] + 1), BLOCK, "right")))
                got = found([(t or b"").decode("utf-8", "replace").replace("İ", "i̇") for t in column.slice(lo, hi - lo).to_pylist()])
                if got is not None:
                    row, how, names = got
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)), pa.array(how), names], ["row_key", "how", "key"])
                lo = hi

    return run
