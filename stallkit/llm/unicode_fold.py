"""One consistent form for text that looks alike, computed on code-point arrays.

A batch's Arrow string buffer is decoded once into one array of code points. Lookup tables, made from the Unicode
database of Python by the rules below, are gathered over it: what to drop, what to replace, what expands to several
code points (written by offsets), which class each belongs to. Marks are put in canonical order and composed with the
letters before them by pair lookups over the whole array, and look-alike letters inside Latin words are replaced after
one pass that numbers the words. No step calls a function per row.

The consistent form: full-width forms of ASCII become ASCII, presentation-form ligatures their letters, every space
character the ASCII space, invisible characters are dropped, letters and marks are composed as in NFC (a composed letter
before a mark is taken apart first), look-alike letters in words with Latin letters become Latin. Line breaks, signs,
words wholly in another script stay; so do joiners and variation selectors behind a symbol, where they choose the picture.
Letters of other scripts that look like no Latin letter are flagged in words with Latin letters and stay: no table of all
confusable letters is at hand here, the one below holds those of the scripts most like Latin.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WIDE, MARK, INVISIBLE, SPACE, MIXED = 1, 2, 4, 8, 16
_NONE, _LATIN, _OTHER, _DIGIT, _JOINED = range(5)
#: Letters of other scripts and the Latin letters they look like. Fixed values.
LOOKALIKES = {
    "Cyrillic": ("АВСЕНІЈКМОРԚЅТԜХУаԁеԍһіјӏорԛѕԝхуѵ", "ABCEHIJKMOPQSTWXYadeghijlopqswxyv"),
    "Cyrillic, less alike": ("кмнтвгпиз", "kmhtbrnu3"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορτυχ", "ABEZHIKMNOPTYXayikvoptux"),
    "Armenian": ("օսհոցք", "ouhngp"),
}
_BLOCKS = [(0x300, 0x370), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100), (0xFE20, 0xFE30)]
#: Code points looked up one by one, and ranges of letters that need no look: ideographs and Hangul syllables.
_IDEOGRAPHS = [(0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2F800), (0x30000, 0x323B0)]
_LOOKED_AT = [(0, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xD7A4, 0x20000), (0x2F800, 0x30000), (0xE0000, 0xE0200)]
#: Selectors, fillers and tags: dropped too, though not told as invisible characters.
_SELECTORS = [0x115F, 0x1160, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)]
_UNSEEN = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF]


def _expansions(longer: dict[int, str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many code points each one becomes, and where they stand in the flat array of all that become several."""
    grows, at = np.ones(size, np.uint8), np.zeros(size, np.int32)
    flat: list[int] = []
    for c, s in longer.items():
        grows[c], at[c] = len(s), len(flat)
        flat += map(ord, s)
    return grows, at, np.array(flat or [0], np.uint32)


def _expand(cp: np.ndarray, row: np.ndarray, grow: np.ndarray, at: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code point as often as it grows, those that grow replaced by what they become."""
    if not (grow > 1).any():
        return cp, row
    source = np.repeat(np.arange(len(cp)), grow)
    nth = np.arange(len(source)) - np.repeat(np.cumsum(grow) - grow, grow)
    return np.where(grow[source] > 1, flat[np.minimum(at[cp[source]] + nth, len(flat) - 1)], cp[source]).astype(np.uint32), row[source]


@lru_cache(1)
def tables() -> SimpleNamespace:
    """Lookup tables over all code points."""
    size = sys.maxunicode + 1
    flag, kind, ccc = np.zeros(size, np.uint8), np.zeros(size, np.uint8), np.zeros(size, np.uint8)
    to = np.arange(size, dtype=np.uint32)
    wide: dict[int, str] = {}
    apart: dict[int, str] = {}
    picture = np.zeros(size, bool)
    pairs: dict[int, int] = {}
    for a, b in _IDEOGRAPHS:
        kind[a:b] = _OTHER
    for c in (c for a, b in _LOOKED_AT for c in range(a, b)):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat[0] == "C" and cat != "Cf":
            continue
        ccc[c] = unicodedata.combining(ch)
        picture[c] = cat == "So" or 0x1F3FB <= c <= 0x1F3FF or c == 0xFE0F
        if cat == "Nd":
            kind[c] = _DIGIT
        elif cat[0] == "L" and cat != "Lm":
            name = unicodedata.name(ch, "")
            if "LATIN " in name or c in (0xAA, 0xBA, 0x212A, 0x212B):
                kind[c] = _LATIN
            elif c not in (0xB5, 0x2126):
                kind[c] = _OTHER
        elif cat[0] == "M":
            kind[c] = _JOINED
        if cat == "Zs" and c != 0x20:
            flag[c] |= SPACE
            to[c] = 0x20
        d = unicodedata.decomposition(ch)
        if not d:
            continue
        if d[0] != "<":
            whole = unicodedata.normalize("NFC", ch)
            if whole == ch and " " in d:
                apart[c] = unicodedata.normalize("NFD", ch)
            if whole == ch and " " in d:
                a, b = (int(x, 16) for x in d.split())
                pairs[a << 21 | b] = c
            elif len(whole) == 1:
                to[c] = ord(whole)
            elif whole != ch:
                wide[c] = whole
        elif 0xFB00 <= c <= 0xFB06:
            wide[c] = unicodedata.normalize("NFKC", ch)
    for c in range(0xFF01, 0xFF5F):
        flag[c] |= WIDE
        to[c] = c - 0xFEE0
    for a, b in _BLOCKS:
        flag[a:b] |= MARK
    drop = np.zeros(size, bool)
    for c in _UNSEEN:
        flag[c] |= INVISIBLE
        drop[c] = True
    drop[_SELECTORS] = True
    joins = np.zeros(size, bool)
    joins[[0x200D, *range(0xFE00, 0xFE10)]] = True
    like = np.arange(size, dtype=np.uint32)
    for odd, plain in reversed(LOOKALIKES.values()):
        for a, b in zip(odd, plain, strict=True):
            like[ord(a)] = ord(b)
    grows, at, flat = _expansions(wide, size)
    apart_grows, apart_at, apart_flat = _expansions(apart, size)
    keys = np.array(sorted(pairs), np.int64)
    composed = np.array([pairs[k] for k in keys.tolist()], np.uint32)
    return SimpleNamespace(flag=flag, kind=kind, ccc=ccc, to=to, drop=drop, like=like, grows=grows, at=at, flat=flat, apart_grows=apart_grows, apart_at=apart_at, apart_flat=apart_flat, keys=keys, composed=composed, picture=picture, joins=joins)


def _pair(t: SimpleNamespace, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Composition of each a with each b, 0 where there is none. Hangul syllables follow by arithmetic."""
    key = a.astype(np.int64) << 21 | b
    i = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
    out = np.where(t.keys[i] == key, t.composed[i], 0).astype(np.uint32)
    lead = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
    out = np.where(lead, 0xAC00 + ((a.astype(np.int64) - 0x1100) * 21 + b - 0x1161) * 28, out)
    tail = (a >= 0xAC00) & (a < 0xD7A4) & ((a.astype(np.int64) - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
    return np.where(tail, a.astype(np.int64) + b - 0x11A7, out).astype(np.uint32)


def _compose(t: SimpleNamespace, cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition of marks; ``row`` numbers the row of each code point, which nothing crosses."""
    ccc = t.ccc[cp]
    marks = np.flatnonzero(ccc)
    starter2 = (cp >= 0x1161) & (cp < 0x11C3) | (cp >= 0x900) & (cp < 0x1100) | (cp >= 0x11000) & (cp < 0x12000)
    if not len(marks) and not starter2.any():
        return cp, row
    # A run: marks that follow each other in one row.
    if len(marks):
        fresh = np.concatenate([[True], (np.diff(marks) > 1) | (row[marks[1:]] != row[marks[:-1]])])
        run = np.cumsum(fresh) - 1
        order = np.lexsort((np.arange(len(marks)), ccc[marks], run))
        cp = cp.copy()
        cp[marks] = cp[marks[order]]
        ccc = t.ccc[cp]
        first = marks[fresh]
        length = np.bincount(run)
        base = first - 1
        ok = (base >= 0) & (row[np.maximum(base, 0)] == row[first])
        base, first, length = base[ok], first[ok], length[ok]
        gone = np.zeros(len(cp), bool)
        last = np.zeros(len(base), np.uint8)  # class of the last mark that stays
        for k in range(int(length.max()) if len(length) else 0):
            live = np.flatnonzero(length > k)
            at = first[live] + k
            free = last[live] < ccc[at]
            new = np.where(free | (last[live] == 0), _pair(t, cp[base[live]], cp[at]), 0)
            hit = new > 0
            cp[base[live[hit]]] = new[hit]
            gone[at[hit]] = True
            last[live[~hit]] = ccc[at[~hit]]
        cp, row = cp[~gone], row[~gone]
    # Letters that compose with a letter: conjoining jamo and a few vowel signs.
    while True:
        pos = np.flatnonzero((cp[1:] >= 0x900) & (t.ccc[cp[1:]] == 0) & (row[1:] == row[:-1])) if len(cp) > 1 else np.zeros(0, int)
        new = _pair(t, cp[pos], cp[pos + 1]) if len(pos) else np.zeros(0, np.uint32)
        pos, new = pos[new > 0], new[new > 0]
        if not len(pos):
            return cp, row
        keep = np.concatenate([[True], np.diff(pos) > 1])  # of touching pairs the first goes first
        while not (settled := np.concatenate([[True], (np.diff(pos[keep]) > 1)])).all():
            keep[np.flatnonzero(keep)[~settled]] = False
        cp = cp.copy()
        cp[pos[keep]] = new[keep]
        left = np.ones(len(cp), bool)
        left[pos[keep] + 1] = False
        cp, row = cp[left], row[left]


def fold_array(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The consistent form of every string, and the bits of what was odd in it. Null gives null and 0.

    Strings of ASCII and the composed letters of Latin-1 alone are in that form already; one look at the bytes finds them.
    """
    n = len(text)
    wide = text.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    # Lead bytes: 0xC3 begins the letters from U+00C0 to U+00FF, which nothing here changes where no mark follows.
    other = np.flatnonzero((data == 0xC2) | (data > 0xC3))
    rows = np.unique(np.searchsorted(offsets - offsets[0], other, "right") - 1)
    odd = np.zeros(n, np.uint8)
    if not len(rows):
        return text.cast(pa.string()), odd
    folded, odd[rows] = _fold(text.take(pa.array(rows)))
    if len(rows) == n:
        return folded, odd
    at = np.arange(n)
    at[rows] = n + np.arange(len(rows))
    return pa.concat_arrays([text.cast(pa.string()), folded]).take(pa.array(at)), odd


def _fold(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``fold_array`` of strings of any kind, all of them on code points."""
    t = tables()
    n = len(text)
    valid = text.is_valid().to_numpy(zero_copy_only=False)
    text = text.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
    if not len(data):
        return pa.array([None if not v else "" for v in valid], pa.string()), np.zeros(n, np.uint8)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    lengths = np.diff(lead[offsets - offsets[0]])
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(n), lengths)
    odd = np.zeros(n, np.uint8)
    seen = t.flag[cp]
    for bit in (WIDE, MARK, INVISIBLE, SPACE):
        odd[row[(seen & bit) > 0]] |= bit
    stay = ~t.drop[cp]
    if t.joins[cp].any():
        # What chooses a picture stays behind a symbol.
        stay[1:] |= t.joins[cp[1:]] & t.picture[cp[:-1]] & (row[1:] == row[:-1])
    cp, row = t.to[cp[stay]], row[stay]
    cp, row = _expand(cp, row, t.grows[cp].astype(np.int64), t.at, t.flat)
    # A composed letter before a mark is taken apart, so that marks meet in canonical order whatever was composed.
    marked = np.zeros(len(cp), bool)
    marked[:-1] = (t.ccc[cp[1:]] > 0) & (row[1:] == row[:-1])
    cp, row = _expand(cp, row, np.where(marked, t.apart_grows[cp], 1).astype(np.int64), t.apart_at, t.apart_flat)
    cp, row = _compose(t, cp, row)
    kind = t.kind[cp]
    inside = kind != _NONE
    if (kind == _OTHER).any():
        starts = inside & np.concatenate([[True], ~inside[:-1] | (row[1:] != row[:-1])])
        word = np.cumsum(starts) - 1
        words = int(word[-1]) + 1 if len(word) else 0
        latin = np.zeros(words + 1, bool)
        latin[word[kind == _LATIN]] = True
        mixed = (kind == _OTHER) & latin[word]
        odd[row[mixed]] |= MIXED
        cp = np.where(mixed, t.like[cp], cp)
    out = cp.astype("<u4").tobytes().decode("utf-32-le").encode()
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, weights=width, minlength=n).astype(np.int64))])
    folded = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out)])
    if not valid.all():
        folded = pc.if_else(pa.array(valid), folded, None)
    return folded.cast(pa.string()), odd


#: Rows of a batch that are decoded together; a very long text makes a batch of few rows, not a longer array.
_BYTES = 8 << 20


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + _BYTES, "right")))
        yield a, b
        a = b


def fold_text(df: DataFrame, columns: Sequence[str], suffix: str = "_folded", odd: str = "_odd") -> DataFrame:
    """``df`` with ``<column><suffix>``, its consistent form, and ``<column><odd>``, the bits of what was odd.

    Null gives null and 0, empty text stays empty. A column of ``df`` that bears a result's name is replaced.
    """
    results = {f"{c}{s}" for c in columns for s in (suffix, odd)}
    kept = [c for c in df.columns if c not in results]
    base = df.select(*[f"`{c}`" for c in kept])
    fields = [f for c in columns for f in (T.StructField(f"{c}{suffix}", T.StringType()), T.StructField(f"{c}{odd}", T.ShortType()))]
    places = [kept.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra: list[pa.Array] = []
            for p in places:
                parts = [fold_array(batch.column(p).slice(a, b - a)) for a, b in _slices(batch.column(p))] or [fold_array(batch.column(p))]
                extra.append(pa.concat_arrays([x for x, _ in parts]))
                extra.append(pa.array(np.concatenate([y for _, y in parts]).astype(np.int16)))
            yield pa.record_batch([*batch.columns, *extra], names=[*batch.schema.names, *[f.name for f in fields]])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *fields]))
