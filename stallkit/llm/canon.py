"""Free values to entries of a fixed list: a multi-pattern automaton, then token-set similarity.

Values and names are brought to one plain form. An Aho-Corasick automaton over the names and aliases of a kind finds
those that stand whole in the value; the longest wins. What has none is compared with every name of its kind by
edits (neighbouring letters swapped count once) over its words as written, turned at commas, and in sorted order;
the nearest entry counts if its edits are few for its length and no other entry is as near.
"""

from __future__ import annotations

import unicodedata
from collections import deque
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkit.llm.unicode_fold import fold_array

UNMATCHED = -1
#: The list is sent to every executor as a whole; one of more entries is refused.
MAX_ENTRIES = 100_000
#: Most edits as a share of the name's letters.
MOST = 0.34
#: Words that say which field this is, or comment on it. Fixed values.
AROUND = frozenset("marke hersteller brand marque by von de gmbh original originale zustand condition état etat rubrik kategorie category catégorie sonstiges mehr used gebraucht siehe bilder see pictures ehrlich".split())


def plain(text: str) -> str:
    """Lower-case words of letters and digits, one space between; commas stay as separators of parts."""
    t = unicodedata.normalize("NFC", text).lower()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("œ", "oe")):
        t = t.replace(a, b)
    t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    parts = [" ".join(regex.findall(r"[\p{L}\p{N}]+", p)) for p in t.split(",")]
    return ",".join(p for p in parts if p)


_AROUND = frozenset(plain(w) for w in AROUND)


class Automaton:
    """Aho-Corasick over patterns of letters and spaces; each is found where it stands as whole words."""

    def __init__(self, patterns: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.out = [0], [[]]
        for word, entry in patterns.items():
            at = 0
            for c in f" {word} ":
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.out.append([])
                at = self.next[at][c]
            self.out[at].append((len(word), entry))
        todo = deque(self.next[0].values())
        while todo:
            at = todo.popleft()
            for c, to in self.next[at].items():
                todo.append(to)
                back = self.fail[at]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[to] = self.next[back].get(c, 0)
                self.out[to] = self.out[to] + self.out[self.fail[to]]

    def longest(self, text: str) -> int | None:
        """The entry of the longest pattern in the text; None if there is none or two entries are as long."""
        at, hits = 0, set()
        for c in f" {text} ":
            while at and c not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(c, 0)
            hits.update(self.out[at])
        top = {e for n, e in hits if n == max(hits)[0]}
        return top.pop() if len(top) == 1 else None


def edits(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours being one; more than ``most`` may come out as ``most + 1``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def letters(word: str) -> np.ndarray:
    """How often each letter stands in a word; letters that share a place only make the bound drawn from it looser."""
    return np.bincount([ord(c) % 64 for c in word], minlength=64)


class Name(NamedTuple):
    entry: int
    joined: str
    ordered: str
    most: int


class Matcher:
    """The entries of one kind: ``entry_id``, ``entry_name`` and ``aliases``."""

    def __init__(self, entries: Sequence[tuple[int, str, Sequence[str]]]):
        self.exact = {name: e for e, name, _ in entries}
        spelled = [(plain(n).replace(",", " "), e) for e, name, aliases in entries for n in (name, *(aliases or ()))]
        self.automaton = Automaton(dict(spelled))
        self.names = [Name(e, j, "".join(sorted(n.split())), max(1, int(MOST * len(j)))) for n, e in spelled for j in [n.replace(" ", "")]]
        self.letters = np.stack([letters(n.joined) for n in self.names])
        self.most, self.sizes = np.array([n.most for n in self.names]), np.array([len(n.joined) for n in self.names])
        self.nearest_of = lru_cache(100_000)(self._nearest_of)

    def nearest(self, value: str) -> tuple[float, int]:
        """Least edits as a share of the name's letters, and the entry; unmatched if two are as near."""
        parts = [[w for w in p.split() if w not in _AROUND] for p in value.split(",")]
        parts = [p for p in parts if p]
        words = [w for p in parts for w in p]
        return self.nearest_of("".join(words), "".join(w for p in reversed(parts) for w in p), "".join(sorted(words))) if words else (1.0, UNMATCHED)

    def _nearest_of(self, joined: str, turned: str, ordered: str) -> tuple[float, int]:
        # No edit changes more than one letter's count up and one down, so most names need no comparison.
        apart = self.letters - letters(joined)
        least = np.maximum(apart.clip(min=0).sum(axis=1), (-apart).clip(min=0).sum(axis=1))
        best: dict[int, float] = {}
        top = 1.0
        for i in sorted(np.flatnonzero(least <= self.most), key=lambda i: least[i] / self.sizes[i]):
            n = self.names[i]
            if least[i] / len(n.joined) > top:
                break
            d = min(*(edits(f, n.joined, n.most) for f in {joined, turned}), edits(ordered, n.ordered, n.most), n.most + 1)
            if d <= n.most:
                best[n.entry] = min(best.get(n.entry, 1.0), d / len(n.joined))
                top = min(top, d / len(n.joined))
        if not best:
            return 1.0, UNMATCHED
        near = [e for e, d in best.items() if d == top]
        return top, near[0] if len(near) == 1 else UNMATCHED

    def resolve(self, value: str) -> int:
        """The entry meant by a value in consistent form."""
        p = plain(value)
        found = self.automaton.longest(p)
        if found is None:
            found = self.automaton.longest(" ".join(reversed(p.split(","))))
        return self.nearest(p)[1] if found is None else found


def resolve_values(values: DataFrame, entries: Sequence[tuple[int, str, str, Sequence[str]]]) -> DataFrame:
    """``field, value`` with the meant ``entry_id``. ``entries`` are kind, which is the field's name, and what Matcher takes."""
    kinds = {k for k, *_ in entries}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = {k: Matcher([(e, n, a) for kind, e, n, a in entries if kind == k]) for k in kinds}
        for b in batches:
            fields, folded = b.column(0).to_pylist(), fold_array(b.column(1))[0].to_pylist()
            ids = pa.array([matchers[k].resolve(v) if k in matchers else UNMATCHED for k, v in zip(fields, folded, strict=True)], pa.int32())
            yield pa.record_batch([b.column(0), b.column(1), ids], names=["field", "value", "entry_id"])

    return values.select("field", "value").mapInArrow(run, "field string, value string, entry_id int")


def meant_entries(records: DataFrame, canon: DataFrame) -> DataFrame:
    """``record_key, field, entry_id`` of every record whose value is not an entry's very name.

    Each distinct value is resolved once. Null and blank values and the condition ``unknown`` are no cases. Of a kind that
    has no entries every value is unmatched. Repeated rows give one.
    """
    rows = canon.limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the list has more than {MAX_ENTRIES} entries")
    entries = [(r.entry_kind, r.entry_id, r.entry_name, [a for a in r.aliases or () if a]) for r in rows if r.entry_kind and r.entry_name]
    names = F.array(F.lit(""), *[F.lit(f"{k}\x1f{n}") for k, _, n, _ in entries])
    blank = F.trim(F.regexp_replace("value", r"[\s\p{Z}\p{Cf}]+", " ")) == ""
    unknown = (F.col("field") == "condition") & (F.lower(F.trim("value")) == "unknown")
    cases = records.where(F.col("value").isNotNull() & ~blank & ~unknown & ~F.array_contains(names, F.concat_ws("\x1f", "field", "value"))).distinct()
    known = resolve_values(cases.select("field", "value").distinct(), entries)
    return cases.join(known, ["field", "value"]).select("record_key", "field", "entry_id")


__all__ = ["Automaton", "Matcher", "edits", "meant_entries", "plain", "resolve_values"]
