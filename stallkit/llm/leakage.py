"""Evaluation passages in a corpus, by windows of canonical templates.

Every word has a template code: numbers, names and units share a placeholder of their type, other words stand for
themselves. Twelve codes in a row are a template; the words under its placeholders are its slots. The corpus' templates
are hash-joined with the evaluation items' over whole texts, then the slots decide: the same words throughout are a
leaked passage, other words that replace the item's one for one are a question with new parameters. For the latter, runs
of placeholders of one kind are one slot, so a value of two words may stand for a value of one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallkit.session import Workspace

WINDOW = 12
#: Bits of the filter of evaluation templates that goes to every executor: 16 MB, whatever the evaluation set. A set of
#: very many templates only makes the filter pass more windows on to the join.
FILTER_BITS = 1 << 27
_BUCKET = 1 << 15
#: Different words of evaluation texts that are sent to every executor; a larger set is refused.
MAX_LEXICON = 4_000_000
#: Words of a template that stand for themselves, for the template to say anything of a question with other values.
LEAST_PLAIN = 6
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_SENTENCE = regex.compile(r"(?<=[.!?])\s+")
_UNSEEN = dict.fromkeys([0xAD, *range(0x200B, 0x2010), *range(0x2060, 0x2065), 0xFEFF])
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BASE = np.uint64(0x100000001B3)


def plain(text: str) -> str:
    """Text without regard to case, full-width forms and invisible characters."""
    return unicodedata.normalize("NFKC", text.translate(_UNSEEN)).lower()


class Codes:
    """Codes of words in one worker: ``exact``, and ``template``, which is one of three placeholders or the exact one."""

    def __init__(self, common: frozenset[str], units: frozenset[str]):
        self.common, self.units, self.cache = common, units, {}

    def of(self, word: str) -> tuple[int, int]:
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 1 << 18:
                self.cache.clear()
            exact = xxhash.xxh64_intdigest(word)
            if any(c.isnumeric() for c in word):
                kind = int(_NUM)
            elif word in self.units:
                kind = int(_UNIT)
            elif word in self.common:
                kind = exact
            else:
                kind = int(_NAME)
            got = self.cache[word] = (exact, kind)
        return got


_LOWER, _INSIDE, _FIRST, _AFTER = 1, 2, 4, 8


def _seen_as(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How words stand in texts: in lower case, capitalised inside a sentence or first in it, after a number."""
    for batch in batches:
        seen: dict[str, int] = {}
        for text in batch.column(0).to_pylist():
            for sentence in _SENTENCE.split(unicodedata.normalize("NFKC", text.translate(_UNSEEN))) if text else ():
                words = _WORD.findall(sentence)
                for i, w in enumerate(words):
                    if w[0].isupper():
                        bit = _INSIDE if i else _FIRST
                    else:
                        bit = _LOWER | (_AFTER if i and words[i - 1].isnumeric() else 0)
                    seen[w.lower()] = seen.get(w.lower(), 0) | bit
        yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int32())], names=["word", "bits"])


def lexicon(items: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Common words and units of the evaluation texts.

    Common is a word that also stands in lower case, or begins a sentence and is never capitalised inside one. A unit is
    a common word that follows a number.
    """
    rows = items.select(F.col("text").cast("string").alias("text")).mapInArrow(_seen_as, "word string, bits int").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = rows.limit(MAX_LEXICON + 1).collect()
    if len(found) > MAX_LEXICON:
        raise ValueError(f"the evaluation texts have more than {MAX_LEXICON} different words")
    common = {r.word for r in found if r.bits & _LOWER or r.bits & (_FIRST | _INSIDE) == _FIRST}
    return frozenset(common), frozenset(r.word for r in found if r.bits & _AFTER and r.word in common)


def _hashes(code: np.ndarray) -> np.ndarray:
    """Polynomial hash of every window of ``code``."""
    n = len(code) - WINDOW + 1
    h = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WINDOW if n > 0 else 0):
            h = h * _BASE + code[j : j + n]
    return h


def _collapsed(words: list[str], codes: Codes) -> tuple[list[int], list[str | None]]:
    """Template codes of a text with runs of one placeholder as one, and the words under each, None under plain words."""
    kinds: list[int] = []
    slots: list[str | None] = []
    for w in words:
        exact, kind = codes.of(w)
        if exact == kind:
            kinds.append(kind)
            slots.append(None)
        elif kinds and slots[-1] is not None and kinds[-1] == kind:
            slots[-1] = f"{slots[-1]} {w}"
        else:
            kinds.append(kind)
            slots.append(w)
    return kinds, slots


def _window_job(key: str, codes_of, wanted_of, collapse: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, wanted = codes_of(), wanted_of()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                words: list[list[str]] = [_WORD.findall(plain(t)) if t else [] for t in part.column(1).to_pylist()]
                if collapse:
                    made = [_collapsed(w, codes) for w in words]
                    kinds = np.array([k for m in made for k in m[0]], np.uint64)
                    slots = [m[1] for m in made]
                    exact = None
                else:
                    pairs = np.array([codes.of(x) for w in words for x in w], np.uint64).reshape(-1, 2)
                    kinds, exact, slots = pairs[:, 1], pairs[:, 0], words
                lengths = np.array([len(x) for x in slots], np.int64)
                row = np.repeat(np.arange(len(slots)), lengths)
                place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                template = _hashes(kinds)
                n = len(template)
                at = np.flatnonzero(row[:n] == row[WINDOW - 1 : WINDOW - 1 + n]) if n else np.zeros(0, np.int64)
                if wanted is not None and len(at):
                    bit = (template[at] % np.uint64(FILTER_BITS)).astype(np.int64)
                    at = at[(wanted[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0]
                cols = [part.column(0).take(pa.array(row[at])), pa.array(template[at].astype(np.int64))]
                if collapse:
                    filled = [[s for s in slots[r][p : p + WINDOW] if s is not None] for r, p in zip(row[at], place[at], strict=True)]
                    keep = [i for i, f in enumerate(filled) if WINDOW - len(f) >= LEAST_PLAIN]
                    cols = [c.take(pa.array(keep, pa.int64())) for c in cols]
                    cols.append(pa.array([filled[i] for i in keep], pa.list_(pa.string())))
                else:
                    # The words under placeholders, in order; others are in the template.
                    under = _hashes(np.where(exact == kinds, np.uint64(1), exact))
                    cols.append(pa.array(under[at].astype(np.int64)))
                yield pa.record_batch(cols, names=[key, "template", "slots"])

    return run


def windows(df: DataFrame, key: str, text: str, words: tuple[frozenset[str], frozenset[str]], wanted: np.ndarray | None = None, collapse: bool = False) -> DataFrame:
    """``key, template, slots`` of the windows of every whole text; ``slots`` is a hash of the words under placeholders.

    ``collapse`` takes runs of a placeholder as one and gives the slots' words; templates of under ``LEAST_PLAIN`` plain
    words are left out then. ``wanted`` is a bitmap of template hashes; others are left out. Null texts and those of under
    twelve words give none.
    """
    sc = df.sparkSession.sparkContext
    lex, want = sc.broadcast(words), sc.broadcast(wanted)
    rows = df.select(F.col(key), F.col(text).cast("string").alias("t"))
    schema = rows.select(key).schema.add("template", "long").add("slots", T.ArrayType(T.StringType()) if collapse else T.LongType())
    return rows.mapInArrow(_window_job(key, lambda: Codes(*lex.value), lambda: want.value, collapse), schema)


def template_bits(item_windows: DataFrame) -> np.ndarray:
    """Bitmap of the templates' hashes, put together from bitmaps of 4 KB: ``FILTER_BITS`` bits whatever the input."""
    # The hash as an unsigned number modulo a power of two is its lower bits.
    bit = F.col("template").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = item_windows.select(F.shiftright(bit, 15).alias("b"), bit.bitwiseAND(F.lit(_BUCKET - 1)).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    out = np.zeros(FILTER_BITS >> 3, np.uint8)
    for r in rows:
        out[r.b * (_BUCKET >> 3) : (r.b + 1) * (_BUCKET >> 3)] = np.frombuffer(bytes(r.m), np.uint8)
    return out


def template_joined(documents: DataFrame, items: DataFrame, collapse: bool) -> tuple[DataFrame, DataFrame]:
    """Windows of items and of documents whose templates are an item's: ``template, slots`` with item_id, and with doc_id and ``doc_slots``."""
    lex = lexicon(items)
    item_windows = Workspace(documents.sparkSession, "leakage").cut(windows(items, "item_id", "text", lex, collapse=collapse).distinct(), "items")
    return item_windows, windows(documents, "doc_id", "text", lex, template_bits(item_windows), collapse).withColumnRenamed("slots", "doc_slots")


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of every document and item that share twelve consecutive words or more.

    Templates meet first, then the words in their slots must be the same. Null texts share nothing. Copies of a document
    are documents of their own; repeated rows give one result.
    """
    a, b = template_joined(documents, items, False)
    same = (a["template"] == b["template"]) & (a["slots"] == b["doc_slots"])
    return b.join(a, same).select("doc_id", "item_id").distinct()


def reparameterised(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_windows``: items of which a document holds a template with other values in its slots.

    In a window equal slots stay equal and different ones different (its pairs of slots are as many as its different
    slots on either side). ``n_windows`` is the number of the item's templates so found, which says how sure it is. A
    document and item that share a window word for word are leaked and left out.
    """
    a, b = template_joined(documents, items, True)
    both = b.join(a, "template")
    pairs = F.arrays_zip(F.col("slots").alias("a"), F.col("doc_slots").alias("b"))
    n = F.size(F.array_distinct(pairs))
    fits = (n == F.size(F.array_distinct("slots"))) & (n == F.size(F.array_distinct("doc_slots")))
    same = F.col("slots") == F.col("doc_slots")
    seen = both.filter(fits).groupBy("doc_id", "item_id").agg(F.count_distinct("template").alias("n_windows"), F.max(same.cast("int")).alias("same"))
    return seen.filter(F.col("same") == 0).select("doc_id", "item_id", "n_windows")
