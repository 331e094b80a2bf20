"""Reading level of documents by label propagation over a document-word graph.

A document is linked to each of its words; the link's weight is the word's share in its sentences, every sentence
counting alike. Graded documents are clamped to the median of their gradings. In turn a word takes the weighted mean of
its documents and a document the weighted mean of its words (a harmonic step on the bipartite graph), where a word that
stands in documents of very different levels counts less. Plain harmonic values shrink towards the mean, so after each
step the scale is stretched again: the medians of the graded documents' own, unclamped values are put back to the
levels they are graded with. Steps go on until the words' values settle.

Words are hashed into a space of fixed size, so their values are an array of bounded size: each step sends it to the
executors, every partition adds up its documents' part of the next one, and parts are summed by a shuffle. No step
gathers documents or links.
"""

from __future__ import annotations

import unicodedata
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkit.session import Workspace

#: Size of the word space; two arrays of so many doubles are sent to executors each step.
SPACE = 1 << 18
#: Far more steps than any input seen needs; whoever reaches it is told.
MOST_ROUNDS = 200
SETTLED = 2e-3
#: Weight of an ungraded document against a graded one.
UNGRADED = 0.1
LEAST_WORDS = 40
#: Share of a sentence's weight that goes to two nodes for its shape, its number of words and their mean length. They
#: tie languages and rare words to the graded documents.
SHAPE = 0.5
_BINS = 2048
#: Mean word lengths from this many half letters on are one shape; words a worker remembers.
_LONG, _CACHE = 400, 1 << 18
_WORD = regex.compile(r"[^\W\d_]+")
_SENTENCE = regex.compile(r"[.!?\n;]+")


class Linker:
    """Links of documents in one worker; places of words seen before come from a cache, which is emptied when full."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}
        # Places of the shapes: sentences of up to 42 words in steps of three, mean word lengths in half letters.
        self.words = np.array([place(f"#words {i}") for i in range(15)], np.int64)
        self.letters = np.array([place(f"#letters {i}") for i in range(_LONG)], np.int64)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of each text's links, and the links' places and weights; a text's weights add up to 1 if it has words."""
        flat: list[str] = []
        lengths: list[int] = []
        owner: list[int] = []
        for i, text in enumerate(texts):
            plain = unicodedata.normalize("NFKC", text).lower()
            sentences = [s for s in map(_WORD.findall, _SENTENCE.split(plain)) if len(s) > 1] or [s for s in [_WORD.findall(plain)] if s]
            for s in sentences:
                flat += s
                lengths.append(len(s))
                owner.append(i)
        if len(self.places) > _CACHE:
            self.places.clear()
        places = self.places
        for w in set(flat).difference(places):
            places[w] = place(w)
        n, doc = np.array(lengths, np.int64), np.array(owner, np.int64)
        each = 1.0 / np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        sentence = np.repeat(np.arange(len(n)), n)
        at = np.fromiter((places[w] for w in flat), np.int64, len(flat))
        letters = np.bincount(sentence, np.fromiter(map(len, flat), np.int64, len(flat)), len(n)) if len(n) else np.zeros(0)
        shape = np.concatenate([self.words[np.minimum(n, 42) // 3], self.letters[np.minimum(np.rint(2 * letters / np.maximum(n, 1)).astype(np.int64), _LONG - 1)]])
        weight = np.concatenate([((1 - SHAPE) / np.maximum(n, 1) * each[doc])[sentence], np.tile(SHAPE / 2 * each[doc], 2)])
        key, inverse = np.unique(np.concatenate([doc[sentence], doc, doc]) * SPACE + np.concatenate([at, shape]), return_inverse=True)
        offsets = np.searchsorted(key, np.arange(len(texts) + 1) * SPACE)
        return offsets, key % SPACE, np.bincount(inverse, weight, len(key)) if len(key) else np.zeros(0)


def place(node: str) -> int:
    return xxhash.xxh32_intdigest(node) % SPACE


def graph(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, word array<int>, weight array<float>, grade`` of documents of ``LEAST_WORDS`` words or more.

    ``grade`` is the median of the distinct gradings (rater and level), null for an ungraded document. Gradings that are
    null or lie outside 1 to 3 don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker = Linker()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(1).to_pylist()
                keep = [i for i, t in enumerate(texts) if t and len(t.split()) >= LEAST_WORDS]
                offsets, word, weight = linker.of([texts[i] for i in keep])
                lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), x) for x in (pa.array(word.astype(np.int32)), pa.array(weight.astype(np.float32)))]
                yield pa.record_batch([batch.column(0).take(pa.array(keep, pa.int64())), *lists], names=["doc_id", "word", "weight"])

    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, word array<int>, weight array<float>")
    graded = labels.filter(F.col("reading_level").between(1, 3)).select("doc_id", "rater", "reading_level").distinct()
    graded = graded.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.percentile("reading_level", F.lit(0.5)).alias("grade"))
    return docs.join(graded, "doc_id", "left")


def _flat(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word, weight = batch.column(first), batch.column(first + 1)
    lengths = pc.list_value_length(word).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(batch.num_rows), lengths), word.flatten().to_numpy(zero_copy_only=False), weight.flatten().to_numpy(zero_copy_only=False).astype(float)


def _values(batch: pa.RecordBatch, first: int, state: dict) -> np.ndarray:
    """Documents' own values: the weighted mean of their words."""
    row, word, weight = _flat(batch, first)
    n = batch.num_rows
    trust = weight * state["trust"][word]
    whole = np.bincount(row, trust, n)
    return np.where(whole > 0, np.bincount(row, trust * state["value"][word], n) / np.maximum(whole, 1e-12), state["mean"])


def _stretch(z: np.ndarray, scale: tuple[list[float], list[float]] | None) -> np.ndarray:
    return z if scale is None else np.interp(z, *scale)


def _sums(parts: DataFrame) -> np.ndarray:
    """The partial sums of all partitions added up: at most ``SPACE`` rows."""
    got = parts.groupBy("word").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"), F.sum("wyy").alias("wyy")).toPandas()
    out = np.zeros((3, SPACE))
    out[:, got["word"].to_numpy(int)] = got[["w", "wy", "wyy"]].to_numpy(float).T
    return out


def until_settled(step: Callable[[], float], most: int = MOST_ROUNDS) -> int:
    """Calls ``step``, which says how far values moved, until they settle; returns the number of calls."""
    for n in range(1, most + 1):
        moved = step()
        if moved < SETTLED:
            return n
    warnings.warn(f"values still move by {moved:.2g} after {most} steps", RuntimeWarning, stacklevel=2)
    return most


def propagate(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, value``: difficulty from 1 to 3 of every document of ``LEAST_WORDS`` words or more.

    Words are separated by white space. Shorter, empty and null texts have no row. Without any grading the value is 2
    throughout. Copies get equal values. Extra columns are not read.
    """
    spark = documents.sparkSession
    sc = spark.sparkContext
    ws = Workspace(spark, "reading")
    g = ws.cut(graph(documents, labels), "graph")
    graded = ws.cut(g.filter(F.col("grade").isNotNull()), "graded")
    mean = graded.agg(F.avg("grade")).first()[0]
    if mean is None:
        return g.select("doc_id", F.lit(2.0).alias("value"))

    def add(state_of, scale):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = state_of()
            total = np.zeros((3, SPACE))
            for batch in batches:
                if not batch.num_rows:
                    continue
                row, word, weight = _flat(batch, 1)
                grade = batch.column(3).to_numpy(zero_copy_only=False).astype(float)
                fixed = ~np.isnan(grade)
                y = grade if state is None else np.where(fixed, grade, _stretch(_values(batch, 1, state), scale))
                w = 100 * weight * np.where(fixed, 1.0, 0.0 if state is None else UNGRADED)[row]
                y = np.nan_to_num(y)[row]
                for i, v in enumerate((w, w * y, w * y * y)):
                    total[i] += np.bincount(word, v, SPACE)
            at = np.flatnonzero(total[0])
            yield pa.record_batch([pa.array(at.astype(np.int32)), *[pa.array(t[at]) for t in total]], names=["word", "w", "wy", "wyy"])

        return run

    def calibrate(state_of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = state_of()
            for batch in batches:
                z = _values(batch, 1, state)
                level = np.rint(batch.column(3).to_numpy(zero_copy_only=False)).astype(np.int32)
                yield pa.record_batch([pa.array(level), pa.array(np.rint((z - 1) / 2 * _BINS).astype(np.int32))], names=["level", "bin"])

        return run

    def state_from(sums: np.ndarray) -> dict:
        w, wy, wyy = sums
        value = (wy + mean) / (w + 1)
        spread = np.maximum(0, (wyy + mean * mean + 2 / 3) / (w + 1) - value * value)
        return {"value": value, "trust": np.where(w > 0, (spread + 0.05) ** -0.5, 0), "mean": mean}

    def scale_of(shared) -> tuple[list[float], list[float]] | None:
        """Medians of the graded documents' own values, level by level, and these levels: a histogram of fixed size."""
        hist = graded.mapInArrow(calibrate(lambda: shared.value), "level int, bin int").groupBy("level", "bin").count().toPandas()
        at = {}
        for level, part in hist.sort_values("bin").groupby("level"):
            half = part["count"].cumsum() >= part["count"].sum() / 2
            at[level] = 1 + 2 * part["bin"][half].iloc[0] / _BINS
        levels = sorted(at)
        places = [at[k] for k in levels]
        return (places, [float(k) for k in levels]) if len(levels) > 1 and all(b > a for a, b in zip(places, places[1:], strict=False)) else None

    out = "word int, w double, wy double, wyy double"
    state = state_from(_sums(graded.mapInArrow(add(lambda: None, None), out)))

    def step() -> float:
        nonlocal state
        shared = sc.broadcast(state)
        scale = scale_of(shared)
        new = state_from(_sums(g.mapInArrow(add(lambda s=shared: s.value, scale), out)))
        known = (state["trust"] > 0) & (new["trust"] > 0)
        moved = float(np.abs(new["value"] - state["value"])[known].mean()) if known.any() else 0.0
        state = new
        shared.unpersist()
        return moved

    until_settled(step)
    shared = sc.broadcast(state)
    scale = scale_of(shared)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(_stretch(_values(batch, 1, shared.value), scale).astype(float))], names=["doc_id", "value"])

    return g.select("doc_id", "word", "weight").mapInArrow(final, "doc_id long, value double")


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, reading_level``: the value of ``propagate`` rounded to a level."""
    return propagate(documents, labels).select("doc_id", F.when(F.col("value") < 1.5, 1).when(F.col("value") < 2.5, 2).otherwise(3).alias("reading_level"))
