"""Token ids of texts by a public byte-level BPE vocabulary.

A text is cut into pieces by the tokenizer's pattern. The bytes of a piece are a doubly linked list of symbols; a
priority queue holds the neighbouring pairs that the vocabulary can merge, by merge rank and place. The best pair is
merged in the list, its new neighbours are queued, and queue entries whose symbols have changed since are skipped.
Pieces seen before in the same worker come from a cache, which is emptied when full. Decoding joins the vocabulary's
byte strings.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary lies; read by the driver and sent to the executors.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's own pattern for pieces. A fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary larger than this is not sent to the executors.
MAX_VOCABULARY_BYTES = 64 << 20
CACHE_PIECES = 1 << 18


def read_vocabulary(path: str) -> dict[bytes, int]:
    """Rank of every symbol of a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    symbols: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    n = len(symbols)
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
    queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, length = heapq.heappop(queue)
        a = symbols[i]
        j = nxt[i]
        if a is None or j >= n or len(a) + len(symbols[j]) != length:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = (joined := a + symbols[j]), None
        nxt[i] = after = nxt[j]
        if after < n:
            prev[after] = i
            if (r := ranks.get(joined + symbols[after])) is not None:
                heapq.heappush(queue, (r, i, length + len(symbols[after])))
        if (before := prev[i]) >= 0 and (r := ranks.get(symbols[before] + joined)) is not None:
            heapq.heappush(queue, (r, before, len(symbols[before]) + length))
    return [ranks[s] for s in symbols if s is not None]


class Encoder:
    """Encodes texts in one worker."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.cache = ranks, {}
        self.pieces = regex.compile(PATTERN).findall

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for piece in self.pieces(text):
            got = cache.get(piece)
            if got is None:
                if len(cache) >= CACHE_PIECES:
                    cache.clear()
                got = merge(piece.encode(), self.ranks)
                if len(piece) <= 64:
                    cache[piece] = got
            out += got
        return out


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids``: the token ids of every text, without special tokens. Null and empty texts give an empty list.

    Special tokens' strings in a text are ordinary text. Other columns are not read. An empty table gives no rows.
    """
    ranks = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    rows = df.select(F.col(key), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            lists = [encoder.ids(t) if t else [] for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    schema = rows.select(key).schema.add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, schema)


def decode_ids(df: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, text``: the texts whose ids are given. A null list gives null; bytes that are no UTF-8 become U+FFFD."""
    ranks = read_vocabulary(vocabulary)
    symbols = df.sparkSession.sparkContext.broadcast([s for s, _ in sorted(ranks.items(), key=lambda x: x[1])])
    rows = df.select(F.col(key), F.col(ids).cast("array<int>").alias("i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbols.value
        for batch in batches:
            out = [None if x is None else b"".join([table[i] for i in x]).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=[key, "text"])

    return rows.mapInArrow(run, rows.select(key).schema.add("text", "string"))
