"""Token ids against a public implementation of the same vocabulary."""

import os
import random

import pytest

from stallkit.llm import bpe
from stallkit.session import local_session

pytestmark = pytest.mark.skipif(not os.path.isfile(bpe.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_vocabulary(bpe.VOCABULARY)


def test_ids_are_those_of_the_public_encoder(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    public = tiktoken.Encoding("byte_bpe_50k", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    texts = ["", " ", "Hello's  world\n\n  x", "ÄÖÜ ß é 漢字 \U0001f600", "<|endoftext|>", "a" * 5000, "".join(chr(r.choice([32, 97, 101, 0xE4, 0x4E00, 0x1F600, 10])) for _ in range(3000))]
    encoder = bpe.Encoder(ranks)
    assert [encoder.ids(t) for t in texts] == [public.encode_ordinary(t) for t in texts]


def test_round_trip_of_odd_rows():
    spark = local_session(cores="2", shuffle_partitions=2)
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "Grüße \U0001f600 " * 2000, "z"), (3, "twice", "z")], "doc_id long, text string, ids string").coalesce(1)
    ids = bpe.encode_texts(df, "doc_id", "text")
    rows = ids.collect()
    assert [r.ids for r in rows[:2]] == [[], []] and len(rows) == 4
    assert [r.text for r in bpe.decode_ids(ids, "doc_id", "ids").collect()] == ["", "", "Grüße \U0001f600 " * 2000, "twice"]
    assert bpe.encode_texts(df.limit(0), "doc_id", "text").collect() == []
