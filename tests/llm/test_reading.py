"""Steps of the reading levels."""

import pytest

from stallkit.llm.reading import SETTLED, until_settled


def test_steps_go_on_until_settled():
    left = iter([1.0] * 20 + [SETTLED / 2, 1.0])
    assert until_settled(lambda: next(left)) == 21


def test_an_unfinished_fit_is_reported():
    with pytest.warns(RuntimeWarning, match="still move"):
        assert until_settled(lambda: 1.0, 5) == 5


def test_levels_of_graded_and_odd_documents():
    import random

    from stallkit.llm.reading import Linker, propagate, reading_levels
    from stallkit.session import local_session

    spark = local_session(cores="2", shuffle_partitions=2)
    r = random.Random(1)
    easy, hard = "the cat sat on a mat and we had tea".split(), "notwithstanding jurisdictional considerations amortisation presupposes heterogeneous counterparties".split()

    def text(words, n):
        return " ".join(" ".join(r.choice(words) for _ in range(n)) + "." for _ in range(90 // n))

    docs = [(i, text(easy, 5) if i % 2 else text(hard, 18), "x") for i in range(40)] + [(90, None, "x"), (91, "", "x"), (92, "too short", "x"), (93, "?! " * 60, "x"), (94, text(easy, 5) * 400, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, value string")
    labels = spark.createDataFrame([(i, "r", 1 if i % 2 else 3) for i in range(10)] + [(0, "r2", None), (1, "r2", 9), (77, "r", 2), (1, "r", 1)], "doc_id long, rater string, reading_level int")
    got = {x.doc_id: x.reading_level for x in reading_levels(df, labels).collect()}
    assert set(got) == {*range(40), 93, 94}
    assert all(got[i] == (1 if i % 2 else 3) for i in range(40)) and got[94] == 1
    assert {x.value for x in propagate(df, labels.limit(0)).collect()} == {2.0}
    assert reading_levels(df.limit(0), labels).collect() == []
    offsets, _, weight = Linker().of(["one two three. four five", "", "..."])
    assert offsets[1] == offsets[2] == offsets[3] and abs(weight.sum() - 1) < 1e-9
