"""The README names every query there is."""

from pathlib import Path

import __spark_entry__


def test_every_query_is_listed():
    text = (Path(__file__).parents[1] / "README.md").read_text()
    assert [q for q in __spark_entry__.queries() if q not in text] == []
    assert "no implementation" not in text
