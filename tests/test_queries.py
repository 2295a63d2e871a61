"""Every core query runs, and equals its SQL twin where it has one."""

import pytest

from helpers import rows, sql_rows
from weftline.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data)
    if name in SQL:
        assert rows(got) == sql_rows(duck, SQL[name])
    else:
        assert got.collect() is not None


def test_entry_without_the_corpus_subpackage(monkeypatch):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    monkeypatch.setattr(entry, "_LLM", None)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL)
