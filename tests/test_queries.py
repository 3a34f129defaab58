"""Every query with SQL gives DuckDB's rows; the others give rows."""

import pytest

from graphwright import registry
from tests.compare import duck, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        same(df, duck(small), SQL[name])
    else:
        assert df.columns
        df.collect()


def test_flagship_has_rows(spark, small):
    assert QUERIES[registry.FLAGSHIP](spark, small).limit(1).count() == 1


def test_entry_works_without_the_training_data_package(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("graphwright.llm") or m == "corpus_pipeline"]:
        monkeypatch.setitem(sys.modules, name, None)
    monkeypatch.setitem(sys.modules, "graphwright.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(__spark_entry__)
    assert set(entry.queries()) == set(QUERIES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
