"""The driver's contract, with and without the llm folders."""

import os
import sys

import pytest

import __spark_entry__
from stratalog import catalogue


def test_names_fit():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(catalogue.queries()) <= set(queries)


@pytest.mark.skipif(not os.path.isdir(__spark_entry__.SMOKE_DIR), reason="no test data")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("missing", ["corpus_pipeline", "stratalog.llm", "zstandard"])
def test_without_llm(monkeypatch, missing):
    for name in list(sys.modules):
        if name == "corpus_pipeline" or name.startswith("stratalog.llm"):
            monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    with pytest.warns(UserWarning, match="without the llm queries"):
        assert set(__spark_entry__.queries()) == set(catalogue.queries())
    with pytest.warns(UserWarning):
        assert set(__spark_entry__.oracle_sql()) == set(catalogue.oracle_sql())
