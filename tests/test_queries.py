"""Every query with SQL gives the SQL's rows; the others run."""

import pytest

from heronry import queries


@pytest.mark.parametrize("name", queries.SQL)
def test_same_as_sql(name, spark, sf_dir, same_as_sql):
    same_as_sql(queries.QUERIES[name](spark, sf_dir), queries.SQL[name])


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.SQL])
def test_runs(name, spark, sf_dir):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_flagship(spark, sf_dir):
    hits = queries.hybrid_search(spark, sf_dir).collect()
    assert hits and all(h["rank"] <= 10 for h in hits)


def test_entry_without_the_corpus_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def fake(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("gone", name=name)
        return real(name, *args, **kwargs)

    sys.modules.pop("__spark_entry__", None)
    monkeypatch.setattr(builtins, "__import__", fake)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(queries.QUERIES)
    monkeypatch.undo()
    sys.modules.pop("__spark_entry__", None)
