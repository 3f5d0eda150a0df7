import pytest

from bidloom.plans.registry import oracles, queries

from .compare import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_equals_its_sql(spark, name):
    assert difference(spark, SF, queries()[name], oracles()[name]) is None


@pytest.mark.parametrize("name", sorted(queries().keys() - oracles().keys()))
def test_query_without_sql_runs(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_entry_works_without_the_training_data_operators(monkeypatch):
    import importlib.util

    import __spark_entry__ as entry

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda m, *a: None if m.startswith(("bidloom.llm", "corpus_pipeline")) else real(m, *a))
    assert not [k for k in entry.queries() if k.startswith("op") or k == "pipeline"] and "bid_matrix" in entry.queries() and "bid_matrix" in entry.oracle_sql()


def test_all_quotes_are_created_and_counted(spark):
    """Not only those of one supplier or category."""
    from bidloom.plans.domain import Domain

    whole = Domain(spark, SF).quotes.filter("unit_price > 0")
    assert queries()["create_quotes"](spark, SF).count() == whole.count()
    assert sum(r["count"] for r in queries()["quote_stats"](spark, SF).collect()) == whole.count()
