"""How often a query reads the quotes, and what it moves."""

import pytest

from bidloom.operators import scoring as S
from bidloom.plans.domain import Domain
from bidloom.plans.queries import valid
from bidloom.plans.registry import queries

SF = "/root/testdata/sf0.001"


def scans(df, table):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len([line for line in plan.split("\n") if "Relation" in line and table in line])


def test_scores_read_the_quotes_once(spark):
    assert scans(queries()["supplier_score"](spark, SF), "l_orderkey") == 1


def test_scores_are_equal_from_one_frame_and_from_two(spark):
    d = Domain(spark, SF)
    rows = lambda quotes, of, category: sorted(map(tuple, S.score(d.suppliers, quotes, of, d.brand_tiers, category=category).collect()))
    for category in (None, "PROMO", "UNHEARD OF"):
        assert rows(d.priced, None, category) == rows(d.categorised, valid(d), category)


@pytest.mark.parametrize("name", ["recommend_suppliers", "recommend_newcomers"])
def test_recommendations_come_from_counts(spark, name):
    """All quotes are counted once, before; neither score reads them again."""
    assert scans(queries()[name](spark, SF), "l_orderkey") == 0


def test_summaries_read_the_quotes_of_those_recommended(spark):
    df = queries()["recommendation_summaries"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert scans(df, "l_orderkey") == 1 and plan.index("LeftSemi") > plan.index("l_suppkey")  # below the joins, at the lines


@pytest.mark.parametrize("name", ["merged_extractions", "extracted_lines"])
def test_pages_are_shuffled_once(spark, name):
    """They are numbered and merged by the same key."""
    assert queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_a_matrix_looks_back_on_its_categories_alone(spark, monkeypatch):
    """Periods and projects are counted for the rows' categories, not for all quotes."""
    from bidloom.operators import matrix

    last = []
    monkeypatch.setattr(matrix, "saved", lambda df, real=matrix.saved: last.append(df) or real(df))
    queries()["bid_matrix_totals"](spark, SF)
    assert last[-1]._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1
