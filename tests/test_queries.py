from __future__ import annotations

import pytest
from marquee.queries import ORACLES, QUERIES
from oracle import same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(name, spark, sf, duck):
    same_rows(QUERIES[name](spark, sf), duck, ORACLES[name])


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_python_in_text_queries(spark, sf):
    for name in ("search_ranked", "facets", "title_cards", "extract_se", "strip_tech", "title_tier", "trending", "entitlement"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name
        assert "CartesianProduct" not in plan


def test_top_lists_are_not_sorted_whole(spark, sf):
    for name in ("newest_files", "browse_movie", "search_page"):
        assert "TakeOrderedAndProject" in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
