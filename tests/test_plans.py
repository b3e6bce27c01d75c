"""Shape of the physical plans that matter at scale."""

import re

import pytest

import __spark_entry__ as contract


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["daily_demand", "sales_panel", "stocking_report", "purchase_probability", "clean_sales", "frequent_itemsets", "performance_table"])
def test_no_products_and_no_row_udfs(spark, sf_dir, name):
    text = plan(contract.queries()[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text, bad


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(contract.queries()["pruned_read"](spark, sf_dir)).split("Physical Plan")[1]
    assert "OrderQuantity" not in text and "ReadSchema: struct<ProductKey" in text
    trimmed = plan(contract.queries()["date_cutoff"](spark, sf_dir))
    assert "PushedFilters" in trimmed


@pytest.mark.parametrize("name,panels", [("sales_panel", 1), ("route_sales", 2)])
def test_panels_read_the_facts_twice(spark, sf_dir, name, panels):
    """One pass for the rows and one, shared by all its uses, for first day, last day and earliest stock date."""
    df = contract.queries()[name](spark, sf_dir)
    df.collect()
    executed = df._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
    assert 1 <= len(set(re.findall(r"Subquery subquery#(\d+)", executed))) <= panels


def test_sales_are_reduced_before_the_item_join(spark, sf_dir):
    from tillwise.operators import joins
    from workloads.registry import Tables

    t = Tables(spark, sf_dir)
    df = joins.daily_by_item(t.returns, t.word_items, "ReturnDate", ["ReturnQuantity"])
    join = df._jdf.queryExecution().optimizedPlan()
    while join.nodeName() != "Join":
        join = join.children().head()
    side = join.children().head()
    while side.nodeName() in ("Filter", "Project"):
        side = side.children().head()
    assert side.nodeName() == "Aggregate"
