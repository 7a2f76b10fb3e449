"""The given tables as events and reports: the longest table moves once."""

import pytest

from panelgraph.plans import catalog, views

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("view", [views.raw_events, views.reports])
def test_orders_meet_customers_before_lines(spark, view):
    """Else, once customers are too many to broadcast, every line is shuffled again by customer."""
    plan = view(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(plan) if "Join Inner" in line and "o_custkey" in line and "c_custkey" in line)
    below = []
    for line in plan[at + 1 :]:
        if depth(line) <= depth(plan[at]):
            break
        below.append(line)
    assert below and not any("l_orderkey" in line for line in below)


def test_news_panel_writes_no_texts(spark, monkeypatch):
    written, cut = [], catalog.cut
    monkeypatch.setattr(catalog, "cut", lambda df: written.append(df.columns) or cut(df))
    assert catalog.news_panel(spark, "/root/testdata/sf0.001").columns[0] == "country_iso3"
    assert len(written) == 1 and not {"title", "url", "conflict_intensity"} & set(written[0])
