"""What plans must look like to hold at scale."""

import io
from contextlib import redirect_stdout

import pytest

from roadlens.operators import anomaly, fuel, messages, scoring
from roadlens.plans import catalog
from roadlens.sources import views as V


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_rules_stay_in_the_jvm(spark, data):
    assert "Python" not in plan(scoring.trip_report(V.trips(spark, data)))


def test_history_takes_one_exchange(spark, data):
    text = plan(anomaly.summary(V.trips(spark, data)))
    assert text.count("\n(") and text.count("Exchange (") <= 2  # once in the tree, once in the details


def test_columns_are_pruned(spark, data):
    text = plan(V.trips(spark, data).select("id", "distance_km"))
    assert "ReadSchema: struct<o_orderkey:bigint>" in text


#: What trains or reads models, or runs a stream, and so more than a plan.
RUNS = {n for n in catalog.QUERIES if n.startswith("stream_") or (n.startswith("ml_") and n not in catalog.ORACLES)}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - RUNS))
def test_relational_plans(spark, data, name):
    """No Python, no product of two tables; joins without keys only against a row or a short list that is sent to all."""
    text = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "InArrow" not in text and "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text or "BuildRight" in text or "BuildLeft" in text


def test_comparisons_inside_a_row_shuffle_nothing(spark, data):
    requests, trips, talk = V.fuel_requests(spark, data), V.trips(spark, data), V.messages(spark, data)
    for df in (fuel.table(requests), fuel.costs(requests), fuel.best(requests), fuel.tips(requests), scoring.trip_report(trips), messages.replies(talk), messages.confidences(talk)):
        text = plan(df)
        assert "Exchange" not in text and "Join" not in text


def test_history_rules_share_an_exchange(spark, data):
    text = plan(anomaly.summary(V.trips(spark, data)))
    assert text.count("hashpartitioning(user_id") <= 2
