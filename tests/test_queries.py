"""Every registered query against its SQL, and what its plan may not contain."""

import __spark_entry__ as entry
import oracle
import pytest

from workload import registry, scoring

QUERIES, SQL = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert unwanted not in plan
    assert oracle.differences(df, con, SQL[name]) == []


def test_samples_are_numbered_in_buckets(spark, sf_dir, monkeypatch):
    """No problem's samples pass through one window task."""
    plans = []
    saved = scoring.saved_once
    monkeypatch.setattr(scoring, "saved_once", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or saved(df, name))
    QUERIES["sample_verdict"](spark, sf_dir)
    (plan,) = plans
    numbered = plan.split("row_number() windowspecdefinition(")[1:]
    assert numbered and all(x.startswith("_bucket") for x in numbered)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
