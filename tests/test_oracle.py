"""Every registered query on the smallest tables, next to its SQL text where it has one."""

from pathlib import Path

import pytest

from tests.compare import connect, differences
from wattlens.plans.catalog import ORACLES, QUERIES
from wattlens.session import owned_stages

FOLDER = "/root/testdata/sf0.001"
MAY_BE_EMPTY = {"p9_risk_filter", "l4_list_assets"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    with owned_stages(spark) as stages:
        df = QUERIES[name](spark, FOLDER)
        if name in ORACLES:
            problem = differences(df, duck, ORACLES[name])
            assert problem is None or (problem == "no rows" and name in MAY_BE_EMPTY)
        else:
            assert df.limit(1).count() == 1
        written = list(stages)
    assert not any(Path(path).exists() for path in written)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", ["f8_customer_components", "w8_attribution_share", "e2_score_entities"])
def test_scoring_reads_the_events_once(spark, name):
    """Stage tables are written while a query is built; what is left to run reads no events."""
    with owned_stages(spark):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "events.parquet" not in plan
