"""Every registered query against its SQL oracle on sf0.001."""

import pytest
from conftest import SF_DIR

from tabgraph.catalog import ORACLES, QUERIES
from tabgraph.catalog.compare import differences

#: Model fits and approximate candidates; their properties are in test_fixtures and test_properties.
NO_ORACLE = {"x13_sim_cosine_lsh", "l5_l8_l9_binary_experiment", "l6_multiclass_experiment"}


def test_only_the_known_queries_lack_an_oracle():
    assert set(QUERIES) - set(ORACLES) == NO_ORACLE


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(name, spark, duck):
    assert differences(QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) == ""


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.count() == 1650
    assert frame.columns[:3] == ["timestamp", "customer_id", "churn"]
