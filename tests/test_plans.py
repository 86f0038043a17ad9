"""What the optimiser makes of plans whose cost depends on it."""

import pytest
from test_queries import SF

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["editorial_unknown_names", "validate_intros"])
def test_the_corpus_is_folded_once_a_row(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(lambda" in plan and "Contains(lower" not in plan
