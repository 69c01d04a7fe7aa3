import pytest

from quarry.plans.queries import QUERIES
from quarry.sources.store import bucketed


def test_a_bucketed_table_is_not_shuffled_again(spark):
    rows = spark.range(300).selectExpr("id % 70 AS k", "id AS v")
    held = bucketed(rows, "k")
    other = spark.range(50).selectExpr("id AS k", "id * 2 AS w").hint("merge")
    plan = held.join(other, "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(held.join(other, "k").collect()) == sorted(rows.join(other, "k").collect())


@pytest.mark.parametrize("name", ["baseline_suppression", "sarif_document"])
def test_findings_are_made_once(spark, name):
    """What is made of findings twice over reads them from a table: no pattern is left in the plan."""
    assert "rlike" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
