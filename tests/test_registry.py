"""Every registered query of the engine against its SQL twin."""

import pytest
from oracle_tool import compare

from eventloom.plans import registry

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # halves, ties and long lists that the smallest tables lack
AGAIN = "models_api papers_api registry_api daily_summary tag_stats score_metrics all_metrics quota_topk trending_boost trending_entities stream_late_rows".split()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    assert compare(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", [n for n in AGAIN if n in registry.ORACLES])
def test_oracle_on_larger_tables(spark, name):
    assert compare(registry.QUERIES[name](spark, LARGER), registry.ORACLES[name], LARGER) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())
