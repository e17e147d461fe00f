"""Pairs of customers: what two lists of options say is looked up, not worked out a pair."""

from __future__ import annotations

from matchengine import queries


def test_similarities_of_lists_are_joined(spark, sf_dir):
    pairs = queries.customer_pairs(spark, sf_dir)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [spin_parity_list_1" in plan
    assert pairs.count() == queries.customer_pairs(spark, sf_dir).select("key_1", "key_2").distinct().count()
