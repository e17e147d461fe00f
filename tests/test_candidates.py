"""Adopted candidates of levels, counted without forming pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from matchengine.operators import adopted, pairs


def test_counts_are_those_of_pairs(spark):
    rng = random.Random(3)
    # Many differences round to the reach or beside it; values repeat.
    left = [(rng.choice([1, 2, None]), k, rng.choice([None, rng.randint(0, 3000) / 100, rng.randint(0, 30) * 1.0])) for k in range(400)]
    right = [(rng.choice([1, 3]), rng.choice([None, rng.randint(0, 3000) / 100, rng.randint(0, 30) * 1.0])) for _ in range(300)]
    one, two = spark.createDataFrame(left, "g int, k int, x double"), spark.createDataFrame(right, "g int, y double")
    got = {r.k: (r.a, r.b) for r in pairs.counts_within(one, two, F.col("x"), F.col("y"), ["k"], {"a": 4.0, "b": 0.3}, ["g"]).collect()}
    for g, k, x in left:
        want = tuple(sum(g == h and y is not None and abs(x - y) <= r for h, y in right) for r in (4.0, 0.3)) if x is not None else (0, 0)
        assert got.get(k, (0, 0)) == want, (g, k, x)
    assert pairs.counts_within(one, two.where("false"), F.col("x"), F.col("y"), ["k"], {"a": 4.0}, ["g"]).count() == 0


def test_candidates_are_those_of_pairs(spark):
    rng = random.Random(4)
    cents = lambda: rng.randint(0, 60_000) / 100
    levels = [(rng.choice("ab"), k, rng.choice("XYZ"), cents(), None) for k in range(300)]
    best = [(rng.choice("ab"), k, cents(), rng.sample("XYZ", rng.randint(0, 2)), rng.choice(["2+", "3-", "", None])) for k in range(100)]
    one = spark.createDataFrame(levels, "n string, level int, dsid string, x double, dx double")
    two = spark.createDataFrame(best, "n string, adopted int, y double, xref array<string>, jpi_text string")
    found = adopted.match_candidates(one, two, ["n"], 40.0, 20.0)
    got = {r.level: r for r in found.collect()}
    assert len(got) == 300
    for n, level, dsid, x, _ in levels:
        near = [(abs(x - y), dsid in xref, jpi) for m, _, y, xref, jpi in best if m == n and abs(x - y) <= 40]
        r = got[level]
        assert (r.n_matched, r.n_listed, r.n_bad, r.n_missed) == (len(near), sum(li for _, li, _ in near), sum(li and d > 20 for d, li, _ in near), sum(not li and d <= 20 for d, li, _ in near))
        assert r.distance == min((d for d, *_ in near), default=None)
        assert (set(r.adopted_jpis) if near else r.adopted_jpis) == ({j for *_, j in near if j is not None} if near else None)


def test_cross_references_are_dealt_by_level(spark):
    from matchengine.operators import rules

    tags = spark.createDataFrame([(1, "A", ""), (2, "B", "7")], "level int, tag string, marker string")
    datasets = spark.createDataFrame([("A", False)], "tag string, is_theory boolean")
    matches = spark.createDataFrame([(1, "A", 99.0, "1"), (2, "A", 1.0, "2")], "level int, tag string, distance double, energy_text string")
    found = rules.level_xref_rule(tags, datasets, matches, 50.0)
    assert "BroadcastHashJoin [level" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.level, r.message) for r in found.collect()) == [(1, "level is discrepant and has no note"), (2, "dataset is missing in the cross-reference"), (2, "tag names no dataset")]
