"""Versions of reference tables as of a date."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from matchengine.operators import reference_tables as rt

DAY = dt.date(2000, 1, 1)


def test_versions_against_a_search(spark):
    rng = random.Random(1)
    versions = [(rng.choice("abc"), DAY + dt.timedelta(rng.randint(0, 30)), k, float(k)) for k in range(60)] + [(None, DAY, 99, 1.0), ("a", None, 98, 1.0)]
    rows = [(k, rng.choice(["a", "b", "c", "d", None]), None if k % 11 == 0 else DAY + dt.timedelta(rng.randint(-5, 40))) for k in range(300)]
    table = spark.createDataFrame(versions, "nuclide string, since date, version int, excess double")
    found = rt.as_of(spark.createDataFrame(rows, "k int, nuclide string, date date"), table, ["nuclide"], "date", {"excess": "mass"}).collect()
    assert len(found) == 300

    def held(nuclide, date):
        past = [(s, v, x) for n, s, v, x in versions if n == nuclide and nuclide and s and date and s <= date]
        return max(past)[2] if past else None

    assert {r.k: r.mass for r in found} == {k: held(n, d) for k, n, d in rows}


def test_limits_by_mass_and_time(spark):
    limits = spark.createDataFrame([("E2", 1, 44, DAY, 1, 100.0), ("E2", 45, 150, DAY, 1, 300.0), ("E2", 1, 44, DAY + dt.timedelta(10), 2, 90.0), ("M1", 1, 150, DAY, 1, 5.0)], "mult string, low int, high int, since date, version int, limit double")
    rows = [(1, "E2", 44, 5, 95.0), (2, "[E2]", 44, 10, 95.0), (3, "E2", 45, 10, 299.0), (4, "(M1+E2)", 100, 0, 6.0), (5, "E2", 44, -1, 1e9), (6, "D", 44, 5, 1e9), (7, None, 44, 5, 1e9), (8, "E2", 200, 5, 1e9)]
    gammas = spark.createDataFrame([(k, m, a, DAY + dt.timedelta(d), s) for k, m, a, d, s in rows], "k int, mult string, mass int, date date, strength double")
    found = rt.with_limits(gammas, limits)
    assert {r.k: r.limit for r in found.collect()} == {1: 100.0, 2: 90.0, 3: 300.0, 4: 5.0, 5: None, 6: None, 7: None, 8: None}
    assert sorted(r.k for r in rt.strength_rule(found, ["k"]).collect()) == [2, 4]


def test_decay_energies_and_targets(spark):
    masses = spark.createDataFrame([("34P", DAY, 1, -24557.0, 2, "+"), ("34S", DAY, 1, -29931.0, 0, "+"), ("34S", DAY + dt.timedelta(9), 2, -29900.0, 0, "+")], "nuclide string, since date, version int, excess double, two_j int, parity string")
    parents = spark.createDataFrame([(1, "34P", "34S", DAY, 5374.0), (2, "34P", "34S", DAY + dt.timedelta(9), 5374.0), (3, "34P", "34X", DAY, 5.0), (4, "34P", "34S", DAY, None)], "k int, parent string, daughter string, date date, q double")
    found = rt.with_decay_energy(parents, masses)
    assert [r.adopted_q for r in found.orderBy("k").collect()] == [5374.0, 5343.0, None, 5374.0]
    assert [(r.k, r.message) for r in rt.decay_energy_rule(found, "k", 5.0).orderBy("k").collect()] == [(2, "parent Q-value differs from the masses"), (3, "no masses of that time")]
    target = rt.with_targets(spark.createDataFrame([("34P", DAY)], "target string, date date"), masses).select("two_j_target", "target_parity").first()
    assert tuple(target) == (2, "+")


def test_empty_tables(spark):
    masses = spark.createDataFrame([], "nuclide string, since date, version int, excess double, two_j int, parity string")
    rows = spark.range(3).select(F.lit("a").alias("target"), F.lit(DAY).alias("date"))
    assert [r.two_j_target for r in rt.with_targets(rows, masses).collect()] == [None] * 3
    assert rt.with_targets(rows.where("false"), masses).count() == 0


def test_versions_of_many_years_meet_in_blocks(spark):
    """Long and short intervals, and no record meets all versions of its key."""
    since = [0, 3, 4, 700, 701, 9000]
    table = spark.createDataFrame([("a", DAY + dt.timedelta(d), d, float(d)) for d in since], "nuclide string, since date, version int, excess double")
    rows = spark.createDataFrame([("a", n, DAY + dt.timedelta(n)) for n in (-1, 0, 3, 5, 699, 700, 5000, 8999, 9000, 20000)], "nuclide string, n int, date date")
    found = rt.as_of(rows, table, ["nuclide"], "date", {"excess": "mass"})
    assert {r.n: r.mass for r in found.collect()} == {-1: None, 0: 0.0, 3: 3.0, 5: 4.0, 699: 4.0, 700: 700.0, 5000: 701.0, 8999: 701.0, 9000: 9000.0, 20000: 9000.0}
    assert "__block" in found._jdf.queryExecution().optimizedPlan().toString()
