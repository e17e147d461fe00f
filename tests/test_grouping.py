"""Grouping, provenance and reports against hand-made and brute-force results."""

from __future__ import annotations

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from matchengine import queries, record_queries
from matchengine.functions import comments
from matchengine.operators import adopted, averages, groups, grouping
from matchengine.plans import matching
from matchengine.schema import CONFIG, GAMMAS, MatchConfig
from matchengine.sources import reports


def brute_matches(a, b, delta):
    """Lines of a, in turn, take the nearest free line of b within delta."""
    free, n = list(range(len(b))), 0
    for x in a:
        near = [(abs(x - b[k]), k) for k in free if abs(x - b[k]) <= delta * (1 + 1e-9)]
        if near:
            free.remove(min(near)[1])
            n += 1
    return n


def test_consistent_gammas(spark):
    rng = random.Random(2)
    rows = [([float(rng.randint(0, 30)) for _ in range(rng.randint(0, 6))], [float(rng.randint(0, 30)) for _ in range(rng.randint(0, 6))]) for _ in range(60)]
    lines = lambda e: [(x, 0.1, 1.0, 0.1) for x in e]
    frame = spark.createDataFrame([(k, lines(a), lines(b)) for k, (a, b) in enumerate(rows)], f"k int, a {GAMMAS}, b {GAMMAS}")
    got = {r.k: r.n for r in frame.select("k", grouping.consistent_gammas(F.col("a"), F.col("b"), 1.5).alias("n")).collect()}
    positive = lambda e: [x for x in e if x > 0]
    assert got == {k: brute_matches(positive(a), positive(b), 1.5) for k, (a, b) in enumerate(rows)}


def test_a_candidate_at_the_very_end_of_the_reach(spark):
    """601.19 is at most 501.19 + 100 as a sum, farther than 100 as a difference."""
    records = spark.createDataFrame([("n", 1, 601.19, 1.0)], "by string, record int, e double, dx double")
    known = spark.createDataFrame([("n", 10, 500.19 - 1, 500.19 + 1, 500.19)], "by string, grp int, low double, high double, mean double")
    assert [r.grp for r in grouping.candidate_groups(records, known, ["by"]).collect()] == [10]


def test_a_group_of_one_energy_has_a_distance(spark):
    """600.19 is at most 500.19 + 100 as a sum, but its distance is above 100."""
    records = spark.createDataFrame([("n", 1, 600.19, 1.0)], "by string, record int, e double, dx double")
    known = spark.createDataFrame([("n", 10, 500.19, 500.19, 500.19)], "by string, grp int, low double, high double, mean double")
    assert grouping.candidate_groups(records, known, ["by"]).isEmpty()


def test_in_order_holds_near_pairs_only():
    """A square of 1,500 records and groups took 18 MB and 16 times that at 6,000."""
    rng = random.Random(5)
    xs, centres = (sorted(rng.uniform(0, 10_000) for _ in range(1500)) for _ in range(2))
    tracemalloc.start()
    taken = adopted._in_order(xs, centres, 20.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    chosen = [(k, g) for k, g in enumerate(taken) if g is not None]
    assert len(chosen) > 1000 and all(abs(xs[k] - centres[g]) <= 20 for k, g in chosen) and [g for _, g in chosen] == sorted({g for _, g in chosen})
    assert peak < 4_000_000
    # Hand-made: the farther pair is given up for two, ties go to the lower centre.
    assert adopted._in_order([1.0, 2.0, 9.0], [1.5, 2.5], 1.0) == [0, 1, None]
    assert adopted._in_order([1.0, 2.0], [1.9], 1.0) == [None, 0]


def test_candidates_stop_at_the_first_group_out_of_reach(spark):
    records = spark.createDataFrame([("n", 1, 1000.0, 1.0), ("n", 2, 5.0, None)], "by string, record int, e double, dx double")
    known = spark.createDataFrame([("n", g, m - 1, m + 1, m) for g, m in enumerate([4.0, 905.0, 960.0, 1002.0, 1050.0, 1180.0])], "by string, grp int, low double, high double, mean double")
    got = sorted((r.record, r.grp) for r in grouping.candidate_groups(records, known, ["by"]).collect())
    # Reach 100 at 1000 keV: 905 to 1050; 4.9 keV at 5 keV.
    assert got == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 0)]


def test_gamma_subgroups(spark):
    rows = [(1, "A", 1, 100.0, None, False), (1, "B", 2, 101.0, None, False), (1, "A", 3, 104.0, None, False), (1, "B", 4, 150.0, None, False), (2, "A", 5, 100.0, "*", False), (2, "B", 6, 200.0, "*", True), (3, "A", 7, 50.0, "*", False), (3, "C", 8, 52.0, None, False)]
    found = grouping.gamma_subgroups(spark.createDataFrame(rows, "lev int, dsid string, record long, x double, marker string, is_adopted boolean"), ["lev"], 5.0).collect()
    grouped: dict = {}
    for r in found:
        grouped.setdefault((r.lev, r.grp), set()).add((r.record, r.marker))
    # Group 5 is starred and holds nothing adopted; record 7 is left once, and unstarred.
    assert grouped == {(1, 0): {(1, None), (2, None)}, (1, 1): {(3, None)}, (1, 2): {(4, None)}, (2, 0): {(6, None)}, (3, 0): {(7, None), (8, None)}}


def test_coarse_groups_keep_agreeing_neighbours(spark):
    rows = [("n", 0.0, 1.0), ("n", 8.0, 1.0), ("n", 20.0, 9.0), ("n", 31.0, 9.0)]
    frame = spark.createDataFrame(rows, "by string, x double, dx double")
    plain = sorted((r.x, r.island) for r in groups.coarse_groups(frame.drop("dx"), "by", 10.0).collect())
    agree = sorted((r.x, r.island) for r in groups.coarse_groups(frame, "by", 10.0).collect())
    assert [i for _, i in plain] == [0, 0, 1, 2] and [i for _, i in agree] == [0, 0, 1, 1]


def test_numbered_over_the_whole_table(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 20), k) for k in range(300)]
    found = groups.numbered(spark.createDataFrame(rows, "x int, k int").repartition(5), [], ["x", "k"], "place").collect()
    assert [(r.x, r.k) for r in sorted(found, key=lambda r: r.place)] == sorted(rows)
    assert sorted(r.place for r in found) == list(range(1, 301))


def test_rescored_members_and_blocked_pairs(spark, sf_dir):
    levels = queries.customer_levels(spark, sf_dir).withColumn("level_id", F.col("key").cast("string")).withColumn("level_index", F.col("key").cast("int")).withColumn("gamma_decays", F.array().cast(GAMMAS))
    near = matching.match(levels, block=["nation"], reach=25.0)
    joined = near.pairs.select(F.abs(F.col("level_index_1") - F.col("level_index_2")).alias("d"))
    assert joined.count() > 0
    assert near.clusters.select("level_id").distinct().count() == levels.count()


def test_settings_round_trip():
    changed = MatchConfig(sigma_scale=0.2, gamma_grid=(0.0, 1.0))
    assert MatchConfig.from_json(changed.to_json()) == changed and MatchConfig.from_json("{}") == CONFIG
    with pytest.raises(TypeError):
        MatchConfig.from_json('{"unknown": 1}')


def test_reports_are_written(spark, tmp_path):
    frame = spark.createDataFrame([("b", 2), ("a", 1)], "line string, place int")
    reports.write_reports({"lev": frame, "gam": frame.drop("place")}, f"file://{tmp_path}", "34S")
    assert [r.value for r in spark.read.text(f"file://{tmp_path}/34S.lev").collect()] == ["a", "b"]
    assert spark.read.text(f"file://{tmp_path}/34S.gam").count() == 2
    (line,) = [r.line for r in reports.record_lines(spark.createDataFrame([("34S", "L", "2127.5", "2", "2+")], "nucid string, record string, energy_text string, uncertainty_text string, field string")).collect()]
    assert len(line) == 80 and line[7] == "L" and line[9:19].strip() == "2127.5" and line[22:24] == "2+"


@pytest.mark.parametrize(("body", "head", "quoted", "value"), record_queries.COMMENTS)
def test_comments(spark, body, head, quoted, value):
    row = spark.createDataFrame([(body, head)], "b string, h string").select(comments.says_from_adopted(F.col("b"), F.col("h")), comments.adopted_value(F.col("b"), F.col("h"))).first()
    assert tuple(row) == (quoted, value)


def test_blocks_do_not_change_an_average(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x, dx = rng.normal(10, 1, 50), rng.uniform(0.5, 2, 50)
    whole = averages.expected_value(x, dx)
    monkeypatch.setattr(averages, "BLOCK", 170)
    assert averages.expected_value(x, dx) == pytest.approx(whole, rel=1e-12)
    mean, spread = averages.bootstrap(x, dx, draws=2000)
    assert abs(mean - 10) < 1 and 0 < spread < 1


def best_assignment(records, sides, cost):
    """Most records placed, then least cost, over all assignments without crossing."""
    if not records or not sides:
        return 0, 0.0
    r, g = records[0], sides[0]
    options = [best_assignment(records[1:], sides, cost), best_assignment(records, sides[1:], cost)]
    if (r, g) in cost:
        n, c = best_assignment(records[1:], sides[1:], cost)
        options.append((n + 1, c + cost[r, g]))
    return max(options, key=lambda o: (o[0], -o[1]))


def test_ordered_assignment_is_the_best(spark):
    rng = random.Random(3)
    rows, costs = [], {}
    for island in range(40):
        cost = {(r, g): round(rng.random() * 10, 3) for r in range(1, 6) for g in range(1, 6) if rng.random() < 0.5}
        costs[island] = cost
        rows += [(island, r, g, c) for (r, g), c in cost.items()]
    found: dict = {}
    for x in groups.assign_in_order(spark.createDataFrame(rows, "isl int, record int, grp int, cost double"), ["isl"]).collect():
        found.setdefault(x.isl, []).append((x.record, x.grp))
    for island, cost in costs.items():
        mine = sorted(found.get(island, []))
        assert [g for _, g in mine] == sorted({g for _, g in mine}) and len({r for r, _ in mine}) == len(mine)
        n, total = best_assignment([1, 2, 3, 4, 5], [1, 2, 3, 4, 5], cost)
        assert len(mine) == n and sum(cost[p] for p in mine) == pytest.approx(total)


def test_averages_by_sums_are_those_of_lists(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = []
    for g in range(60):
        n = int(rng.integers(1, 12))
        rows += [(g, float(x), float(d)) for x, d in zip(rng.normal(1000, rng.choice([0.1, 5]), n), rng.choice([0.05, 1, 2], n), strict=True)]
    rows += [(99, 1.0, None), (99, None, 1.0), (98, 1.0, 0.0)]
    frame = spark.createDataFrame(rows, "g int, x double, dx double")
    # No bound of points holds for these two.
    monkeypatch.setattr(averages, "MAX_POINTS", 1)
    found = {(r.g, r.method): (r.value, r.uncertainty) for r in averages.other_averages(frame, "g", "x", "dx", ["LWM", "MP"]).collect()}
    assert set(found) == {(g, m) for g in range(60) for m in ("LWM", "MP")}
    for g in range(60):
        x, dx = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2))
        for name, f in (("LWM", averages.limited_weights), ("MP", averages.mandel_paule)):
            assert found[g, name] == pytest.approx(f(x, dx), rel=1e-6), (g, name)


def test_averages_beside_lists_are_taken_from_them(spark, monkeypatch):
    import numpy as np

    rows = [(g, float(k * k % 7 + g), 0.5 + k % 3) for g in range(9) for k in range(g + 1)]
    monkeypatch.setattr(averages, "keep", lambda *a: pytest.fail("rounds over the rows"))
    found = averages.other_averages(spark.createDataFrame(rows, "g int, x double, dx double"), "g", "x", "dx", ["LWM", "EVM", "MP"]).collect()
    assert len(found) == 27
    for r in found:
        x, dx = np.array(sorted((x, d) for g, x, d in rows if g == r.g)).T
        assert (r.value, r.uncertainty) == pytest.approx(averages.METHODS[r.method](x, dx), rel=1e-9)


def test_islands_over_batches(spark):
    """Islands that span Arrow batches, with nulls in their keys, are solved whole and
    one by one."""
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), k) for k in range(600)] + [(9, "long", k) for k in range(300)]
    frame = spark.createDataFrame(rows, "k int, s string, v int").repartition(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = groups.by_island(frame, ["k", "s"], ["v"], lambda v: [(len(v), sum(v))], "n int, total int").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want: dict = {}
    for k, s, v in rows:
        n, total = want.get((k, s), (0, 0))
        want[k, s] = (n + 1, total + v)
    assert len(found) == len(want) and {(r.k, r.s): (r.n, r.total) for r in found} == want


def test_assignment_without_pairs_is_that_of_pairs(spark):
    rng = random.Random(5)
    rows = [(99, "record", 1, None), (99, "grp", 1, 5.0)]
    for n in range(40):
        for side in ("record", "grp"):
            xs = sorted(rng.choice([rng.randint(0, 30) * 1.0, rng.uniform(0, 30)]) for _ in range(rng.randint(0, 14)))
            rows += [(n, side, k, x) for k, x in enumerate(xs, 1)]
    frame = spark.createDataFrame(rows, "n int, side string, place int, x double")
    found = groups.assign_near(frame, ["n"], 4.0).collect()
    side = lambda name, value: frame.where(F.col("side") == name).select("n", F.col("place").alias(name), F.col("x").alias(value))
    near = side("record", "a").join(side("grp", "b"), "n").withColumn("cost", F.abs(F.col("a") - F.col("b"))).where("cost <= 4")
    assert sorted(map(tuple, found)) == sorted(map(tuple, groups.assign_in_order(near, ["n"]).collect())) and len(found) > 100
