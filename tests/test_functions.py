"""Scalar expectation tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchengine.functions import nuclear, similarity, text
from matchengine.operators import averages, groups, learning, pairs, rules
from matchengine.schema import GAMMAS
from matchengine.sources import datasets, logs, reports
from matchengine.streaming import ingest


def values(spark, rows, schema, column):
    frame = spark.createDataFrame(rows, schema).coalesce(1)
    return [r[0] for r in frame.select(column).collect()]


def test_uncertainty_from_precision(spark):
    cases = {"2000": 5, "2.0E3": 500, "2.00E3": 50, "1234.5": 0.5, "567.89": 0.05, "2E3": 5000, "": 5, "2000.0": 0.5, None: 5, "2Ex": 5}
    got = values(spark, [(c,) for c in cases], "t string", text.uncertainty_from_precision(F.col("t")))
    assert got == pytest.approx(list(cases.values()))


def test_absolute_uncertainty(spark):
    cases = [("123", "12", 12), ("123.4", "12", 1.2), ("0.123", "4", 0.004), ("5", "", 0), ("2.0E3", "3", 300)]
    got = values(spark, [c[:2] for c in cases], "v string, u string", text.absolute_uncertainty(F.col("v"), F.col("u")))
    assert got == pytest.approx([c[2] for c in cases])


def test_spin_parity(spark):
    n, t = None, True
    f = False
    cases = {
        "1:3": [(2, f, n, f), (4, f, n, f), (6, f, n, f)], "2-,3-": [(4, f, "-", f), (6, f, "-", f)], "(4)-": [(8, t, "-", t)], "5(+)": [(10, t, "+", t)],
        "(1,2)+": [(2, t, n, f), (4, t, "+", t)], "(3,4)(+)": [(6, t, n, f), (8, t, "+", t)], "(1+,2+)": [(2, t, "+", t), (4, t, "+", t)], "(3/2+,5/2-)": [(3, t, "+", t), (5, t, "-", t)],
        "3/2,5/2,7/2(+)": [(3, f, n, f), (5, f, n, f), (7, t, "+", t)], "(3/2,5/2,7/2)+": [(3, t, n, f), (5, f, n, f), (7, t, "+", t)], "1/2:11/2": [], "unknown": [], "": [], None: [], "x": [],
    }
    got = values(spark, [(c,) for c in cases], "t string", text.parse_spin_parity(F.col("t")))
    assert [[tuple(o) for o in g] for g in got] == list(cases.values())


GAMMA_CASES = [
    ([(2000, 0, 100, 0), (1400, 3, 80, 10), (900, 3, 25, 5), (600, 3, 5, 2), (300, 3, 5, 2)], [(2005, 2, 85, 10), (1405, 3, 100, 0)], 0.986),
    ([(2000, 0, 100, 0), (1400, 3, 80, 10), (900, 3, 25, 5), (600, 3, 5, 2), (300, 3, 5, 2)], [(899, 2, 65, 10), (598, 3, 100, 0)], 0.182),
    ([], [(1, 1, 1, 1)], 0.5),
    ([(0, 1, 5, 1)], [(1, 1, 1, 1)], 0.5),
    ([(902, 2, 0, 0), (1400, 3, 0, 0)], [(900, 3, 25, 5), (1402, 3, 80, 10), (5, 1, 1, 1)], 1.0),
]


def test_gamma_similarity(spark):
    row = lambda g: [tuple(map(float, x)) for x in g]
    got = values(spark, [(row(a), row(b)) for a, b, _ in GAMMA_CASES], f"a {GAMMAS}, b {GAMMAS}", similarity.gamma_similarity(F.col("a"), F.col("b")))
    assert got == pytest.approx([c[2] for c in GAMMA_CASES], abs=0.02)


def test_specificity_forms(spark):
    want = {"sqrt": [1, 0.71, 0.5, 0.33], "linear": [1, 0.5, 0.25, 0.11], "log": [1, 0.77, 0.62, 0.51], "tunable": [1, 0.67, 0.4, 0.2]}
    for form, numbers in want.items():
        assert values(spark, [(m, 1) for m in (1, 2, 4, 9)], "a int, b int", similarity.specificity(F.col("a"), F.col("b"), form)) == pytest.approx(numbers, abs=0.006)
    with pytest.raises(ValueError):
        similarity.specificity(F.lit(1), F.lit(1), "other")


def test_physics_label(spark):
    rows = [(1.0, 1.0, 1.0, 1.0, 0.5, 0.92195), (0.4, 0.8, 0.8, 1.0, 0.5, 0.29503), (0.4, 1.0, 1.0, 1.0, 0.5, 0.58310), (1.0, 0.05, 1.0, 1.0, 0.5, 0.0), (1.0, 1.0, 0.05, 1.0, 0.5, 0.20616)]
    got = values(spark, [r[:5] for r in rows], "e double, s double, p double, c double, g double", similarity.physics_label(*map(F.col, "espcg")))
    assert got == pytest.approx([r[5] for r in rows], abs=1e-5)


def test_text_helpers(spark):
    one = spark.range(1)
    got = one.select(text.tag_marker(F.lit("A(*)")), F.size(text.wrap_line(F.lit("aa bb cc dd"), 5)), text.rounded_like(F.lit(12.345), F.lit("12.3")), text.short_label(F.lit("x " * 20)), text.message_line(F.lit(3), F.lit("bad"), F.lit("E")), text.nuclide(F.lit("34S"))["mass"], text.evaluator_input(F.lit(" 5 "), F.lit(" "))).first()
    assert got[0] == "*" and got[1] == 2 and got[2] == "12.3" and got[3] == "x" and got[4].startswith("   *") and got[5] == 34 and got[6] == "5"


LOG = """# Dataset A:
 34S   L 0         0  0+
 34S   L 600       1

 34S   L 2000      1  (1+,2+)
 34S   G 1400      1  100
 34S   G 2000      1  23     3
 34S  cL 2000      comment
 34S   L X+100     1
# Dataset B:
 34S   G 5         1
 34S   L 603       3
"""


def test_log_to_json_and_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.log").write_text(LOG)
    records = logs.parse_records(logs.carry_forward(logs.read_lines(spark, f"file://{tmp_path}/in/x.log")))
    assert records.where("rejected IS NOT NULL").count() == 1
    numbered = logs.number_levels(records)
    levels, gammas = logs.levels(numbered), logs.gammas(numbered)
    assert sorted((r.dataset_code, r.level_index, r.energy_value) for r in levels.collect()) == [("A", 0, 0.0), ("A", 1, 600.0), ("A", 2, 2000.0), ("B", 0, 603.0)]
    assert sorted((r.initial_level, r.final_level, r.intensity, r.intensity_uncertainty.value) for r in gammas.collect()) == [(2, 0, 23.0, 3.0), (2, 1, 100.0, 5.0)]
    datasets.write_datasets(datasets.to_documents(levels, gammas), f"file://{tmp_path}/json")
    back = datasets.read_datasets(spark, f"file://{tmp_path}/json/dataset_code=A/log=x", r"dataset_code=([A-Z])/")
    got = {r.level_id: r for r in back.collect()}
    assert sorted(got) == ["A_0", "A_2000", "A_600"] and [g.energy for g in got["A_2000"].gamma_decays] == [1400.0, 2000.0]
    assert [o.twoTimesSpin for o in got["A_2000"].spin_parity_list] == [2, 4]
    assert logs.blocks(logs.read_lines(spark, f"file://{tmp_path}/in/x.log")).agg(F.sum("n_levels")).first()[0] == 6


def test_files_with_one_dataset_code_stay_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    record = lambda kind, e: f" 34S   {kind} {e:<10}".ljust(80)
    for name, energies in (("x", (0, 600)), ("y", (0, 900))):
        (tmp_path / "in" / f"{name}.log").write_text("\n".join(["# Dataset A:", record("L", energies[0]), record("L", energies[1]), record("G", energies[1])]))
    numbered = logs.number_levels(logs.parse_records(logs.carry_forward(logs.read_lines(spark, f"file://{tmp_path}/in"))))
    levels, gammas = logs.levels(numbered), logs.gammas(numbered)
    assert levels.count() == 4
    assert sorted((r.file[-5:], r.energy_value, r.initial_level, r.final_level, r.line_no) for r in gammas.collect()) == [("x.log", 600.0, 1, 0, 3), ("y.log", 900.0, 1, 0, 3)]
    documents = datasets.to_documents(levels, gammas)
    found = sorted((r.file[-5:], [v.energy.value for v in r.levelsTable.levels], [g.energy.value for g in r.gammasTable.gammas]) for r in documents.collect())
    assert found == [("x.log", [0.0, 600.0], [600.0]), ("y.log", [0.0, 900.0], [900.0])]
    datasets.write_datasets(documents, f"file://{tmp_path}/json")
    back = datasets.read_datasets(spark, f"file://{tmp_path}/json/dataset_code=A/*", r"log=(.)/").collect()
    assert sorted((r.level_id, len(r.gamma_decays)) for r in back) == [("x_0", 0), ("x_600", 1), ("y_0", 0), ("y_900", 1)]


def test_blocks_of_a_large_file(spark, tmp_path):
    """A file that many tasks read keeps its line numbers, datasets and continuations."""
    rng, lines = random.Random(4), []
    for k in range(900):
        lines.append(rng.choice(["", f"# Dataset D{k}:", f" 34S   L {k}", f" 34S   G {k}", f" 34S  cL comment {k}", f" 34S 2cL goes on {k}", "\u00e9 text"]).ljust(rng.choice([0, 80])))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "in" / "b.log").write_text("\r\n".join(["# Dataset B:", " 34S   L 7 "]))
    with_small_blocks = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in with_small_blocks}
    try:
        for k, v in with_small_blocks.items():
            spark.conf.set(k, v)
        read = logs.read_lines(spark, f"file://{tmp_path}/in")
        rows = read.collect()
        datasets_of = sorted((r.line_no, r.dataset_code) for r in logs.carry_forward(read).collect() if r.file.endswith("a.log"))
        records = sorted((r.line_no, r.n_lines, r.record, r.text) for r in logs.with_continuations(logs.carry_forward(read)).collect() if r.file.endswith("a.log"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({r.block for r in rows if r.file.endswith("a.log")}) > 10
    assert [r.line for r in sorted((r for r in rows if r.file.endswith("a.log")), key=lambda r: r.line_no)] == lines
    assert sorted((r.line_no, r.line) for r in rows if r.file.endswith("b.log")) == [(0, "# Dataset B:"), (1, " 34S   L 7 ")]
    code, want, joined = None, [], []
    for n, line in enumerate(lines):
        if line.startswith("#"):
            code = line.split()[2][:-1]
        elif line.strip() and code:
            want.append((n, code))
            if line[5:6] in (" ", "1", ""):
                joined.append([n, code, line[6:8], [line[9:80].rstrip()]])
            elif joined and joined[-1][1] == code:
                joined[-1][3].append(line[9:80].rstrip())
    assert datasets_of == want
    assert records == [(n, len(t), " " + kind, " ".join(t)) for n, _, kind, t in joined] and max(r[1] for r in records) > 1


def test_stream_of_logs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.log").write_text(LOG)
    seen = []
    q = ingest.ingest(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/state", lambda levels, gammas, n: seen.append((levels.count(), gammas.count())))
    q.awaitTermination(60)
    assert seen == [(4, 2)]


def test_cluster_report_round_trip(spark):
    rows = [(1, "A", "A_0", True, None), (1, "B", "B_0", False, 0.942), (2, "A", "A_6", True, None)]
    told = reports.cluster_report(spark.createDataFrame(rows, "cluster_no int, dataset_code string, level_id string, is_anchor boolean, match_probability double"))
    lines = told.select(F.lit("f").alias("file"), F.posexplode(F.split("text", "\n")).alias("k", "line"), "cluster_no").select("file", (F.col("cluster_no") * 100 + F.col("k")).alias("line_no"), "line")
    got = sorted((r.cluster_no, r.level_id, r.is_anchor, r.match_probability) for r in reports.parse_cluster_report(lines).collect())
    assert got == [(1, "A_0", True, None), (1, "B_0", False, pytest.approx(0.942)), (2, "A_6", True, None)]


def test_range_join_equals_theta_join(spark):
    a = spark.createDataFrame([(k, float((k * 37) % 101) - 50) for k in range(80)], "i long, x double")
    b = spark.createDataFrame([(k, float((k * 53) % 97) - 48.5) for k in range(80)], "j long, y double")
    fast = pairs.range_join(a, b, F.col("x"), F.col("y"), 3.0).select("i", "j")
    assert sorted(map(tuple, fast.collect())) == sorted((r.i, s.j) for r in a.collect() for s in b.collect() if abs(r.x - s.y) <= 3.0)


def test_range_join_at_the_very_end_of_the_reach(spark):
    """The difference rounds to the reach, and the values lie two of its widths apart."""
    a, b = (spark.createDataFrame([(v,)], f"{n} double") for n, v in (("x", -1e-15), ("y", 50.0)))
    assert pairs.range_join(a, b, F.col("x"), F.col("y"), 50.0).count() == 1


def test_nearest_forms_no_pairs(spark):
    """Against all pairs: ties, equal values, empty buckets, nulls and the end of the reach."""
    rng = random.Random(7)
    value = lambda: rng.choice([None, float("nan"), -1e-15, 0.0, 5.0, 10.0, 15.0, *[rng.randrange(-400, 400) / 4 for _ in range(60)]])
    one, two = ([(rng.choice(["p", "q", None]), k, value()) for k in range(120)] for _ in range(2))
    a, b = spark.createDataFrame(one, "by string, i long, x double"), spark.createDataFrame(two, "by string, j long, y double")
    fits = lambda v, w: v[0] is not None and v[0] == w[0] and v[2] is not None and w[2] is not None and abs(v[2] - w[2]) <= 5.0
    best = lambda v, other: min(((abs(v[2] - w[2]), w[1]) for w in other if fits(v, w)), default=None)
    found = pairs.nearest(a, b, F.col("x"), F.col("y"), ["i"], F.col("j"), 5.0, ["by"])
    assert {r.i: r.nearest and tuple(r.nearest) for r in found.collect()} == {v[1]: best(v, two) for v in one}
    both = pairs.mutually_nearest(a, b, F.col("x"), F.col("y"), "i", "j", 5.0, ["by"]).collect()
    assert {(r.i, r.j, r.distance) for r in both} == {(v[1], w[1], abs(v[2] - w[2])) for v in one for w in two if fits(v, w) and best(v, two)[1] == w[1] and best(w, one)[1] == v[1]}
    # The only join is that of the answers to the left rows.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_averages(spark):
    rows = spark.createDataFrame([("a", 10.0, 1.0), ("a", 12.0, 2.0), ("a", 11.0, None), ("b", 5.0, 1.0)], "g string, x double, dx double")
    got = {r.g: r for r in averages.weighted_mean(rows, ["g"], "x", "dx").collect()}
    assert got["a"].n == 2 and got["a"].weighted == pytest.approx((10 + 12 / 4) / 1.25) and got["a"].chi2 == pytest.approx(0.8) and got["b"].external == 0
    x, dx = np.array([10.0, 10.1, 9.9, 15.0]), np.array([0.1, 0.1, 0.1, 0.1])
    for name, f in averages.METHODS.items():
        value, error = f(x, dx)
        assert 9.5 < value < 12 and 0 < error < 5, name
    assert averages.METHODS["RT"](x, dx)[0] == pytest.approx(10.0, abs=0.1)


def test_groups(spark):
    rows = spark.createDataFrame([("n", float(x)) for x in (0, 4, 8, 12, 16, 40)], "by string, x double")
    got = sorted((r.x, r.island, r.part) for r in groups.coarse_groups(rows, "by", 6.0).collect())
    assert [g[1:] for g in got] == [(0, 0), (0, 0), (0, 0), (0, 1), (0, 1), (1, 0)]
    cost = spark.createDataFrame([("n", 1, 1, 5.0), ("n", 1, 2, 1.0), ("n", 2, 1, 1.0), ("n", 2, 2, 4.0)], "by string, record int, grp int, cost double")
    assert sorted((r.record, r.grp) for r in groups.assign_in_order(cost, ["by"]).collect()) == [(1, 1), (2, 2)]
    labels = spark.createDataFrame([("f", str(k), float(k)) for k in range(5)], "fig string, label_id string, y double")
    moved = sorted(r.label_y for r in groups.spread_labels(labels, "fig", 3.0).collect())
    assert min(b - a for a, b in zip(moved, moved[1:], strict=False)) > 2.9


def test_rules(spark):
    rows = spark.createDataFrame([(1, 3, 2, "E2", ["M1", "E2"]), (2, 0, 2, "E3", ["M1"]), (3, None, 1, "", [])], "id int, final_level_index int, level_index int, mult string, expected_mult array<string>")
    got = sorted((r.id, r.rule) for r in rules.check(rows, rules.gamma_rules(), ["id"]).collect())
    assert got == [(1, "R17"), (2, "R18"), (3, "R17")]
    noted = [("(M1+E2)", 0), ("[E2]", 0), ("M1(+E2)", 0), ("E1,M2", 1), ("D+Q", 0), ("E2 ", 0), ("M1+E2", 0), ("E1+E2", 1), ("O", 1), ("E3", 1), ("", 0), (None, 0)]
    frame = spark.createDataFrame([(m, ["M1", "E2"], n) for m, n in noted], "mult string, expected_mult array<string>, n int")
    assert all((r.m == "") == (r.n == 0) for r in frame.select("n", F.when(nuclear.mult_unexpected(F.col("mult"), F.col("expected_mult")), "x").otherwise("").alias("m")).collect())
    levels = spark.createDataFrame([(1, "2021WA16", "12", "B- DECAY"), (2, "2012WA38", "12", "34P B+ DECAY")], "id int, q_reference string, q_uncertainties string, dsid string")
    assert sorted((r.id, r.rule) for r in rules.check(levels, rules.level_rules(), ["id"]).collect()) == [(2, "R10"), (2, "R3")]


def test_nuclear(spark):
    got = spark.range(1).select(nuclear.multipolarities(F.lit(4), F.lit("+"), F.lit(0), F.lit("+")), nuclear.coupled_spins(F.lit(3), F.lit(1)), nuclear.half_life_from_width(F.lit(1.0)), nuclear.log_ft_conflict(F.lit(5.0), F.lit(0.1), F.lit(""), F.lit(2), F.lit(False), F.lit(""))).first()
    assert got[0] == ["E2"] and got[1] == [2, 4] and got[2] == pytest.approx(4.56e-16, rel=1e-2) and got[3] == "log ft does not fit the spin change"


def test_learning(spark):
    rows = learning.training_set(spark)
    assert rows.count() == 22_198
    train, check = learning.split(rows)
    assert train.count() + check.count() == 22_198 and 4_000 < check.count() < 5_000
    scored = learning.BoostedScorer(trees=10, depth=5).fit(train).score(check)
    assert averages.regression_metrics(scored, "label", "probability").first().rmse < 0.1
    assert set(r.probability for r in learning.ClusterScorer().fit(train).score(check).select("probability").distinct().collect()) == {0.0, 1.0}


def test_kept_tables_are_swept(spark):
    from matchengine import durable

    kept = durable.keep(spark.range(5), "numbers")
    assert kept.count() == 5
    folder = durable.own_folder(spark).removeprefix("file://")
    import os

    assert os.path.isdir(folder)
    durable.sweep(spark)
    assert not os.path.isdir(folder)


def test_fine_groups(spark):
    from matchengine.operators import adopted

    rows = [("n", "A", 1, 100.0), ("n", "A", 2, 110.0), ("n", "A", 3, 120.0), ("n", "B", 4, 102.0), ("n", "B", 5, 119.0), ("n", "C", 6, 111.0), ("n", "C", 7, 140.0)]
    found = adopted.fine_groups(spark.createDataFrame(rows, "nuclide string, dsid string, record long, x double"), ["nuclide"], 5.0).collect()
    groups_: dict[int, set[int]] = {}
    for r in found:
        groups_.setdefault(r.grp, set()).add(r.record)
    assert [groups_[k] for k in sorted(groups_)] == [{1, 4}, {2, 6}, {3, 5}, {7}]


def test_matching_adopted_levels(spark):
    from matchengine.operators import adopted

    levels = spark.createDataFrame([("n", 1, "B", 100.0), ("n", 2, "B", 200.0), ("n", 3, "B", 300.0), ("n", 4, "B", 900.0)], "nuclide string, level long, dsid string, x double")
    known = spark.createDataFrame([("n", 10, 100.5, ["A"]), ("n", 11, 102.0, ["B"]), ("n", 12, 207.0, []), ("n", 13, 300.0, ["B"])], "nuclide string, adopted long, y double, xref array<string>")
    got = {r.level: (r.adopted, r.status) for r in adopted.match_adopted(levels, known, ["nuclide"], 10.0, 5.0).collect()}
    assert got == {1: (11, "chosen"), 2: (12, "discrepant"), 3: (13, "single"), 4: (None, "none")}


def test_matching_adopted_levels_forms_no_pairs(spark):
    """Listed ones first, several in reach by equal energies, none with null energies."""
    from matchengine.operators import adopted

    levels = spark.createDataFrame([("n", 1, "B", 100.0), ("n", 2, "B", 205.0), ("n", 3, None, 205.0), ("n", 4, "B", None)], "nuclide string, level long, dsid string, x double")
    known = spark.createDataFrame([("n", 10, 101.0, None), ("n", 11, 101.0, ["A"]), ("n", 12, 210.0, ["A", "B", "B"]), ("n", 13, 205.0, []), ("n", 14, None, ["B"])], "nuclide string, adopted long, y double, xref array<string>")
    found = adopted.match_adopted(levels, known, ["nuclide"], 10.0, 5.0)
    assert {r.level: (r.adopted, r.listed, r.distance, r.status) for r in found.collect()} == {1: (10, False, 1.0, "chosen"), 2: (12, True, 5.0, "chosen"), 3: (13, False, 0.0, "chosen"), 4: (None, None, None, "none")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 0


def test_rounded_like(spark):
    cases = [(1234.56, "1234.5", "1234.6"), (999.99, "1000.0", "1000.0"), (1234.56, "1234", "1235"), (0.123456784, "0.12345678", "0.12345678"), (-0.06, "1.0", "-0.1"), (5.0, "5.000", "5.000"), (1234567.5, "1234567.50", "1234567.50"), (0.004, "0.00", "0.00")]
    got = values(spark, [c[:2] for c in cases], "v double, p string", text.rounded_like(F.col("v"), F.col("p")))
    assert got == [c[2] for c in cases]


def test_levels_of_both_ends_join_each_others_clusters():
    """Overlapping datasets: a joins the cluster of b, and b that of a."""
    from matchengine.operators.cluster import GreedyCliques

    levels = [("A", "a1"), ("B", "b1"), ("C", "c1"), ("C", "c2")]
    found = GreedyCliques(levels, [("a1", "c1"), ("b1", "c2"), ("a1", "b1"), ("a1", "c2"), ("b1", "c1")])
    got = sorted(tuple(sorted(c.items())) for c in found.clusters())
    # After the first two edges the clusters A+C(c1) and B+C(c2) both hold C.
    assert (("A", "a1"), ("B", "b1"), ("C", "c1")) in got
    assert (("A", "a1"), ("B", "b1"), ("C", "c2")) in got


def test_older_gamma_similarity(spark):
    line = "array<struct<energy:double,energy_uncertainty:double,intensity:double,intensity_uncertainty:double>>"
    rows = [
        # Energies two keV apart agree only with the older 1 keV on each side.
        (1, [(500.0, 0.0, 100.0, 0.0)], [(502.0, 0.0, 100.0, 0.0)], 1.0),
        # Intensities 100(10) and 72(7): within 2.4 sigmas, beyond the older limit of 2.
        (2, [(500.0, 1.0, 100.0, 0.0), (900.0, 1.0, 100.0, 0.0)], [(500.0, 1.0, 100.0, 0.0), (900.0, 1.0, 72.0, 0.0)], (100 + 72) / 172),
        (3, [], [(1.0, 1.0, 1.0, 1.0)], 0.5),
    ]
    found = spark.createDataFrame(rows, f"k int, a {line}, b {line}, want double").select("k", "want", similarity.old_gamma_similarity(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.got == pytest.approx(r.want) for r in found), found


def test_bare_lists_of_levels(spark, tmp_path):
    (tmp_path / "A.json").write_text('{"levelsTable": {"levels": [{"energy": {"value": 1.0}, "gammas": [0]}]}, "gammasTable": {"gammas": [{"energy": {"value": 1.0}}]}}')
    (tmp_path / "B.json").write_text('\n [{"energy": {"value": 2.0}},\n {"energy": {"value": 3.0}, "gammas": [0]}]')
    found = sorted((r.dataset_code, r.energy_value, len(r.gamma_decays)) for r in datasets.read_datasets(spark, f"file://{tmp_path}").collect())
    assert found == [("A", 1.0, 1), ("B", 2.0, 0), ("B", 3.0, 0)]


def test_merged_datasets_are_written_in_order(spark, tmp_path):
    lines = [("34S", d, n, f"{d} line {n}") for d in ("X", "ADOPTED") for n in range(30)] + [("35S", "X", 0, "one"), ("35S", "gone", 0, "none")]
    ranks = [("34S", "ADOPTED", 0), ("34S", "X", 1), ("35S", "X", 1)]
    merged = reports.merged_lines(spark.createDataFrame(lines, "nuclide string, dsid string, line_no int, line string").repartition(3), spark.createDataFrame(ranks, "nuclide string, dsid string, rank int"))
    reports.write_merged(merged, f"file://{tmp_path}/out")
    read = logs.read_lines(spark, f"file://{tmp_path}/out/nuclide=34S").orderBy("line_no").collect()
    assert [r.line.rstrip() for r in read] == [f"ADOPTED line {n}" for n in range(30)] + [""] + [f"X line {n}" for n in range(30)] + [""] and {len(r.line) for r in read} == {80}
    reports.write_merged(merged.where("nuclide = '35S'"), f"file://{tmp_path}/out")
    assert logs.read_lines(spark, f"file://{tmp_path}/out/nuclide=34S").count() == 62


def test_printed_values_of_two_sides(spark):
    rows = [
        ("12.34(5)", 12.34, 0.05, 0.05, None), ("12.34 5", 12.34, 0.05, 0.05, None), ("320 FS 40", 320.0, 40.0, 40.0, "FS"), ("1.2 PS +4-3", 1.2, 0.4, 0.3, "PS"), ("1.2(+4-3) PS", 1.2, 0.4, 0.3, "PS"), ("-5.0 {I12}", -5.0, 1.2, 1.2, None),
        ("7", 7.0, None, None, None), ("7 %", 7.0, None, None, "%"), ("1.5E3 2", 1500.0, 200.0, 200.0, None), ("LT 5", None, None, None, None), ("", None, None, None, None), (None, None, None, None, None), ("5 GT", 5.0, None, None, None),
    ]
    found = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, t string").select("k", text.printed_value(F.col("t")).alias("v")).collect()
    for r in found:
        want = rows[r.k][1:]
        assert tuple(r.v) == tuple(pytest.approx(w) if isinstance(w, float) else w for w in want), rows[r.k]
    body = "T=1.2 ps {I4} (1999Ab01), 1.5(+3-2) (2001Cd02) and 2 from others. T=9"
    (got,) = [r.v for r in spark.createDataFrame([(body,)], "b string").select(text.comment_values(F.col("b"), "T").alias("v")).collect()]
    assert [(v.x, v.label, v.unit) for v in got] == [(1.2, "1999Ab01", "PS"), (1.5, "2001Cd02", None), (2.0, "", None)]
    assert [(v.dx, v.up, v.down) for v in got] == [(pytest.approx(0.4), pytest.approx(0.4), pytest.approx(0.4)), (pytest.approx(0.25), pytest.approx(0.3), pytest.approx(0.2)), (-1.0, None, None)]


def test_parts_of_printed_values_are_evaluated_once(spark):
    frame = spark.createDataFrame([("T=1.2(3)",)], "b string").select(text.comment_values(F.col("b"), "T").alias("v"))
    # Each pattern stands in the plan once or twice; it is evaluated at each place.
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_") < 30
