"""Every implemented rule gets its columns in a registered query."""

from __future__ import annotations

import pytest

from matchengine import queries
from matchengine.functions import nuclear
from matchengine.operators import adopted, rules
from pyspark.sql import functions as F


@pytest.mark.parametrize(("name", "implemented"), [("every_level_rule", rules.level_rules), ("every_gamma_rule", rules.gamma_rules)])
def test_no_rule_is_skipped(spark, sf_dir, monkeypatch, name, implemented):
    seen = []
    monkeypatch.setattr(rules, "check", lambda rows, some, key, check=rules.check: seen.append((set(rows.columns), some)) or check(rows, some, key))
    told = {r.rule for r in queries.QUERIES[name](spark, sf_dir).select("rule").distinct().collect()}
    ((columns, some),) = seen
    assert [r.name for r in some if not set(r.needs) <= columns] == []
    assert told == {r.name for r in implemented()}


def test_log_ft_flag_and_window(spark):
    rows = spark.createDataFrame([(9.0, 0.2, 2, True, None, False), (9.0, 0.2, 2, True, "1u", False), (8.6, 0.2, 2, True, "", False), (5.0, 0.1, 0, False, "", True), (6.4, 0.1, 0, False, "", True), (5.0, 0.1, 0, False, "", False)], "f double, u double, dj int, pc boolean, q string, z boolean")
    c = F.col
    got = [(r[0] is not None, r[1] is not None) for r in rows.select(nuclear.unique_flag_missing(c("f"), c("u"), F.lit(""), c("dj"), c("pc"), c("q")), nuclear.zero_to_zero_conflict(c("f"), c("u"), c("z"))).collect()]
    assert got == [(True, False), (False, False), (False, False), (False, True), (False, False), (False, False)]


def test_log_ft_against_spins(spark):
    rows = [(5.0, 0.1, "", 2, True, ""), (5.0, 0.1, "", 1, True, ""), (5.0, 0.1, "", 2, False, ""), (5.0, 0.1, "", 1, False, ""), (5.0, None, "", 2, True, ""), (5.5, 5.0, "LT", 2, False, ""), (9.0, 0.2, "", 2, False, "1U"), (9.0, 0.2, "", 2, False, ""), (8.6, 0.2, "GT", 3, True, "1u"), (9.0, 0.2, "", 2, True, "1U")]
    c = F.col
    frame = spark.createDataFrame(rows, "f double, u double, l string, dj int, pc boolean, q string").coalesce(1)
    got = [r[0] for r in frame.select(nuclear.log_ft_conflict(c("f"), c("u"), c("l"), c("dj"), c("pc"), c("q"))).collect()]
    told = lambda what: f"log ft does not fit the {what} change"
    assert got == [told("parity and spin"), told("parity"), told("spin"), None, None, told("spin"), told("parity"), None, told("spin"), None]


def test_moment_and_q_references(spark):
    rows = [("M1", "2014StZZ", None), ("M1", "1990Ra01,2019StZV", None), ("E2", "2019StZV", None), ("E2", "2021StZZ", None), ("M1", None, "from 2020StZV"), ("M1", None, None), (None, "2011StZZ", None)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, moment string, moment_reference string, moment_comment string")
    assert sorted(r.k for r in rules.check(frame, rules.level_rules(), ["k"]).collect()) == [0, 2, 5]
    frame = spark.createDataFrame([(0, "2012Wa38", "12"), (1, "2021Wa16,1999XX01", "12"), (2, "2012Wa38", "CA"), (3, "", "12")], "k int, q_reference string, q_uncertainties string")
    assert [r.k for r in rules.check(frame, rules.level_rules(), ["k"]).collect()] == [0]


def test_hindrance_factors(spark):
    rows = [(3.0, 0.5, "", True, False, True), (3.6, 0.5, "", True, False, True), (3.0, 0.5, "", True, True, True), (3.6, None, "", True, False, True), (3.9, None, "LT", True, False, True), (9.0, 1.0, "", False, False, False), (None, None, "", True, False, True)]
    c = F.col
    frame = spark.createDataFrame(rows, "hf double, u double, l string, odd boolean, same boolean, natural boolean").coalesce(1)
    assert [r[0] is not None for r in frame.select(nuclear.hindrance_conflict(c("hf"), c("u"), c("l"), c("odd"), c("same"), c("natural"))).collect()] == [True, False, False, False, True, True, False]
    # Relative uncertainties 10 and 10 %, 10 and 13, 20 and 17.5, 5 and 5.8 (off by 0.14, but small), none.
    frame = spark.createDataFrame([(2.0, 0.2, 50.0, 5.0), (2.0, 0.2, 50.0, 6.5), (2.0, 0.4, 40.0, 7.0), (2.0, 0.1, 50.0, 2.9), (2.0, None, 50.0, 5.0), (2.0, 0.2, 50.0, 0.0)], "hf double, u double, a double, ua double").coalesce(1)
    assert [r[0] is not None for r in frame.select(nuclear.hindrance_spread(c("hf"), c("u"), c("a"), c("ua"))).collect()] == [False, True, True, False, False, False]


def test_multipolarities_and_spins_zero(spark):
    c = F.col
    rows = [("M1+E2", "E2+M1"), ("M1,E2", "E2+M1"), ("E2", "M1"), ("[E2]", "M1"), ("E2", "[M1]"), ("", "E1"), ("E1", "E1")]
    frame = spark.createDataFrame(rows, "m string, a string").coalesce(1)
    assert [r[0] for r in frame.select(nuclear.mult_differs(c("m"), c("a"))).collect()] == [False, True, True, False, False, True, False]
    frame = spark.createDataFrame([(0, 0, True), (0, 0, False), (0, 0, None), (0, 2, True), (None, 0, True)], "i int, f int, p boolean").coalesce(1)
    assert [r[0] for r in frame.select(nuclear.zero_to_zero_gamma(c("i"), c("f"), c("p"))).collect()] == ["0 to 0 with a change of parity is not allowed", "0 to 0 is an E0 transition", None, None, None]


def test_negligible_conversion(spark):
    # Limits at Z = 50 for 0.01: E1 62.5 - 212.5 + 269.5 + 102.29 + 57.72 = 279.51,
    # M1 625 - 2487.5 + 3721 - 1683.55 + 371.11 = 546.06; half where questionable.
    c = F.col
    rows = [(279.0, 50, 1, True, False), (280.0, 50, 1, True, False), (139.0, 50, 0, True, True), (140.0, 50, 0, True, True), (546.0, 50, 1, False, False), (547.0, 50, 1, False, False), (1.0, 50, 0, None, False), (0.0, 50, 0, True, False)]
    frame = spark.createDataFrame(rows, "e double, z int, dj int, p boolean, q boolean").coalesce(1)
    got = [r[0] is not None for r in frame.select(nuclear.icc_missing(c("e"), c("z"), c("dj"), c("p"), c("q"))).collect()]
    assert got == [True, False, True, False, True, False, False, False]


def test_placement(spark):
    gammas = spark.createDataFrame([(1, "A", 100.0, None, False), (2, "A", 100.0, 7, False), (3, "A", 200.0, None, False), (4, "A", 200.0, None, True), (5, "B", 100.0, None, None), (6, "A", None, None, False), (7, "A", -3.0, None, True)], "g int, nuclide string, energy double, adopted_gamma int, questionable boolean")
    adopted = spark.createDataFrame([("A", 105.0), ("A", 95.0), ("A", 105.1), ("A", 1.9), ("B", 300.0), ("A", None)], "nuclide string, energy double")
    got = {r.g: (r.message[:7], r.n_similar) for r in rules.placement_rule(gammas, adopted, ["nuclide"], "g").collect()}
    assert got == {1: ("similar", 2), 3: ("no such", 0), 5: ("no such", 0), 6: ("no such", 0), 7: ("similar", 1)}
    assert rules.placement_rule(gammas.limit(0), adopted, ["nuclide"], "g").count() == 0


def test_parent_branches(spark):
    parents = [(1, 1, "EC", 0.5, "3.1", "3.1"), (2, 1, "EC+B+", 1.0, None, "3.1"), (3, 2, "EC+B+", 0.25, "3.1", "3.2"), (4, 2, "A", 0.1, "1", None), (5, 3, "B+", 0.4, None, None), (6, 3, "EC", None, None, None), (7, 4, "B-", 1.0, None, None), (8, 5, "B-", 0.3, None, None)]
    modes = [(1, "EC", 50.0), (1, "EC+B+", 90.0), (2, "B+", 25.0), (3, "EC+%B+", 40.0), (5, "B-", 30.0), (5, "A", 70.0)]
    got = adopted.branch_conflict(spark.createDataFrame(parents, "dataset int, level int, mode string, br double, q string, adopted_q string"), spark.createDataFrame(modes, "level int, mode string, percent double"))
    assert sorted(map(tuple, got.collect())) == [(2, "branching differs from Adopted"), (3, "decay mode is named differently in Adopted"), (3, "parent Q-value differs"), (4, "decay mode is missing in Adopted"), (7, "decay mode is missing in Adopted")]


def test_spin_parities_not_quoted(spark):
    rows = [(1, "2+", "3-", False, True, ["2+"], ["3-"]), (2, "2+", "3-", False, False, ["2+"], ["3-"]), (3, "(1,2)+", "2+", False, False, ["1+", "2+"], ["2+"]), (4, "", "2+", False, False, [], ["2+"]), (5, "2+", "3-", True, False, ["2+"], ["3-"])]
    frame = spark.createDataFrame(rows, "k int, jpi_text string, adopted_jpi string, is_quoted boolean, is_decay boolean, jpi_options array<string>, adopted_options array<string>")
    got = {(r.k, r.message) for r in rules.check(frame, rules.level_rules(), ["k"]).collect()}
    assert got == {(1, "spin-parity differs from Adopted"), (2, "spin-parity contradicts Adopted"), (5, "spin-parity quoted from Adopted differs")}
