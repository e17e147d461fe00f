"""Best values of groups, inferred multipolarities and the adopted records."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from matchengine.operators import averages
from matchengine.operators import best_values as bv
from matchengine.sources import reports

VALUES = "grp int, field string, dsid string, place int, text string, unc_text string, tentative boolean, quoted boolean, questionable boolean, is_adopted boolean"


def value(grp, dsid, text, unc="", tentative=False, quoted=False, questionable=False, adopted=False, field="E", place=0):
    return (grp, field, dsid, place, text, unc, tentative, quoted, questionable, adopted)


def test_each_choice(spark):
    rows = [
        value(1, "A", "100.0", "5"), value(1, "B", "101.0", "5"), value(1, "C", "500", "1", tentative=True), value(1, "D", "700", "1", quoted=True),
        value(2, "A", "100", ""), value(2, "B", "101.0", "9", questionable=True), value(2, "C", "102", "", questionable=True),
        value(3, "A", "100", "", questionable=True), value(3, "B", "X+5", ""), value(3, "C", " ", "3"),
        value(4, "A", "99", "1", tentative=True, place=2), value(4, "B", "98", "1", tentative=True, adopted=True, place=3), value(4, "C", "97", "1", quoted=True),
        value(5, "A", "99", "1", quoted=True, place=1), value(5, "B", "98", "2", quoted=True, adopted=True, place=2),
        value(6, "A", None, None), value(7, "A", "5.0", "1", field="T"), value(7, "A", "5.0", "LT"),
    ]
    found = {(r.grp, r.field): (r.choice, r.value, r.uncertainty, r.source) for r in bv.best_values(spark.createDataFrame(rows, VALUES), ["grp"]).collect()}
    assert found == {
        (1, "E"): ("average", "100.5", "5", None),
        (2, "E"): ("firm", "101.0", "9", "B"), (3, "E"): ("firm", "X+5", "", "B"), (4, "E"): ("tentative", "98", "1", "B"), (5, "E"): ("quoted", "98", "2", None), (7, "T"): ("firm", "5.0", "1", "A"), (7, "E"): ("firm", "5.0", "LT", "A"),
    }


def test_the_decision_shuffles_the_values_once(spark):
    """Before, the values were read 10 times and met in as many joins."""
    rows = spark.range(100).selectExpr("id % 9 AS g", "id * 1.5D AS x", "1D + id % 4 AS dx").hint("rebalance")
    plan = averages.average_decision(rows, ["g"], "x", "dx")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Range (") == 1


def test_report_lines_round_as_sql_does(spark):
    values = [1.0005, 4.0005, 1.0015, 1234.5675, 2.0005, 8.0025]
    told = ["adopted", "w_used", "chi2_used", "weighted", "chi2", "unweighted"]
    rows = spark.createDataFrame([(k, "W", 2, *[x] * 6) for k, x in enumerate(values)], "g int, kind string, n long, " + ", ".join(f"{c} double" for c in told))
    got = {r.g: float(r.line.split("used ")[1].split(" ")[0]) for r in reports.decision_lines(rows, ["g"]).collect()}
    assert got == {k: duckdb.execute("SELECT round(?::DOUBLE, 3)", [x]).fetchone()[0] for k, x in enumerate(values)}


MULTS = "g int, dsid string, place int, mult string, quoted boolean, argued boolean, two_ji int, parity_i string, two_jf int, parity_f string"


def test_multipolarities(spark):
    rows = [
        (1, "A", 1, "(E2)", False, False, None, None, None, None), (1, "B", 2, "D", False, False, None, None, None, None), (1, "C", 3, "M1(+E2)", False, False, None, None, None, None),
        (2, "A", 1, "(M1+E2)", False, False, 4, "+", 0, "+"), (2, "B", 2, "[E2]", False, False, 4, "+", 0, "+"),
        (3, "A", 1, "E1", True, False, 2, "-", 4, "+"), (3, "B", 2, "Q", True, True, 2, "-", 4, "+"),
        (4, "A", 1, "", False, None, 4, "+", 0, "+"), (5, "A", 1, None, False, None, 4, "+", 2, "+"), (6, "A", 1, "[M1]", False, None, 4, "+", 2, "-"), (7, "A", 1, "E1", True, None, 0, "+", 0, "+"), (8, "A", 1, "", False, None, 4, None, 0, "+"),
    ]
    found = {r.g: (r.mult, r.mult_choice, r.source) for r in bv.best_multipolarities(spark.createDataFrame(rows, MULTS), ["g"]).collect()}
    assert found == {1: ("M1(+E2)", "firm", "C"), 2: ("(M1+E2)", "tentative", "A"), 3: ("Q", "order", "B"), 4: ("[E2]", "inferred", None), 5: ("[M1,E2]", "inferred", None), 6: ("[E1]", "inferred", None), 7: ("", "none", None), 8: ("", "none", None)}


def test_bands_and_cross_references(spark):
    members = spark.createDataFrame([(1, "n", "x", 500.0), (1, "n", "y", 501.0), (1, "n", "x", 502.0), (2, "n", "y", 100.0), (3, "n", None, 0.0), (4, "m", "x", 9.0)], "level int, nuclide string, band string, energy double")
    assert {r.level: r.flag for r in bv.band_flags(members, ["level"]).collect()} == {1: "B", 2: "A", 4: "A"}
    tags = [(1, "B", None, 1000.0, "1000", 1001.0), (1, "A", "*", 1002.0, "1002", 1001.0), (1, "3", None, 1050.0, "1050", 1001.0), (1, "C", "?", 1001.5, "1001.5", 1001.0)]
    tags += [(2, f"T{k:02d}", None, 5.0, "5", 5.0) for k in range(40)]
    lines = {r.level: r.lines for r in bv.cross_reference_lines(spark.createDataFrame(tags, "level int, tag string, marker string, energy double, energy_text string, adopted_energy double"), ["level"]).collect()}
    assert lines[1] == ["XREF=3(1050)A(1002*)BC(?)"]
    assert [x.split("=")[0] for x in lines[2]] == ["XREF", "XREF+"] and "".join(x.split("=")[1] for x in lines[2]) == "".join(f"T{k:02d}" for k in range(40)) and all(len(x) <= 71 for x in lines[2])


LEVELS = "nuclide string, level int, dsid string, place int, tag string, marker string, energy_text string, energy_unc string, t12_text string, t12_unc string, t12_unit string, spin_text string, quoted boolean, questionable boolean, is_adopted boolean, n_gammas int, band string"
GAMMAS = "nuclide string, level int, gamma long, dsid string, place int, marker string, energy_text string, energy_unc string, ri_text string, ri_unc string, mult string, quoted boolean, argued boolean, questionable boolean, is_adopted boolean, two_ji int, parity_i string, two_jf int, parity_f string"


def test_adopted_records(spark):
    levels = [
        ("34S", 0, "ADOPTED", 0, None, None, "0", "", "STABLE", "", None, "0+", False, False, True, 0, None),
        ("34S", 0, "A", 1, "A", None, "0", "", "", "", None, "0+", False, False, False, 0, None),
        ("34S", 1, "ADOPTED", 0, None, None, "2127.5", "2", "", "", None, "2+", False, False, True, 2, "g"),
        ("34S", 1, "A", 1, "A", None, "2127.9", "5", "320", "40", "FS", "2+", False, False, False, 2, "g"),
        ("34S", 1, "B", 2, "B", None, "2120", "9", "", "", "FS", "2+", False, False, False, 0, None),
        ("34S", 2, "A", 1, "A", None, "3304.0", "4", "", "", None, "2+", False, False, False, 0, None),
        ("34S", 2, "B", 2, "B", None, "3305.0", "4", "", "", None, "2+", False, False, False, 0, None),
    ]
    gamma = lambda level, g, dsid, e, de, ri, dri, mult, spins, place=1: ("34S", level, g, dsid, place, None, e, de, ri, dri, mult, False, False, False, dsid == "ADOPTED", *spins)
    gammas = [
        gamma(1, 1, "A", "2127.4", "3", "100", "", "E2", (4, "+", 0, "+")), gamma(1, 1, "B", "2127.6", "3", "100", "", "", (4, "+", 0, "+"), 2),
        gamma(1, 2, "A", "500.0", "", "3.1", "4", "", (4, "+", 2, "+")),
    ]
    found = bv.adopted_scheme(spark.createDataFrame(levels, LEVELS), spark.createDataFrame(gammas, GAMMAS))
    lines = [r.line.rstrip() for r in found.orderBy("level", "place").collect()]
    assert all(len(r.line) == 80 for r in found.collect())
    assert lines == [
        "  34S  L 0            0+               STABLE",
        "  34SX L XREF=A",
        "  34S  L 2127.5    2  2+               320 FS    40                         A",
        "  34SX L XREF=AB",
        "  34S cL T$from A",
        "  34S  G 500.0        3.1     4  [M1,E2]",
        "  34S  G 2127.50   21 100        E2",
        "  34S cG M,RI$from A",
        "  34S  L 3304.5    5  2+",
        "  34SX L XREF=AB",
    ]


def test_empty_tables(spark):
    assert bv.adopted_scheme(spark.createDataFrame([], LEVELS), spark.createDataFrame([], GAMMAS)).count() == 0
    assert bv.best_values(spark.createDataFrame([], VALUES), ["grp"]).count() == 0


@pytest.mark.parametrize(("spins", "want"), [((4, "+", 0, "+"), "[E2]"), ((2, "-", 2, "-"), "[M1,E2]"), ((1, "+", 1, "+"), "[M1]"), ((8, "+", 2, "-"), "[E3]"), ((0, "+", 0, "+"), None), ((4, "+", 0, None), None)])
def test_inferred(spark, spins, want):
    frame = spark.createDataFrame([spins], "a int, p string, b int, q string")
    assert frame.select(bv.inferred_multipolarity(F.col("a"), F.col("p"), F.col("b"), F.col("q"))).first()[0] == want
