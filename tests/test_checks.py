"""The driver of all rules on a hand-made nuclide."""

from __future__ import annotations

import duckdb
import pytest
from oracle import TABLES, assert_same
from pyspark.sql import functions as F

import __spark_entry__
from matchengine.functions import nuclear
from matchengine.operators import checks, rules

LEVELS = "nuclide string, dsid string, level long, line_no long, energy_text string, unc_text string, jpi_text string, t12_text string"
GAMMAS = "nuclide string, dsid string, gamma long, level long, line_no long, energy_text string, unc_text string, mult string"
COMMENTS = "nuclide string, dsid string, record string, key long, field string, body string"

L = [
    ("34S", "ADOPTED", 1, 10, "0", "", "0+", "STABLE"), ("34S", "ADOPTED", 2, 20, "2127.6", "2", "2+", "320 FS"), ("34S", "ADOPTED", 3, 30, "3304", "1", "2+", "140 FS"), ("34S", "ADOPTED", 4, 40, "3916", "1", "0+", "1.2 PS"),
    ("34S", "34P B- DECAY", 11, 110, "0", "", "0+", "STABLE"), ("34S", "34P B- DECAY", 12, 120, "2128", "", "2+", "0.32 PS"), ("34S", "34P B- DECAY", 13, 130, "3305.0", "5", "1+", "140 FS"), ("34S", "34P B- DECAY", 14, 140, "3950", "9", "0+", "1.2 PS"), ("34S", "34P B- DECAY", 15, 150, "6000", "9", "", ""), ("34S", "34P B- DECAY", 16, 160, "X", "", "", ""),
    ("40X", "A", 21, 210, "500", "1", "", ""),
]
G = [
    ("34S", "ADOPTED", 101, 2, 25, "2127.5", "2", "E2"), ("34S", "ADOPTED", 102, 3, 35, "1176.6", "1", "M1+E2"),
    ("34S", "34P B- DECAY", 111, 12, 121, "2127.4", "2", "M1"), ("34S", "34P B- DECAY", 112, 13, 131, "1176.5", "1", "E2+M1"), ("34S", "34P B- DECAY", 113, 13, 132, "3000.0", "1", ""), ("34S", "34P B- DECAY", 114, 13, 133, "2.0", "1", ""),
]
C = [
    ("34S", "34P B- DECAY", "level", 12, "E", "From Adopted Levels"), ("34S", "34P B- DECAY", "level", 13, "E", "From Adopted Levels"), ("34S", "34P B- DECAY", "level", 13, "J", "measured"), ("34S", "34P B- DECAY", "gamma", 111, "M", "from adopted gammas"),
    ("34S", "34P B- DECAY", "gamma", 112, "M", "from adopted gammas"),
]


def test_messages_by_line(spark):
    found = checks.check_nuclides(spark.createDataFrame(L, LEVELS), spark.createDataFrame(G, GAMMAS), spark.createDataFrame(C, COMMENTS)).collect()
    got = sorted((r.line_no, r.severity, r.rule, r.message) for r in found)
    assert got == [
        (121, "E", "R18", "multipolarity does not fit the spins"), (121, "E", "R18", "multipolarity quoted from Adopted differs"),
        (130, "E", "R13", "energy quoted from Adopted differs"), (130, "E", "R14", "spin-parity differs from Adopted"),
        (132, "E", "R17", "gamma has no final level"), (133, "E", "R17", "final level is not below the initial one"),
        (140, "W", "R24", "energy is discrepant from the adopted record"), (150, "W", "R23", "no adopted record"),
    ]
    assert all(r.nuclide == "34S" and r.dsid == "34P B- DECAY" for r in found)


@pytest.mark.parametrize("empty", ["levels", "gammas", "comments"])
def test_empty_tables(spark, empty):
    frames = [spark.createDataFrame([] if name == empty else rows, schema) for name, rows, schema in (("levels", L, LEVELS), ("gammas", G, GAMMAS), ("comments", C, COMMENTS))]
    out = checks.check_nuclides(*frames)
    assert (out.count() == 0) == (empty == "levels")


def test_grades(spark):
    rows = [
        (1, "500", False, 0, 0, 0, 0, None), (2, "500.0", True, 0, 0, 0, 0, None), (3, "5", False, 1, 0, 0, 0, 1.0), (4, "5", True, 1, 0, 0, 0, 1.0), (5, "5", False, 1, 1, 0, 0, 70.0), (6, "5", None, 1, 1, 0, 0, 130.0), (7, "5", False, 1, 1, 0, 0, 10.0),
        (8, "5", False, 3, 0, 0, 0, 1.0), (9, "5", False, 2, 1, 1, 1, 1.0), (10, "5", False, 2, 1, 1, 0, 1.0), (11, "5", False, 2, 1, 0, 1, 1.0), (12, "5", False, 2, 1, 0, 0, 1.0),
    ]
    frame = spark.createDataFrame([(*r, 60.0, 100.0) for r in rows], "level int, energy_text string, questionable boolean, n_matched int, n_listed int, n_bad int, n_missed int, distance double, small double, large double")
    got = {r.level: (r.severity, r.message) for r in rules.level_grades(frame, ["level"]).collect()}
    tag = "tag of the dataset is missing in the cross-reference"
    assert got == {
        1: ("W", "level not placed in Adopted"), 2: ("W", "questionable level not placed in Adopted or discrepant"), 3: ("E", tag), 4: ("W", tag), 5: ("W", "energy is discrepant from Adopted"), 6: ("W", "energy is largely discrepant from Adopted"),
        8: ("E", "3 possible matches in Adopted, none with the tag of the dataset"), 9: ("W", "2 possible matches in Adopted, missing and incorrect cross-reference"), 10: ("W", "2 possible matches in Adopted, incorrect cross-reference"), 11: ("W", "2 possible matches in Adopted, missing cross-reference"),
    }


def test_quoted_values(spark):
    rows = [(1, "E", "12.3 3", "12.3"), (2, "E", "12.4 3", "12.3"), (3, "J", "2+", "3-"), (4, "M", "E2", "E2"), (5, "M", "E2", "M1"), (6, "M", "", "M1"), (7, "J", "2+", None)]
    found = rules.quoted_value_rule(spark.createDataFrame(rows, "k int, field string, value string, adopted_text string"), ["k"])
    assert {r.k: r.rule for r in found.collect()} == {2: "R13", 3: "R14", 5: "R18"}


def test_half_lives(spark):
    rows = [("5 NS", 5e-9), ("1.5E3 Y", 1500 * 31_556_926.0), ("320 fs", 3.2e-13), ("STABLE", None), ("", None), (None, None), ("5 XX", None)]
    found = spark.createDataFrame(rows, "t string, want double").select("want", nuclear.half_life_seconds(F.col("t")).alias("got")).collect()
    assert all(r.got == (pytest.approx(r.want) if r.want is not None else None) for r in found)
    pairs = [("5 NS", "5000 PS", False), ("5 NS", "5.1 NS", True), ("STABLE", "STABLE", False), ("STABLE", "5 NS", True)]
    assert all(r.d == r.want for r in spark.createDataFrame(pairs, "a string, b string, want boolean").select("want", nuclear.half_lives_differ(F.col("a"), F.col("b")).alias("d")).collect())


def test_halves_and_equally_near_levels(spark, sf_dir, tmp_path):
    """Each supplier's energy is there twice, and numbers end in halves of a last digit."""
    changed = {
        "customer": "SELECT * REPLACE (floor(abs(c_acctbal)) + 0.25 AS c_acctbal) FROM {}", "orders": "SELECT * REPLACE (floor(o_totalprice) + 0.5 AS o_totalprice) FROM {}",
        "supplier": "SELECT * REPLACE (s_suppkey + i * (SELECT max(s_suppkey) + 1 FROM {0}) AS s_suppkey) FROM {0}, range(2) r(i)",
    }
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if name in changed:
            duckdb.execute(f"COPY ({changed[name].format(repr(path))}) TO '{tmp_path}/{name}.parquet'")
        else:
            (tmp_path / f"{name}.parquet").symlink_to(path)
    assert_same(__spark_entry__.queries()["checked_nuclides"](spark, str(tmp_path)), __spark_entry__.oracle_sql()["checked_nuclides"], str(tmp_path))
