"""Whole spectra of orders, against a brute-force comparison."""

from __future__ import annotations

import math

import pytest

from matchengine import queries
from matchengine.schema import CONFIG

LINES = {
    1: [(10.0, 1000.0, 0.0), (20.0, 4000.0, 0.1), (30.0, 2000.0, 0.05), (40.0, 500.0, 0.0), (50.0, 900.0, 0.02), (60.0, 8000.0, 0.1), (70.0, 3000.0, 0.04)],
    2: [(70.0, 2500.0, 0.02), (11.0, 900.0, 0.0), (33.0, 100.0, 0.0), (60.5, 7000.0, 0.0), (90.0, 800.0, 0.0), (21.0, 4500.0, 0.03), (71.0, 100.0, 0.0)],
    3: [(70.0, 1000.0, 0.0)],
}


def z(x, dx, y, dy):
    spread = math.hypot(dx, dy)
    return abs(x - y) / (spread or 1.0)


def brute(a, b, weighed):
    """Similarity of lists of (energy, price, discount)."""
    a, b = ([(e, 1.0, p / 1000, 100 * d) for e, p, d in g] for g in (a, b))
    if weighed:
        a, b = ([(e, de, 100 * i / max(x[2] for x in g), 100 * di / max(x[2] for x in g)) for e, de, i, di in g] for g in (a, b))
    used, total = set(), 0.0
    for x in a:
        free = [(z(x[0], x[1], y[0], y[1]) if weighed else k, k) for k, y in enumerate(b) if k not in used and z(x[0], x[1], y[0], y[1]) <= CONFIG.energy_z]
        if free:
            _, k = min(free)
            used.add(k)
            near = z(x[2], x[3], b[k][2], b[k][3]) <= CONFIG.intensity_z
            total += 1.0 if not weighed else (x[2] + b[k][2]) / 2 if near else min(x[2], b[k][2])
    return min(1.0, total / min(sum(x[2] for x in g) for g in (a, b))) if weighed else total / min(len(a), len(b))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('spectra')}"
    lines = [(o, n + 1, *x) for o, g in LINES.items() for n, x in enumerate(g)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(o, 5, f"2020-01-0{o}") for o in LINES], "o_orderkey long, o_custkey long, o_orderdate string").write.parquet(f"{path}/orders.parquet")
    return path


@pytest.mark.parametrize(("name", "weighed"), [("gamma_similarity", True), ("gamma_binary", False)])
def test_whole_spectra(spark, tables, name, weighed):
    got = {(r.o_orderkey, r.next_key): r.similarity for r in queries.QUERIES[name](spark, tables).collect()}
    assert got == {(a, b): pytest.approx(brute(LINES[a], LINES[b], weighed), abs=1e-6) for a, b in ((1, 2), (2, 3))}
    assert brute(LINES[1][:5], LINES[2][:5], weighed) != pytest.approx(got[1, 2], abs=1e-6)
