"""The 22 fixture levels: golden features, probabilities and clusters."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from matchengine.operators import pairs
from matchengine.operators.cluster import GreedyCliques, greedy_clusters
from matchengine.plans import matching
from matchengine.schema import LEVELS

# Dataset, energy, sigma, spin-parity text, options (2J, spin
# tentative, parity, parity tentative) and gammas (E, sigma, I, sigma).
_F, _T = False, True
FIXTURE = [
    ("A", 0, 0, "0+", [(0, _F, "+", _F)], []),
    ("A", 600, 1, "", [], []),
    ("A", 2000, 1, "", [], [(1400, 1, 100, 5), (2000, 1, 23, 3)]),
    ("A", 2005, 1, "", [], [(1405, 2, 10, 2), (2005, 3, 100, 5)]),
    ("A", 3000, 1, "2+", [(4, _F, "+", _F)], []),
    ("A", 3005, 1, "1-", [(2, _F, "-", _F)], []),
    ("A", 4000, 1, "(1)-", [(2, _T, "-", _T)], []),
    ("A", 4005, 1, "(2)+", [(4, _T, "+", _T)], []),
    ("A", 5000, 1, "(1+,2+,3+)", [(2, _T, "+", _T), (4, _T, "+", _T), (6, _T, "+", _T)], []),
    ("A", 5005, 1, "(3-,4-,5-)", [(6, _T, "-", _T), (8, _T, "-", _T), (10, _T, "-", _T)], []),
    ("B", 0, 0, "0+", [(0, _F, "+", _F)], []),
    ("B", 603, 3, "", [], []),
    ("B", 2006, 1, "", [], [(1403, 2, 100, 5), (2006, 2, 18, 3)]),
    ("B", 3000, 2, "1-", [(2, _F, "-", _F)], []),
    ("B", 4000, 2, "2(+)", [(4, _T, "+", _T)], []),
    ("B", 5000, 2, "(4-)", [(8, _T, "-", _T)], []),
    ("C", 0, 0, "0+", [(0, _F, "+", _F)], []),
    ("C", 601, 3, "", [], []),
    ("C", 2000, 1, "", [], [(1399, 2, 8, 2), (1999, 2, 100, 5)]),
    ("C", 3005, 30, "", [], []),
    ("C", 4003, 30, "1:3", [(2, _F, None, _F), (4, _F, None, _F), (6, _F, None, _F)], []),
    ("C", 5003, 30, "2,3,4", [(4, _F, None, _F), (6, _F, None, _F), (8, _F, None, _F)], []),
]
TEN = [
    "A_0 B_0 C_0", "A_600 B_603 C_601", "A_2000 B_2006", "A_2005 C_2000", "A_3000 C_3005", "A_3005 B_3000 C_3005",
    "A_4000 C_4003", "A_4005 B_4000 C_4003", "A_5000 C_5003", "A_5005 B_5000 C_5003",
]


def golden() -> list[tuple]:
    """The 156 rows: two levels, five features, three probabilities."""
    text = (Path(__file__).resolve().parent.parent / "FIXTURES.md").read_text()
    row = re.compile(r"^([ABC]_\d+) ([ABC]_\d+) \| ([\d.]+) ([\d.]+) ([\d.]+) ([\d.]+) ([\d.]+) \| ([\d.]+) \| ([\d.]+) \| (\d)$", re.M)
    return [(m[1], m[2], *map(float, m.groups()[2:])) for m in row.finditer(text)]


@pytest.fixture(scope="module")
def levels(spark):
    count, rows = {}, []
    for ds, e, u, text, options, gammas in FIXTURE:
        rows.append((ds, count.setdefault(ds, 0), f"{ds}_{e}", float(e), float(u), options, text, [tuple(map(float, g)) for g in gammas]))
        count[ds] += 1
    return spark.createDataFrame(rows, LEVELS)


def test_features_are_the_golden_ones(levels):
    found = pairs.features(pairs.cross_dataset_pairs(levels)).collect()
    got = {(r.level_id_1, r.level_id_2): tuple(round(r[c] + 1e-9, 2) for c in ("energy", "spin", "parity", "specificity", "gamma")) for r in found}
    want = {(g[0], g[1]): g[2:7] for g in golden()}
    assert len(got) == 156
    assert all(got[k] == pytest.approx(want[k], abs=0.0051) for k in want)


def members(rows) -> list[str]:
    clusters: dict[tuple, list[str]] = {}
    for r in rows:
        clusters.setdefault((r.component, r.n), []).append(r.level_id)
    return sorted(" ".join(sorted(c)) for c in clusters.values())


def test_ten_clusters_from_the_rule_based_score(levels):
    found = matching.match(levels)
    assert members(found.clusters.collect()) == sorted(TEN)
    told = matching.report_members(found)
    assert told.where("is_anchor").count() == 10
    scheme = matching.consensus(told, levels).orderBy("cluster_no").collect()
    assert len(scheme) == 10 and scheme[0].adopted_energy == 0.0 and scheme[0].sources.startswith("A_0(100%)")
    assert scheme[0].adopted_spin_parity == "0+"


@pytest.mark.parametrize(("column", "clusters"), [(7, 10), (8, 84), (9, 107)])
def test_clusters_of_committed_probabilities(column, clusters):
    """Golden numbers of clusters for the three probability columns."""
    edges = [(g[0], g[1], g[column] / (1 if column == 9 else 100)) for g in golden()]
    strong = sorted((e for e in edges if e[2] >= 0.15), key=lambda e: -e[2])
    found = GreedyCliques([(d, f"{d}_{e}") for d, e, *_ in FIXTURE], [(a, b) for a, b, _ in strong]).clusters()
    assert len(found) == clusters
    valid = {frozenset(e[:2]) for e in strong}
    for c in found:
        m = list(c.values())
        assert all(frozenset((x, y)) in valid for k, x in enumerate(m) for y in m[k + 1 :])


def test_greedy_clusters_frame(spark, levels):
    rows = [(g[0], g[1], g[7] / 100, f"{k:04d}") for k, g in enumerate(golden())]
    edges = spark.createDataFrame(rows, "level_1_id string, level_2_id string, probability double, pair_rank string")
    nodes = levels.select("dataset_code", "level_id", "energy_value", "energy_uncertainty", F.concat("dataset_code", F.lpad(F.col("level_index").cast("string"), 4, "0")).alias("seq"))
    assert members(greedy_clusters(nodes, edges).collect()) == sorted(TEN)
