"""Registered queries against DuckDB, and the driver's contract."""

from __future__ import annotations

import math

import numpy as np
import pytest
from oracle import assert_same

import __spark_entry__
from matchengine import queries
from matchengine.operators import averages
from matchengine.operators.cluster import GreedyCliques
from matchengine.schema import CONFIG


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE[name], sf_dir)


# --- queries that SQL cannot express: their values ------------------------------------


def z_score(x, dx, y, dy):
    return abs(x - y) / math.hypot(dx, dy) if dx or dy else (0.0 if x == y else math.inf)


def similarity(a, b, weighed):
    """Greedy overlap of two line lists (energy, its error, intensity, its error)."""
    a, b = ([g for g in lines if g[0] > 0] for lines in (a, b))
    if not a or not b:
        return CONFIG.neutral
    top = [max(g[2] for g in lines) for lines in (a, b)]
    weighed = weighed and min(top) > 0
    if weighed:
        a, b = ([(e, de, 100 * i / t, 100 * di / t) for e, de, i, di in lines] for lines, t in zip((a, b), top, strict=True))
    used, total = set(), 0.0
    for x in a:
        near = [(z_score(*x[:2], *y[:2]), k) for k, y in enumerate(b) if k not in used and z_score(*x[:2], *y[:2]) <= CONFIG.energy_z]
        if near:
            k = min(near)[1] if weighed else min(k for _, k in near)
            used.add(k)
            y = b[k]
            total += 1 if not weighed else (x[2] + y[2]) / 2 if z_score(*x[2:], *y[2:]) <= CONFIG.intensity_z else min(x[2], y[2])
    return min(1.0, total / min(sum(g[2] for g in lines) for lines in (a, b))) if weighed else total / min(len(a), len(b))


def spectra(spark, sf_dir):
    return {(r.o_orderkey, r.next_key): ([tuple(g) for g in r.a], [tuple(g) for g in r.b]) for r in queries.order_spectra(spark, sf_dir).collect()}


def same_similarities(spark, sf_dir, got, weighed):
    given = spectra(spark, sf_dir)
    assert len(got) == len(given)
    for r in got.itertuples():
        a, b = given[r.o_orderkey, r.next_key]
        if not weighed:
            a, b = ([(e, de, 0.0, di) for e, de, _, di in lines] for lines in (a, b))
        assert r.similarity == pytest.approx(similarity(a, b, weighed), abs=2e-6), (r.o_orderkey, a, b)


def matched_lines(spark, sf_dir, got):
    given = spectra(spark, sf_dir)
    for r in got.itertuples():
        a, b = ([g[0] for g in lines if g[0] > 0] for lines in given[r.o_orderkey, r.next_key])
        free = list(range(len(b)))
        n = 0
        for x in a:
            near = [(abs(x - b[k]), k) for k in free if abs(x - b[k]) <= 1.0 + 1e-9]
            if near:
                free.remove(min(near)[1])
                n += 1
        assert r.n == n


def customers(spark, sf_dir):
    return queries.customer_levels(spark, sf_dir).toPandas().set_index("key")


def cliques(spark, sf_dir, got):
    """Cliques of valid pairs, one level a dataset, that hold every level; those of
    the machine on each component's own edges."""
    levels = customers(spark, sf_dir)
    edges = queries.customer_pairs(spark, sf_dir).where(f"probability >= {CONFIG.merge_threshold}").toPandas()
    ranked = sorted(edges.itertuples(), key=lambda e: (-e.probability, f"{e.key_1:012d}{e.key_2:012d}"))
    found = GreedyCliques([(levels.dataset_code[k], k) for k in levels.index], [(e.key_1, e.key_2) for e in ranked])
    want = sorted(tuple(sorted(c.values())) for c in found.clusters())
    assert sorted(tuple(sorted(map(int, g.level_id))) for _, g in got.groupby(["component", "n"])) == want


def one_group_each(spark, sf_dir, got, group, record, dataset=None):
    assert not got.duplicated(record).any()
    assert dataset is None or not got.duplicated([*group, dataset]).any()


def probabilities(spark, sf_dir, got, column):
    pairs = queries.customer_pairs(spark, sf_dir).toPandas()
    assert set(zip(got.key_1, got.key_2, strict=True)) == set(zip(pairs.key_1, pairs.key_2, strict=True))
    assert got[column].between(0, 1).all()
    # Good pairs get more than bad ones.
    merged = got.merge(pairs, on=["key_1", "key_2"], suffixes=("", "_rule"))
    rule = merged["probability_rule" if column == "probability" else "probability"]
    good, bad = merged[rule > 0.6][column], merged[rule < 0.05][column]
    assert good.empty or bad.empty or good.mean() > bad.mean()


def averages_of_lists(spark, sf_dir, got):
    points = queries.priced_lines(spark, sf_dir).toPandas()
    for part, g in points.sort_values(["x", "dx"]).groupby("part"):
        x, dx = g.x.to_numpy(), g.dx.to_numpy()
        for r in got[got.part == part].itertuples():
            value, error = averages.METHODS[r.method](x, dx)
            assert r.value == pytest.approx(value, abs=2e-4) and r.uncertainty == pytest.approx(error, abs=2e-4), (part, r.method)


def in_order(spark, sf_dir, got):
    for _, g in got.groupby(["nation", "island"]):
        g = g.sort_values("record")
        assert g.record.is_unique and g.grp.is_unique and g.grp.is_monotonic_increasing


def labels_apart(spark, sf_dir, got):
    for _, g in got.groupby("s_nationkey"):
        gaps = np.diff(np.sort(g.label_y))
        assert not len(gaps) or gaps.min() > 250 - 0.01


def all_lines_in_groups(spark, sf_dir, got):
    """Each line once, one of a flag in a group, groups in order of their means."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").toPandas()
    record = lines.l_orderkey * 10_000_000 + lines.l_linenumber * 1_000_000 + lines.l_partkey
    assert sorted(got.record) == sorted(record)
    assert not got.duplicated(["level_group", "grp", "dsid"]).any()
    means = got.merge(lines.assign(record=record).groupby("record").l_extendedprice.mean().rename("x"), on="record").groupby(["level_group", "grp"]).x.mean()
    steps = means.groupby("level_group").diff().dropna()
    assert (steps >= -1e-9).mean() > 0.99


VALUES = {
    "gamma_similarity": lambda *a: same_similarities(*a, True),
    "gamma_binary": lambda *a: same_similarities(*a, False),
    "consistent_gamma_counts": matched_lines,
    "greedy_cliques": cliques,
    "kmeans_match": lambda *a: probabilities(*a, "is_match"),
    "boosted_match": lambda *a: probabilities(*a, "probability"),
    "monotone_match": lambda *a: probabilities(*a, "probability"),
    "average_methods": averages_of_lists,
    "ordered_assignment": in_order,
    "label_spread": labels_apart,
    "fine_grouping": lambda *a: one_group_each(*a, ["nation", "island", "grp"], "record", "dsid"),
    "grouped_with_adopted": lambda *a: one_group_each(*a, ["nation", "grp"], "record", "dsid"),
    "grouped_without_adopted": lambda *a: one_group_each(*a, ["nation", "grp"], "record", "dsid"),
    "gamma_subgroups": all_lines_in_groups,
}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_values_of_a_query_without_sql(spark, sf_dir, name):
    VALUES[name](spark, sf_dir, queries.QUERIES[name](spark, sf_dir).toPandas())


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
