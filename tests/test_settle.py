"""Clusters of large components in rounds against the sequential machine."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from matchengine.operators.cluster import GreedyCliques, greedy_clusters
from matchengine.operators.components import _forests

EDGES = "level_1_id string, level_2_id string, probability double, pair_rank string"
LEVELS = "dataset_code string, level_id string, seq string, energy_value double, energy_uncertainty double"


def make_graph(rng, name, most):
    levels = [("ABCD"[rng.randrange(4)], f"{name}_{k:02d}") for k in range(rng.randint(2, most))]
    edges = []
    for i, (d, a) in enumerate(levels):
        for e, b in levels[i + 1 :]:
            if d != e and rng.random() < rng.choice([0.3, 0.6, 0.9]):
                edges.append((a, b, rng.choice([0.2, 0.4, 0.5, 0.8, 0.8, 0.9]), f"{a}{b}"))
    return levels, edges


def sequential(levels, edges):
    ranked = sorted(edges, key=lambda e: (-e[2], e[3]))
    return sorted(tuple(sorted(c.values())) for c in GreedyCliques(levels, [e[:2] for e in ranked]).clusters())


def clusters_of(rows):
    found: dict = {}
    for r in rows:
        found.setdefault((r.component, r.n), set()).add(r.level_id)
    return found


@pytest.mark.parametrize(("graphs", "most"), [(2900, 7), (100, 16)])
def test_rounds_give_the_clusters_of_the_machine(spark, graphs, most):
    rng = random.Random(graphs)
    made = [make_graph(rng, f"g{n:04d}", most) for n in range(graphs)]
    levels = [(d, x, x, 1.0, 1.0) for ls, _ in made for d, x in ls]
    edges = [e for _, es in made for e in es]
    found = clusters_of(greedy_clusters(spark.createDataFrame(levels, LEVELS), spark.createDataFrame(edges, EDGES), largest=0).collect())
    got: dict = {}
    for members in found.values():
        got.setdefault(next(iter(members))[:5], []).append(tuple(sorted(members)))
    for n, (ls, es) in enumerate(made):
        assert sorted(got[f"g{n:04d}"]) == sequential(ls, es), n


def test_a_mix_of_large_and_small_components(spark):
    rng = random.Random(1)
    made = [make_graph(rng, f"m{n:03d}", 9) for n in range(60)]
    levels = spark.createDataFrame([(d, x, x, 1.0, 1.0) for ls, _ in made for d, x in ls], LEVELS)
    edges = spark.createDataFrame([e for _, es in made for e in es], EDGES)
    rows = lambda largest: sorted((r.component, r.n, r.dataset_code, r.level_id) for r in greedy_clusters(levels, edges, largest=largest).collect())
    assert rows(8) == rows(10**6)


def test_pairs_without_a_fit_change_nothing():
    """The clusters are those of meeting every cluster of one level with every one of the other."""

    class Plain(GreedyCliques):
        def _edge(self, a, b):
            done = False
            for one in list(self.in_[a]):
                for two in list(self.in_[b]):
                    if one is two:
                        done = True
                    elif one.keys() & two.keys():
                        for level, cluster in ((a, two), (b, one)):
                            if self._fits(level, cluster):
                                self._join(level, cluster)
                                done = True
                    elif all(y in self.valid[x] for x in one.values() for y in two.values()):
                        self._merge(one, two)
                        done = True
            if done:
                return
            for level, alone in ((b, self.in_[a]), (a, self.in_[b])):
                for cluster in [c for c in alone if len(c) == 1][:1]:
                    if self._fits(level, cluster):
                        return self._join(level, cluster)
            fresh = {self.of[a]: a, self.of[b]: b}
            for level in (a, b):
                self.in_[level].append(fresh)

    for seed in range(200):
        rng = random.Random(seed)
        levels = [(f"d{rng.randrange(4)}", f"{k:02d}") for k in range(rng.randint(2, 16))]
        edges = [(a, b) for d, a in levels for e, b in levels if d < e and rng.random() < 0.6]
        rng.shuffle(edges)
        assert GreedyCliques(levels, edges).rows() == Plain(levels, edges).rows()


def test_forests_of_names():
    """Edges between strings become a forest in their task, as those between integers do."""
    names = [f"v{k:02d}" for k in range(40)]
    edges = [(a, b) for a in names[:20] for b in names[:20] if a < b] + [(names[k], names[k + 1]) for k in range(20, 39)]
    batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges]), pa.array([b for _, b in edges])], names=["a", "b"])
    (found,) = _forests(iter([batch]))
    rows = list(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))
    assert len(rows) == 38 and len({b for _, b in rows}) == 38
    assert {a in names[:20] for a, b in rows if b in names[:20]} == {True} and {a in names[20:] for a, b in rows if b in names[20:]} == {True}
