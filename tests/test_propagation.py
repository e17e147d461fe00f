"""Spin-parities carried along gammas: a chain, random schemes against a version
option by option, and against all consistent schemes."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from matchengine.functions import nuclear
from matchengine.operators import propagation

USUAL = [[(1, True)], [(1, False)], [(2, False)]]
MULTS = {
    "E1": [[(1, True)]], "(M1+E2)": [[(1, False), (2, False)]], "[E2]": USUAL, "M1(+E2)": [[(1, False)]], "E1,M2": [[(1, True)], [(2, True)]], "D+Q": [[(1, None), (2, None)]],
    " e2 ": [[(2, False)]], "(Q)": [[(2, None)]], "O": [[(3, None)]], "": USUAL, None: USUAL, "what": USUAL, "E3": [[(3, True)]], "[M1,E2]": USUAL, "(E1),M1": [[(1, False)]],
}


def test_notation(spark):
    rows = spark.createDataFrame([(m,) for m in MULTS], "m string").select("m", nuclear.transitions(F.col("m")).alias("t"), nuclear.multipolarity_parts(F.col("m")).alias("p")).collect()
    assert {r.m: [[tuple(p) for p in a] for a in r.t] for r in rows} == MULTS
    parts = {r.m: r.p for r in rows}
    assert parts["M1(+E2)"] == parts["(M1+E2)"] == ["M1", "E2"] and parts["E1,M2"] == ["E1", "M2"] and parts[" e2 "] == ["E2"] and parts[None] == []


def allows(a, b, alternatives):
    return any(all(abs(a[0] - b[0]) <= 2 * n <= a[0] + b[0] and (c is None or (a[1] != b[1]) == c) for n, c in parts) for parts in alternatives)


EVERY = [(j, p) for parity in (0, 1) for j in range(parity, 40, 2) for p in "+-"]


def brute(levels, gammas):
    """levels: name to set of options (empty: unknown); whole rounds at once."""
    known, unknown, wrong = {k: set(v) for k, v in levels.items() if v}, {k for k, v in levels.items() if not v}, set()
    arcs = [(a, b, MULTS[m]) for i, f, m in gammas for a, b in ((i, f), (f, i)) if i != f and i in levels and f in levels]
    while True:
        new, gone = {}, set()
        for a in [*known, *unknown]:
            limits = [(b, alt) for x, b, alt in arcs if x == a and b in known]
            if not limits:
                continue
            start = known[a] if a in known else {o for o in EVERY if (o[0] - next(iter(known[limits[0][0]]))[0]) % 2 == 0}
            left = {o for o in start if all(any(allows(o, q, alt) for q in known[b]) for b, alt in limits)}
            if left:
                new[a] = left
            else:
                gone.add(a)
        if all(known.get(a) == v for a, v in new.items()) and not gone:
            return known, wrong
        known = {k: v for k, v in {**known, **new}.items() if k not in gone}
        wrong |= gone
        unknown -= set(new) | gone


def run(spark, levels, gammas, **more):
    frame = spark.createDataFrame([(k, sorted(v) or None) for k, v in levels.items()], f"level int, options {propagation.OPTIONS}")
    arcs = spark.createDataFrame(gammas, "initial int, final int, mult string")
    return {r.level: r for r in propagation.propagated_options(frame, arcs, **more).collect()}


def test_random_schemes(spark):
    rng, levels, gammas, base = random.Random(6), {}, [], 0
    schemes = []
    for _ in range(40):
        n = rng.randint(2, 9)
        mine = {base + k: {(2 * rng.randint(0, 4), rng.choice("+-")) for _ in range(rng.randint(0, 3))} for k in range(n)}
        lines = [(base + rng.randrange(n), base + rng.randrange(n), rng.choice(list(MULTS))) for _ in range(rng.randint(1, 10))]
        schemes.append((mine, lines))
        levels |= mine
        gammas += lines
        base += 100
    got = run(spark, levels, [*gammas, (0, 99_999, "E1")])
    kinds = set()
    for mine, lines in schemes:
        known, wrong = brute(mine, lines)
        for k in mine:
            row = got[k]
            assert {(o.two_j, o.parity) for o in row.options} == (known.get(k, set()) if k not in wrong else set()), k
            assert row.options == sorted(row.options) and row.contradiction == (k in wrong) and row.derived == (k in known and not mine[k])
            kinds.add((bool(mine[k]), row.contradiction, row.derived, bool(row.options)))
    assert kinds == {(True, False, False, True), (True, True, False, False), (False, False, True, True), (False, False, False, False), (False, True, False, False)}


def test_no_consistent_option_is_lost(spark):
    """Every option of a level that is part of a whole scheme without conflicts stays."""
    rng = random.Random(8)
    levels, gammas, kept, base = {}, [], {}, 0
    for _ in range(25):
        n = rng.randint(2, 5)
        mine = {base + k: {(2 * rng.randint(0, 3), rng.choice("+-")) for _ in range(rng.randint(1, 4))} for k in range(n)}
        lines = [(base + rng.randrange(n), base + rng.randrange(n), rng.choice(["E1", "(M1+E2)", "E1,M2", ""])) for _ in range(4)]
        for scheme in itertools.product(*mine.values()):
            given = dict(zip(mine, scheme, strict=True))
            if all(i == f or allows(given[i], given[f], MULTS[m]) for i, f, m in lines):
                for k, o in given.items():
                    kept.setdefault(k, set()).add(o)
        levels |= mine
        gammas += lines
        base += 100
    got = run(spark, levels, gammas)
    assert len(kept) > 20
    assert all(options <= {(o.two_j, o.parity) for o in got[k].options} for k, options in kept.items())


def test_chain_of_unknown_levels(spark):
    """0+ feeds four levels of unknown spin by E2s; unknown is not a contradiction."""
    chain = [(k + 1, k, "E2") for k in range(4)]
    got = run(spark, {0: {(0, "+")}, 1: set(), 2: set(), 3: set(), 4: {(16, "+"), (8, "-")}, 5: set()}, chain)
    assert [[(o.two_j, o.parity) for o in got[k].options] for k in (1, 2)] == [[(4, "+")], [(8, "+")]]
    assert [(o.two_j, o.parity) for o in got[3].options] == [(12, "+")] and [(o.two_j, o.parity) for o in got[4].options] == [(16, "+")]
    assert got[5].options == [] and not got[5].contradiction and not got[5].derived
    # One step reaches one level.
    assert run(spark, {0: {(0, "+")}, 1: set(), 2: set()}, chain[:2], rounds=1)[2].options == []
    wrong = run(spark, {0: {(0, "+")}, 1: {(2, "+")}, 2: set()}, chain[:2])
    assert wrong[0].contradiction and wrong[1].contradiction and not wrong[2].contradiction


def test_open_parities_and_half_spins(spark):
    frame = spark.createDataFrame([(1, [(3, None)]), (2, [(1, "-")]), (3, [])], f"level int, options {propagation.OPTIONS}")
    gammas = spark.createDataFrame([(1, 2, "M1"), (3, 1, "E1")], "initial int, final int, mult string")
    got = {r.level: [(o.two_j, o.parity) for o in r.options] for r in propagation.propagated_options(frame, gammas).collect()}
    assert got == {1: [(3, "-")], 2: [(1, "-")], 3: [(1, "+"), (3, "+"), (5, "+")]}


@pytest.mark.parametrize("empty", ["levels", "gammas"])
def test_empty_tables(spark, empty):
    levels = spark.createDataFrame([(1, [(2, "+")])], f"level int, options {propagation.OPTIONS}")
    gammas = spark.createDataFrame([(1, 2, "E1")], "initial int, final int, mult string")
    out = propagation.propagated_options(levels.where("false") if empty == "levels" else levels, gammas.where("false"))
    assert out.count() == (empty == "gammas")
