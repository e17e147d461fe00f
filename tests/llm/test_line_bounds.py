"""Repeated runs that are judged by their characters and words."""

from __future__ import annotations

import random

import pytest

from matchengine.llm import line_dedup


def brute_runs(texts, m, run_chars, run_words, long_line=200):
    seen, out = set(), {}
    for i, t in texts:
        lines, gone = t.split("\n"), set()
        for k in range(len(lines)):
            for size in range(1, m + 1):
                run = "\n".join(lines[k : k + size])
                long = (run_chars and len(run) >= run_chars) or (run_words and len(run.split()) >= run_words)
                if k + size <= len(lines) and (size == m or long or (size == 1 and len(run) >= long_line)):
                    if (size, run) in seen:
                        gone |= set(range(k, k + size))
                    seen.add((size, run))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_two_lines_of_a_long_passage(spark):
    one, two, words = "alpha beta gamma " * 9, "delta epsilon zeta " * 8, "ab " * 55
    assert max(map(len, (one, two, words))) < 200
    rows = [(1, f"a\n{one}\n{two}\nb\n{words}\nc"), (2, f"d\n{one}\n{two}\ne"), (3, f"f\n{words}\ng"), (4, f"h\n{one}\ni")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), run_chars=200, run_words=50)
    assert {r.doc_id: r.text for r in found.collect()} == {1: rows[0][1], 2: "d\ne", 3: "f\ng", 4: rows[3][1]}


@pytest.mark.parametrize(("m", "run_chars", "run_words"), [(3, 8, None), (3, None, 3), (5, 9, 4)])
def test_runs_by_length(spark, m, run_chars, run_words):
    rng = random.Random(m)
    rows = [(k, "\n".join(rng.choice(["a", "b b", "ccccc", "d d d", ""]) for _ in range(rng.randint(0, 14)))) for k in range(30)]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_lines=m, run_chars=run_chars, run_words=run_words)
    got, want = {r.doc_id: r.text for r in found.collect()}, brute_runs(rows, m, run_chars, run_words)
    assert got == want
    assert want != brute_runs(rows, m, None, None)
