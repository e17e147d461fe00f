"""Stages of the corpus pipeline, each against a brute-force version."""

from __future__ import annotations

import corpus_pipeline as cp
import pytest
from test_operators import brute_components, brute_contamination, brute_lines, library_ids

from matchengine.llm import queries


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs.toPandas())]
    for name, stage in cp.STAGES:
        docs = cp.keep(stage(spark, docs, sf_dir), name)
        out.append((name, docs.toPandas()))
    return dict(out)


def rows(frame):
    return sorted(zip(frame.doc_id.tolist(), frame.text.tolist(), strict=True))


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "lines", "near_copies", "decontaminate", "pack"]
    for name, _ in cp.STAGES[:-1]:
        assert list(stages[name].columns) == list(stages["documents"].columns)


def test_quality_stage(spark, sf_dir, stages):
    kept = queries.op3_adaptive_quality(spark, sf_dir).where("kept").toPandas()
    assert set(stages["quality"].doc_id) == set(kept.doc_id)
    assert 0 < len(kept) < len(stages["documents"])


def test_line_stage(stages):
    want = brute_lines(rows(stages["quality"]))
    gone = {i for i, t in rows(stages["quality"]) if want[i][1] == t.count("\n") + 1}
    assert dict(rows(stages["lines"])) == {i: t for i, (t, _) in want.items() if i not in gone}
    assert (stages["lines"].n_chars == stages["lines"].text.str.len()).all()


def test_near_copy_stage(stages):
    found = brute_components(rows(stages["lines"]), 5, 80)
    assert set(stages["near_copies"].doc_id) == {i for i, (_, c) in found.items() if i == c}


def test_decontamination_stage(spark, sf_dir, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = set()
    for i, t in rows(stages["near_copies"]):
        n, hit, _ = brute_contamination(t, items)
        if hit and 20 * hit >= n:
            dirty.add(i)
    assert set(stages["decontaminate"].doc_id) == set(stages["near_copies"].doc_id) - dirty


def test_pack_stage(spark, sf_dir, stages):
    lengths = {i: len(library_ids("word_bpe_49k.json", t, 1)) for i, t in rows(stages["decontaminate"])}
    assert stages["pack"].groupby("doc_id").length.sum().to_dict() == lengths
    assert sorted(map(tuple, cp.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(stages["pack"][["doc_id", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cid int, matches string, n_words int, __id int, row string"


def odd_documents(spark):
    plain = " ".join(f"word{k} of a text" for k in range(40))
    texts = [(None, plain), (None, None), (1, None), (2, ""), (3, plain + " end"), (3, plain + " end"), (4, "\n\n\n"), (5, "lone"), (5, plain.replace("word3 ", "x ")), (6, " ".join(f"z{k}" for k in range(30_000)))]
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 else "s", None, k, "m", 7, 1, "r") for k, (i, t) in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("number", range(5))
def test_stage_on_odd_and_empty_tables(spark, sf_dir, number):
    """Nulls in every column, repeated rows, ids with two texts, long texts, clashing
    names; what is kept is whole rows of the input."""
    name, stage = cp.STAGES[number]
    docs = odd_documents(spark)
    assert stage(spark, docs.where("false"), sf_dir).count() == 0
    out = stage(spark, docs, sf_dir)
    if name == "pack":
        assert sorted({(r.doc_id is None, r.doc_id or 0) for r in out.select("doc_id").collect()}) == [(False, k) for k in range(1, 7)] + [(True, 0)]
        return
    assert out.columns == docs.columns
    left = [tuple(r) for r in out.drop("n_chars").collect()]
    given = [tuple(r) for r in docs.drop("n_chars").collect()]
    if name != "lines":
        assert all(left.count(r) <= given.count(r) for r in left)
    # Neither a text without an id nor one that is given twice is lost.
    assert any(r[0] == 3 for r in left) and any(r[0] is None and r[1] for r in left)
