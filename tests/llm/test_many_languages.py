"""No label is left out of the language model without a word."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from matchengine.llm import langid, textvec


def test_labels_beyond_the_bound_are_an_error(spark, monkeypatch):
    rows = [(k, f"{name} word {k}", name) for k, name in enumerate(["aa"] * 30 + ["bb"] * 20 + ["cc"] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    assert langid.train(docs).languages == ["aa", "bb", "cc"]
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        langid.train(docs)


def test_more_languages_than_landmarks(spark, monkeypatch):
    """Every label can be predicted, however many there are."""
    monkeypatch.setattr(langid, "LANDMARKS", 20)
    rows = [(3 * k, " ".join([f"{chr(97 + k % 26)}{chr(97 + k // 26)}q"] * 30), f"l{k:02d}") for k in range(40) for _ in range(6)]
    rows = [(100 * n + r[0], *r[1:]) for n, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == sorted({r[2] for r in rows}) and model.landmarks.shape[1] == 20


def bucket_set(text: str) -> frozenset[int]:
    """Buckets of the n-grams of one to three bytes, without numpy."""
    raw = bytes((b + 32 if 65 <= b <= 90 else b) if (65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32 for b in text.encode())
    found = set()
    for size in (1, 2, 3):
        for p in range(len(raw) - size + 1):
            h = size * 0x9E3779B1 & 0xFFFFFFFF
            for j, factor in zip(range(size), (2654435761, 2246822519, 3266489917), strict=False):
                h = (h ^ raw[p + j]) * factor & 0xFFFFFFFF
            found.add((h ^ h >> 15) & 8191)
    return frozenset(found)


def test_kernel_against_sets_and_a_dense_solution():
    """The kernel by sets, the ridge system in its dual form, whole."""
    rng = random.Random(4)
    alphabets = {"x": "abcde é", "y": "defgh ü", "z": "ghijk ñ"}
    text = lambda a: "".join(rng.choice(alphabets[a]) for _ in range(rng.randint(5, 60)))
    labels = [rng.choice("xyz") for _ in range(200)]
    texts = [text(a) for a in labels]
    tests = [text(a) for a in "xyz" * 20] + ["a", "", "1 2", "zz " * 5000]
    sets, asked = [bucket_set(t) for t in texts], [bucket_set(t) for t in tests]
    rows = langid.presence(*textvec.buffers(pa.array(texts + tests)))
    assert [frozenset(map(int, r.nonzero()[0])) for r in rows] == sets + asked

    model = langid.KernelModel.fit(rows[: len(texts)], labels)
    best, score = model.score(rows[len(texts) :])
    kernel = lambda a, b: len(a & b) / ((len(a) or 1) * (len(b) or 1)) ** 0.5
    order = {c: [k for k, x in enumerate(labels) if x == c] for c in "xyz"}
    marks = sorted([(turn, k) for c in "xyz" for turn, k in enumerate(order[c])])[: langid.LANDMARKS]
    marks = [sets[k] for k in sorted(k for _, k in marks)]
    k_mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(k_mm)
    inverse = vectors @ np.diag(1 / np.maximum(values, 1e-6)) @ vectors.T
    k_nm = np.array([[kernel(a, b) for b in marks] for a in sets])
    wanted = np.array([[1.0 if x == c else -1.0 for c in "xyz"] for x in labels])
    dual = np.linalg.solve(k_nm @ inverse @ k_nm.T + langid.RIDGE * len(texts) * np.eye(len(texts)), wanted)
    dense = np.array([[kernel(a, b) for b in marks] for a in asked]) @ inverse @ k_nm.T @ dual
    assert np.allclose(score, np.clip((dense.max(axis=1) + 1) / 2, 0, 1), atol=2e-3)
    clear = np.sort(dense, axis=1)[:, -1] - np.sort(dense, axis=1)[:, -2] > 5e-3
    assert clear.sum() > 50 and (best == dense.argmax(axis=1))[clear].all()


def test_odd_tables(spark):
    rows = [(3 * k, f"{'der die das' if k % 2 else 'the of and'} {k}", "de" if k % 2 else "en") for k in range(60)]
    docs = spark.createDataFrame([(*r, "zz", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid.train(docs)
    assert langid.predict(docs, model).columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert langid.predict(docs.where("false"), model).count() == 0
    odd = [(1, "the of and " * 20_000), (2, None), (2, None), (3, "the"), (3, "the"), (None, "das")]
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(spark.createDataFrame(odd, "doc_id long, text string").coalesce(1), model).collect()]
    assert got == [(1, "en"), (2, "und"), (2, "und"), (3, "en"), (3, "en"), (None, "de")]
    # Texts that say nothing of either label tie; the first label in order wins.
    same = spark.createDataFrame([(k, "xyz", name) for k in range(0, 90, 3) for name in ("bb", "aa")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(same, langid.train(same)).collect()} == {"aa"}
