"""The source audit and the mixing operator against brute-force versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchengine.llm import mixing, queries, radix, source_audit

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def make_rows():
    """Ids repeat or are null, texts are null, empty and very long, languages and
    sources null, a source holds a third of the rows; columns have clashing names."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcÉñxyZ") for _ in range(rng.randint(1, 5))) for _ in range(150)] + ["x" * 300 + c for c in "abc"]
    text = lambda n: rng.choice([" ", "-1 "]).join(rng.choices(vocabulary, range(len(vocabulary), 0, -1), k=n))
    rows = [(k, text(rng.choice([1, 5, 40, 300])), rng.choice(["en", "fr", None, "zz"]) if k % 7 else "", rng.choice(["hot", "hot", "a", "é", "", None])) for k in range(240)]
    rows += [(None, None, None, None), (1, None, "solo", "one"), (2, "", "en", "void"), (3, text(20_000), "en", "a"), (3, text(30), "en", "a"), (None, text(30), "fr", "\U0001f600"), (None, text(9), "fr", "＀")]
    rows += [(7, "same words here", "en", "hot")] * 5
    return [(*r, n, "v", n) for n, r in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, size int"


@pytest.fixture(scope="module")
def given():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, given):
    return spark.createDataFrame(given, SCHEMA).repartition(3)


def brute_audit(rows, least, k):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall(fold(text or ""))
        groups.add((lang, source))
        counts[lang, source].update(words)
        held[lang].update(set(words))
    out = []
    kept = {lang: [t for t, n in held[lang].items() if n >= least] for lang, _ in groups}

    def rate(lang, count):
        v = len(kept[lang])
        n = sum(count[t] for t in kept[lang])
        return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * v) for t in kept[lang]}

    p = {g: rate(g[0], counts[g]) for g in groups}
    for lang, source in groups:
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])
        q = rate(lang, whole)
        mine = p[lang, source]
        pairs = [(s, sum(abs(mine[t] - p[lang, s][t]) for t in mine)) for la, s in groups if la == lang and s != source]
        terms = [(t, mine[t] - q[t]) for t in mine if counts[lang, source][t] and mine[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, k)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, r) for r, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def tuples(frame):
    return sorted(map(tuple, frame.select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize(("least", "k"), [(30, 50), (3, 4), (10**6, 5)])
def test_audit(docs, given, least, k):
    assert tuples(source_audit.audit(docs, least=least, k=k)) == brute_audit([r[:4] for r in given], least, k)


def test_audit_of_an_empty_table(docs):
    out = source_audit.audit(docs.where("false"))
    assert out.count() == 0 and out.schema.simpleString() == "struct<lang:string,source:string,part:string,item:string,value:bigint,rank:int>"


def test_chunks_of_one_document_count_the_same(docs, given, monkeypatch):
    import pyarrow as pa

    rows = [(r[1] or "", r[2] or "", r[3] or "") for r in given]
    batch = pa.RecordBatch.from_pylist([dict(zip(("text", "lang", "source"), r, strict=True)) for r in rows])

    def sums():
        found = Counter()
        for out in source_audit._chunk_counts(iter([batch])):
            for r in out.to_pylist():
                found[r["lang"], r["source"], r["term"]] += r["n"] + 10_000 * r["docs"]
        return found

    whole = sums()
    monkeypatch.setattr(source_audit.tv.chunks, "__defaults__", (1,))
    monkeypatch.setattr(source_audit.tv.text_chunks, "__defaults__", (1,))
    assert sums() == whole and len(whole) > 300


@pytest.mark.parametrize("settled", [0, 7])
def test_ties_are_divided_by_bytes(spark, settled):
    """Many equal values; long common beginnings, items that begin one another, and
    characters of one to four bytes."""
    rng = random.Random(2)
    stem = "é" * 3000
    items = {stem + "".join(rng.choice("ab＀\U0001f600") for _ in range(rng.randint(0, 6))) for _ in range(200)}
    rows = [(g, i, rng.choice([5, 5, 5, 9, 1 << 40])) for g in ("one", "two") for i in items] + [("few", "b", 0), ("few", "a", 0)]
    frame = spark.createDataFrame(rows, "g string, item string, value long")
    got = sorted(map(tuple, radix.top(frame, ["g"], "value", "item", 150, settled=settled).select("g", "item", "value", "rank").collect()))
    want = []
    for g in ("one", "two", "few"):
        ranked = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:150]
        want += [(*r, n) for n, r in enumerate(ranked, 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("bits", [1, 13, 14, 40, 63])
def test_kth_values(spark, bits):
    rng = random.Random(bits)
    rows = [(g, rng.getrandbits(bits) >> rng.choice([0, bits // 2]), k) for g, k in ((1, 1), (2, 50), (3, 10**6), (4, 0)) for _ in range(120)]
    found = {r.g: (r.cut, r.n, r.need) for r in radix.kth_values(spark.createDataFrame(rows, "g int, v long, k long"), ["g"], "v", "k", bits).collect()}
    assert set(found) == {1, 2, 3}
    for g, (cut, n, need) in found.items():
        values = sorted(v for a, v, _ in rows if a == g)
        k = min(120, next(k for a, _, k in rows if a == g))
        assert values[k - 1] == cut and n == values.count(cut) and need == k - sum(v < cut for v in values)


def brute_targets(sizes, weights, most):
    """sizes: name to words; exact, stopping one round of sources at a time."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in free)) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return {s: float(share[s]) if s in share else float(most * sizes[s]) for s in names}
        stopped |= above


def test_targets(spark):
    rng = random.Random(3)
    for trial in range(8):
        sizes = {f"s{k:02d}": rng.choice([0, 1, 10, 1000, 10**6, rng.randint(1, 10**9)]) for k in range(rng.randint(1, 9))}
        names = sorted(sizes)
        frame = spark.createDataFrame([(s, sizes[s], (1, 2, 3)[i % 3]) for i, s in enumerate(names)], "source string, size long, weight long")
        got = {r.source: r.target for r in mixing.targets(frame, 3).collect()}
        want = brute_targets(sizes, (1, 2, 3), 3)
        assert got == pytest.approx(want, rel=1e-12), trial
        assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def check_mix(frame, rows, weights=(1, 2, 3), most=3):
    sizes, words = Counter(), []
    for i, text, source in rows:
        words.append((i is None, i or 0, len(WORD.findall(text or ""))))
        sizes[source] += words[-1][2]
    want = brute_targets(sizes, weights, most)
    assert sorted(zip(frame.doc_id.isna(), frame.doc_id.fillna(0).astype(int), frame["size"], strict=True)) == sorted(words)
    assert (frame.taken <= most * frame["size"]).all() and (frame.taken == frame.copies * frame["size"]).all()
    for source, g in frame.groupby(frame.source.fillna("~null")):
        name = None if source == "~null" else source
        assert set(g.source_size) == {sizes[name]} and g.target.iloc[0] == pytest.approx(want[name], rel=1e-12)
        assert g[g["size"] > 0].copies.max() - g[g["size"] > 0].copies.min() <= 1 if (g["size"] > 0).any() else True
    return want


def test_mixing(docs, given):
    out = mixing.mix(docs).toPandas()
    check_mix(out, [(r[0], r[1], r[3]) for r in given])
    for _, g in out.groupby(out.source.fillna("~null")):
        # Within the largest document, and within its own size if sizes are many.
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(1, g["size"].max())
    again = mixing.mix(docs.repartition(5)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    canonical = lambda f: sorted(map(repr, f[key].astype(object).where(f[key].notna(), None).itertuples(index=False, name=None)))
    assert canonical(out) == canonical(again)


def test_taken_words_are_near_the_targets(spark, sf_dir):
    found = queries.op12_pareto_mixing(spark, sf_dir.replace("0.001", "0.01")).join(spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "source"), "doc_id")
    sums = found.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).toPandas()
    assert len(sums) == 20 and (abs(sums.taken - sums.target) <= 0.005 * sums.target + 2).all()


def test_mixing_of_an_empty_table_and_of_one_without_words(docs):
    assert mixing.mix(docs.where("false")).count() == 0
    out = mixing.mix(docs.where("text IS NULL OR text = ''")).toPandas()
    assert len(out) == 3 and out.taken.sum() == 0 and out.target.sum() == 0


def test_pareto_order(spark, docs):
    """The documents taken once more are the first n of their stratum by the
    quotient of odds."""
    rows = mixing.measure(docs).toPandas()
    out = mixing.mix(docs).toPandas()
    target = out.groupby(out.source.fillna("~"))[["source_size", "target"]].max()
    rows["name"] = rows.source.fillna("~")
    want = Counter()
    for name, g in rows.groupby("name"):
        strata = g.groupby("step").agg(m=("size", "size"), words=("size", "sum"), least=("size", "min"), most=("size", "max")).reset_index()
        strata["squares"] = [sum((z - s) ** 2 for z in g[g.step == s]["size"]) for s in strata.step]
        strata["source_size"], strata["target"], strata["sid"] = target.source_size[name], target.target[name], 0
        plan = mixing.settle(strata).set_index("step")
        for s, h in g.groupby("step"):
            r = plan.loc[s]
            p = r.base + r.slope * (h["size"] - r["mean"])
            u = (h.u + 0.5) / 2.0**52
            odds = (u * (1 - p)) / (u * (1 - p) + (1 - u) * p)
            first = set(odds.sort_values(kind="stable").index[: int(r.n)])
            for i, x in h.iterrows():
                copies = (int(r.whole) + (i in first)) if x["size"] else 0
                want[name, -1 if pd.isna(x.doc_id) else int(x.doc_id), int(x["size"]), copies] += 1
    got = Counter((s, -1 if pd.isna(i) else int(i), int(z), int(c)) for s, i, z, c in zip(out.source.fillna("~"), out.doc_id, out["size"], out.copies, strict=True))
    assert got == want


def test_inclusion_follows_preferences(spark):
    """A document of ten times the odds is taken far more often."""
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three "), F.col("id")).alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"), F.when(F.col("id") % 2 == 0, 10.0).alias("liked"))
    out = mixing.mix(frame, preference="liked").toPandas()
    a = out[out.source == "a"]
    assert a.taken.sum() == pytest.approx(a.target.iloc[0], abs=4)
    even, odd = a[a.doc_id % 2 == 0].copies.mean(), a[a.doc_id % 2 == 1].copies.mean()
    assert even > 1.5 * odd > 0
