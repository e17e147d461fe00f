"""Every operator of the subpackage against a brute-force version, on texts with
nulls, empty and long texts, repeated rows, ties and clashing column names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from matchengine.llm import byte_dedup, decontaminate, jaccard, langid, line_dedup, packing, quality, quotations, token_codec, token_files, tokens, urls

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def make_texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdéfghñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",\n", "\n"]) for _ in range(n))
    rows: list[tuple[int | None, str | None]] = [(k, text(rng.choice([3, 12, 60, 200]))) for k in range(40)]
    passage = text(40)
    rows += [(100 + k, text(20) + "\n" + passage + "\n" + text(20)) for k in range(5)]
    words = rows[5][1].split(" ")
    rows += [(200 + k, " ".join(words[:k] + ["changed"] + words[k + 1 :])) for k in range(0, len(words), max(1, len(words) // 6))]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, ""), (303, None), (304, "one"), (305, "  \n\t "), (306, "Ünï © ß " * 30), (307, text(5000)), (308, "spam " * 300), (None, text(30)), (None, None)]
    rows += [(40, text(50))] * 2 + [(41, "aaaa" * 200)]
    return rows


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if k % 5 == 0 else f"s{k % 2}", k, "x", k) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, matches string, __id int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def keyed(texts):
    """Documents with an id, repeated rows once."""
    return sorted({(i, t or "") for i, t in texts if i is not None})


def test_codec_round_trip():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, np.uint32), np.array([7], np.uint32), rng.integers(0, 1 << 24, 5000), np.zeros(5000), rng.zipf(1.2, 9000).clip(0, 50_000)):
        ids = ids.astype(np.uint32)
        assert (token_codec.decode_stripe(token_codec.encode_stripe(ids)) == ids).all()
    data = bytearray(token_codec.encode_stripe(np.arange(4000, dtype=np.uint32)))
    data[3 * len(data) // 4] ^= 255
    with pytest.raises(ValueError):
        token_codec.decode_stripe(bytes(data))
    assert token_codec.decode_stripe(token_codec.encode_stripe(np.array([1 << 24, 2**32 - 1], np.uint32))).tolist() == [1 << 24, 2**32 - 1]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_tokens_equal_the_library(name, texts):
    import pyarrow as pa

    encoder = tokens.encoder(tokens.tokenizer_path(name))
    odd = ["a  b\n\n c", None, " lead", "tail ", "'s don't WE'LL x", "\u3000z é \u00a0ñ", "x\x00y \x01 z", "1 23 4,5 ?!", "\r\n a\r\nb", "<|endoftext|> a", "a .b'c.'d", "İ ΑΣ"]
    column = [t for _, t in texts] + odd
    from matchengine.llm import textvec

    ids, begin = encoder.encode(*textvec.buffers(pa.array(column, pa.string())))
    for k, t in enumerate(column):
        assert ids[begin[k] : begin[k + 1]].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def library_ids(name, text, end):
    return [*tokens.encoder(tokens.tokenizer_path(name)).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, texts, empty):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    pieces = packing.pack_documents(docs, path, with_ids=True).toPandas()
    want = sorted(library_ids("word_bpe_49k.json", t, 1) for _, t in texts)
    placed = pieces.sort_values(["sequence_id", "offset"])
    for _, g in placed.groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
        total = int(g.length.sum())
        assert total <= 2048
    assert sum(map(len, want)) == pieces.length.sum()
    for x in pieces.itertuples():
        assert len(x.ids) == 4 * x.length and zlib.crc32(x.ids) == x.ids_crc32
    once = [i for i, _ in texts if i is not None and sum(i == j for j, _ in texts) == 1]
    for i, t in texts:
        if i in once:
            mine = pieces[pieces.doc_id == i].sort_values("start")
            ids = b"".join(mine.ids)
            assert ids == np.array(library_ids("word_bpe_49k.json", t, 1), "<u4").tobytes()
            assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]] and set(mine.doc_tokens) == {len(ids) // 4}
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_padding():
    bins = packing.HarmonicBins(2048, 64, 0)
    rng = random.Random(1)
    lengths = [rng.randint(1, 5000) for _ in range(300)]
    for k, n in enumerate(lengths):
        bins.add(k, n)
    bins.close()
    used: dict[int, int] = {}
    for _, _, n, s, _ in bins.placed:
        used[s] = used.get(s, 0) + n
    assert sum(used.values()) == sum(lengths)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used.values())
    assert padding < 0.01 * sum(lengths)


def test_token_files(spark, docs, texts, tmp_path, empty):
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(docs, path, tokens.tokenizer_path("byte_bpe_50k.json"))
    rows = token_files.read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([i for i, _ in texts], key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        at += r.n_tokens
    assert sorted(r.ids_crc32 for r in rows) == sorted(crc(library_ids("byte_bpe_50k.json", t, 2)) for _, t in texts)
    token_files.write_token_files(empty, f"{path}-none", tokens.tokenizer_path("byte_bpe_50k.json"))
    assert token_files.read_token_files(spark, f"{path}-none").count() == 0


def brute_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    inside = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)} if len(words) < 2000 else None
    if inside is None:
        seen: dict[tuple, list[int]] = {}
        for k, w in enumerate(windows):
            seen.setdefault(w, []).append(k)
        inside = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality(docs, texts, empty):
    judged = quality.judge(docs)
    got = sorted(tuple(r) for r in judged.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == sorted(brute_counts(t) for _, t in texts)
    for r in judged.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns
    assert good.count() == judged.where("kept").count()
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0


def verdicts(spark, rows):
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    return {r.doc_id: r.kept for r in judged.collect()}


def prose(k: int, n: int = 60) -> list[str]:
    return [f"word{(7 * k + 13 * j) % 997:03d}" for j in range(n)]


#: name: (usual text of a plain source, usual text of a source full of it, odd text that the one rejects and the other keeps)
GROUPS = {
    "symbols": (lambda k: " ".join(prose(k)), lambda k: " ".join(prose(k)) + " #" * (8 + k % 8), lambda k: " ".join(prose(k)) + " #" * 12),
    "lines": (lambda k: "\n".join(prose(k, 40)), lambda k: "\n".join(prose(k, 40) + prose(k, 6 + k % 8)[::-1]), lambda k: "\n".join(prose(k, 40) + prose(k, 10)[::-1])),
    "words": (lambda k: " ".join(prose(k, 200)), lambda k: " ".join(prose(k, 200) + prose(k, 9 + k % 6)), lambda k: " ".join(prose(k, 200) + prose(k, 12))),
    "length": (lambda k: " ".join(prose(k) + ["ab"] * (k % 4)), lambda k: " ".join([w * 2 for w in prose(k)] + ["ab"] * (k % 4)), lambda k: " ".join(w * 2 for w in prose(k))),
}


@pytest.mark.parametrize("ratio", list(GROUPS))
def test_quality_rejects_by_own_group(spark, ratio):
    """One text is rejected in one source and kept in the other: no cutoff for
    all could do that."""
    plain, full, odd = GROUPS[ratio]
    rows = [(k, plain(k), "a", "x") for k in range(300)] + [(1000 + k, full(k), "b", "y") for k in range(300)]
    rows += [(5000, odd(1), "a", "x"), (5001, odd(1), "b", "y")]
    got = verdicts(spark, rows)
    assert not got.pop(5000) and got.pop(5001)
    assert sum(got.values()) > 0.98 * len(got)


def test_quality_limits_of_small_groups_and_long_words(spark):
    """A source of one document takes the limits of its language; a word length
    beyond the exact steps is no clipped value."""
    rows = [(k, " ".join(prose(k)), "a", "x") for k in range(200)] + [(900, " ".join(prose(3)) + " #" * 40, "alone", "x"), (901, " ".join(prose(5)), "other", "x")]
    rows += [(2000 + k, " ".join("x" * (3000 + k % 40 + j) for j in range(12)), "long", None) for k in range(200)] + [(3000, " ".join("x" * 9000 for _ in range(12)), "long", None)]
    got = verdicts(spark, rows)
    assert not got[900] and got[901]
    assert got[2000] and got[2100] and not got[3000]


def brute_lines(texts, m=3, long_line=200, run_words=50):
    """Texts left after deleting later copies of runs of m lines, of shorter ones
    with so many words and of single long lines; documents in id order."""
    seen, out = set(), {}
    for i, t in texts:
        lines, gone = t.split("\n"), set()
        for k in range(len(lines)):
            for size in range(1, m + 1):
                long = (size == 1 and len(lines[k]) >= long_line) or len(SPACE.findall("\n".join(lines[k : k + size]))) >= run_words
                if k + size <= len(lines) and (size == m or long):
                    key = (size, tuple(lines[k : k + size]))
                    if key in seen:
                        gone |= set(range(k, k + size))
                    seen.add(key)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)
    return out


def test_line_dedup(spark, docs, texts, empty):
    unique = [(i, t) for i, t in keyed(texts) if sum(i == j for j, _ in keyed(texts)) == 1]
    found = line_dedup.dedup_lines(spark.createDataFrame(unique, "doc_id long, text string"), report=True).collect()
    want = brute_lines(unique)
    assert {r.doc_id: (r.text, r.n_removed) for r in found} == want
    assert sum(n for _, n in want.values()) > 0
    cut = line_dedup.dedup_lines(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("m", [1, 2, 5])
def test_line_runs_of_any_length(spark, m):
    rng = random.Random(m)
    rows = [(k, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 14)))) for k in range(30)]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_lines=m).collect()
    assert {r.doc_id: r.text for r in found} == {i: t for i, (t, _) in brute_lines(rows, m).items()}


def test_url_trie(spark):
    rules = [urls.UrlRule("allow", "org"), urls.UrlRule("block", "example.org", "/es/"), urls.UrlRule("block", "example.org", "/en/1"), urls.UrlRule("block", "org", "/x"), urls.UrlRule("allow", "org", "/x")]
    cases = {
        "http://a.Example.ORG/es/1?q=/en/": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://notexample.org": ("notexample.org", "", None, "allow"),
        "https://other.org/x": ("other.org", "/x", "org/x", "block"),
        "ftp://host.com/p://q": ("host.com", "/p://q", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, "host", "v") for k, u in enumerate(cases)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, rules, keep=["page_id"]).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.filter_urls(pages.where("false"), rules, keep=["page_id"]).count() == 0
    with pytest.raises(ValueError):
        urls.filter_urls(pages, [urls.UrlRule("maybe", "org")])


def brute_urls(url, rules, default="allow"):
    found = urls.URL.search(url or "")
    host, path = (fold(found[1]), found[2]) if found else ("", "")
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
    return host, path, best.text if best else None, best.verdict if best else default


@pytest.mark.parametrize("most", [100_000, 3])
def test_url_rules_of_any_number(spark, monkeypatch, most):
    """The trie, and the joins beyond its bound, against trying every rule."""
    rng = random.Random(6)
    monkeypatch.setattr(urls, "MAX_RULES", most)
    host = lambda: ".".join(rng.choice(["a", "b", "co", "org"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(["", "x", "xy", "en", "é"]) for _ in range(rng.randint(0, 3)))
    rules = [urls.UrlRule(rng.choice(["allow", "block"]), host(), rng.choice([path(), "", "/"])) for _ in range(60)]
    rules = [r for r in rules if r.path]
    cases = [f"http://{host()}{path()}" for _ in range(150)] + ["http://A.B" + "/x" * 40_000, "http://" + "a." * 300 + "org/x", None, "", "http://", "b.org/x", "x://ORG/x#/en", "http://org?/x"]
    cases += cases[:5]
    pages = spark.createDataFrame([(k, u, "r", 1) for k, u in enumerate(cases)], "page_id long, url string, rule string, size int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, rules, keep=["page_id"]).collect()}
    assert got == {k: brute_urls(u, rules) for k, u in enumerate(cases)}


def brute_contamination(text, items, window=13):
    words, hit, names = ALNUM.findall(fold(text or "")), set(), set()
    for name, item in items:
        w = ALNUM.findall(fold(item or ""))
        size = min(window, len(w))
        for k in range(len(w) - size + 1) if w else ():
            for p in range(len(words) - size + 1):
                if words[p : p + size] == w[k : k + size]:
                    hit |= set(range(p, p + size))
                    names.add(str(name))
    return len(words), len(hit), ",".join(sorted(names))


def test_decontamination(spark, docs, texts, empty, monkeypatch):
    passage = ALNUM.findall(fold(texts[41][1]))
    items = [(1, " ".join(passage[20:45])), (2, " ".join(texts[1][1].split()[:4])), (3, None), (4, ""), (10, " ".join(passage[22:40]) + " tail"), (1, " ".join(passage[20:45]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute_contamination(t, items) for _, t in texts)
    for size in (decontaminate.BLOCK_BYTES, 150):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        found = decontaminate.match_benchmark(docs, bench).withColumn("names", F.array_join(decontaminate.item_names(), ","))
        assert sorted((r.n_words, r.n_hit, r.names) for r in found.collect()) == want
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not (h and 20 * h >= n) for n, h, _ in want)
    assert decontaminate.match_benchmark(empty, bench).count() == 0
    assert decontaminate.match_benchmark(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_longest_matches_have_locations(spark):
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(1, "x y " + " ".join(words[5:35]) + " z")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    (m,) = decontaminate.match_benchmark(docs, bench).first().matches
    assert (m.item, m.item_word, m.doc_word, m.n_words) == ("9", 5, 2, 30)


def test_language(spark, docs):
    sf = "/root/testdata/sf0.01/documents.parquet"
    all_docs = spark.read.parquet(sf)
    got = langid.predict(all_docs, langid.train(all_docs)).join(all_docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out & got.lang.notna()]
    assert len(got) == all_docs.count() and len(held) > 100
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    odd = langid.predict(docs, langid.train(all_docs)).collect()
    assert len(odd) == docs.count()
    short = spark.createDataFrame([(1, None), (2, ""), (3, "12 -- 3"), (4, "é"), (None, "word")], "doc_id long, text string")
    assert [(r.lang_pred == "und") for r in langid.predict(short, langid.train(all_docs)).collect()] == [True, True, True, False, False]
    assert {r.lang_pred for r in langid.predict(short, langid.train(all_docs.where("false"))).collect()} == {"und"}


def brute_bytes(texts, length=100):
    seen, out = set(), {}
    for i, t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    return out


def text_hash(text: str) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def in_order(texts):
    """Rows with a key (id, hash of the text); a row given twice once, ids that are missing first."""
    keys = {((-(2**63) if i is None else i), text_hash(t or "")): t or "" for i, t in texts}
    return sorted(keys.items())


def byte_rows(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()), key=str)


def test_byte_dedup(spark, docs, texts, empty):
    found = byte_dedup.remove_repeats(docs.repartition(5))
    want = brute_bytes(in_order(texts))
    keyed_rows = [(i, *want[-(2**63) if i is None else i, text_hash(t or "")]) for i, t in texts]
    assert byte_rows(found) == sorted(keyed_rows, key=str)
    assert sum(w[1] for w in want.values()) > 1000
    assert byte_dedup.remove_repeats(empty).count() == 0
    with pytest.raises(TypeError):
        byte_dedup.remove_repeats(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


@pytest.mark.parametrize("batch", [7, 10_000])
def test_byte_dedup_repeated_ids(spark, batch):
    """Different texts under one id or without any, rows given twice, long
    texts that change in places: every length of a common string around 100."""
    rng = random.Random(13)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, base), (1, base), (None, base[100:900]), (None, base[850:1400] + "x"), (None, None), (2, "tail " + base[2000:])]
    for k in range(60):
        size, at = rng.randint(96, 240), rng.randrange(2700)
        rows.append((rng.choice([None, 3, 3, 4, 100 + k]), f"{k}#" + base[at : at + size] + f"#{k}" + base[at + 3 : at + 110]))
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = byte_rows(byte_dedup.remove_repeats(spark.createDataFrame([(*r, "d", 1) for r in rows], "doc_id long, text string, doc string, h int").repartition(5)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute_bytes(in_order(rows))
    assert found == sorted(((i, *want[-(2**63) if i is None else i, text_hash(t or "")]) for i, t in rows), key=str)


def test_byte_dedup_of_a_large_group_of_near_copies(spark):
    """One text with a change in another place in each copy, exact copies among
    them: most ranks have many different runs in every chunk, some in one only."""
    rng = random.Random(29)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1200))
    rows = []
    for k in range(150):
        at = rng.randrange(1200)
        rows.append((k, base if k % 10 == 3 else base[:at] + f"<{k}>" + base[at + rng.randint(0, 3) :]))
    rows += [(1000 + k, f"{k}" + base[50 * k : 50 * k + 130]) for k in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute_bytes(in_order(rows))
    assert byte_rows(byte_dedup.remove_repeats(frame)) == sorted(((i, *want[i, text_hash(t)]) for i, t in rows), key=str)


def test_byte_runs_of_one_rank_are_dealt_out():
    """Of 500 different runs of one rank two go by the rank; equal ones are merged."""
    n = 500
    name = np.append(np.full(2 * n, 77, np.uint64), [np.uint64(91)])
    whole = np.append(np.repeat(np.arange(10, 10 + n, dtype=np.uint64) << np.uint64(8), 2), [np.uint64(5)])
    doc, place = np.arange(2 * n + 1), np.full(2 * n + 1, 1 << 14)
    runs, again = [b.to_pandas() for b in byte_dedup._dealt(name, whole, doc, doc, place)]
    assert len(runs) == n + 1 and len(again) == n and again.whole.isna().all()
    by_rank = runs[runs.deal % 2 == 0]
    assert sorted(by_rank.deal) == [76, 76, 90] and runs[runs.deal % 2 == 1].deal.is_unique
    assert sorted([*runs.doc, *again.doc]) == list(range(2 * n + 1)) and set(again.doc) == set(range(1, 2 * n, 2))


def brute_sets(text, n):
    words = SPACE.findall(fold(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute_components(rows, n, percent):
    sets = {i: brute_sets(t, n) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = find(a), find(b)
                top[max(a_, b_)] = min(a_, b_)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, docs, texts, n, percent):
    unique = [(i, t) for i, t in keyed(texts) if sum(i == j for j, _ in keyed(texts)) == 1]
    rng = random.Random(5)
    base = unique[10][1].split() * 3
    for k in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(50)}"
        unique.append((1000 + k, " ".join(words)))
    found = jaccard.link_components(spark.createDataFrame(unique, "doc_id long, text string").repartition(4), n=n, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(unique, n, percent)


def test_jaccard_edges(docs, empty):
    assert jaccard.link_components(docs).count() == docs.count()
    kept = jaccard.keep_one_each(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert jaccard.link_components(empty).count() == 0


def test_quotations(spark):
    rows = [
        (1, 1, "user", "How does it work?\nPlease explain."),
        (1, 2, "assistant", "It works by magic.\n\nThat is all."),
        (1, 3, "user", "On Monday someone wrote:\n> It  works by MAGIC.\n\nReally?"),
        (1, 4, "assistant", ">> How does it work?\n>> Please explain.\n> Really?\nYes."),
        (1, 5, "user", "> never said before\nHm."),
        (1, 6, "user", None),
        (1, 7, "user", "> Yes.\nThanks"),
        (1, 7, "user", "> Yes.\nThanks"),
        (2, 1, "user", "> Really?\nother conversation"),
        (None, 1, "user", "lone"),
        (3, None, "user", "> lone"),
        (3, 1, "user", ""),
    ]
    found = quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.turn): (r.parent_turn, r.thread_turn, r.depth, r.text) for r in found.collect()}
    assert found.count() == len(rows)
    assert got[1, 1] == (None, 1, 0, rows[0][3])
    assert got[1, 3] == (2, 2, 1, "Really?")
    assert got[1, 4] == (3, 2, 2, "Yes.")
    assert got[1, 5] == (None, 5, 0, "Hm.")
    assert got[1, 6] == (None, 6, 0, None)
    assert got[1, 7] == (4, 2, 3, "Thanks")
    assert got[2, 1] == (None, 1, 0, "other conversation")
    chat = quotations.format_chat(found.where("conv_id = 1 AND turn IN (1, 2, 3, 4, 5)")).collect()
    assert [r.turn for r in chat] == [1, 2, 3, 4, 5] and chat[2].chat == "<|user|>\nReally?\n"
    kept = quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), keep_unlinked=True)
    assert kept.where("conv_id = 1 AND turn = 5").first().text == rows[4][3]
    assert quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").where("false")).count() == 0


@pytest.mark.parametrize("hot", [1, 4096])
def test_jaccard_cells_of_large_tiles(spark, monkeypatch, hot):
    """Tiles of more members than a task takes, links across their blocks; tokens
    read as runs or, where frequent, summed up."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(300)}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(base[:30] + [f"x{k}y{j}" for j in range(20)])) for k in range(40)]
    rng.shuffle(rows)
    monkeypatch.setattr(jaccard, "CELL", 16)
    monkeypatch.setattr(jaccard, "HOT_TOKEN", hot)
    found = jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute_components(rows, 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert len({c for _, c in want.values()}) > 60


def test_jaccard_repeated_and_null_ids(spark):
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(9, one), (9, two), (9, two), (3, two + " end"), (4, one + " end"), (None, one), (None, None), (5, ""), (6, "A1 a2"), (7, "a1 A2")]
    frame = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id long, text string, cid int, f1 string")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_components(frame).collect()), key=str)
    assert found == sorted([(9, 37, 4), (9, 37, 3), (9, 37, 3), (3, 38, 3), (4, 38, 4), (None, 37, None), (None, 0, None), (5, 0, 5), (6, 1, 6), (7, 1, 6)], key=str)
    kept = jaccard.keep_one_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 4), (False, 5), (False, 6), (True, 0), (True, 0)]
    with pytest.raises(TypeError):
        jaccard.link_components(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
