"""Source divergence audit: how far the words of sources of one language differ.

Terms are runs of letters A-Z and of characters outside ASCII, A-Z lower-cased.
A language keeps the terms that at least ``least`` of its documents hold.  Every
source of a language, and the language as a whole, gives a kept term the smoothed
integer probability ``1 + (SCALE * (count + ALPHA)) div (N + ALPHA * V)``, of V
kept terms with N occurrences there.  Two reports come out:

* ``pair``: for each two sources of a language the sum of the distances of all
  kept terms' probabilities;
* ``term``: for each source the ``k`` terms that it uses most above the language.

Counting: a worker counts the terms of a chunk of text per language and source, so
one row for each term, group and chunk is shuffled, however large a source is.
Distances: most terms do not occur in most sources, where a probability is the
source's baseline (that of count 0).  The sum over all terms is the distance of the
baselines times the terms that neither source has, plus each source's own terms
against the other's baseline (from running sums over its distinct probabilities),
plus a correction for terms that both have.  Only these last are joined.  The
terms are ranked by radix selection (``radix``).

Defined results: null text, language and source are read as empty; a group without
terms is still compared with the others; a language of one source has no pairs,
one without kept terms has distances of 0; repeated rows count as often as they
occur; an empty table gives no rows; other columns are not read.  Languages and
sources are compared as strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchengine.durable import keep
from matchengine.llm import radix
from matchengine.llm import textvec as tv

SCALE = 1_000_000_000
ALPHA = 5
#: Bytes of terms after lower-casing A-Z.
TERM = tv.byte_class((0x61, 0x7A), (0x80, 0xFF))
#: Rows of counts that a worker holds and adds up before they are shuffled (some 15 MB),
#: and the odd number that spreads groups over their terms' hashes.
MERGE_ROWS = 150_000
_SPREAD = np.uint64(0xC2B2AE3D27D4EB4F)
_COUNTS = "lang string, source string, term string, n long, docs long"


def _distinct_groups(lang: pa.Array, source: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Language and source of each distinct group, and each row's group."""
    a, b = lang.dictionary_encode(), source.dictionary_encode()
    code = a.indices.to_numpy().astype(np.int64) * len(b.dictionary) + b.indices.to_numpy()
    found, group = np.unique(code, return_inverse=True)
    return a.dictionary.take(pa.array(found // len(b.dictionary))), b.dictionary.take(pa.array(found % len(b.dictionary))), group


def _texts_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans [start, end) of UTF-8 data as strings."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    at = np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[at])])


def _chunk_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term, per group, in each chunk of text; the
    counts of some chunks are added up before they leave the worker.

    Each group also has a row with an empty term, so that none is lost.
    """
    names: dict[tuple[str, str], int] = {}
    held: list[tuple] = []
    rows = 0
    for batch, data, offsets in tv.text_chunks(batches, 0):
        langs, sources, group = _distinct_groups(batch.column(1), batch.column(2))
        number = np.array([names.setdefault(g, len(names)) for g in zip(langs.to_pylist(), sources.to_pylist(), strict=True)])
        folded = tv.LOWER[data]
        starts, ends, first = tv.spans(folded, offsets, TERM)
        hashes, sample, word = np.unique(tv.span_hashes(tv.prefix_sums(folded), starts, ends), return_index=True, return_inverse=True)
        docs, groups = len(offsets) - 1, len(number)
        seen, times = np.unique(word * docs + tv.owners(first), return_counts=True)
        pair, at = np.unique(seen // docs * groups + group[seen % docs], return_inverse=True)
        terms = _texts_at(folded, starts[sample], ends[sample]).take(pa.array(pair // groups))
        held.append((terms, hashes[pair // groups], number[pair % groups], np.bincount(at, times, len(pair)).astype(np.int64), np.bincount(at, minlength=len(pair))))
        rows += len(pair)
        if rows >= MERGE_ROWS:
            yield _merged(held, names)
            held, rows = [], 0
    if names:
        yield _merged(held, names)


def _merged(held: list[tuple], names: dict[tuple[str, str], int]) -> pa.RecordBatch:
    """One row for each term and group of some chunks, and one for each group."""
    groups = len(names)
    terms = pa.chunked_array([h[0] for h in held], pa.large_string()).combine_chunks() if held else pa.array([], pa.large_string())
    column = lambda k, kind: np.concatenate([np.zeros(0, kind), *[h[k] for h in held]])
    number = column(2, np.int64)
    key = tv.mix(column(1, np.uint64) + number.astype(np.uint64) * _SPREAD)
    _, sample, at = np.unique(key, return_index=True, return_inverse=True)
    n, d = (np.zeros(len(sample), np.int64) for _ in range(2))
    np.add.at(n, at, column(3, np.int64))
    np.add.at(d, at, column(4, np.int64))
    owner = pa.array(np.concatenate([np.arange(groups), number[sample]]))
    none = np.zeros(groups, np.int64)
    lang, source = (pa.array([g[k] for g in names], pa.string()).take(owner) for k in (0, 1))
    text = pa.concat_arrays([pa.array([""] * groups, pa.large_string()), terms.take(pa.array(sample))]).cast(pa.string())
    return pa.RecordBatch.from_arrays([lang, source, text, pa.array(np.concatenate([none, n])), pa.array(np.concatenate([none, d]))], names=["lang", "source", "term", "n", "docs"])


def term_counts(documents: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n occurrences and docs that hold it; the empty term of
    each group has counts of 0."""
    rows = documents.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in (("text", text), ("lang", lang), ("source", source))])
    return rows.mapInArrow(_chunk_counts, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _probability(count: str, total: str, terms: str) -> Column:
    """In decimals of 31 digits, which counts of any table fit."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + {ALPHA} AS DECIMAL(20,0))) div nullif(CAST({total} + {ALPHA} * {terms} AS DECIMAL(20,0)), 0)")


def _distance(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b))


def audit(documents: DataFrame, *, least: int = 30, k: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item (the other source, or the
    term), value and rank from 1 by value, largest first, then by item."""
    counted = keep(term_counts(documents, text=text, lang=lang, source=source), "audit-counts")
    kept = counted.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    held = keep(counted.where("term <> ''").drop("docs").join(kept.drop("docs"), ["lang", "term"]), "audit-kept")
    wide = held.groupBy("lang", "term").agg(F.max("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    own = held.groupBy("lang", "source").agg(F.count("*").alias("terms"), F.sum("n").alias("size"))
    groups = counted.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").join(wide, "lang", "left").na.fill(0)
    groups = keep(groups.withColumn("p0", F.coalesce(_probability("CAST(0 AS BIGINT)", "size", "v"), F.lit(0))), "audit-groups")
    rated = held.join(groups, ["lang", "source"]).select("lang", "source", "term", "p0", _probability("n", "size", "v").alias("p"), _probability("total", "lang_n", "v").alias("q"))
    above = rated.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = radix.top(keep(above, "audit-above"), ["lang", "source"], "value", "item", k)
    pairs = radix.ranked(_pair_distances(rated, groups), ["lang", "source"], "value", "item")
    columns = lambda part, rows: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns("pair", pairs).unionByName(columns("term", best))


def _pair_distances(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language) and value."""
    mine = groups.select("lang", "source", "p0", "terms", "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("terms").alias("q_terms"))
    couples = mine.join(other, "lang").where("source <> item")
    # Terms of a source against the others' baselines: running sums over its distinct
    # probabilities and these baselines, in one order.
    points = rated.groupBy("lang", "source", F.col("p").alias("x")).agg(F.count("*").alias("m")).withColumn("item", F.lit(None).cast("string"))
    marks = couples.select("lang", "source", F.col("q0").alias("x"), F.lit(0).cast("long").alias("m"), "item")
    whole = Window.partitionBy("lang", "source")
    upto = whole.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.col("m") * F.col("x")
    swept = points.unionByName(marks).select("lang", "source", "item", "x", F.sum("m").over(upto).alias("m_low"), F.sum(weight).over(upto).alias("s_low"), F.sum("m").over(whole).alias("m_all"), F.sum(weight).over(whole).alias("s_all"))
    alone = swept.where("item IS NOT NULL").select("lang", "source", "item", F.expr("x * (2 * m_low - m_all) + s_all - 2 * s_low").alias("value"))
    neither = couples.where("source < item").select("lang", "source", "item", ((F.col("v") - F.col("terms") - F.col("q_terms")) * _distance("p0", "q0")).alias("value"))
    again = rated.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = rated.drop("q").join(again, ["lang", "term"]).where("source < item")
    both = both.select("lang", "source", "item", (_distance("p", "q") - _distance("p", "q0") - _distance("q", "p0") + _distance("p0", "q0")).alias("value"))
    parts = reduce(DataFrame.unionByName, [alone, neither, both])
    sums = parts.groupBy("lang", F.least("source", "item").alias("low"), F.greatest("source", "item").alias("high")).agg(F.sum("value").alias("value"))
    turned = F.inline(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item"))))
    return sums.select("lang", "value", turned)
