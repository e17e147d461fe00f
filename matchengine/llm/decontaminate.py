"""Benchmark decontamination with suffix arrays over the training text.

Each shard (a few MB of whole documents) gets a suffix array over its word
sequence.  Only suffixes whose first words open some benchmark window can be
the answer to a search, so the array is sparse: it holds those suffixes,
sorted by their first ``window`` word hashes.  Every benchmark suffix is
then binary-searched in it; equal ranges are verbatim matches, and matches
that continue on the same diagonal are joined to the longest one.  Documents
whose matched words reach the contamination share are removed.

The benchmark side is read by the driver in blocks of ``BLOCK_BYTES`` of text,
so what is broadcast never exceeds that bound.  For a larger benchmark the corpus
is read once, with a bitmap of the first words of all windows (``OPENING_BITS``);
only documents that have some of these are written and searched block by block,
and the matches of a document are then united by its row.

Defined results: null and empty texts have no words and no matches; an item
without words matches nothing; an item shorter than the window is one window
as a whole; repeated documents are judged alike and repeated items count once
each; a null item_id is treated as the text ``null``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchengine.durable import keep
from matchengine.llm import textvec as tv

BLOCK_BYTES = 32 << 20
OPENING_BITS = 1 << 27
MATCHES = "array<struct<item:string,item_word:int,doc_word:int,n_words:int>>"


@dataclass
class TestSuffixes:
    """Windows of the benchmark, grouped by length and sorted by word hashes."""

    names: list[str]
    #: length -> (sorted unique windows as fixed bytes, first and last + 1 of
    #: their places, item of each place, word of each place)
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    openings: dict[int, np.ndarray]


def _rows(hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` words from each place, as byte strings in word order."""
    table = hashes[at[:, None] + np.arange(length)[None, :]]
    return np.ascontiguousarray(table.astype(">u8")).view(f"S{8 * length}").ravel()


def test_suffixes(items: list[tuple[str | None, str | None]], window: int) -> TestSuffixes:
    data, offsets = tv.buffers(pa.array([t for _, t in items], pa.large_string()))
    hashes, first = tv.words(data, offsets, tv.ALNUM)
    # A zero byte at the end of a fixed string is not significant to numpy.
    hashes |= np.uint64(1)
    places: dict[int, list[tuple[int, int]]] = {}
    for item in range(len(items)):
        low, high = int(first[item]), int(first[item + 1])
        if high - low >= window:
            places.setdefault(window, []).extend((item, p) for p in range(low, high - window + 1))
        elif high > low:
            places.setdefault(high - low, []).append((item, low))
    by_length, openings = {}, {}
    for length, found in sorted(places.items()):
        item, at = np.array(found, np.int64).T
        rows = _rows(hashes, at, length)
        order = np.argsort(rows, kind="stable")
        unique, begin = np.unique(rows[order], return_index=True)
        end = np.append(begin[1:], len(order))
        by_length[length] = (unique, begin, end, item[order], (at - first[item])[order])
        head = min(3, length)
        openings[length] = np.unique(tv.grams(hashes, first, head)[0] if length == window else _head(hashes, at, head))
    return TestSuffixes(["null" if i is None else str(i) for i, _ in items], by_length, openings)


def _head(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    return tv.grams(hashes[(at[:, None] + np.arange(k)[None, :]).ravel()], np.arange(0, len(at) * k + 1, k), k)[0]


def search(tests: TestSuffixes, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longest verbatim matches in one shard: place, words, item, item word."""
    hashes = hashes | np.uint64(1)
    found = []
    for length, (unique, begin, end, item, item_word) in tests.by_length.items():
        head, at = tv.grams(hashes, first, min(3, length))
        stop = np.repeat(first[1:], np.diff(first))
        opening = tests.openings[length]
        near = np.minimum(np.searchsorted(opening, head), len(opening) - 1)
        at = at[(opening[near] == head) & (at + length <= stop[at])]
        if not len(at):
            continue
        rows = _rows(hashes, at, length)
        suffixes = np.argsort(rows, kind="stable")
        ranked = rows[suffixes]
        low, high = np.searchsorted(ranked, unique, "left"), np.searchsorted(ranked, unique, "right")
        for k in np.flatnonzero(high > low):
            where = np.sort(at[suffixes[low[k] : high[k]]])
            for j in range(begin[k], end[k]):
                found.append((where, np.full(len(where), item[j]), np.full(len(where), item_word[j]), np.full(len(where), length)))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    place, item, word, length = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((place, place - word, item))
    place, item, word, length = place[order], item[order], word[order], length[order]
    # Matches of one item that go on at the next word are parts of a longer one.
    start = np.ones(len(place), bool)
    start[1:] = (item[1:] != item[:-1]) | (place[1:] - word[1:] != place[:-1] - word[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(start)
    last = np.append(at[1:], len(place)) - 1
    return place[at], place[last] + length[last] - place[at], item[at], word[at]


def match_benchmark(documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit and its longest verbatim
    ``matches`` (item, places in words, length)."""
    found = _matched(documents, benchmark, text, item_id, item_text, window, [doc_id])
    return found.select(F.col("__c0").alias(doc_id), "n_words", "n_hit", "matches")


def _matched(documents: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, window: int, carry: list[str]) -> DataFrame:
    """The ``carry`` columns as __c0, __c1, ... with what matches."""
    spark = documents.sparkSession
    tests_of = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t"))
    blocks = _blocks(tests_of)
    source = documents.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(carry)], F.xxhash64(f"`{text}`").alias("__body"))
    names = [*[f"__c{k}" for k in range(len(carry))], "__body"]
    schema = ", ".join(f"{n} {source.schema[n].dataType.simpleString()}" for n in names) + f", n_words long, n_hit long, matches {MATCHES}"

    def search_in(tests) -> DataFrame:
        return source.mapInArrow(lambda batches: _shards(batches, tests.value, names), schema)

    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return search_in(spark.sparkContext.broadcast(test_suffixes(first, window)))
    # Once over the benchmark for the openings, once over the corpus, then block by
    # block over the documents with an opening.
    bits, heads = np.zeros(OPENING_BITS // 8, np.uint8), set()
    for block in chain([first, second], blocks):
        for length, openings in test_suffixes(block, window).openings.items():
            at = (tv.mix(openings) & np.uint64(OPENING_BITS - 1)).astype(np.int64)
            np.bitwise_or.at(bits, at // 8, (1 << (at % 8)).astype(np.uint8))
            heads.add(min(3, length))
    shared = spark.sparkContext.broadcast(bits.tobytes())
    kinds = schema.rsplit(", n_words long", 1)[0]
    marked = keep(source.mapInArrow(lambda batches: _with_openings(batches, shared.value, heads, names), f"__text string, {kinds}, n_words long"), "benchmark-candidates")
    source = marked.where("__text IS NOT NULL").drop("n_words")
    none = marked.where("__text IS NULL").select(*names, "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast(MATCHES).alias("matches"))
    parts = []
    for block in _blocks(tests_of):
        tests = spark.sparkContext.broadcast(test_suffixes(block, window))
        parts.append(keep(search_in(tests), "benchmark-matches"))
        tests.destroy()
    return none.unionByName(_united(parts, names))


def _with_openings(batches: Iterator[pa.RecordBatch], bits: bytes, heads: set[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows with their number of words; the text only where some run of words may
    open a window."""
    table = np.frombuffer(bits, np.uint8)
    for part, data, offsets in tv.text_chunks(batches, 0):
        hashes, first = tv.words(data, offsets, tv.ALNUM)
        hashes = hashes | np.uint64(1)
        may = np.zeros(part.num_rows, bool)
        for head in heads:
            found, at = tv.grams(hashes, first, head)
            slot = (tv.mix(found) & np.uint64(OPENING_BITS - 1)).astype(np.int64)
            hit = (table[slot // 8] >> (slot % 8).astype(np.uint8) & 1).astype(bool)
            may[np.searchsorted(first, at[hit], "right") - 1] = True
        text = pc.if_else(pa.array(may), part.column(0), pa.scalar(None, part.column(0).type))
        yield pa.RecordBatch.from_arrays([text, *part.columns[1:], pa.array(np.diff(first), pa.int64())], names=["__text", *names, "n_words"])


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        block.append((row.i, row.t))
        size += 64 + len(row.t or "")
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _united(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Matches against each block in turn; a document's are then put together."""
    blocks, found = len(parts), reduce(DataFrame.unionByName, parts)
    # Repeated rows of a document have equal matches, block by block.
    united = found.groupBy(*keys).agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("matches")))).alias("matches"), (F.count("*") / F.lit(blocks)).cast("int").alias("__copies"))
    covered = F.aggregate(
        F.array_sort(F.transform("matches", lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b")))),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("upto")),
        lambda acc, m: F.struct((acc["hit"] + F.greatest(F.lit(0), m["b"] - F.greatest(acc["upto"], m["a"]))).cast("long").alias("hit"), F.greatest(acc["upto"], m["b"]).alias("upto")),
        lambda acc: acc["hit"],
    )
    return united.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*keys, "n_words", covered.alias("n_hit"), "matches")


def _shards(batches: Iterator[pa.RecordBatch], tests: TestSuffixes, names: list[str]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())]))
    for part, data, offsets in tv.text_chunks(batches, 0):
        hashes, first = tv.words(data, offsets, tv.ALNUM)
        place, size, item, word = search(tests, hashes, first)
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + size, -1)
        hit = np.append(0, np.cumsum(np.cumsum(edge[:-1]) > 0))
        owner = np.searchsorted(first, place, "right") - 1
        order = np.lexsort((size, item, place, owner))
        count = np.append(0, np.cumsum(np.bincount(owner, minlength=part.num_rows)))
        matches = pa.ListArray.from_arrays(
            pa.array(count, pa.int32()),
            pa.StructArray.from_arrays(
                [pa.array([tests.names[i] for i in item[order]], pa.string()), pa.array(word[order], pa.int32()), pa.array((place - first[owner])[order], pa.int32()), pa.array(size[order], pa.int32())],
                names=["item", "item_word", "doc_word", "n_words"],
            ),
        ).cast(kind)
        columns = [*part.columns[1:], pa.array(np.diff(first), pa.int64()), pa.array(hit[first[1:]] - hit[first[:-1]], pa.int64()), matches]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "n_hit", "matches"])


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", per: int = 20):
    """True if at least one word in ``per`` is hit."""
    return (F.col(n_hit) > 0) & (per * F.col(n_hit) >= F.col(n_words))


def item_names(matches: str = "matches"):
    """Distinct items with a match, sorted as strings."""
    return F.array_sort(F.array_distinct(F.transform(F.col(matches), lambda m: m["item"])))


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, per: int = 20) -> DataFrame:
    """``documents`` without the contaminated ones, columns unchanged."""
    found = _matched(documents, benchmark, text, item_id, item_text, window, documents.columns)
    return found.where(~contaminated(per=per)).select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(documents.columns)])
