"""Removal of repeated byte strings by distributed prefix doubling.

Every ``LENGTH``-byte string that also starts earlier is removed.  Sorting all
suffixes of a corpus would take many times its size on disk, so positions are
sampled in a way that loses no match: a string's anchor is its ``SEED``-byte
piece with the least hash, which equal strings choose alike.  Neighbouring
strings share anchors, so a text falls into runs (about one in 35 bytes) of
strings with one anchor.  Ranks of positions then grow, and what is unique at
one length drops out before the next.

1. Length 32.  Spark sorts the runs by (rank at the anchor, rank of the run's
   whole bytes, position).  A run whose anchor is unique drops out.  Of runs with
   equal bytes all but the first are repeats as a whole; runs that differ stay
   open.
2. Length 91.  An open run falls into groups of strings by their distance to the
   anchor, ten distances each, which have 91 bytes in common.  The rank of these is
   the pair of ranks of their first and last 64 bytes, each a pair of ranks at
   length 32.  Spark sorts the groups likewise: unique ones drop out, equal ones are
   repeats, and those that differ stay open.
3. Length 100.  Each string of an open group is a position with the pair of ranks
   of its first and last 64 bytes.  One whose pair stands at an earlier position
   is a repeat.
4. The repeats' bytes are united per document and cut out.

Ranks are 64-bit names of the bytes they stand for (63 bits where they deal rows
out).  Before the first and the second sort, equal runs or groups of one chunk of
a task are merged, so thousands of copies of a passage send one row a chunk; and
of different ones with one rank only two a chunk are dealt out by that rank, the
others by their own bytes, so no rank gathers a large group of near copies in one
task.  Sorted rows are read as a stream.  The last round sums up a rank's positions
before the shuffle and joins them to a written table, whose hot ranks adaptive
execution can split.

Defined results: a document is its id and its text; a null text is empty; texts
shorter than ``LENGTH`` stay; rows that repeat an id and its text are one
document and get one result; different texts under one id are documents ordered
by a hash of the text; documents without an id come first.  Ids of other than
integer types are an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchengine.llm import textvec as tv
from matchengine.durable import discard, keep, release

SEED = 32
#: Distances to the anchor that one group of strings has.
GROUP = 10
_U = np.uint64
#: A sampled value holds 40 bits of hash and 24 of position.
_PLACE_BITS = 24
_SEGMENT = 1 << 22


def _anchors(sums: np.ndarray, low: int, high: int, length: int) -> np.ndarray:
    """Place of the least-hashed seed of each string that starts in [low, high)."""
    width = length - SEED + 1
    count = high - low + width - 1
    at = np.arange(low, low + count)
    seeds = tv.mix((sums[at + SEED] - sums[at]) * tv.powers(len(sums), -1)[low : low + count])
    seeds = (seeds & ~_U((1 << _PLACE_BITS) - 1)) | np.arange(count, dtype=_U)
    blocks = -(-count // width)
    padded = np.full(blocks * width, ~_U(0), _U)
    padded[:count] = seeds
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: high - low], ahead[width - 1 : width - 1 + high - low])
    return (least & _U((1 << _PLACE_BITS) - 1)).astype(np.int64) + low


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: document, first string, number of
    strings, anchor's place in the chunk, and the sums for hashing."""
    sums = tv.prefix_sums(data)
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4 + (sums,)
    anchor = np.concatenate([_anchors(sums, s, min(s + _SEGMENT, n), length) for s in range(0, n, _SEGMENT)])
    sizes = np.diff(offsets)
    stop = np.repeat(offsets[1:], sizes)[:n]
    valid = np.arange(n) + length <= stop
    change = valid.copy()
    change[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    first = np.flatnonzero(change)
    # Where a document ends, its last string is followed by invalid places.
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | (anchor[1:] != anchor[:-1])
    last = np.flatnonzero(ends)
    return np.searchsorted(offsets, first, "right") - 1, first, last - first + 1, anchor[first], sums


def _dealt(name: np.ndarray, whole: np.ndarray, doc: np.ndarray, h: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (deal, whole, doc, h, place) of runs with the rank ``name`` in common.

    Of equal ones (``whole``) only the first goes on; the others are repeats, sent
    without ``whole``.  The first two different ones of a rank are dealt out by the
    rank; that there are two shows all others of the rank to be open, wherever they
    come from.  So more than two are dealt by their own bytes, with an odd number
    that says they are open: no rank brings more than two rows of a chunk to a task.
    """
    order = np.lexsort((place, h, doc, whole, name))
    name, whole, doc, h, place = (x[order] for x in (name, whole, doc, h, place))
    other = np.append(True, name[1:] != name[:-1])[: len(name)]
    new = other | np.append(True, whole[1:] != whole[:-1])[: len(name)]
    # The same place twice is one row given twice, not a repeat.
    again = ~new & np.append(False, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (place[1:] != place[:-1]))[: len(name)]
    number = np.cumsum(new)
    many = number - number[other][np.cumsum(other) - 1] > 1
    deal = np.where(many, whole | _U(1), name & ~_U(1))
    for chosen, is_run in ((new, True), (again, False)):
        if k := int(chosen.sum()):
            to = deal[chosen] if is_run else tv.mix(doc[chosen].astype(_U) + place[chosen].astype(_U))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to.view(np.int64)), pa.array(whole[chosen].view(np.int64)) if is_run else pa.nulls(k, pa.int64()), pa.array(doc[chosen]), pa.array(h[chosen]), pa.array(place[chosen])],
                names=["deal", "whole", "doc", "h", "place"],
            )


def _named_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (deal, whole, doc, h, place) of the runs of a chunk, see ``_dealt``."""
    for part, data, offsets in tv.text_chunks(batches, 2, tv.CHUNK_BYTES // 2):
        doc, first, count, anchor, sums = runs(data, offsets, length)
        if not len(first):
            continue
        ids, h = part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc]
        start = first - offsets[doc]
        name = tv.span_hashes(sums, anchor, anchor + SEED)
        whole = tv.mix(tv.span_hashes(sums, first, first + count + length - 1) + (anchor - first).astype(_U))
        yield from _dealt(name, whole, ids, h, (start << 14) | (count << 7) | (anchor - first))


def _first_ranks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs to repeats, as spans (doc, h, start, stop), and to the first of
    each of the different runs of one anchor, with stop null.

    Rows are a stream; of an anchor whose rows go on only the last row is kept,
    and its first run until a second shows that both are open.  Runs dealt by their
    own bytes are open in any case.
    """
    names = ["deal", "whole", "doc", "h", "place"]
    before: list[int | None] | None = None
    pending: list[int] | None = None

    def found(gone: list[np.ndarray], open_: list[np.ndarray]) -> pa.RecordBatch:
        start, count = gone[2] >> 14, (gone[2] >> 7) & 127
        columns = [np.append(gone[0], open_[0]), np.append(gone[1], open_[1]), np.append(start, open_[2])]
        stop = pa.concat_arrays([pa.array(start + count + length - 1, pa.int64()), pa.nulls(len(open_[0]), pa.int64())])
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], stop], names=["doc", "h", "start", "stop"])

    none = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        if not len(batch):
            continue
        inside = ~np.asarray(batch.column(1).is_null())
        deal, doc, h, place = (batch.column(k).to_numpy() for k in (0, 2, 3, 4))
        if not inside.all():
            yield found([x[~inside] for x in (doc, h, place)], none)
            batch = batch.filter(pa.array(inside))
            if not len(batch):
                continue
        deal, whole, doc, h, place = (batch.column(k).to_numpy() for k in range(5))
        if before is not None:
            deal, whole, doc, h, place = (np.append(b, x) for b, x in zip(before, (deal, whole, doc, h, place), strict=True))
        skip = int(before is not None)
        other = np.append(True, deal[1:] != deal[:-1])
        new = other | np.append(True, whole[1:] != whole[:-1])
        same = np.append(False, (doc[1:] == doc[:-1]) & (h[1:] == h[:-1]) & (place[1:] == place[:-1]))
        if skip:
            new[0] = other[0] = False
        gone = ~new & ~same
        gone[:skip] = False
        # A first run is open if another one of its anchor follows.
        firsts = np.flatnonzero(new)
        leads, known = other[firsts], (deal[firsts] & 1).astype(bool)
        followed = np.append(~leads[1:], False)
        open_ = firsts[~leads | followed | known]
        extra = none
        if pending is not None:
            if len(firsts) and not leads[0]:
                extra = [np.array([x], np.int64) for x in pending]
            if len(firsts):
                pending = None
        if len(firsts) and leads[-1] and not known[-1]:
            k = int(firsts[-1])
            pending = [int(doc[k]), int(h[k]), int(place[k])]
        before = [x[-1:] for x in (deal, whole, doc, h, place)]
        yield found([x[gone] for x in (doc, h, place)], [np.append(e, x[open_]) for e, x in zip(extra, (doc, h, place), strict=True)])


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Open runs of a document with their bytes."""
    for batch in batches:
        data, offsets = tv.buffers(batch.column(2))
        lists = batch.column(3)
        begin = lists.offsets.to_numpy()
        place = lists.values.to_numpy()[begin[0] : begin[-1]]
        owner = np.repeat(np.arange(len(batch)), np.diff(begin))
        docs, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for low in range(0, len(place), 20_000):
            own, p = owner[low : low + 20_000], place[low : low + 20_000]
            first, count = p >> 14, (p >> 7) & 127
            size = count + length - 1
            upto = np.append(0, np.cumsum(size))
            source = np.arange(upto[-1]) + np.repeat(offsets[own] + first - upto[:-1], size)
            text = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(data[source].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(docs[own]), pa.array(h[own]), pa.array(first), pa.array(count), pa.array(p & 127), text], names=["doc", "h", "run", "strings", "shift", "bytes"])


def _rank64(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks at length 64, from pairs of ranks at length 32."""
    rank = lambda p: tv.span_hashes(sums, p, p + SEED)
    return tv.mix(rank(at) * tv._GRAM[5] + rank(at + SEED) * tv._GRAM[6])


def _groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (deal, whole, doc, h, place) of groups of strings of the open runs, see
    ``_dealt``.

    Strings whose distance to the anchor falls into one class of GROUP distances
    have all but GROUP - 1 of their bytes in common; these are ranked by the pair of
    their first and last 64.
    """
    core = length - GROUP + 1
    for batch in batches:
        doc, h, run, strings, shift = (batch.column(k).to_numpy() for k in range(5))
        data, offsets = tv.buffers(batch.column(5))
        sums = tv.prefix_sums(data)
        lowest = shift - strings + 1
        count = shift // GROUP - lowest // GROUP + 1
        of = np.repeat(np.arange(len(run)), count)
        kind = shift[of] // GROUP - (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
        high, low = np.minimum(shift[of], kind * GROUP + GROUP - 1), np.maximum(lowest[of], kind * GROUP)
        n, skip = high - low + 1, shift[of] - high
        base = offsets[:-1][of]
        at = base + shift[of] - kind * GROUP
        name = tv.mix(_rank64(sums, at) * tv._GRAM[1] + _rank64(sums, at + core - 2 * SEED) * tv._GRAM[2] + kind.astype(_U))
        whole = tv.mix(tv.span_hashes(sums, base + skip, base + skip + n + length - 1) + high.astype(_U))
        yield from _dealt(name, whole, doc[of], h[of], ((run[of] + skip) << 14) | (n << 7) | skip)


def _positions(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every string of the open groups (doc, h, place, bytes of the run) as a
    position with its pair of ranks."""
    for batch in batches:
        doc, h, place = (batch.column(k).to_numpy() for k in range(3))
        data, offsets = tv.buffers(batch.column(3))
        sums = tv.prefix_sums(data)
        count, skip = (place >> 7) & 127, place & 127
        upto = np.append(0, np.cumsum(count))
        of = np.repeat(np.arange(len(count)), count)
        step = np.arange(upto[-1]) - upto[:-1][of]
        at = offsets[:-1][of] + skip[of] + step
        rank = lambda p: pa.array(_rank64(sums, p).view(np.int64))
        yield pa.RecordBatch.from_arrays([rank(at), rank(at + length - 2 * SEED), pa.array(doc[of]), pa.array(h[of]), pa.array((place[of] >> 14) + step)], names=["r1", "r2", "doc", "h", "start"])


def _place() -> Column:
    return F.struct("doc", "h", "start")


def repeated_spans(documents: DataFrame, *, length: int = 100) -> DataFrame:
    """Spans (doc, h, start, stop) of repeated strings, overlaps included.
    ``documents`` has columns doc and h (longs, not null) and text."""
    if not 2 * SEED + GROUP <= length <= 120:
        raise ValueError("strings of 74 to 120 bytes can be compared")
    named = documents.select("doc", "h", "text").mapInArrow(lambda b: _named_runs(b, length), "deal long, whole long, doc long, h long, place long")
    ordered = named.repartition("deal").sortWithinPartitions("deal", "whole", "doc", "h", "place")
    first = keep(ordered.mapInArrow(lambda b: _first_ranks(b, length), "doc long, h long, start long, stop long"), "run-ranks")
    release(documents.sparkSession)
    spans = "doc long, h long, start long, stop long"
    open_runs = first.where("stop IS NULL").groupBy("doc", "h").agg(F.collect_list("start").alias("runs"))
    texts = documents.select("doc", "h", "text").join(open_runs, ["doc", "h"]).select("doc", "h", "text", "runs")
    contexts = keep(texts.mapInArrow(lambda b: _contexts(b, length), "doc long, h long, run long, strings long, shift long, bytes binary"), "run-bytes")
    release(documents.sparkSession)
    grouped = contexts.mapInArrow(lambda b: _groups(b, length), "deal long, whole long, doc long, h long, place long")
    ordered = grouped.repartition("deal").sortWithinPartitions("deal", "whole", "doc", "h", "place")
    second = keep(ordered.mapInArrow(lambda b: _first_ranks(b, length), spans), "group-ranks")
    release(documents.sparkSession)
    open_groups = second.where("stop IS NULL").select("doc", "h", F.col("start").alias("place"), (F.shiftright("start", 14) - F.col("start").bitwiseAND(F.lit(127))).alias("run"))
    shared = open_groups.join(contexts.select("doc", "h", "run", "bytes"), ["doc", "h", "run"]).select("doc", "h", "place", "bytes")
    positions = keep(shared.mapInArrow(lambda b: _positions(b, length), "r1 long, r2 long, doc long, h long, start long"), "string-ranks")
    discard(contexts)
    names = positions.groupBy("r1", "r2").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first < last")
    earlier = keep(names.select("r1", "r2", "first"), "first-strings")
    later = positions.join(earlier, ["r1", "r2"]).where(_place() > F.col("first"))
    found = [rows.where("stop IS NOT NULL") for rows in (first, second)]
    return found[0].unionByName(found[1]).unionByName(later.select("doc", "h", "start", (F.col("start") + length).alias("stop")))


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, out = batch.column(1), ([], [], [], [], [])
        spans = batch.column(2)
        begin = spans.offsets.to_numpy()
        low, high = spans.values.field("start").to_numpy(), spans.values.field("stop").to_numpy()
        for k in range(len(batch)):
            raw = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
            a, b = (low[begin[k] : begin[k + 1]], high[begin[k] : begin[k + 1]]) if spans[k].is_valid else (low[:0], high[:0])
            removed = n_spans = 0
            if len(a):
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.append(True, a[1:] > b[:-1])
                a, b = a[new], b[np.append(np.flatnonzero(new)[1:], len(b)) - 1]
                removed, n_spans = int((b - a).sum()), len(a)
                kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
            else:
                kept = raw
            for column, value in zip(out, (len(raw), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                column.append(value)
        columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())]
        if with_text:
            columns.append(pa.array(out[4], pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])


def remove_repeats(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 100, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    and the remaining bytes as ``kept`` if asked for."""
    number = tv.long_id(documents, doc_id)
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    named = documents.select(number.alias("doc_id"), F.coalesce(number, F.lit(-(2**63)).cast("long")).alias("doc"), F.xxhash64(body).alias("h"), body.alias("text"))
    spans = repeated_spans(named, length=length)
    per_doc = spans.groupBy("doc", "h").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = named.join(per_doc, ["doc", "h"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(lambda b: _cut(b, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
