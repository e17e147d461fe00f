"""N-gram Jaccard join: documents whose shingle sets are similar enough.

A document is the set of its distinct word n-grams.  Documents with one set
are a class; everything below is between classes.  The join has four parts.

1. Stars.  Pairs of min-hashes of a set are keys; members of a key are compared
   with its first and its last class.  True links gather copies of one text into
   few components before anything quadratic could happen.
2. Tiles.  Two sets of similarity t or more share a token among the first
   n - ceil(t n) + 1 of each, in any common order (prefix filter).  Tokens are
   ordered by frequency level, from a count sketch of all tokens, then by hash,
   so what many documents share comes last.  Classes with a common prefix token
   form a tile; tiles with equal members are one.  A tile of over CELL members is
   dealt out as cells.  First each member is in one block, chosen by hash; what
   this links makes one component of most of the tile.  Then the largest
   component and the rest are cut into blocks, and each block of the rest meets
   every block.  The largest component does not meet itself, so its rows grow
   with the number of blocks of the rest.
3. Bitmaps.  Inside a cell, classes are sorted by size and compared band by band:
   sizes within the threshold, different components, and a bound on the overlap
   (n_x + n_y - d) / 2 from the d bits in which hashed bitmaps differ.  Bitmaps
   are as wide as a set is large; a wider one folds to a narrower.  What is left
   is a graph of possible links; each of its components is a subcell, named by
   its members, so equal subcells of many tokens are one.  Subcells that overlap
   are put together while they have few members.
4. Exact check.  The sorted arrays of a subcell's members go to one task, which
   intersects those of different components and gives the links that join two
   of them: fewer than it has members.  No table of pairs is written.

Every link between two components lies in some subcell, so none that could join
two components is left out, and copies of one text are not expanded into pairs.

The count sketch grows with the documents up to 4 million counts, the filter of
documents whose sets are needed with their number up to 16 MB; both only save
work and may be too small without changing a result.  A task holds one cell.

Defined results: null or empty text and text without words is an empty set,
linked with nothing; with fewer words than the n-gram has, the words are one
shingle.  Repeated rows are one class.  Different texts under one id are judged
each by its own set.  A null id is not linked and has no component.  Ids of other
than integer types are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchengine.durable import discard, keep
from matchengine.llm import textvec as tv
from matchengine.operators.components import components

#: Bitmap widths; a set has the least that is as large as itself, or the last.
WIDTHS = np.array([1 << 10, 1 << 12, 1 << 14, 1 << 16])
KEYS = 4
SKETCH_SLICE = 4096
#: Counts in the sketch: one for 16 documents, between these bounds.
SKETCH_SIZES = (1 << 18, 1 << 22)
#: Bits of the filter of documents: eight for each, between these bounds.
FILTER_SIZES = (1 << 20, 1 << 27)
#: Members of a tile or of a block that one task compares.
CELL = 128
#: Occurrences of a token from which its rows are spread over tasks.
HOT_TOKEN = 4096
_HASHES = tv._GRAM[:8]
_U = np.uint64
_LEVEL_SHIFT = _U(59)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each begins."""
    hashes, first = tv.words(data, offsets, tv.NON_SPACE)
    found, at = tv.grams(hashes, first, n)
    owner = np.searchsorted(first, at, "right") - 1
    count = np.diff(first)
    for k in range(1, n):
        docs = np.flatnonzero(count == k)
        if len(docs):
            part, place = tv.grams(hashes[(first[docs][:, None] + np.arange(k)).ravel()], np.arange(0, len(docs) * k + 1, k), k)
            found, owner = np.append(found, part), np.append(owner, docs[place // k])
    found &= (_U(1) << _LEVEL_SHIFT) - _U(1)
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.searchsorted(owner[new], np.arange(len(offsets)))


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    upto = np.append(_U(0), np.cumsum(values, dtype=_U))
    return upto[begin[1:]] - upto[begin[:-1]]


def _profile(batches: Iterator[pa.RecordBatch], n: int, places: int) -> Iterator[pa.RecordBatch]:
    """Size, set fingerprint, bitmap and min-hash keys of each document; and,
    as rows without a document, slices of this task's token counts."""
    sketch = np.zeros(places, np.int64)
    names = ["doc_id", "text_hash", "n_shingles", "f1", "f2", "bitmap", "keys", "slice", "counts"]
    lists = pa.list_(pa.int64())
    for part, data, offsets in tv.text_chunks(batches, 2, tv.CHUNK_BYTES // 2):
        sets, begin = shingles(data, offsets, n)
        sketch += np.bincount((tv.mix(sets) & _U(len(sketch) - 1)).astype(np.int64), minlength=len(sketch))
        size = np.diff(begin)
        some = np.flatnonzero(size)
        width = WIDTHS[np.minimum(np.searchsorted(WIDTHS, size), len(WIDTHS) - 1)]
        base = np.append(0, np.cumsum(width))
        bitmap = np.zeros(base[-1], bool)
        bitmap[np.repeat(base[:-1], size) + (tv.mix(sets ^ _HASHES[0]).astype(np.int64) & (np.repeat(width, size) - 1))] = True
        bitmap = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((base // 8).astype(np.int32).tobytes()), pa.py_buffer(np.packbits(bitmap).tobytes())])
        least = np.zeros((8, len(size)), _U)
        if len(some):
            for j in range(8):
                least[j, some] = np.minimum.reduceat(tv.mix(sets * _HASHES[j]), begin[some])
        keys = np.stack([tv.mix(least[2 * j] * _HASHES[1] + least[2 * j + 1] + _HASHES[j]) for j in range(KEYS)], axis=1)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * KEYS, pa.int32()), pa.array(keys.ravel().view(np.int64))).cast(lists)
        m = part.num_rows
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(_sums(tv.mix(sets), begin).view(np.int64)), pa.array(_sums(tv.mix(sets * _HASHES[7]), begin).view(np.int64)), bitmap, keys, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
            names=names,
        )
    if sketch.any():
        s = places // SKETCH_SLICE
        yield pa.RecordBatch.from_arrays([*[pa.nulls(s, pa.int64())] * 5, pa.nulls(s, pa.binary()), pa.nulls(s, lists), pa.array(np.arange(s), pa.int32()), pa.array([x.tobytes() for x in sketch.reshape(s, -1)], pa.binary())], names=names)


def _frequency_levels(slices: DataFrame, places: int, mean: float) -> np.ndarray:
    """Frequency level of each place of the sketch: 0 up to twice the mean."""

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH_SLICE, np.int64)
        for batch in rows:
            for x in batch.column(1):
                total += np.frombuffer(x.as_py(), np.int64)
        level = np.clip(np.floor(np.log2(np.maximum(total / mean, 1e-9))), 0, 15).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["slice", "levels"])

    # Tasks add up their own share first, so a slice meets few rows.
    levels = np.zeros((places // SKETCH_SLICE, SKETCH_SLICE), np.uint8)
    for row in slices.groupBy("slice").applyInArrow(add, "slice int, levels binary").collect():
        levels[row["slice"]] = np.frombuffer(bytes(row["levels"]), np.uint8)
    return levels.ravel()


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of n of which a similar set must share one."""
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def _prefix_rows(batches: Iterator[pa.RecordBatch], n: int, percent: int, levels: np.ndarray, hot_level: int) -> Iterator[pa.RecordBatch]:
    """Prefix tokens (deal, token, f1): dealt by token, but those of ``hot_level``
    by token and set."""
    for _, data, offsets in tv.text_chunks(batches, 0, tv.CHUNK_BYTES // 2):
        sets, begin = shingles(data, offsets, n)
        size = np.diff(begin)
        name = _sums(tv.mix(sets), begin).view(np.int64)
        # Exact copies in one chunk give the same rows; one of them is enough.
        copy = np.zeros(len(size), bool)
        copy[np.unique(name, return_index=True)[1]] = True
        level = levels[(tv.mix(sets) & _U(len(levels) - 1)).astype(np.int64)].astype(_U)
        token = (level << _LEVEL_SHIFT) | sets
        owner = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((token, owner))
        place = np.arange(len(sets)) - begin[owner]
        chosen = (place < prefix_size(size, percent)[owner]) & copy[owner]
        token, name = token[order][chosen], name[owner][chosen]
        deal = np.where(token >> _LEVEL_SHIFT >= _U(hot_level), tv.mix(token * _HASHES[6] + name.view(_U)), token)
        yield pa.RecordBatch.from_arrays([pa.array(deal.view(np.int64)), pa.array(token.view(np.int64)), pa.array(name)], names=["deal", "token", "f1"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows sorted by their first column, cut into whole runs of equal keys."""
    left: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        if not len(key):
            continue
        at = np.flatnonzero(key[1:] != key[:-1])
        if left and left[0].column(0)[0].as_py() == key[0] and not len(at):
            left.append(batch)
            continue
        cut = int(at[-1]) + 1 if len(at) else 0
        if left and not cut:
            yield pa.Table.from_batches(left)
            left = []
        elif cut:
            yield pa.Table.from_batches([*left, batch.slice(0, cut)])
            left = []
        left.append(batch.slice(cut))
    if left:
        yield pa.Table.from_batches(left)


def _tiles(batches: Iterator[pa.RecordBatch], hot_level: int) -> Iterator[pa.RecordBatch]:
    """Rows (tile, token, f1): tokens with two classes or more, tiles of the same
    members once a task; a hot token's rows without a tile, each set once."""
    seen = np.zeros(0, _U)
    for rows in _runs(batches):
        token, name = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
        token, name = token[new], name[new]
        begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        size = np.diff(np.append(begin, len(token)))
        hot = token[begin].view(_U) >> _LEVEL_SHIFT >= _U(hot_level)
        tile = np.add.reduceat(tv.mix(name.view(_U) * _HASHES[3]), begin) + size.astype(_U)
        _, once = np.unique(tile, return_index=True)
        good = np.zeros(len(begin), bool)
        good[once] = True
        good &= (size > 1) & ~hot & ~np.isin(tile, seen)
        seen = np.append(seen, tile[good])[-4_000_000:]
        good |= hot
        chosen = np.repeat(good, size)
        cold = pa.array(np.repeat(hot, size)[chosen])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(tile, size)[chosen].view(np.int64), mask=np.asarray(cold)), pa.array(token[chosen]), pa.array(name[chosen])], names=["tile", "token", "f1"])


def _narrow(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Members of a tile with a partner of another component and near size.

    Sorted by size, the nearest such partners of a member are the neighbours of
    the run of its component.
    """
    for rows in _runs(batches):
        tile, size, comp = (rows.column(k).to_numpy() for k in (0, 2, 3))
        begin = np.flatnonzero(np.append(True, (tile[1:] != tile[:-1]) | (comp[1:] != comp[:-1])))
        run = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(tile))))
        before, after = begin[run] - 1, np.append(begin[1:], len(tile))[run]
        near = np.zeros(len(tile), bool)
        k = np.flatnonzero(before >= 0)
        near[k] = (tile[before[k]] == tile[k]) & (100 * size[before[k]] >= percent * size[k])
        k = np.flatnonzero(after < len(tile))
        near[k] |= (tile[after[k]] == tile[k]) & (100 * size[k] >= percent * size[after[k]])
        yield from rows.filter(pa.array(near)).to_batches()


def _folded(bitmaps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of one width or wider ones, as rows of 64-bit words."""
    own = 8 * len(bitmaps[0])
    words = np.frombuffer(b"".join(bitmaps), np.uint64)
    return np.bitwise_or.reduce(words.reshape(len(bitmaps), own // width, width // 64), axis=1)


def _may_link(n1: np.ndarray, n2: np.ndarray, different: np.ndarray, percent: int) -> np.ndarray:
    """False where the bits that differ leave too small an overlap."""
    overlap = np.minimum((n1 + n2 - different) // 2, np.minimum(n1, n2))
    return 100 * overlap >= percent * (n1 + n2 - overlap)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each one's component in the graph of pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        nearer = label.copy()
        np.minimum.at(nearer, a, low)
        np.minimum.at(nearer, b, low)
        nearer = nearer[nearer]
        if (nearer == label).all():
            return label
        label = nearer


def _subcells(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Members of a cell that bitmaps and sizes leave a possible link between
    two components, by component of the graph of such links."""
    for rows in _runs(batches):
        cell, cid, size, comp = (rows.column(k).to_numpy() for k in (0, 1, 2, 3))
        bitmaps = rows.column(4).to_pylist()
        # Bands: one cell, one width; sizes ascend inside a cell.
        width = np.array([8 * len(x) for x in bitmaps])
        edge = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (width[1:] != width[:-1])))
        bands = list(zip(edge.tolist(), np.append(edge[1:], len(cell)).tolist(), strict=True))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (low, high) in enumerate(bands):
            step = max(1, min(256, (1 << 20) // int(width[low])))
            for block in range(low, high, step):
                mine = slice(block, min(block + step, high))
                bits, largest = _folded(bitmaps[mine], int(width[low])), size[mine][-1] * 100 // percent
                for start, stop in bands[k:]:
                    if cell[start] != cell[low] or size[start] > largest:
                        break
                    reach = start + int(np.searchsorted(size[start:stop], largest, "right"))
                    for other in range(max(start, block), reach, 4 * step):
                        theirs = slice(other, min(other + 4 * step, reach))
                        different = np.bitwise_count(bits[:, None, :] ^ _folded(bitmaps[theirs], int(width[low]))[None, :, :]).sum(axis=2, dtype=np.int64)
                        may = _may_link(size[mine][:, None], size[theirs][None, :], different, percent) & (comp[mine][:, None] != comp[theirs][None, :])
                        may &= np.arange(mine.start, mine.stop)[:, None] < np.arange(theirs.start, theirs.stop)[None, :]
                        a, b = np.nonzero(may)
                        left.append(a + mine.start)
                        right.append(b + theirs.start)
        a, b = np.concatenate(left), np.concatenate(right)
        if not len(a):
            continue
        label = _labels(len(cell), a, b)
        member = np.unique(np.append(a, b))
        member = member[np.lexsort((cid[member], label[member]))]
        begin = np.flatnonzero(np.append(True, label[member][1:] != label[member][:-1]))
        count = np.diff(np.append(begin, len(member)))
        name = tv.mix(np.add.reduceat(tv.mix(cid[member].view(_U) * _HASHES[4] + _HASHES[5]), begin) + count.astype(_U))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, count).view(np.int64)), pa.array(cid[member]), pa.array(comp[member])], names=["cell", "cid", "comp"])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted arrays, all with all."""
    merged, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(merged, kind="stable")
    merged, owner = merged[order], owner[order]
    new = np.append(True, merged[1:] != merged[:-1])
    # What only one has is in no intersection.
    count = np.diff(np.append(np.flatnonzero(new), len(merged)))
    shared = np.repeat(count > 1, count)
    column, owner = np.cumsum(new[shared]) - 1, owner[shared]
    out = np.zeros((len(sets), len(sets)), np.int64)
    step = 1 << 14
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        s = slice(*np.searchsorted(column, [low, low + step]))
        has = np.zeros((len(sets), step), np.float32)
        has[owner[s], column[s] - low] = 1
        out += (has @ has.T).astype(np.int64)
    return out


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of components, by exact intersection: a forest of each cell."""
    for rows in _runs(batches):
        cell, comp = rows.column(0).to_numpy(), rows.column(2).to_numpy()
        edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        left, right = [], []
        for low, high in zip(edge.tolist(), np.append(edge[1:], len(cell)).tolist(), strict=True):
            raw, offsets = tv.buffers(rows.column(3).slice(low, high - low))
            at = offsets.tolist()
            sets = [np.frombuffer(raw[x:y].tobytes(), _U) for x, y in zip(at, at[1:], strict=False)]
            size, mine = np.diff(offsets) // 8, comp[low:high]
            both = _overlaps(sets)
            link = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (mine[:, None] != mine[None, :])
            a, b = np.nonzero(np.triu(link))
            top: dict[int, int] = {}

            def find(x: int, top: dict[int, int] = top) -> int:
                while (up := top.get(x, x)) != x:
                    top[x] = top.get(up, up)
                    x = up
                return x

            for x, y in zip(mine[a].tolist(), mine[b].tolist(), strict=True):
                if (x := find(x)) != (y := find(y)):
                    top[max(x, y)] = min(x, y)
                    left.append(x)
                    right.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _between(number: int, sizes: tuple[int, int]) -> int:
    """The power of two from ``number`` on, between two sizes."""
    return min(max(1 << max(number - 1, 0).bit_length(), sizes[0]), sizes[1])


def _document_filter(rows: DataFrame) -> np.ndarray:
    """A bitmap with the hashes of all (doc_id, text_hash) of ``rows``."""
    places = _between(8 * rows.count(), FILTER_SIZES)
    size = 4096
    whole = np.zeros((places // (8 * size), size), np.uint8)
    slot = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(places))
    parts = rows.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / (8 * size)).alias("bucket")).agg(F.bitmap_construct_agg((F.col("slot") % (8 * size)).cast("long")).alias("bits"))
    for row in parts.collect():
        whole[row["bucket"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return whole.ravel()


def class_sets(documents: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """Sorted arrays (cid, tokens) of ``classes`` (cid, doc_id, text_hash,
    n_shingles, f1, f2), from the text of the one row each of them names."""
    spark = documents.sparkSession
    bits = _document_filter(classes)
    places, wanted = 8 * len(bits), spark.sparkContext.broadcast(bits.tobytes())
    rows = documents.select(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(places)).alias("slot"), "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            slot = batch.column(0).to_numpy()
            batch = batch.filter(pa.array((bits[slot // 8] >> (slot % 8).astype(np.uint8) & 1).astype(bool)))
            for part, data, offsets in tv.text_chunks(iter([batch]), 1, tv.CHUNK_BYTES // 2):
                found, begin = shingles(data, offsets, n)
                name = [pa.array(_sums(tv.mix(found * f), begin).view(np.int64)) for f in (_U(1), _HASHES[7])]
                tokens = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((8 * begin).astype(np.int32).tobytes()), pa.py_buffer(found.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(begin)), *name, tokens], names=["n_shingles", "f1", "f2", "tokens"])

    found = rows.mapInArrow(sets, "n_shingles long, f1 long, f2 long, tokens binary").join(classes.select("cid", "n_shingles", "f1", "f2"), ["n_shingles", "f1", "f2"])
    # A row may be given twice, and the filter lets other rows through.
    return keep(found.groupBy("cid").agg(F.first("tokens").alias("tokens")), "sets")


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links by exact intersection."""
    of = lambda c, t: sets.select(F.col("cid").alias(c), F.col("tokens").alias(t))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(links, "a long, b long")


def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n1, n2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        different = np.zeros(len(n1), np.int64)
        for k, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
            width = 8 * min(len(x), len(y))
            different[k] = np.bitwise_count(_folded([x], width) ^ _folded([y], width)).sum()
        yield batch.select(["a", "b"]).filter(pa.array(_may_link(n1, n2, different, percent)))


def _stars(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a class with the first and the last of each of its keys
    whose bitmaps and sizes leave a link possible."""
    member = classes.select("cid", F.explode("keys").alias("key"))
    ends = member.groupBy("key").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low < high")
    hub = keep(ends.select("key", F.explode(F.array("low", "high")).alias("hub")), "hubs")
    pairs = member.join(hub, "key").where("cid <> hub").select(F.least("hub", "cid").alias("a"), F.greatest("hub", "cid").alias("b")).distinct()
    of = lambda c, s: classes.select(F.col("cid").alias(c), F.col("n_shingles").alias(f"n{s}"), F.col("bitmap").alias(f"m{s}"))
    joined = pairs.join(of("a", 1), "a").join(of("b", 2), "b").select("a", "b", "n1", "n2", "m1", "m2")
    found = keep(joined.mapInArrow(lambda batches: _bounded(batches, percent), "a long, b long"), "pairs")
    discard(hub)
    return found


def _token_tiles(tokens: DataFrame, hot_level: int) -> tuple[DataFrame, DataFrame]:
    """Tiles (tile, f1) of tokens (deal, token, f1), and the table they read.  Rows of tokens are read as
    sorted runs; those of a token that the sketch calls frequent are dealt by
    their sets too, so the token is summed up and joined instead."""
    dealt = tokens.repartition("deal").sortWithinPartitions("deal", "token", "f1")
    found = keep(dealt.mapInArrow(lambda b: _tiles(b, hot_level), "tile long, token long, f1 long"), "tiles")
    often = found.where("tile IS NULL").select("token", "f1").distinct()
    many = often.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("f1").cast("decimal(38,0)")).alias("sum")).where("n > 1")
    hot = often.join(many.select("token", F.xxhash64("n", "sum").alias("tile")), "token").select("tile", "f1")
    return found.where("tile IS NOT NULL").select("tile", "f1").unionByName(hot).distinct(), found


def _large_tiles(members: DataFrame) -> DataFrame:
    """Tiles of over CELL members: their number, largest component and its number."""
    per = members.groupBy("tile", "comp").agg(F.count("*").alias("n"))
    per = per.groupBy("tile").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("big"))
    return keep(per.where(F.col("n") > CELL).select("tile", "n", F.col("big.n").alias("n_big"), F.col("big.comp").alias("big")), "large-tiles")


def _blocks(n: Column) -> Column:
    return F.ceil(n / CELL).cast("int")


def _block(blocks: Column) -> Column:
    """The block of a member, of so many of its tile."""
    return F.pmod(F.xxhash64("cid", "tile"), blocks).cast("int")


def _own_blocks(members: DataFrame, large: DataFrame) -> DataFrame:
    """Members (cell, cid, n_shingles, comp) of large tiles, each in one block."""
    dealt = members.join(large.where("n > n_big").select("tile", "n"), "tile")
    return dealt.select(F.xxhash64("tile", F.lit("own"), _block(_blocks(F.col("n")))).alias("cell"), "cid", "n_shingles", "comp")


def _cells(members: DataFrame, large: DataFrame) -> DataFrame:
    """Members (tile, cid, n_shingles, comp) dealt out as (cell, ...), so that any
    two of one tile and different components meet in a cell."""
    dealt = members.join(large, "tile", "left").withColumn("of_big", _blocks(F.col("n_big"))).withColumn("of_rest", _blocks(F.col("n") - F.col("n_big")))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    name = lambda kind, i, j: F.xxhash64("tile", F.lit(kind), i, j)
    big, rest = _block(F.col("of_big")), _block(F.col("of_rest"))
    in_big = F.transform(upto("of_rest"), lambda j: name("big", big, j))
    in_rest = F.concat(F.transform(upto("of_big"), lambda i: name("big", i, rest)), F.transform(upto("of_rest"), lambda j: name("rest", F.least(j, rest), F.greatest(j, rest))))
    cells = F.when(F.col("big").isNull(), F.array("tile")).when(F.col("comp") == F.col("big"), in_big).otherwise(in_rest)
    return dealt.select(F.explode(cells).alias("cell"), "cid", "n_shingles", "comp")


def _merged_subcells(subcells: DataFrame) -> DataFrame:
    """Subcells (cell, cid, comp) that overlap, as one where they have few members.

    Many tokens give a group of similar texts nearly equal subcells.  Where all
    that hangs together has at most two cells' members, one cell holds them all.
    """
    first = subcells.groupBy("cell").agg(F.min("cid").alias("a"))
    edges = subcells.join(first, "cell").select("a", F.col("cid").alias("b")).where("a <> b").distinct()
    found = components(edges)
    tops = found.select(F.col("vertex").alias("cid"), F.col("component").alias("top"))
    few = tops.groupBy("top").agg(F.count("*").alias("n")).where(F.col("n") <= 2 * CELL).select("top", F.lit(True).alias("few"))
    named = subcells.join(tops.join(few, "top", "left"), "cid")
    cells = keep(named.select(F.when(F.col("few"), F.col("top")).otherwise(F.col("cell")).alias("cell"), "cid", "comp").distinct(), "verified-cells")
    discard(found)
    return cells


def _row_components(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text_hash, text)."""
    spark = documents.sparkSession
    places = _between(documents.count() // 16, SKETCH_SIZES)
    sizes = "doc_id long, text_hash long, n_shingles long, f1 long, f2 long, bitmap binary, keys array<long>, slice int, counts binary"
    profile = keep(documents.select("doc_id", "text_hash", "text").mapInArrow(lambda b: _profile(b, n, places), sizes), "profiles")
    known = profile.where("slice IS NULL").drop("slice", "counts")
    mean = max((known.agg(F.sum("n_shingles")).first()[0] or 0) / places, 8.0)
    levels = spark.sparkContext.broadcast(_frequency_levels(profile.where("slice IS NOT NULL").select("slice", "counts"), places, mean))

    named = known.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("n_shingles", "f1", "f2")
    classes = named.agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("bitmap").alias("bitmap"), F.first("keys").alias("keys"))
    classes = keep(classes.select(F.monotonically_increasing_id().alias("cid"), "rep.*", "n_shingles", "f1", "f2", "bitmap", "keys"), "classes")
    names = classes.select("cid", "doc_id", "text_hash", "n_shingles", "f1", "f2")

    def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels (cid, comp) after links (a, b) between components."""
        found = components(links)
        tops = found.select(F.col("vertex").alias("comp"), F.col("component").alias("top"))
        after = keep(labels.join(tops, "comp", "left").select("cid", F.coalesce("top", "comp").alias("comp")), "components")
        discard(links, found, labels)
        return after

    def links_in(cells: DataFrame) -> DataFrame:
        """Links (a, b) of components inside cells; ``sets`` grows by what they need."""
        dealt = cells.repartition("cell").sortWithinPartitions("cell", "n_shingles", "cid")
        open_cells = keep(dealt.mapInArrow(lambda b: _narrow(b, percent), "cell long, cid long, n_shingles long, comp long"), "open-cells")
        near = open_cells.join(classes.select("cid", "bitmap"), "cid").select("cell", "cid", "n_shingles", "comp", "bitmap").repartition("cell").sortWithinPartitions("cell", "n_shingles", "cid")
        each = keep(near.mapInArrow(lambda b: _subcells(b, percent), "cell long, cid long, comp long").distinct(), "subcells")
        subcells = _merged_subcells(each)
        discard(open_cells, each)
        known_sets = reduce(DataFrame.unionByName, sets)
        more = subcells.select("cid").distinct().join(known_sets, "cid", "left_anti")
        sets.append(class_sets(documents, names.join(more, "cid", "left_semi"), n))
        full = subcells.join(reduce(DataFrame.unionByName, sets), "cid").select("cell", "cid", "comp", "tokens").repartition("cell").sortWithinPartitions("cell", "cid")
        links = keep(full.mapInArrow(lambda b: _verify(b, percent), "a long, b long").distinct(), "links")
        discard(subcells)
        return links

    pairs = _stars(classes, percent)
    in_stars = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    sets = [class_sets(documents, names.join(in_stars, "cid", "left_semi"), n)]
    labels = merged(classes.select("cid", F.col("cid").alias("comp")), keep(_checked(pairs, sets[0], percent), "links"))
    discard(pairs)

    hot_level = max(1, int(np.ceil(np.log2(HOT_TOKEN / mean))))
    tokens = documents.select("text").mapInArrow(lambda b: _prefix_rows(b, n, percent, levels.value, hot_level), "deal long, token long, f1 long")
    tiles, source = _token_tiles(tokens, hot_level)
    members = keep(tiles.join(classes.select("f1", "cid", "n_shingles"), "f1").select("tile", "cid", "n_shingles").join(labels, "cid"), "tile-members")
    discard(source)
    large = _large_tiles(members)
    if large.where("n > n_big").take(1):
        # What one block each shows makes one component of most of a large tile.
        labels = merged(labels, links_in(_own_blocks(members, large)))
        before, members = members, keep(members.drop("comp").join(labels, "cid"), "tile-members")
        discard(before, large)
        large = _large_tiles(members)
    last = merged(labels, links_in(_cells(members, large)))
    labels = last.join(names, "cid")

    least = labels.groupBy("comp").agg(F.min("doc_id").alias("least"))
    of = labels.join(least, "comp").select(F.col("n_shingles").alias("cn"), F.col("f1").alias("c1"), F.col("f2").alias("c2"), "least")
    same = (F.col("n_shingles") == F.col("cn")) & (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2"))
    of = keep(of, "class-names")
    discard(members, large, last, classes, *sets)
    return known.join(of, same, "left").select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def _named(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(tv.long_id(documents, doc_id).alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text"))


def link_components(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return _row_components(_named(documents, doc_id, text), n, percent).drop("text_hash")


def keep_one_each(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """``documents`` with the smallest document of each component only, columns
    unchanged.  Repeated rows of that document stay as they are given; of
    different texts under one id, each goes or stays by its own component."""
    found = _row_components(_named(documents, doc_id, text), n, percent)
    gone = keep(found.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__gone_text")).distinct(), "near-copies")
    same = (tv.long_id(documents, doc_id) == F.col("__gone")) & (F.xxhash64(F.col(f"`{text}`")) == F.col("__gone_text"))
    return documents.join(gone, same, "left_anti")
