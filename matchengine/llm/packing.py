"""Harmonic packing of token sequences, worker by worker.

A document (its ids and an end id) is cut into pieces; pieces are put into
sequences of at most ``capacity`` tokens.  Lengths fall into reciprocal-capacity
classes: class j holds lengths in (capacity / (j + 1), capacity / j], of which
every bin takes exactly j.  As cutting is free, a document's length is first
cut at class bounds of full use: whole capacities, then capacity / 2,
capacity / 4 and so on down to ``tail``, whose bins hold exactly 2, 4, ...
pieces without padding.  Only the rest below ``tail`` is packed by its own
length, with a bin's padding under 1 / (j + 1) of the capacity.

Each worker fills its classes' bins alone, so nothing is shuffled.  What its
open bins hold at the end is packed once more into common sequences, cut where
one is full; the last is cut at powers of two, which need no padding.

Defined results: null and empty texts are documents of the end id alone;
repeated rows are packed as documents of their own; an empty table gives no
pieces.  A sequence id is the worker's partition number times 2^32 plus a count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchengine.llm import textvec as tv
from matchengine.llm import tokens as tk


def cuts(length: int, capacity: int, tail: int) -> list[int]:
    """Piece lengths of one document, largest first."""
    out = [capacity] * (length // capacity)
    rest, size = length % capacity, capacity // 2
    while size >= tail and rest:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class HarmonicBins:
    """Open bins of one worker.  A piece is a row (document, start, length);
    ``placed`` gets it with its sequence and offset."""

    def __init__(self, capacity: int, tail: int, first_sequence: int):
        if capacity & (capacity - 1) or tail & (tail - 1) or not 0 < tail <= capacity:
            raise ValueError("capacity and tail must be powers of two, tail the smaller")
        self.capacity, self.tail, self.next = capacity, tail, first_sequence
        self.open: dict[int, list[tuple]] = {}
        self.placed: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.placed.append((*piece, self.next, offset))
            offset += piece[2]
        self.next += 1

    def add(self, document: object, length: int) -> None:
        start = 0
        for size in cuts(length, self.capacity, self.tail):
            piece, start = (document, start, size), start + size
            count = self.capacity // size
            if count == 1:
                self._emit([piece])
                continue
            pieces = self.open.setdefault(count, [])
            pieces.append(piece)
            if len(pieces) == count:
                self._emit(pieces)
                self.open[count] = []

    def close(self) -> None:
        left = [p for count in sorted(self.open) for p in self.open[count]]
        total = sum(p[2] for p in left)
        self.open = {}
        room = [self.capacity] * (total // self.capacity) + [1 << b for b in range(self.capacity.bit_length(), -1, -1) if (total % self.capacity) >> b & 1]
        k = 0
        for size in room:
            pieces, free = [], size
            while free:
                document, start, length = left[k]
                taken = min(free, length)
                pieces.append((document, start, taken))
                free -= taken
                if taken == length:
                    k += 1
                else:
                    left[k] = (document, start + taken, length - taken)
            self._emit(pieces)


def pack_documents(documents: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = 2048, tail: int = 64, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and ``ids`` (little-endian 32-bit) if asked for.

    The pieces held back in open bins are at most one bin a class, so a worker
    keeps a bounded number of ids.
    """
    source = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tk.encoder(tokenizer)
        bins = HarmonicBins(capacity, tail, TaskContext.get().partitionId() << 32)
        held: dict[int, tuple[object, int, memoryview]] = {}
        number = 0
        for part, data, offsets in tv.text_chunks(batches, 1, tv.CHUNK_BYTES // 2):
            ids, begin = tk.with_end(*encoder.encode(data, offsets), end_id)
            raw, begin = memoryview(ids.astype("<u4").tobytes()), begin.tolist()
            for k, name in enumerate(part.column(0).to_pylist()):
                held[number] = (name, begin[k + 1] - begin[k], raw[4 * begin[k] : 4 * begin[k + 1]])
                bins.add(number, begin[k + 1] - begin[k])
                number += 1
            yield rows(bins, held)
            # Ids of open pieces are copied, so that no whole chunk stays alive.
            waiting = {p[0] for pieces in bins.open.values() for p in pieces}
            held = {d: (*held[d][:2], memoryview(bytes(held[d][2])) if held[d][2].nbytes * 8 < held[d][2].obj.__len__() else held[d][2]) for d in waiting}
        bins.close()
        if bins.placed:
            yield rows(bins, held)

    def rows(bins: HarmonicBins, held: dict) -> pa.RecordBatch:
        placed, bins.placed = bins.placed, []
        ids = [held[d][2][4 * s : 4 * (s + n)] for d, s, n, _, _ in placed]
        columns = [
            pa.array([held[p[0]][0] for p in placed], source_type(kind)),
            *[pa.array([p[k] for p in placed], pa.int64()) for k in (1, 2)],
            pa.array([zlib.crc32(x) for x in ids], pa.int64()),
            pa.array([held[p[0]][1] for p in placed], pa.int64()),
            *[pa.array([p[k] for p in placed], pa.int64()) for k in (3, 4)],
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns.append(pa.array([bytes(x) for x in ids], pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(pack, schema)


def source_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}[kind]
