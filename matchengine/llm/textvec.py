"""Byte-level vector operations on Arrow string columns.

An Arrow string array already holds its texts as one UTF-8 buffer with
offsets.  The helpers below read that buffer as a numpy array and find words,
hash spans and hash word n-grams for a whole batch at once, so no Python code
runs per word.  Work is cut into chunks of a few MB of text (always of whole
documents), which bounds a worker's memory by ``CHUNK_BYTES`` or by the longest
single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 2 << 20
_SEED = 0x5EED0FB17E5
_rng = np.random.default_rng(_SEED)
#: Random odd 64-bit value of each byte, base of the polynomial and the
#: multipliers of word n-grams.  They only have to agree inside one job.
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Powers of the base and of its inverse modulo 2^64.
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def long_id(documents: DataFrame, name: str) -> Column:
    """Column ``name`` as a long; ids of other than integer types are an error."""
    if not isinstance(kind := documents.schema[name].dataType, T.IntegralType):
        raise TypeError(f"{name} must be of an integer type, is {kind.simpleString()}")
    return F.col(f"`{name}`").cast("long")


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of 256 entries, true inside the given closed ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words ``[^\x20\x09-\x0D]+``.
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together, one at least."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        high = min(high, low + 65_536, n)
        yield low, high
        low = high


def text_chunks(batches: Iterator[pa.RecordBatch], text: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes and offsets of column ``text``."""
    for batch in batches:
        data, offsets = buffers(batch.column(text))
        for low, high in chunks(offsets, limit):
            part = offsets[low : high + 1]
            yield batch.slice(low, high - low), data[part[0] : part[-1]], part - part[0]


def powers(n: int, sign: int = 1) -> np.ndarray:
    if len(_powers[sign]) < n:
        base = np.uint64(pow(int(_BASE), sign, 1 << 64))
        _powers[sign] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, CHUNK_BYTES + 4096) - 1, base)]), dtype=np.uint64)
    return _powers[sign]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any span of ``data`` in constant time."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers(len(data))[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span [start, end): equal bytes, equal hash."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), -1)[starts] + (ends - starts).astype(np.uint64) * _GRAM[63])


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of class ``inside`` that stay in one document.

    Returns starts, ends and, for each document, the number of its first run
    (n + 1 entries).
    """
    hit = inside[data]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first, last = hit.copy(), hit.copy()
    first[1:] &= ~hit[:-1]
    last[:-1] &= ~hit[1:]
    first[edge] = hit[edge]
    stop = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[stop] = hit[stop]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and each document's first word (n + 1 entries)."""
    folded = LOWER[data] if lower else data
    starts, ends, first = spans(folded, offsets, inside)
    return span_hashes(prefix_sums(folded), starts, ends), first


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each place where k words of the document remain.

    Returns the hashes and their places (indices into ``hashes``).
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = hashes[:n] * _GRAM[0]
    for j in range(1, k):
        total += hashes[j : j + n] * _GRAM[j]
    owner_end = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + k <= owner_end)
    return mix(total[at] + np.uint64(k)), at


def owners(first: np.ndarray) -> np.ndarray:
    """Document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
