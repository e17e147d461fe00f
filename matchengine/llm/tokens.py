"""Exact tokenisation of whole texts through a cache of text segments.

Both vocabularies split a text into pieces before merging, and never merge
across pieces.  A text can therefore be cut wherever a piece surely ends (at a
single blank or line feed between other characters, and between an ASCII letter
and ASCII punctuation), each distinct segment be encoded by the tokenizers
library once, and the ids of a text be put together from those of its segments.
Where a cut would not be sure (runs of white space, characters that may be
non-ASCII white space, apostrophes) none is made.

``EncoderCache`` lives as long as its Python worker and holds ``MAX_SEGMENTS``
segments at most; beyond that it starts anew, which only costs time.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd

from matchengine.llm import textvec as tv

MAX_SEGMENTS = 3_000_000
#: Bits of a byte: letter 1, punctuation 2, blank or line feed 4, white space 8.
_KIND = np.array([sum(bit * bool(t) for bit, t in zip((1, 2, 4, 8), row, strict=True)) for row in zip(tv.byte_class((0x41, 0x5A), (0x61, 0x7A)), tv.byte_class((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)), tv.byte_class((0x20, 0x20), (0x0A, 0x0A)), ~tv.NON_SPACE, strict=True)], np.uint8)
#: Bytes that may lead a non-ASCII white space; bytes that surely end or open a
#: character that is none (a multi-byte one ends surely by its lead).
_LEADS = tv.byte_class((0xC2, 0xC2), (0xE1, 0xE3))
_ENDS = tv.NON_SPACE & ~tv.byte_class((0x1C, 0x1F))
_OPENS = _ENDS & ~_LEADS
#: A character of its own piece that parts segments where blanks are dropped.
_MARK = "\x01"
_caches: dict[str, EncoderCache] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> EncoderCache:
    """This process's cache for one tokenizer file."""
    if path not in _caches:
        _caches[path] = EncoderCache(path)
    return _caches[path]


class EncoderCache:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: Blanks open a piece of the byte vocabulary; the word vocabulary drops
        #: them between pieces and is lower case.
        self.keeps_space = spec.get("normalizer") is None
        if self.keeps_space:
            vocabulary = self.tokenizer.get_vocab()
            self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.token_bytes[i] = len(token)
        else:
            (self.mark,) = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        #: For each key, in order: where its ids begin in the pool, how many.
        self.begin, self.size, self.used = np.zeros(0, np.int32), np.zeros(0, np.int32), 0
        self.pool = np.zeros(1 << 16, np.uint32)

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        cut = np.zeros(n + 1, bool)
        kind = _KIND[data]
        np.not_equal((kind[:-1] << 1) & kind[1:] & 2, 0, out=cut[1:n])
        cut[offsets] = True
        if self.keeps_space:
            at = np.flatnonzero(kind & 4)
            at = at[(at >= 3) & (at < n - 1)]
            before = data[at - 1]
            sure = _ENDS[before] & _OPENS[data[at + 1]]
            wide = np.flatnonzero(before >= 0x80)
            sure[wide] &= ~(_LEADS[data[at[wide] - 2]] | _LEADS[data[at[wide] - 3]])
            at = at[sure]
            cut[at] = True
            cut[at[data[at] == 0x0A] + 1] = True
            starts = np.flatnonzero(cut[:n])
            return starts, np.append(starts[1:], n)[: len(starts)], np.searchsorted(starts, offsets)
        space = kind >= 8
        cut[1:n] |= space[1:] != space[:-1]
        starts = np.flatnonzero(cut[:n])
        ends = np.append(starts[1:], n)[: len(starts)]
        inside = ~space[starts]
        starts, ends = starts[inside], ends[inside]
        return starts, ends, np.searchsorted(starts, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and where each begins (n + 1)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        data = data if self.keeps_space else tv.LOWER[data]
        starts, ends, first = self._segments(data, offsets)
        codes, keys = pd.factorize(tv.span_hashes(tv.prefix_sums(data), starts, ends))
        if len(self.keys) + len(keys) > MAX_SEGMENTS:
            self._clear()
        order = np.argsort(keys)
        ranked = keys[order]
        near = np.searchsorted(self.keys, ranked)
        known = np.zeros(len(keys), bool)
        inner = near < len(self.keys)
        known[inner] = self.keys[near[inner]] == ranked[inner]
        if not known.all():
            example = np.empty(len(keys), np.int64)
            example[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            fresh = example[order[~known]]
            self._learn(data, ranked[~known], starts[fresh], ends[fresh])
            near = np.searchsorted(self.keys, ranked)
        slot = np.empty(len(keys), np.int64)
        slot[order] = near
        slot = slot[codes]
        size = self.size[slot]
        upto = np.append(0, np.cumsum(size, dtype=np.int64))
        ids = self.pool[np.arange(upto[-1]) + np.repeat(self.begin[slot] - upto[:-1], size)]
        return ids, upto[first]

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        new, size = self._encode_all(texts, ends - starts)
        total = int(size.sum())
        while self.used + total > len(self.pool):
            self.pool = np.append(self.pool, np.zeros(len(self.pool), np.uint32))
        self.pool[self.used : self.used + total] = new
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.begin = np.insert(self.begin, at, (self.used + np.append(0, np.cumsum(size))[:-1]).astype(np.int32))
        self.size = np.insert(self.size, at, size.astype(np.int32))
        self.used += total

    def _encode_all(self, texts: list[str], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments (of ``length`` bytes) one after another, and how
        many each has.

        Most segments go to the library as one text, parted so that none can
        join its neighbour; the rest are encoded one by one.
        """
        if self.keeps_space:
            plain = np.array([not t[-1].isspace() and (not t[0].isspace() or (t[0] == " " and len(t) > 1 and not t[1].isspace())) for t in texts], bool)
        else:
            plain = np.array([_MARK not in t for t in texts], bool)
        joined, alone = np.flatnonzero(plain), np.flatnonzero(~plain)
        size = np.zeros(len(texts), np.int64)
        flat = low = high = np.zeros(0, np.int64)
        if len(joined):
            some = texts if not len(alone) else [texts[k] for k in joined.tolist()]
            text = "\nx" + "".join([t if t[0] == " " else "\n" + t for t in some]) if self.keeps_space else f" {_MARK} ".join(some)
            (encoded,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            flat = np.array(encoded.ids, np.uint32)
            if self.keeps_space:
                bare = np.fromiter((t[0] != " " for t in some), np.int64, len(some))
                stop = 2 + np.cumsum(length[joined] + bare)
                start = stop - length[joined]
                at = np.append(0, np.cumsum(self.token_bytes[flat]))
                low, high = np.searchsorted(at, start), np.searchsorted(at, stop)
                assert (at[low] == start).all() and (at[high] == stop).all()
            else:
                marks = np.flatnonzero(flat == self.mark)
                low, high = np.append(0, marks + 1), np.append(marks, len(flat))
                assert len(low) == len(joined)
            size[joined] = high - low
        single = [e.ids for e in self.tokenizer.encode_batch_fast([texts[k] for k in alone.tolist()], add_special_tokens=False)]
        size[alone] = [len(x) for x in single]
        begin = np.append(0, np.cumsum(size))
        ids = np.zeros(begin[-1], np.uint32)
        count = size[joined]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        ids[step + np.repeat(begin[:-1][joined], count)] = flat[step + np.repeat(low, count)]
        for k, x in zip(alone.tolist(), single, strict=True):
            ids[begin[k] : begin[k + 1]] = x
        return ids, size


def with_end(ids: np.ndarray, begin: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    n = len(begin) - 1
    out = np.empty(len(ids) + n, np.uint32)
    for k, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        out[a + k : b + k] = ids[a:b]
        out[b + k] = end_id
    return out, begin + np.arange(n + 1)
