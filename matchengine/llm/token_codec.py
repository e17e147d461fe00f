"""Adaptive range coder for token ids, many blocks at a time.

A block is a run of at most ``BLOCK_TOKENS`` ids that is coded on its own: model
and coder start afresh, and checksums of its ids and of its payload are kept
with it, so a block can be read, checked or lost without the others.  The blocks
of a stripe are the lanes of numpy vectors: each step codes one id of every
block.

Three models predict the next id.  Order 2 holds, for a hash of the last two
ids, the id that followed last in the block and a confidence; order 1 the id
that follows the last id most often in the stripe, with its share; order 0 the
shares of all ids in the stripe.  The tables of orders 0 and 1 stand once in the
stripe's header, so that a block starts with what the stripe knows; there are as
many bytes of them as pay off.  The mix adapts inside a block: each of orders 1
and 2 has a weight that moves with how far its probabilities hold there, equal
predictions pool their probabilities, different ones share what is left in turn,
and the rest is an escape to order 0.  All arithmetic is on integers, so any
machine decodes what another coded.  Ids are coded by their rank among the ids
of the stripe, so any 32-bit ids can be coded.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_TOKENS = 2048
STRIPE_BLOCKS = 2048
MAGIC = b"MTK3"
_ONE, _MOST = 1 << 12, 7 << 9
_SLOTS = 512
#: Probability (of 4096) of a prediction of order 2 by its confidence.
_TRUSTED = np.array([0, 700, 1700, 2400, 2800, 3100, 3300, 3500], np.int32)
#: A follower is kept if it was seen that often and has that share (of 4096).
_LEAST_SEEN, _LEAST_SHARE = 4, 200
_U = np.uint64
_FULL = _U(1 << 48)


class _Tables:
    """What a stripe's header says of its ids: the sorted distinct ids, the place
    of each one's share of order 0, and the follower of each with its share."""

    def __init__(self, alphabet: np.ndarray, shares: np.ndarray, follower: np.ndarray, p1: np.ndarray):
        self.alphabet, self.shares = alphabet, shares
        self.follower, self.p1 = follower, p1
        self.upto = np.append(0, np.cumsum(shares, dtype=np.int64))
        self.total_bits = int(self.upto[-1]).bit_length() - 1
        self.start = self.upto[:-1].astype(_U)
        self.size = shares.astype(_U)

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[_Tables, np.ndarray]:
        """The tables of ``ids``, and the ids as ranks."""
        top = int(ids.max()) if len(ids) else 0
        if top < 1 << 22:
            counts = np.bincount(ids, minlength=1)
            alphabet = np.flatnonzero(counts)
            rank = np.zeros(top + 1, np.int32)
            rank[alphabet] = np.arange(len(alphabet))
            ranks, counts = rank[ids], counts[alphabet]
        else:
            alphabet, ranks, counts = np.unique(ids, return_inverse=True, return_counts=True)
        ranks = ranks.astype(np.int32)
        n = len(alphabet)
        follower, p1 = np.zeros(n, np.int32), np.zeros(n, np.int32)
        if len(ids) > 1:
            key = ranks[:-1].astype(np.uint64) * _U(n) + ranks[1:].astype(np.uint64)
            if n < 1 << 16:
                key = key.astype(np.uint32)
            key.sort()
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            seen, pair = np.diff(np.append(at, len(key))), key[at]
            context = (pair // key.dtype.type(n)).astype(np.int64)
            begin = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            order = np.lexsort((seen, context))
            best = order[np.append(begin[1:], len(order)) - 1]
            share = seen[best] * 4096 // (np.add.reduceat(seen, begin) + 2)
            good = (seen[best] >= _LEAST_SEEN) & (share >= _LEAST_SHARE)
            which = context[best][good]
            follower[which] = pair[best][good] % key.dtype.type(n)
            p1[which] = np.minimum(share[good], _MOST) >> 4 << 4
        return _Tables(alphabet.astype(np.uint32), _scaled(counts), follower, p1), ranks

    def pack(self) -> bytes:
        some = np.flatnonzero(self.p1)
        parts = [np.diff(self.alphabet, prepend=np.uint32(0)).astype("<u4"), self.shares.astype("<u4"), np.diff(some, prepend=0).astype("<u4"), self.follower[some].astype("<u4"), (self.p1[some] >> 4).astype("u1")]
        # Bytes of one place stand together: the high ones are nearly all zero.
        raw = b"".join(np.ascontiguousarray(p.view(np.uint8).reshape(len(p), p.itemsize).T).tobytes() for p in parts)
        return struct.pack("<II", len(self.alphabet), len(some)) + zlib.compress(raw, 6)

    @staticmethod
    def unpack(data: bytes) -> _Tables:
        n, k = struct.unpack_from("<II", data)
        raw, at, parts = zlib.decompress(data[8:]), 0, []
        for count, size in ((n, 4), (n, 4), (k, 4), (k, 4), (k, 1)):
            rows = np.frombuffer(raw, np.uint8, count * size, at).reshape(size, count)
            parts.append(np.ascontiguousarray(rows.T).view(f"<u{size}").ravel())
            at += count * size
        follower, p1 = np.zeros(n, np.int32), np.zeros(n, np.int32)
        some = np.cumsum(parts[2], dtype=np.int64)
        follower[some] = parts[3]
        p1[some] = parts[4].astype(np.int32) << 4
        return _Tables(np.cumsum(parts[0], dtype=np.uint32), parts[1].astype(np.int64), follower, p1)

    def ranks_at(self) -> np.ndarray | None:
        """Rank at each place of order 0, where that is a small table."""
        return np.repeat(np.arange(len(self.shares), dtype=np.int32), self.shares) if self.total_bits <= 20 else None


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Shares of a power of two, at least one each, in proportion to counts."""
    n = len(counts)
    total = 1 << max(16, (4 * n).bit_length())
    if not n:
        return np.zeros(0, np.int64)
    shares = 1 + counts.astype(np.int64) * (total - n) // int(counts.sum())
    shares[int(counts.argmax())] += total - int(shares.sum())
    return shares


class _Mixer:
    """The mixed prediction of the next rank in every lane."""

    def __init__(self, lanes: int, tables: _Tables):
        self.follower, self.p1 = tables.follower, tables.p1
        self.slots = np.zeros(lanes * _SLOTS, np.int64 if len(tables.alphabet) >= 1 << 28 else np.int32)
        self.base = np.arange(lanes) * _SLOTS
        self.w1, self.w2 = np.full(lanes, 256, np.int32), np.full(lanes, 200, np.int32)
        self.last, self.before, self.fresh = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32), True

    def predict(self) -> None:
        slot = self.last * np.int32(40503)
        slot += self.before * np.int32(30011)
        slot >>= 4
        slot &= _SLOTS - 1
        self.slot = slot + self.base
        found = self.slots.take(self.slot)
        self.id2, self.trust = found >> 3, found & 7
        self.p2 = np.minimum((_TRUSTED.take(self.trust) * self.w2) >> 8, _MOST)
        self.id1 = self.follower.take(self.last)
        # The first id of a block has nothing before it.
        self.p1_ = np.zeros_like(self.p2) if self.fresh else np.minimum((self.p1.take(self.last) * self.w1) >> 8, _MOST)
        more = ((_ONE - self.p2) * self.p1_) >> 12
        same = self.id1 == self.id2
        self.f2 = self.p2 + same * more
        self.c1 = self.p2 + more

    def learn(self, x: np.ndarray) -> None:
        hit2, hit1 = self.id2 == x, self.id1 == x
        # A weight moves towards where its probabilities hold.
        self.w2 += ((hit2 * np.int32(_ONE)) - self.p2) * (self.p2 > 0) >> 9
        self.w1 += ((hit1 * np.int32(_ONE)) - self.p1_) * (self.p1_ > 0) >> 9
        np.clip(self.w2, 16, 330, out=self.w2)
        np.clip(self.w1, 16, 330, out=self.w1)
        trust = np.where(hit2 & (self.trust > 0), np.minimum(self.trust + 1, 7), self.trust >> 1)
        self.slots[self.slot] = np.where(trust > 0, (self.id2 << 3) | trust, (x << 3) | 1)
        self.before, self.last, self.fresh = self.last, x, False


class _Encoder:
    """Lower end and width of every lane's interval, and its words.

    A sum that overflows carries into words that are out already.
    """

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, 2**64 - 1, _U)
        self.at, self.lanes = np.zeros(lanes, np.int64), np.arange(lanes)
        #: Lanes advance at nearly the same pace, so words of one place are kept
        #: together, not those of one lane.
        self.out = np.zeros((4 * steps + 8) * lanes, np.uint16)

    def add(self, amount: np.ndarray) -> None:
        low = self.low + amount
        carry = np.flatnonzero(low < amount)
        place = (self.at[carry] - 1) * len(self.lanes) + carry
        while len(place):
            self.out[place] += np.uint16(1)
            place = place[self.out[place] == 0] - len(self.lanes)
        self.low = low

    def shift(self) -> None:
        while True:
            due = self.range < _FULL
            lanes = np.flatnonzero(due)
            if not len(lanes):
                return
            self.out[self.at[lanes] * len(self.lanes) + lanes] = self.low[lanes] >> _U(48)
            by = due.astype(_U) << _U(4)
            self.low <<= by
            self.range <<= by
            self.at += due

    def finish(self) -> list[bytes]:
        for _ in range(4):
            self.out[self.at * len(self.lanes) + self.lanes] = self.low >> _U(48)
            self.at += 1
            self.low <<= _U(16)
        by_lane = np.ascontiguousarray(self.out.reshape(-1, len(self.lanes))[: int(self.at.max())].T).astype("<u2")
        return [by_lane[k, :n].tobytes() for k, n in enumerate(self.at.tolist())]


class _Decoder:
    """Place of every lane's code inside its interval, and its words."""

    def __init__(self, payloads: list[bytes]):
        words = np.zeros((len(payloads), max(len(p) for p in payloads) // 2 + 8), np.uint16)
        for k, p in enumerate(payloads):
            words[k, : len(p) // 2] = np.frombuffer(p, "<u2")
        self.code, self.range = np.zeros(len(payloads), _U), np.full(len(payloads), 2**64 - 1, _U)
        for k in range(4):
            self.code = (self.code << _U(16)) | words[:, k]
        self.at, self.lanes = np.full(len(payloads), 4, np.int64), np.arange(len(payloads))
        self.words = np.ascontiguousarray(words.T).ravel()

    def shift(self) -> None:
        while True:
            due = self.range < _FULL
            lanes = np.flatnonzero(due)
            if not len(lanes):
                return
            by = due.astype(_U) << _U(4)
            self.code <<= by
            self.range <<= by
            # Behind its end a short block meets words that no id needs.
            place = np.minimum(self.at[lanes] * len(self.lanes) + lanes, len(self.words) - 1)
            self.code[lanes] |= self.words.take(place)
            self.at += due


def encode_stripe(ids: np.ndarray) -> bytes:
    """The ids as a stripe of blocks: header, tables, block table, payloads."""
    tables, ranks = _Tables.of(ids)
    head = tables.pack()
    blocks = [ranks[k : k + BLOCK_TOKENS] for k in range(0, len(ids), BLOCK_TOKENS)]
    payloads: list[bytes] = []
    for k in range(0, len(blocks), STRIPE_BLOCKS):
        payloads += _encode_blocks(blocks[k : k + STRIPE_BLOCKS], tables)
    wide = ids.astype("<u4")
    table = b"".join(struct.pack("<IIII", len(b), len(p), zlib.crc32(p), zlib.crc32(wide[k * BLOCK_TOKENS : k * BLOCK_TOKENS + len(b)])) for k, (b, p) in enumerate(zip(blocks, payloads, strict=True)))
    return MAGIC + struct.pack("<III", len(blocks), len(head), zlib.crc32(head)) + head + table + b"".join(payloads)


def _encode_blocks(blocks: list[np.ndarray], tables: _Tables) -> list[bytes]:
    lanes, steps = len(blocks), max(map(len, blocks))
    grid = np.zeros((lanes, steps), np.int32)
    for k, b in enumerate(blocks):
        grid[k, : len(b)] = b
    grid = np.ascontiguousarray(grid.T)
    bits = _U(tables.total_bits)
    model, coder = _Mixer(lanes, tables), _Encoder(lanes, steps)
    for x in grid:
        model.predict()
        hit2 = (model.id2 == x) & (model.f2 > 0)
        hit1 = (model.id1 == x) & (model.c1 > model.f2) & ~hit2
        escaped = ~(hit2 | hit1)
        unit = coder.range >> _U(12)
        begin = np.where(hit2, 0, np.where(hit1, model.f2, model.c1))
        end = np.where(hit2, model.f2, np.where(hit1, model.c1, _ONE))
        width = (end - begin).astype(_U) * unit
        amount = begin.astype(_U) * unit
        small = width >> bits
        amount += escaped * (tables.start.take(x) * small)
        coder.add(amount)
        coder.range = np.where(escaped, tables.size.take(x) * small, width)
        coder.shift()
        model.learn(x)
    return coder.finish()


def decode_stripe(data: bytes) -> np.ndarray:
    """The ids of a stripe; raises if a checksum does not hold."""
    if data[:4] != MAGIC:
        raise ValueError("not a token stripe")
    count, size, crc = struct.unpack_from("<III", data, 4)
    head = data[16 : 16 + size]
    if zlib.crc32(head) != crc:
        raise ValueError("the stripe's tables are damaged")
    tables = _Tables.unpack(head)
    table = list(struct.iter_unpack("<IIII", data[16 + size : 16 + size + 16 * count]))
    at, payloads = 16 + size + 16 * count, []
    for k, (_, size, crc, _) in enumerate(table):
        payloads.append(data[at : at + size])
        at += size
        if zlib.crc32(payloads[-1]) != crc:
            raise ValueError(f"block {k} is damaged")
    out = np.zeros(sum(n for n, *_ in table), "<u4")
    filled = 0
    for k in range(0, count, STRIPE_BLOCKS):
        sizes = [n for n, *_ in table[k : k + STRIPE_BLOCKS]]
        grid = tables.alphabet.take(_decode_blocks(payloads[k : k + STRIPE_BLOCKS], max(sizes), tables))
        if min(sizes) == max(sizes):
            out[filled : filled + grid.size] = grid.ravel()
        else:
            np.concatenate([row[:n] for row, n in zip(grid, sizes, strict=True)], out=out[filled : filled + sum(sizes)])
        filled += sum(sizes)
    at = 0
    for k, (n, _, _, crc) in enumerate(table):
        if zlib.crc32(out[at : at + n]) != crc:
            raise ValueError(f"block {k} is decoded to other ids")
        at += n
    return out


def _decode_blocks(payloads: list[bytes], steps: int, tables: _Tables) -> np.ndarray:
    lanes = len(payloads)
    grid = np.zeros((steps, lanes), np.int32)
    bits, last_place = _U(tables.total_bits), _U((1 << tables.total_bits) - 1)
    ranks_at = tables.ranks_at()
    model, coder = _Mixer(lanes, tables), _Decoder(payloads)
    for t in range(steps):
        model.predict()
        unit = coder.range >> _U(12)
        v = np.minimum(coder.code // unit, _U(_ONE - 1)).astype(np.int32)
        hit2 = v < model.f2
        inside = v < model.c1
        begin = np.where(hit2, 0, np.where(inside, model.f2, model.c1))
        end = np.where(hit2, model.f2, np.where(inside, model.c1, _ONE))
        code, width = coder.code - begin.astype(_U) * unit, (end - begin).astype(_U) * unit
        small = width >> bits
        # Where a prediction was right the quotient says nothing.
        place = np.minimum(code // small, last_place)
        found = ranks_at.take(place.astype(np.int64)) if ranks_at is not None else (np.searchsorted(tables.upto, place.astype(np.int64), "right") - 1).astype(np.int32)
        x = np.where(hit2, model.id2, np.where(inside, model.id1, found))
        escaped = ~inside
        coder.code = code - escaped * (tables.start.take(found) * small)
        coder.range = np.where(escaped, tables.size.take(found) * small, width)
        coder.shift()
        model.learn(x)
        grid[t] = x
    return np.ascontiguousarray(grid.T)
