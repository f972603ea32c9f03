"""Context-mixing range coder for token ids in independent, checksummed blocks.

A block's ids are predicted by three orders. Order 2 and order 1 predict the id last seen
after the two ids, or the one id, before it, with a confidence that grows with each hit.
Order 0 predicts by the block's own id counts, which its header holds. Each step mixes them
into one distribution: the two confidences (and whether both predict the same id) pick
adaptive weights for "order 2 is right", "order 1 is right" and "take order 0", and the
weights move towards what came true. One arithmetic coding step per id spends that
distribution's code length.

All models start anew in each block, and blocks are coded side by side: a step handles one
id of every block at once.

Block: 4 bytes number of ids, 4 bytes payload length, 4 bytes crc32 of the ids as
little-endian unsigned 32-bit integers, then the payload: header of ids and counts (deflated
varints), then 16-bit digits of the code.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 8192
# Blocks coded side by side; about 200 kB each.
LANES = 1024
_SLOTS1, _SLOTS2 = 1024, 2048
_LIMIT, _STEP = 4000, 32
_LOW = np.uint64(1) << np.uint64(32)
_MASK32 = np.uint64(0xFFFFFFFF)
_S16, _S32 = np.uint64(16), np.uint64(32)
HEAD = struct.Struct("<III")


class _Model:
    """Predictions and weights of all lanes."""

    def __init__(self, lanes: int):
        self.base1 = np.arange(lanes) * _SLOTS1
        self.base2 = np.arange(lanes) * _SLOTS2
        self.base_w = np.arange(lanes) * 32
        # An id times four plus its confidence.
        self.table1 = np.zeros(lanes * _SLOTS1, np.int32)
        self.table2 = np.zeros(lanes * _SLOTS2, np.int32)
        c = np.arange(32)  # the surer, the heavier, from the start
        self.w0 = np.tile(1 + 24 * (c >> 2 & 3), lanes)
        self.w1 = np.tile(1 + np.where(c < 16, 12 * (c & 3), 0), lanes)
        self.w2 = np.tile(np.full(32, 64), lanes)

    def predict(self, last: np.ndarray, before: np.ndarray, n: int):
        mixed = last * 40503
        self.at1 = (mixed & (_SLOTS1 - 1)) + self.base1[:n]
        self.at2 = ((mixed + before * 30011 + (before >> 5)) & (_SLOTS2 - 1)) + self.base2[:n]
        first, second = self.table1.take(self.at1), self.table2.take(self.at2)
        self.p1, self.c1 = first >> 2, first & 3
        self.p2, self.c2 = second >> 2, second & 3
        self.w_at = self.base_w[:n] + (self.c2 * 4 + self.c1 + 16 * (self.p1 == self.p2))
        self.now = self.w0.take(self.w_at), self.w1.take(self.w_at), self.w2.take(self.w_at)
        return self.now

    def learn(self, ids: np.ndarray, hit1: np.ndarray, hit2: np.ndarray, event: np.ndarray) -> None:
        w0, w1, w2 = self.now
        w0 = w0 + _STEP * (event == 0)
        w1 = w1 + _STEP * (event == 1)
        w2 = w2 + _STEP * (event == 2)
        full = (w0 + w1 + w2 > _LIMIT).view(np.int8)
        if full.any():
            w0, w1, w2 = ((w >> full) + full for w in (w0, w1, w2))
        self.w0[self.w_at], self.w1[self.w_at], self.w2[self.w_at] = w0, w1, w2
        fresh = ids * 4 + 1
        for table, at, p, c, hit in (
            (self.table1, self.at1, self.p1, self.c1, hit1),
            (self.table2, self.at2, self.p2, self.c2, hit2),
        ):
            held = p * 4 + np.where(hit, np.minimum(c + 1, 3), c - 1)
            table[at] = np.where(hit | (c > 0), held, fresh)


def _varints(values: np.ndarray) -> bytes:
    """Seven bits a byte, the lowest first; the top bit says that more follow."""
    values = values.astype(np.uint64)
    n = np.maximum(1, (np.frexp(values.astype(float))[1] + 6) // 7)
    row = np.repeat(np.arange(len(values)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    data = (values[row] >> (7 * place).astype(np.uint64)) & np.uint64(127)
    data |= (place < n[row] - 1).astype(np.uint64) << np.uint64(7)
    return data.astype(np.uint8).tobytes()


def _numbers(data: bytes, count: int) -> tuple[np.ndarray, int]:
    """The first ``count`` varints of ``data`` and how many bytes they take."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)[:count]
    used = int(ends[-1]) + 1 if count else 0
    b = b[:used].astype(np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1]) if count else np.zeros(0, int)
    place = np.arange(used) - np.repeat(starts, ends - starts + 1)
    return (np.add.reduceat((b & 127) << (7 * place), starts) if count else b), used


class _Counts:
    """Order 0: sorted ids of each lane, and each id's first place and count among them."""

    def __init__(self, blocks: list[np.ndarray]):
        self.total = np.array([len(b) for b in blocks])
        self.base = np.cumsum(self.total) - self.total
        self.sorted = np.concatenate([np.sort(b) for b in blocks]).astype(np.int32)
        lane = np.repeat(np.arange(len(blocks)), self.total)
        new = (np.diff(self.sorted, prepend=-1) != 0) | (np.diff(lane, prepend=-1) != 0)
        start = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        count = np.diff(np.append(np.flatnonzero(new), len(new)))
        self.first = start - self.base[lane]
        self.count = np.repeat(count, count)


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids (none empty) as bytes."""
    out = []
    for i in range(0, len(blocks), LANES):
        out += _encode(blocks[i : i + LANES])
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lanes = [blocks[i].astype(np.int64) for i in order]
    sizes = np.array([len(b) for b in lanes])
    counts, model = _Counts(lanes), _Model(len(lanes))
    ids = np.zeros((sizes[0], len(lanes)), np.int64)
    where = np.zeros((sizes[0], len(lanes)), np.int64)
    for k, lane in enumerate(lanes):
        ids[: len(lane), k] = lane
        own = counts.sorted[counts.base[k] : counts.base[k] + len(lane)]
        where[: len(lane), k] = counts.base[k] + np.searchsorted(own, lane)
    low = np.zeros(len(lanes), np.uint64)
    size = np.full(len(lanes), (1 << 48) - 1, np.uint64)
    digits = np.zeros((len(lanes), 2 * sizes[0] + 8), np.uint32)
    used = np.zeros(len(lanes), np.int64)
    last = before = np.zeros(len(lanes), np.int64)
    for t in range(sizes[0]):
        n = int(np.searchsorted(-sizes, -t, side="left"))
        x, at = ids[t, :n], where[t, :n]
        w0, w1, w2 = model.predict(last[:n], before[:n], n)
        hit1, hit2 = model.p1 == x, model.p2 == x
        event = np.where(hit2, 0, 2 - hit1)
        total0 = counts.total[:n]
        end0, end1 = w0 * total0, (w0 + w1) * total0
        whole = end1 + w2 * total0
        start = np.where(hit2, 0, np.where(hit1, end0, end1 + w2 * counts.first.take(at)))
        share = np.where(hit2, end0, np.where(hit1, end1 - end0, w2 * counts.count.take(at)))
        unit = size[:n] // whole.view(np.uint64)
        low[:n] += unit * start.view(np.uint64)
        size[:n] = unit * share.view(np.uint64)
        while len(small := np.flatnonzero(size[:n] < _LOW)):
            digits[small, used[small]] = (low[small] >> _S32).astype(np.uint32)
            used[small] += 1
            low[small] = (low[small] & _MASK32) << _S16
            size[small] <<= _S16
        model.learn(x, hit1, hit2, event)
        last, before = x, last
    for shift in (32, 16, 0):
        part = low >> np.uint64(shift)
        digits[np.arange(len(lanes)), used] = part if shift == 32 else part & np.uint64(0xFFFF)
        used += 1
    for j in range(digits.shape[1] - 1, 0, -1):  # carries into the digit before
        digits[:, j - 1] += digits[:, j] >> 16
        digits[:, j] &= 0xFFFF
    out: list[bytes] = [b""] * len(blocks)
    for k, i in enumerate(order):
        kinds, number = np.unique(lanes[k], return_counts=True)
        header = _varints(np.concatenate([np.diff(kinds, prepend=0), number]))
        header = zlib.compress(header, 1)
        payload = _varints(np.array([len(kinds), len(header)])) + header
        payload += digits[k, : used[k]].astype("<u2").tobytes()
        crc = zlib.crc32(lanes[k].astype("<u4").tobytes())
        out[i] = HEAD.pack(len(lanes[k]), len(payload), crc) + payload
    return out


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """Ids of each block; an error if one doesn't fit its checksum."""
    out = []
    for i in range(0, len(blocks), LANES):
        out += _decode(blocks[i : i + LANES])
    return out


def _decode(blocks: list[bytes]) -> list[np.ndarray]:
    heads = [HEAD.unpack_from(b) for b in blocks]
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][0])
    tables, codes = [], []
    for i in order:
        data = blocks[i][HEAD.size :]
        (kinds, size), skip = _numbers(data, 2)
        used = int(size)
        values, _ = _numbers(zlib.decompress(data[skip : skip + used]), 2 * int(kinds))
        tables.append(np.repeat(np.cumsum(values[:kinds]), values[kinds:]))
        codes.append(np.frombuffer(data[skip + used :], "<u2"))
    sizes = np.array([heads[i][0] for i in order])
    if any(len(t) != s for t, s in zip(tables, sizes, strict=True)):
        raise ValueError("a block's header is damaged")
    counts, model = _Counts(tables), _Model(len(order))
    longest = max(map(len, codes))
    digits = np.zeros((len(order), longest + 8), np.uint64)
    for k, code in enumerate(codes):
        digits[k, : len(code)] = code
    value = (digits[:, 0] << _S32) | (digits[:, 1] << _S16) | digits[:, 2]
    used = np.full(len(order), 3)
    size = np.full(len(order), (1 << 48) - 1, np.uint64)
    ids = np.zeros((sizes[0], len(order)), np.int64)
    last = before = np.zeros(len(order), np.int64)
    for t in range(sizes[0]):
        n = int(np.searchsorted(-sizes, -t, side="left"))
        w0, w1, w2 = model.predict(last[:n], before[:n], n)
        total0 = counts.total[:n]
        end0, end1 = w0 * total0, (w0 + w1) * total0
        whole = end1 + w2 * total0
        unit = size[:n] // whole.view(np.uint64)
        q = np.minimum((value[:n] // unit).view(np.int64), whole - 1)
        in2, in1 = q < end0, q < end1
        event = np.where(in2, 0, 2 - in1)
        at = counts.base[:n] + np.maximum(q - end1, 0) // w2
        x = np.where(in2, model.p2, np.where(in1, model.p1, counts.sorted.take(at))).astype(np.int64)
        start = np.where(in2, 0, np.where(in1, end0, end1 + w2 * counts.first.take(at)))
        share = np.where(in2, end0, np.where(in1, end1 - end0, w2 * counts.count.take(at)))
        value[:n] -= unit * start.view(np.uint64)
        size[:n] = unit * share.view(np.uint64)
        while len(small := np.flatnonzero(size[:n] < _LOW)):
            value[small] = (value[small] << _S16) | digits[small, np.minimum(used[small], longest + 7)]
            used[small] += 1
            size[small] <<= _S16
        model.learn(x, model.p1 == x, model.p2 == x, event)
        ids[t, :n] = x
        last, before = x, last
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for k, i in enumerate(order):
        found = np.ascontiguousarray(ids[: sizes[k], k]).astype("<u4")
        if zlib.crc32(found.tobytes()) != heads[i][2]:
            raise ValueError("a block's ids do not fit its checksum")
        out[i] = found
    return out
