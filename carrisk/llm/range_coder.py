"""Adaptive context-mixing range coder for token ids, many independent blocks side by side.

Model of a block (all of it starts anew with the block, so blocks decode alone):

* order 2 and order 1: tables keyed by the last two ids and by the last one
  predict one id each, with a confidence from 0 to 3; for every confidence an
  adaptive counter says how often such a prediction held, and the rest of the
  order's probability is spread as order 0 has it;
* order 0: adaptive counts of 47 classes of ids (half octaves of id + 1; ids
  of public vocabularies run from frequent to rare), even within a class.

The three distributions are mixed by weights, one set of them for every
confidence of order 2.  After each id a weight moves towards its order's share
in what the mixture gave that id (its posterior), so that the orders that
predict well in a block come to carry it.  Weights and counters are integers
with bounds: no id ever gets an empty interval.  The mixture is one interval of
``TOTAL`` for each predicted id and for each class; the place within a class
follows as plain bits.  A 64-bit range coder codes it and emits 16-bit digits;
carries are added to the digits written and resolved when the block ends.

Ids run to ``MAX_ID`` = 2^24 - 2; a larger one is refused.

A numpy row holds one number per block, so a step codes one id of every block;
nothing is shared between blocks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
TOTAL_BITS, CLASS_BITS, CLASSES = 22, 12, 47
TABLE_BITS = (8, 9)  # order 1, order 2
ID_BITS, EMPTY = 24, 4  # a table entry is id | confidence << 24; confidence EMPTY: no prediction yet
NONE = (1 << ID_BITS) - 1
STATES = 5  # confidences
LEAST, MOST, RATE = 1 << 10, (1 << 16) - (1 << 10), 4  # bounds and step of the counters, of 65536
FLOOR, WEIGHT_RATE = 1 << 8, 4  # least weight, of 65536, and step of the weights
RARE_BITS = 6  # order 0 counts as 2^-6 where a prediction held
REBUILD, CELL_BITS = 64, 4
LOW = U(1 << 48)
FLUSH = 4

# Classes of id + 1 start at 1, 2, 3, 4, 6, 8, 12, 16, ...
CLASS_START = np.array(sorted({1 << k for k in range(24)} | {3 << k for k in range(23)}), np.int64)
CLASS_RAW = np.maximum(np.log2(CLASS_START).astype(np.int64) - 1, 0)  # bits of the place within a class
MAX_ID = int(CLASS_START[-1] + (1 << int(CLASS_RAW[-1])) - 2)


@lru_cache(maxsize=1)
def _class_of() -> np.ndarray:
    """Class of every id."""
    return np.repeat(np.arange(CLASSES, dtype=np.int8), 1 << CLASS_RAW)


def _keys(last, before):
    """Table slots of order 1 and order 2."""
    return ((last * 0x9E3779B1 >> 11) & ((1 << TABLE_BITS[0]) - 1), ((last * 0x85EBCA6B + before * 0xC2B2AE35) >> 11) & ((1 << TABLE_BITS[1]) - 1))


class _Model:
    def __init__(self, n: int):
        self.lane = np.arange(n)
        self.tables = [np.full(n << b, NONE | EMPTY << ID_BITS, np.int32) for b in TABLE_BITS]
        start = np.array([1 << 13, 1 << 14, 1 << 15, 3 << 14, LEAST], np.int64)
        self.held = [np.tile(start, n) for _ in TABLE_BITS]
        self.weights = [np.full(n * STATES, w, np.int64) for w in (30 << 10, 32 << 10)]
        self.counts = np.full(n * CLASSES, 2, np.int32)
        self.step = 0
        self.narrow(n)

    def narrow(self, n: int) -> None:
        """Go on with the first ``n`` blocks."""
        if self.step == 0 or n < len(self.lane):
            self.lane = self.lane[:n]
            self.table_at = [self.lane << b for b in TABLE_BITS]
            self.state_at, self.class_at, self.cum_at = self.lane * STATES, self.lane * CLASSES, self.lane * (CLASSES + 1)

    def rebuild(self) -> None:
        n = len(self.lane)
        sums = np.cumsum(self.counts[:n * CLASSES].reshape(n, CLASSES), axis=1, dtype=np.int64)
        cum = np.zeros((n, CLASSES + 1), np.int64)
        cum[:, 1:] = sums * ((1 << CLASS_BITS) - CLASSES) // sums[:, -1:] + np.arange(1, CLASSES + 1)
        self.cum = cum.reshape(-1)

    def predict(self, keys) -> None:
        if self.step % REBUILD == 0:
            self.rebuild()
        self.step += 1
        self.slot = [at + key for at, key in zip(self.table_at, keys)]
        entry = [t.take(s) for t, s in zip(self.tables, self.slot)]
        self.guess = [e & NONE for e in entry]
        self.sure = [e >> ID_BITS for e in entry]
        self.at = [self.state_at + sure for sure in self.sure]
        self.p = [h.take(i) for h, i in zip(self.held, self.at)]
        self.w = [w.take(self.at[1]) for w in self.weights]
        share1, self.f2 = (w * p >> 32 - TOTAL_BITS for w, p in zip(self.w, self.p))
        same = self.guess[0] == self.guess[1]
        self.f2 += share1 * same
        self.f1 = share1 * ~same
        self.rest = (1 << TOTAL_BITS) - self.f2 - self.f1

    def class_interval(self, cls):
        """(start, end) of a class within ``rest``."""
        at = self.cum_at + cls
        return self.rest * self.cum.take(at) >> CLASS_BITS, self.rest * self.cum.take(at + 1) >> CLASS_BITS

    def update(self, ids, cls) -> None:
        self.counts[self.class_at + cls] += 6
        total = 65536 - self.w[0] - self.w[1] << 16
        gave = []  # what each order's part of the mixture gave the id, in units of order 0's probability
        for k in (0, 1):
            p, hit = self.p[k], self.guess[k] == ids
            gave.append(self.w[k] * np.where(hit, p << RARE_BITS, 65536 - p))
            total += gave[k]
            self.held[k][self.at[k]] = p + ((hit * (MOST - LEAST) + LEAST - p) >> RATE)
            self.tables[k][self.slot[k]] = ids | (hit * np.minimum(self.sure[k] + 1, 3)) << ID_BITS
        for w, now, part in zip(self.weights, self.w, gave):
            goal = (part / total * (65536 - 3 * FLOOR)).astype(np.int64) + FLOOR
            w[self.at[1]] = now + (goal - now >> WEIGHT_RATE)


def _active(lengths: np.ndarray, t: int) -> int:
    """Blocks still longer than ``t``; lengths do not rise."""
    return int(np.searchsorted(-lengths, -t, side="left"))


def encode_blocks(ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Bytes of every block; row ``i`` of ``ids`` holds ``lengths[i]`` ids of block i, and lengths do not rise."""
    n, steps = ids.shape
    if n and (ids.min(initial=0) < 0 or ids.max(initial=0) > MAX_ID):
        raise ValueError(f"ids must lie in 0..{MAX_ID}")
    model = _Model(n)
    low, size = np.zeros(n, U), np.full(n, (1 << 64) - 1, U)
    digits: list[np.ndarray] = []  # a row for every shift: the digit of each block, and whether it is one
    real: list[np.ndarray] = []
    last = np.zeros(n, np.int64)  # row of each block's latest digit
    past = np.zeros((steps + 2, n), np.int64)  # the ids by step, after two zeros
    past[2:] = ids.T
    all_keys = _keys(past[1:-1], past[:-2])
    columns = past[2:]
    classes = _class_of()[columns]
    raws, places = CLASS_RAW[classes], columns + 1 - CLASS_START[classes]

    def shift(small):
        digits.append((low >> U(48)).astype(np.uint32))
        real.append(small)
        last[small] = len(digits) - 1
        low[:] <<= small * U(16)

    for t in range(steps):
        k = _active(lengths, t)
        if not k:
            break
        model.narrow(k)
        model.predict([keys[t, :k] for keys in all_keys])
        x, cls = columns[t, :k], classes[t, :k]
        hit2 = model.guess[1] == x
        hit1 = (model.guess[0] == x) & ~hit2
        start, end = model.class_interval(cls)
        both = model.f2 + model.f1
        miss = ~(hit1 | hit2)
        first = np.where(miss, both + start, hit1 * model.f2)
        share = np.where(miss, end - start, np.where(hit2, model.f2, model.f1))
        unit = size[:k] >> U(TOTAL_BITS)
        part = unit * share.view(U) >> (raws[t, :k] * miss).view(U)
        add = unit * first.view(U) + part * (places[t, :k] * miss).view(U)
        low[:k] += add
        over = low[:k] < add
        if over.any():
            for i in np.flatnonzero(over):
                digits[last[i]][i] += 1
        size[:k] = part
        small = size < LOW
        while small.any():
            shift(small)
            size <<= small * U(16)
            small = size < LOW
        model.update(x, cls)
    every = np.ones(n, bool)
    for _ in range(FLUSH if n else 0):
        shift(every)
    if not n:
        return []
    where = np.stack(real).T
    flat = np.stack(digits).T[where].astype(np.int64)
    over = np.flatnonzero(flat >> 16)
    while len(over):  # resolve carries; a block's first digit never has one
        carry = flat[over] >> 16
        flat[over] &= 0xFFFF
        np.add.at(flat, over - 1, carry)
        over = np.unique(over - 1)
        over = over[flat[over] >> 16 > 0]
    data = flat.astype(">u2").tobytes()
    ends = np.append(0, 2 * np.cumsum(where.sum(1))).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def decode_blocks(blocks: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """Ids of blocks made by ``encode_blocks``, one row each; lengths do not rise."""
    n, steps = len(blocks), int(lengths.max(initial=0))
    model = _Model(n)
    width = max(map(len, blocks), default=0) // 2 + 8
    digits = np.zeros((n, width), U)
    for i, b in enumerate(blocks):
        digits[i, :len(b) // 2] = np.frombuffer(b, ">u2")
    code, size = np.zeros(n, U), np.full(n, (1 << 64) - 1, U)
    for j in range(4):
        code = code << U(16) | digits[:, j]
    pos, final = np.arange(n) * width + 4, np.arange(1, n + 1) * width - 1
    digits = digits.reshape(-1)
    out = np.zeros((steps + 2, n), np.int64)  # after two zeros
    class_of = _class_of()
    cells = (1 << CLASS_BITS - CELL_BITS) + 1
    for t in range(steps):
        k = _active(lengths, t)
        model.narrow(k)
        fresh = model.step % REBUILD == 0
        model.predict(_keys(out[t + 1, :k], out[t, :k]))
        if fresh:  # class in which each cell of 16 shares starts: the classes that end before it
            ends = (model.cum.reshape(k, -1)[:, 1:] + (1 << CELL_BITS) - 1) >> CELL_BITS
            counted = np.bincount((model.lane[:, None] * cells + ends).reshape(-1), minlength=k * cells)
            cell_class = np.cumsum(counted.reshape(k, cells), axis=1).reshape(-1)
        unit = size[:k] >> U(TOTAL_BITS)
        value = np.minimum(code[:k] // unit, U((1 << TOTAL_BITS) - 1)).view(np.int64)
        both = model.f2 + model.f1
        hit2 = value < model.f2
        miss = value >= both
        hit1 = ~(hit2 | miss)
        target = ((((value - both) * miss + 1) << CLASS_BITS) - 1) // model.rest
        cls = cell_class.take(model.lane * cells + (target >> CELL_BITS))
        while True:  # a cell may hold several classes
            late = model.cum.take(model.cum_at + cls + 1) <= target
            if not late.any():
                break
            cls = cls + late
        start, end = model.class_interval(cls)
        raw = CLASS_RAW.take(cls) * miss
        first = np.where(miss, both + start, hit1 * model.f2)
        share = np.where(miss, end - start, np.where(hit2, model.f2, model.f1))
        part = unit * share.view(U) >> raw.view(U)
        left = code[:k] - unit * first.view(U)
        place = np.minimum(left // part, ((1 << raw) - 1).view(U)) * miss
        code[:k] = left - part * place
        size[:k] = part
        x = np.where(miss, CLASS_START.take(cls) + place.view(np.int64) - 1, np.where(hit2, model.guess[1], model.guess[0]))
        small = size < LOW
        while small.any():
            by = small * U(16)
            code = code << by | digits.take(np.minimum(pos, final)) * small
            pos += small
            size <<= by
            small = size < LOW
        out[t + 2, :k] = x
        model.update(x, class_of.take(x, mode="clip"))
    return np.ascontiguousarray(out[2:].T)
