"""Adaptive context-mixing range coder for token ids below 65536, in independent blocks.

A block's ids are cut into lanes of consecutive ids; all lanes advance together, one id of each
at a step, as numpy arrays. Lanes share the block's model and have a range coder each. Nothing
learnt in one block is used in another, so a block is decoded alone.

Each id is one of four events: what the order-2 context (the last two ids) predicts, what the
order-1 context predicts, another id with an order-0 frequency, or an id without one, which is
sent as it is. Both contexts keep the id that last followed them and how sure that is.

Probabilities of the events are mixed from four experts: one sees how sure order 2 is, one how
sure order 1 is, one whether the last id was predicted, one all of these. Their weights, one set
for each sureness of order 2, adapt by the experts' share in what was coded. Frequencies, experts
and weights are learnt from all ids up to the last settlement; settlements come after 1, 2, 4, ..
steps, then after every 32nd. The model is integers only, so that encoder and decoder agree on
any machine.

A block's bytes: the number of lanes and of 16-bit words in each lane (unsigned 32-bit integers,
little-endian), then the words lane by lane.
"""

from __future__ import annotations

import zlib

import numpy as np

ID = 0xFFFF
LANE_IDS, MOST_LANES = 512, 4096
EVENT_BITS, ORDER0_BITS = 10, 16  # precision of an event and of an order-0 id
RANGE_BITS, WORD = 48, 16
LEAST_RANGE = 1 << 32
SLOT_BITS, SURE = 16, 3  # order-2 slots as a power of two, highest sureness
MOST_SEEN = 1 << 15  # ids with an order-0 frequency
UNIT = 1 << 16  # probability one
EVENTS, CONTEXTS = 4, 64
LONGEST_WAIT = 32
FIELD = 20  # a start lies above a width in one integer
LOW = (1 << FIELD) - 1
UNSEEN = 1 << 2 * FIELD  # marks an id without an order-0 frequency
STEP1, STEP2 = 0x9E3779B1, 0x85EBCA6B


def shape(n: int) -> tuple[int, int]:
    """Lanes of a block of ``n`` ids and the steps each takes."""
    lanes = min(MOST_LANES, max(1, -(-n // LANE_IDS)))
    return lanes, -(-n // lanes)


class Mixer:
    """Event probabilities in every context: sureness of order 2, of order 1, whether both
    predict one id, whether the last id was predicted."""

    AXES = ((1, 3), (0, 3), (0, 1, 2), ())  # what each expert doesn't see of a context

    def __init__(self):
        self.seen = [np.zeros((4, 4, 2, 2, EVENTS), np.int64).sum(axis=a, keepdims=True) + 1 for a in self.AXES]
        self.weights = np.full((len(self.AXES), 4), UNIT // len(self.AXES), np.int64)
        self.mix()

    def mix(self) -> None:
        self.parts = []
        for seen, weight in zip(self.seen, self.weights, strict=True):
            p = seen * (UNIT - EVENTS) // seen.sum(axis=-1, keepdims=True) + 1
            self.parts.append(p * weight[:, None, None, None, None])
        total = sum(np.broadcast_to(p, (4, 4, 2, 2, EVENTS)) for p in self.parts)
        self.total = np.maximum(total, 1)
        flat = self.total.reshape(CONTEXTS, EVENTS)
        scale = 1 << EVENT_BITS
        width = flat * (scale - EVENTS) // flat.sum(axis=1, keepdims=True) + 1
        rows = np.arange(CONTEXTS)
        width[rows, width.argmax(axis=1)] += scale - width.sum(axis=1)
        self.place = (((np.cumsum(width, axis=1) - width) << FIELD) + width).ravel()  # start and width
        self.event_at = np.repeat(np.tile(np.arange(EVENTS), CONTEXTS), width.ravel())  # by context and place

    def learn(self, cells: np.ndarray) -> None:
        """``cells`` are context * EVENTS + event of the ids coded since the last time."""
        new = np.bincount(cells, minlength=CONTEXTS * EVENTS).reshape(4, 4, 2, 2, EVENTS)
        share = np.stack([(new * p // self.total.clip(1) if p.shape == new.shape else new * np.broadcast_to(p, new.shape) // self.total) for p in self.parts])
        # ``new * part`` stays below 2 ** 63: counts below 2 ** 20, parts below 2 ** 32.
        share = share.sum(axis=(2, 3, 4, 5)) + 1
        self.weights = (self.weights + share * UNIT // share.sum(axis=0)) // 2
        for k, axes in enumerate(self.AXES):
            self.seen[k] = self.seen[k] // 2 + new.sum(axis=axes, keepdims=True) * 8 + 1
        self.mix()


class Order0:
    """Frequencies of the ids that were not predicted."""

    def __init__(self):
        self.counts = np.zeros(1 << 16, np.int64)
        self.place = self.unseen = (np.arange(1 << 16) << FIELD) + UNSEEN + 1  # start and width by id
        self.id_at = np.arange(1 << ORDER0_BITS)

    def learn(self, ids: np.ndarray) -> None:
        self.counts += np.bincount(ids, minlength=1 << 16)
        seen = (self.counts > 0).nonzero()[0]
        if not len(seen):
            return
        if len(seen) > MOST_SEEN:
            seen = np.sort(seen[np.argsort(-self.counts[seen], kind="stable")[:MOST_SEEN]])
        own = self.counts[seen]
        width = own * ((1 << ORDER0_BITS) - len(seen)) // own.sum() + 1
        width[own.argmax()] += (1 << ORDER0_BITS) - width.sum()
        self.place = self.unseen.copy()
        self.place[seen] = ((np.cumsum(width) - width) << FIELD) + width
        self.id_at = np.repeat(seen, width)


class Model:
    """What a block has learnt. ``predict``, then ``learn``, once a step."""

    def __init__(self, lanes: int):
        self.second, self.first = np.zeros(1 << SLOT_BITS, np.int64), np.zeros(1 << 16, np.int64)
        self.mixer, self.order0 = Mixer(), Order0()
        self.last, self.older, self.hit = (np.zeros(lanes, np.int64) for _ in range(3))
        self.cells: list[np.ndarray] = []
        self.unpredicted: list[np.ndarray] = []
        self.wait, self.steps = 1, 0

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids that order 2 and order 1 predict, and the context of the event."""
        self.at2 = ((self.last * STEP1 + self.older * STEP2) >> 15) & ((1 << SLOT_BITS) - 1)
        self.s2, self.s1 = self.second.take(self.at2), self.first.take(self.last)
        guess2, guess1 = self.s2 & ID, self.s1 & ID
        context = ((self.s2 >> 16) << 4) + ((self.s1 >> 16) << 2) + self.hit
        context += (guess2 == guess1) * 2
        return guess2, guess1, context

    def learn(self, ids: np.ndarray, cell: np.ndarray, event: np.ndarray, right2: np.ndarray, right1: np.ndarray, own: np.ndarray) -> None:
        top = SURE << 16
        self.second[self.at2] = np.where(right2, np.minimum(self.s2 + UNIT, ids + top), ids)
        self.first[self.last] = np.where(right1, np.minimum(self.s1 + UNIT, ids + top), ids)
        self.older, self.last, self.hit = self.last, ids, (event < 2).astype(np.int64)
        self.cells.append(cell)
        self.unpredicted.append(own)
        self.steps += 1
        if self.steps == self.wait:
            self.mixer.learn(np.concatenate(self.cells))
            self.order0.learn(np.concatenate(self.unpredicted))
            self.cells, self.unpredicted = [], []
            self.steps, self.wait = 0, min(2 * self.wait, LONGEST_WAIT)


def encode_block(ids: np.ndarray) -> bytes:
    lanes, steps = shape(len(ids))
    if not len(ids):
        return np.zeros(1, "<u4").tobytes()
    grid = np.zeros(lanes * steps, np.uint16)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T).astype(np.int64)
    model = Model(lanes)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << RANGE_BITS, np.int64)
    out_lane, out_word = [], []
    for now in grid:
        guess2, guess1, cell = model.predict()
        mixer, order0 = model.mixer, model.order0
        right2, right1 = guess2 == now, guess1 == now
        own = (~(right2 | right1)).nonzero()[0]
        own_ids = now.take(own)
        own_place = order0.place.take(own_ids)
        event = right1.astype(np.int64)
        event[own] = (own_place >> 2 * FIELD) + 2
        np.putmask(event, right2, 0)
        cell = (cell << 2) + event
        place = mixer.place.take(cell)
        unit = span >> EVENT_BITS
        low += unit * (place >> FIELD)
        span = unit * (place & LOW)
        unit = span.take(own) >> ORDER0_BITS
        low[own] += unit * (own_place >> FIELD & LOW)
        span[own] = unit * (own_place & LOW)
        need = (span < LEAST_RANGE).nonzero()[0]
        while len(need):
            lo = low.take(need)
            out_lane.append(need.astype(np.uint16))
            out_word.append(lo >> 32)  # with a carry perhaps, which is settled at the end
            low[need] = (lo & 0xFFFFFFFF) << WORD
            wider = span.take(need) << WORD
            span[need] = wider
            need = need[wider < LEAST_RANGE]
        model.learn(now, cell, event, right2, right1, own_ids)
    every = np.arange(lanes, dtype=np.uint16)
    for _ in range(3):
        out_lane.append(every)
        out_word.append(low >> 32)
        low = (low & 0xFFFFFFFF) << WORD
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    order = np.argsort(lane, kind="stable")
    word = word[order]
    while len(over := np.flatnonzero(word > ID)):
        word[over] &= ID
        word[over - 1] += 1  # a lane's value stays below one, so its first word takes no carry out
    head = np.concatenate([[lanes], np.bincount(lane, minlength=lanes)]).astype("<u4")
    return head.tobytes() + word.astype("<u2").tobytes()


def decode_block(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` ids of a block; damaged bytes give other ids or a ValueError."""
    lanes, steps = shape(n)
    if not n:
        return np.zeros(0, np.uint16)
    head = np.frombuffer(raw, "<u4", 1 + lanes) if len(raw) >= 4 * (1 + lanes) else np.zeros(1, "<u4")
    sizes = head[1:].astype(np.int64)
    if head[0] != lanes or len(raw) != 4 * (1 + lanes) + 2 * sizes.sum():
        raise ValueError("a block of token ids has other lanes than its size tells")
    words = np.concatenate([np.frombuffer(raw, "<u2", offset=4 * (1 + lanes)).astype(np.int64), np.zeros(4, np.int64)])
    place = np.cumsum(sizes) - sizes
    code = np.zeros(lanes, np.int64)
    for _ in range(3):
        code = (code << WORD) | words.take(place, mode="clip")
        place += 1
    model, span = Model(lanes), np.full(lanes, 1 << RANGE_BITS, np.int64)
    grid = np.zeros((steps, lanes), np.uint16)
    top, u64 = (1 << EVENT_BITS) - 1, np.uint64
    for t in range(steps):
        guess2, guess1, context = model.predict()
        mixer, order0 = model.mixer, model.order0
        unit = span >> EVENT_BITS
        at = np.minimum((code.view(u64) // unit.view(u64)).view(np.int64), top)
        event = mixer.event_at.take((context << EVENT_BITS) + at)
        cell = (context << 2) + event
        spot = mixer.place.take(cell)
        code -= unit * (spot >> FIELD)
        span = unit * (spot & LOW)
        now = np.where(event == 0, guess2, guess1)
        own = (event > 1).nonzero()[0]
        unit = span.take(own) >> ORDER0_BITS
        rest = code.take(own)
        at = np.minimum((rest.view(u64) // unit.view(u64)).view(np.int64), ID)
        own_ids = np.where(event.take(own) == 2, order0.id_at.take(at), at)
        spot = order0.place.take(own_ids)
        code[own] = rest - unit * (spot >> FIELD & LOW)
        span[own] = unit * (spot & LOW)
        now[own] = own_ids
        need = (span < LEAST_RANGE).nonzero()[0]
        while len(need):
            from_ = place.take(need)
            code[need] = (code.take(need) << WORD) | words.take(from_, mode="clip")
            place[need] = from_ + 1
            wider = span.take(need) << WORD
            span[need] = wider
            need = need[wider < LEAST_RANGE]
        model.learn(now, cell, event, guess2 == now, guess1 == now, own_ids)
        grid[t] = now
    return np.ascontiguousarray(grid.T).ravel()[:n]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u2").tobytes())
