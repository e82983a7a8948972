"""Adaptive context-mixing range coder for token ids, many blocks in step.

A block's model starts empty and works on slots: ids numbered in the order in which they first stand in the block. For
each id, an order-2 and an order-1 table give a predicted slot with a confidence. Two adaptive distributions over
(order-2 slot right, order-1 slot right, seen before, new), one chosen by the confidences and one by the last
outcomes, are mixed with a weight that follows the better of them; the mixture drives the range coder. An id that
was seen but not predicted is coded by its order-0 frequency in the block, whose sums are renewed at growing distances
(slots that are younger than the sums count once), a new one by 16 even bits. All arithmetic is on integers, or on
doubles where these are exact, so what one machine codes any other decodes.

Blocks are independent; numpy codes the same place of many blocks at once. The four shares of a distribution are 16-bit
fields of one 64-bit number, the two tables and the two distributions are rows of one array.
"""

from __future__ import annotations

import numpy as np

BLOCK = 2048
#: The coder's low end and range have 48 bits and are held in doubles, which are exact there; words of 16 bits go out.
_RANGE, _BOTTOM, _WORD = float(1 << 48), float(1 << 32), float(1 << 16)
#: A table's entry is a slot and, from this bit on, how sure it is: 1 to 3; an empty one is 0 and guesses slot 0.
_SURE = BLOCK
_CONTEXTS = 32
#: A share loses 1 / 2^_RATE of itself with each id, the outcome's share gains _GAIN; weights are of _WEIGHTS.
_RATE, _GAIN, _WEIGHTS = 5, 120, 8
_ONES = np.uint64(0x0001000100010001)
_DECAY = np.uint64(((1 << 16 - _RATE) - 1) * 0x0001000100010001)
_FIELD = np.uint64(0xFFFF)
#: The gain and the place of each outcome's field.
_GAINS = np.array([_GAIN << 16 * o for o in range(4)], np.uint64)
_PLACES = np.array([16 * o for o in range(4)], np.uint64)
#: The outcome by 2 * (order-2 right) + (order-1 right).
_OUTCOMES = np.array([2, 1, 0, 0])


class _Model:
    """The models of the lanes, one block each; all methods work on the first k lanes."""

    def __init__(self, lanes: int):
        # For each slot, side by side: the order-1 entry, how often it stood, the order-0 sum below it, its id (decoding);
        # sums are of the places when they were renewed, and one for each slot since then. Then the order-2 entries.
        size = lanes * (BLOCK + 1) * 4
        self.tables = np.zeros(size + lanes * BLOCK, np.int16)
        self.records = self.tables[:size].reshape(lanes, BLOCK + 1, 4)
        self.names = self.tables.view(np.uint16)
        self.shares = np.full(2 * lanes * _CONTEXTS, _ONES * np.uint64(_GAIN * 2), np.uint64)
        self.weight = np.full(lanes, _WEIGHTS * 8, np.int64)
        self.own = np.arange(lanes) * BLOCK
        # Places in the tables and in the distributions: order-2 and confidences first, order-1 and past second.
        self.table_base = np.stack([self.own + size, np.arange(lanes) * (BLOCK + 1) * 4])
        self.at = self.table_base.copy()
        self.share_base = np.arange(2 * lanes).reshape(2, lanes) * _CONTEXTS
        self.share_at = self.share_base.copy()
        self.past = np.zeros(lanes, np.int64)
        self.mark = np.zeros(lanes, np.int64)
        self.slots = np.zeros(lanes, np.int64)
        self.reach = np.zeros(lanes, np.int64)
        self.renew = 16

    def renewed(self, k: int, t: int) -> bool:
        """Renews the order-0 sums if it is time: with growing distances, so that all renewals take linear time."""
        if t < self.renew:
            return False
        n = int(self.slots[:k].max(initial=0))
        np.cumsum(self.records[:k, :n, 1], axis=1, out=self.records[:k, 1 : n + 1, 2])
        self.reach[:k] = t
        self.renew = t + max(16, t // 5)
        return True

    def predict(self, k: int) -> None:
        self.entry = self.tables[self.at[:, :k]]
        self.guess = self.entry & BLOCK - 1
        sure = self.entry >> 11
        context = sure[0] << 3
        context += sure[1] << 1
        context += self.guess[0] == self.guess[1]
        at = self.share_at[:, :k]
        np.add(self.share_base[0, :k], context.astype(np.int64), out=at[0])
        np.add(self.share_base[1, :k], self.past[:k], out=at[1])
        self.pair = self.shares[at]
        first = (self.weight[:k] >> 4).view(np.uint64)
        # At least 1 for each outcome.
        self.mixed = self.pair[0] * first
        self.mixed += self.pair[1] * (np.uint64(_WEIGHTS) - first)
        self.mixed += _ONES
        self.upto = self.mixed * _ONES
        self.total = (self.upto >> np.uint64(48)).view(np.int64)

    def interval(self, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.place = _PLACES[outcome]
        end = (self.upto >> self.place & _FIELD).view(np.int64)
        share = (self.mixed >> self.place & _FIELD).view(np.int64)
        return end - share, share

    def places(self, k: int, slot: np.ndarray) -> np.ndarray:
        place = slot << 2
        place += self.table_base[1, :k]
        return place

    def learn(self, k: int, outcome: np.ndarray, slot: np.ndarray, place: np.ndarray) -> None:
        pair = self.pair
        had = (pair >> self.place & _FIELD).view(np.int64)
        weight = self.weight[:k]
        weight += np.sign(had[0] - had[1])
        np.maximum(weight, 16, out=weight)
        np.minimum(weight, _WEIGHTS * 16 - 16, out=weight)
        pair = pair - (pair >> np.uint64(_RATE) & _DECAY)
        pair += _GAINS[outcome]
        self.shares[self.share_at[:, :k]] = pair
        # Right: surer, up to 3. Wrong: less sure, or replaced where it was not sure.
        small = slot.astype(np.int16)
        entry = self.entry
        right = np.minimum(entry + _SURE, small + 3 * _SURE)
        wrong = np.where(entry >= 2 * _SURE, entry - _SURE, small + _SURE)
        self.tables[self.at[:, :k]] = np.where(self.guess == small, right, wrong)
        past = self.past[:k]
        past <<= 2
        past += outcome
        past &= 31
        new = np.flatnonzero(outcome == 3)
        self.slots[new] += 1
        self.reach[new] += 1
        self.tables[place[new] + 6] = self.reach[new]
        at = self.at[:, :k]
        mark = slot * 40503
        np.add(mark, self.mark[:k] * 29, out=at[0])
        at[0] >>= 3
        at[0] &= BLOCK - 1
        at[0] += self.table_base[0, :k]
        self.mark[:k] = mark
        at[1] = place
        self.tables[place + 1] += 1


def numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each id of each row (BLOCK columns at most), and whether it stands there for the first time in its row."""
    lanes, width = ids.shape
    keys = np.sort(ids.astype(np.int32) << 11 | np.arange(width, dtype=np.int32), axis=1)
    starts = np.ones((lanes, width), bool)
    np.greater(keys[:, 1:] ^ keys[:, :-1], BLOCK - 1, out=starts[:, 1:])
    keys &= BLOCK - 1
    keys += np.arange(lanes, dtype=np.int32)[:, None] * np.int32(width)
    # In the order of ids, the first place of a run is that of its id.
    place, heads = keys.ravel().astype(np.int64), np.flatnonzero(starts)
    heads_place = place[heads]
    first = np.zeros(lanes * width, bool)
    first[heads_place] = True
    rank = np.cumsum(first.reshape(lanes, width), axis=1, dtype=np.int16) - np.int16(1)
    slots = np.empty(lanes * width, np.int16)
    slots[place] = np.repeat(rank.ravel()[heads_place], np.diff(heads, append=lanes * width))
    return slots.reshape(lanes, width), first.reshape(lanes, width)


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block (BLOCK ids at most) as bytes. Raises ValueError for an id that has more than 16 bits."""
    if any(len(b) and (b.min() < 0 or b.max() > 65535) for b in blocks):
        raise ValueError("an id has more than 16 bits")
    order = sorted(range(len(blocks)), key=lambda n: -len(blocks[n]))
    lengths = np.array([len(blocks[n]) for n in order])
    lanes, longest = len(order), int(lengths.max(initial=0))
    rows = np.full((lanes, longest), 65535, np.uint16)
    for row, n in enumerate(order):
        rows[row, : len(blocks[n])] = blocks[n]
    slots, first = numbered(rows)
    slots, first, ids = np.ascontiguousarray(slots.T), np.ascontiguousarray(first.T) * np.int16(3), np.ascontiguousarray(rows.T)
    model = _Model(lanes)
    low, rng = np.zeros(lanes), np.full(lanes, _RANGE - 1)
    # 16-bit words, two an id at most (shares are over 2^-16, new ids have 16 bits); the first takes a carry out of the top.
    width = longest * 2 + 8
    out, used = np.zeros(lanes * width, np.uint16), np.ones(lanes, np.int64)
    base = np.arange(lanes) * width

    def renorm(at: np.ndarray, size: np.ndarray) -> None:
        over = np.flatnonzero(at >= _RANGE)
        if len(over):
            at[over] -= _RANGE
            back = base[over] + used[over] - 1
            while len(back):  # the carry runs through words of all ones
                out[back] += np.uint16(1)
                back = back[out[back] == 0] - 1
        who = np.flatnonzero(size < _BOTTOM)
        while len(who):
            some = at[who]
            word = np.floor(some * (1 / _BOTTOM))
            out[base[who] + used[who]] = word
            used[who] += 1
            at[who] = (some - word * _BOTTOM) * _WORD
            grown = size[who] * _WORD
            size[who] = grown
            who = who[grown < _BOTTOM]

    k, plain = lanes, bool(lanes) and int(lengths.min()) == longest
    for t in range(longest):
        if not plain:
            k = int(np.searchsorted(-lengths, -t, side="left"))
        slot = slots[t, :k].astype(np.int64)
        model.renewed(k, t)
        model.predict(k)
        right = model.guess == slot
        outcome = _OUTCOMES[right[0] * 2 + right[1]]
        outcome |= first[t, :k]
        start, share = model.interval(outcome)
        part = np.floor(rng[:k] / model.total)
        at, size = low[:k], rng[:k]
        at += part * start
        np.multiply(part, share, out=size)
        # The second step is empty where an order-2 or order-1 guess was right.
        seen, new = outcome == 2, outcome == 3
        place = model.places(k, slot)
        start, share, total = np.zeros(k), np.ones(k), np.ones(k)
        below = model.tables[place + 2]
        np.copyto(start, below, where=seen)
        np.copyto(share, model.tables[place + 6] - below, where=seen)
        np.copyto(total, model.reach[:k], where=seen)
        np.copyto(start, ids[t, :k], where=new)
        np.copyto(total, _WORD, where=new)
        part = np.floor(size / total)
        at += part * start
        np.multiply(part, share, out=size)
        renorm(at, size)
        model.learn(k, outcome, slot, place)
    for shift in (32, 16, 0):
        out[base + used] = low.astype(np.int64) >> shift & 65535
        used += 1
    done: list[bytes] = [b""] * lanes
    words = out.astype("<u2", copy=False).reshape(lanes, width)
    for row, n in enumerate(order):
        done[n] = words[row, : used[row]].tobytes()
    return done


def decode(coded: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The blocks that `encode` coded, given how many ids each has."""
    order = sorted(range(len(coded)), key=lambda n: -lengths[n])
    sizes = np.array([lengths[n] for n in order])
    lanes, longest = len(order), int(sizes.max(initial=0))
    width = max((len(c) // 2 for c in coded), default=0) + 4
    data = np.zeros((lanes, width), np.uint16)
    for row, n in enumerate(order):
        data[row, : len(coded[n]) // 2] = np.frombuffer(coded[n][: len(coded[n]) // 2 * 2], "<u2")
    code = data[:, 1:4] @ np.array([_BOTTOM, _WORD, 1.0])
    data, base, used = data.ravel(), np.arange(lanes) * width, np.full(lanes, 4, np.int64)
    model, ids = _Model(lanes), np.zeros((longest, lanes), np.uint16)
    rng = np.full(lanes, _RANGE - 1)
    inverse = np.zeros(lanes * BLOCK, np.int16)

    k, plain = lanes, bool(lanes) and int(sizes.min()) == longest
    for t in range(longest):
        if not plain:
            k = int(np.searchsorted(-sizes, -t, side="left"))
        if model.renewed(k, t):
            counts = model.records[:k, : int(model.slots[:k].max(initial=0)), 1]
            slots = np.broadcast_to(np.arange(counts.shape[1], dtype=np.int16), counts.shape)
            inverse.reshape(-1, BLOCK)[:k, :t] = np.repeat(slots.ravel(), counts.ravel()).reshape(k, t)
        model.predict(k)
        # In a sound block code stays below the range; in a damaged one all is clipped, so that it stays within bounds.
        at, size = code[:k], rng[:k]
        part = np.floor(size / model.total)
        got = np.minimum(np.floor(at / part), model.total - 1)
        upto, reached = model.upto, got.astype(np.uint64)
        outcome = (reached >= upto & _FIELD).astype(np.int64)
        outcome += reached >= upto >> _PLACES[1] & _FIELD
        outcome += reached >= upto >> _PLACES[2] & _FIELD
        start, share = model.interval(outcome)
        at -= part * start
        np.multiply(part, share, out=size)
        slot = np.where(outcome == 0, model.guess[0], model.guess[1]).astype(np.int64)
        seen, new = outcome == 2, outcome == 3
        total = np.ones(k)
        np.copyto(total, np.maximum(model.reach[:k], 1), where=seen)
        np.copyto(total, _WORD, where=new)
        part = np.floor(size / total)
        start = np.minimum(np.floor(at / part), total - 1)
        value = start.astype(np.int64)
        mine = inverse[model.own[:k] + np.minimum(value, BLOCK - 1)]
        np.copyto(slot, mine, where=seen)
        who = np.flatnonzero(new)
        slot[who] = fresh = np.minimum(model.slots[who], BLOCK - 1)
        place = model.places(k, slot)
        below, share = model.tables[place + 2], np.ones(k)
        np.copyto(start, below, where=seen)
        np.copyto(share, np.maximum(model.tables[place + 6] - below, 1), where=seen)
        at -= part * start
        np.multiply(part, share, out=size)
        model.names[place[who] + 3] = value[who]
        inverse[model.own[who] + np.minimum(model.reach[who], BLOCK - 1)] = fresh
        np.maximum(at, 0, out=at)
        np.minimum(at, size - 1, out=at)
        who = np.flatnonzero(size < _BOTTOM)
        while len(who):
            at[who] = at[who] * _WORD + data[base[who] + np.minimum(used[who], width - 1)]
            used[who] += 1
            grown = size[who] * _WORD
            size[who] = grown
            who = who[grown < _BOTTOM]
        ids[t, :k] = model.names[place + 3]
        model.learn(k, outcome, slot, place)
    back = np.ascontiguousarray(ids.T)
    done: list[np.ndarray] = [np.zeros(0, np.int64)] * lanes
    for row, n in enumerate(order):
        done[n] = back[row, : sizes[row]].astype(np.int64)
    return done
