"""A range coder for token ids: many independent blocks coded side by side.

A frame begins with a table of its ids and their rounded counts. Every block starts from this table and otherwise empty models and
has its own CRC-32, as the table has, so a damaged block harms no other. numpy steps through the blocks of a frame together, one
id of each at a step: a block is a lane of the arrays.

Predictions, for each block on its own:
* order 2 and order 1: the id that last followed the two ids (the id) before, from small hashed tables, with a confidence of
  0 to 3 that a hit raises and a miss halves;
* order 0: the ids so far, as SLOTS evenly spaced places of their sorted list, made anew at the REBUILD places; and the table of the
  frame for ids that are not among them.

Mixing: how likely each prediction is right is estimated twice, under the confidences of both predictions and under the last
two outcomes; the two estimates are mixed by a weight that follows which of them has been the better one in this block.
The mixed probabilities share out an interval of 2 ** 16 for the range coder: [order 2 | order 1 | order-0 slots | escape]; an
escaped id follows by its share of the table. The MOST_NAMED commonest ids of a frame are in its table; another one follows as the
table's escape and 16 bits, or 16 bits of ones and then 32 if it is wide.

The coder keeps 48 bits of low and of range, emits 16-bit words and carries into words already written. All quantities are
integers, the same on both sides."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

BLOCK = 2048
LANES = 2048  # blocks in a frame at most
SLOTS = 1024
REBUILD = (16, 64, 192, 512, 1152)
HASHED = 512  # entries of an order-1 or order-2 table
LEAST = 32  # share of each prediction at least, of 2 ** 16
ESCAPE = 512  # share of the escape at least
TOP = 1 << 48
U = np.uint64
I = np.int32  # noqa: E741
MOST_NAMED = 16_384
#: Rounded counts are powers of the fourth root of two, cut off.
ROOTS = np.array([math.isqrt(math.isqrt(1 << q)) for q in range(128)], np.int64)
MAGIC = b"SHID3\0"


class _Table:
    """Order 0 of a frame: ids in ascending order and, last, the escape for all others, each with its share of 2 ** 16."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray):
        """marks: places in ROOTS, one more than ids."""
        self.ids, self.marks = ids, marks
        roots, n = ROOTS[marks], len(marks)
        self.width = 1 + roots * (65536 - n) // int(roots.sum())
        self.width[-1] += 65536 - int(self.width.sum())
        self.start = np.cumsum(self.width) - self.width
        self.at = np.repeat(np.arange(n), self.width)

    @classmethod
    def of(cls, ids: np.ndarray) -> _Table:
        names, counts = np.unique(ids, return_counts=True)
        rest = 0
        if len(names) > MOST_NAMED:
            keep = np.sort(np.argsort(-counts, kind="stable")[:MOST_NAMED])
            rest = int(counts.sum() - counts[keep].sum())
            names, counts = names[keep], counts[keep]
        marks = np.searchsorted(ROOTS[4:], np.append(counts, rest), "right") + 3  # from 4 on, each mark is another root
        return cls(names.astype(np.int64), marks)

    def entries(self, most: int) -> np.ndarray:
        """id -> entry, for ids up to most."""
        out = np.full(most + 1, len(self.ids), np.int64)
        out[self.ids] = np.arange(len(self.ids))
        return out

    def packed(self) -> bytes:
        return zlib.compress(np.diff(self.ids, prepend=0).astype("<u4").tobytes() + self.marks.astype(np.uint8).tobytes(), 6)

    @classmethod
    def unpacked(cls, data: bytes, n: int) -> _Table:
        raw = zlib.decompress(data)  # its own Adler-32 is checked; the CRC-32 of the blocks follows
        return cls(np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)), np.frombuffer(raw, np.uint8, n + 1, 4 * n).astype(np.int64))


class _Coder:
    """Range coder state of all lanes; words are uint16, a row a lane."""

    def __init__(self, n: int, words: np.ndarray):
        self.range = np.full(n, TOP - 1, U)
        self.flat = words.reshape(-1)
        self.words = words
        self.at = np.arange(n, dtype=np.int64) * words.shape[1]
        self.base = self.at.copy()


class _Writer(_Coder):
    def __init__(self, n: int, room: int):
        super().__init__(n, np.zeros((n, room), np.uint16))
        self.low = np.zeros(n, U)

    def put(self, start: np.ndarray, width: np.ndarray) -> None:
        """Narrows all lanes to [start, start + width) of 2 ** 16."""
        r = self.range >> U(16)
        self.low += r * start
        r *= width
        if (carry := np.flatnonzero(self.low >= U(TOP))).size:
            self.low[carry] &= U(TOP - 1)
            spot = self.at[carry] - 1
            while spot.size:
                self.flat[spot] += np.uint16(1)
                spot = spot[self.flat[spot] == 0] - 1
        self.range = r
        small = np.flatnonzero(r < U(1 << 32))
        while small.size:
            self._shift(small)
            small = small[self.range[small] < U(1 << 32)]

    def _shift(self, lanes: np.ndarray) -> None:
        low, at = self.low[lanes], self.at[lanes]
        self.flat[at] = low >> U(32)
        self.at[lanes] = at + 1
        self.low[lanes] = (low << U(16)) & U(TOP - 1)
        self.range[lanes] <<= U(16)

    def put_some(self, lanes: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        """As put(), in some lanes."""
        r = self.range[lanes] >> U(16)
        low = self.low[lanes] + r * start.astype(U)
        r *= width.astype(U)
        carry = low >= U(TOP)
        spot = self.at[lanes[carry]] - 1
        while spot.size:
            self.flat[spot] += np.uint16(1)
            spot = spot[self.flat[spot] == 0] - 1
        self.low[lanes] = low & U(TOP - 1)
        self.range[lanes] = r
        small = lanes[r < U(1 << 32)]
        while small.size:
            self._shift(small)
            small = small[self.range[small] < U(1 << 32)]

    def put_raw(self, lanes: np.ndarray, value: np.ndarray) -> None:
        """16 even bits in some lanes."""
        self.put_some(lanes, value, np.ones(len(lanes), np.int64))

    def finish(self) -> np.ndarray:
        """Flushes; the number of words of each lane."""
        for shift in (32, 16, 0):
            self.flat[self.at] = (self.low >> U(shift)) & U(0xFFFF)
            self.at += 1
        return self.at - self.base


class _Reader(_Coder):
    def __init__(self, words: np.ndarray):
        super().__init__(len(words), words)
        self.code = np.zeros(len(words), U)
        for _ in range(3):
            self.code = (self.code << U(16)) | self.flat[self.at]
            self.at += 1

    def peek(self) -> np.ndarray:
        """Where in 2 ** 16 the code of each lane lies. A quotient of integers below 2 ** 48 is exact in doubles once cut off."""
        self.unit = self.range >> U(16)
        return np.minimum(self.code.astype(np.float64) / self.unit, 65535.0).astype(I)

    def take(self, start: np.ndarray, width: np.ndarray) -> None:
        self.code -= self.unit * start
        self.range = self.unit * width
        small = np.flatnonzero(self.range < U(1 << 32))
        while small.size:
            self._shift(small)
            small = small[self.range[small] < U(1 << 32)]

    def _shift(self, lanes: np.ndarray) -> None:
        at = self.at[lanes]
        self.code[lanes] = (self.code[lanes] << U(16)) | self.flat[at]
        self.range[lanes] <<= U(16)
        self.at[lanes] = at + 1

    def take_some(self, lanes: np.ndarray, table: _Table) -> np.ndarray:
        """Table entries of some lanes."""
        code, unit = self.code[lanes], self.range[lanes] >> U(16)
        entry = table.at.take(np.minimum(code.astype(np.float64) / unit, 65535.0).astype(np.int64))
        self.code[lanes] = code - unit * table.start.take(entry).astype(U)
        self.range[lanes] = r = unit * table.width.take(entry).astype(U)
        small = lanes[r < U(1 << 32)]
        while small.size:
            self._shift(small)
            small = small[self.range[small] < U(1 << 32)]
        return entry

    def take_raw(self, lanes: np.ndarray) -> np.ndarray:
        code, unit = self.code[lanes], self.range[lanes] >> U(16)
        value = np.minimum(code.astype(np.float64) / unit, 65535.0).astype(np.int64)
        self.code[lanes] = code - unit * value.astype(U)
        self.range[lanes] = unit
        small = lanes[unit < U(1 << 32)]
        while small.size:
            self._shift(small)
            small = small[self.range[small] < U(1 << 32)]
        return value


def _mask(yes: np.ndarray) -> np.ndarray:
    """-1 where yes, else 0: choosing by ``&`` and ``|`` is quicker than np.where, which guesses branches."""
    return np.negative(yes.view(np.int8), dtype=I)


class _Models:
    """Predictions and their estimates for n blocks, in int32. An estimate has 15 bits; the two of a context (order 2, and order
    1 where order 2 missed) share an entry."""

    def __init__(self, n: int):
        self.two, self.one = np.zeros(n * HASHED, I), np.zeros(n * HASHED, I)  # id * 4 + confidence
        lane = np.arange(n, dtype=np.int64)
        self.at_table, self.at_trust, self.at_past, self.at_slot = lane * HASHED, lane * 32, lane * 9, lane * (SLOTS + 1)
        self.trust, self.seen = np.full(n * 32, 8000 << 16 | 8000, I), np.full(n * 9, 8000 << 16 | 8000, I)
        self.weight = np.full(n, 32, I)
        self.past = np.zeros(n, I)
        self.last, self.before = np.zeros(n, I), np.zeros(n, I)
        self.ready = False

    def predict(self) -> None:
        self.i1 = self.at_table + (self.last & I(HASHED - 1))
        self.i2 = self.at_table + (((self.last * I(1213) ^ self.before * I(877)) >> I(2)) & I(HASHED - 1))
        self.e2, self.e1 = self.two.take(self.i2), self.one.take(self.i1)
        self.p2, self.p1 = self.e2 >> 2, self.e1 >> 2
        self.c2, self.c1 = self.e2 & I(3), self.e1 & I(3)
        self.t = self.at_trust + ((self.c2 << 3) + (self.c1 << 1) + (self.p1 == self.p2))
        self.q = self.at_past + self.past
        a, b = self.trust.take(self.t), self.seen.take(self.q)
        self.a2, self.b2, self.a1, self.b1 = a >> 16, b >> 16, a & I(0xFFFF), b & I(0xFFFF)
        m2 = self.b2 + ((self.a2 - self.b2) * self.weight >> 6)
        m1 = self.b1 + ((self.a1 - self.b1) * self.weight >> 6)
        room = 65536 - 2 * LEAST - SLOTS - ESCAPE
        self.w2 = (m2 * I(room >> 1) >> 14) + I(LEAST)
        self.w1 = (m1 * ((I(room + LEAST) - self.w2) >> 1) >> 14) + I(LEAST)
        self.zero = self.w2 + self.w1
        if self.ready:
            self.unit = np.maximum((self.free - self.zero) >> 10, I(1))
            self.esc = self.zero + (self.unit << 10)
        else:
            self.esc = self.zero

    def update(self, ids: np.ndarray, hit2: np.ndarray, m2: np.ndarray, m1: np.ndarray) -> None:
        """hit2: order 2 was right; m2 and m1: masks of the blocks that took order 2, order 1."""
        self.weight += ((((self.a2 > self.b2) == hit2).view(np.int8) << 1) - 1).astype(I)
        np.minimum(np.maximum(self.weight, I(4)), I(60), out=self.weight)
        to2, to1, missed = m2 & I(32768), m1 & I(32768), ~m2
        for table, at, x2, x1 in ((self.trust, self.t, self.a2, self.a1), (self.seen, self.q, self.b2, self.b1)):
            table[at] = ((x2 + ((to2 - x2) >> 4)) << 16) | (x1 + (((to1 - x1) >> 4) & missed))
        fresh = ids << 2
        for table, at, e, c, right in ((self.two, self.i2, self.e2, self.c2, m2), (self.one, self.i1, self.e1, self.c1, _mask(self.p1 == ids))):
            keep = _mask(c > 1) & ~right
            table[at] = ((e + (c < 3)) & right) | ((e - c + I(1)) & keep) | (fresh & ~(right | keep))
        self.past = (self.past % I(3)) * I(3) + (I(2) + m2 + m2 + m1)  # 0 order 2, 1 order 1, 2 other
        self.before, self.last = self.last, ids

    def rebuild(self, seen: np.ndarray) -> None:
        """Order 0 from the ids so far (a row a lane). The escape's share follows the share of ids seen once. ``spans`` holds a
        slot's first slot and, from bit 16, how many slots its id has; place SLOTS stands for the escape."""
        ordered = np.sort(seen, axis=1)
        k = seen.shape[1]
        new = np.ones(ordered.shape, bool)
        new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        once = (new[:, :-1] & new[:, 1:]).sum(1) + new[:, -1]
        self.free = (65536 - np.clip(once * 60000 // k, ESCAPE, 60000)).astype(I)
        self.slots = np.zeros((len(seen), SLOTS + 1), I)
        self.slots[:, :SLOTS] = ordered[:, (np.arange(SLOTS) * k) // SLOTS]
        new = np.ones((len(seen), SLOTS + 1), bool)
        new[:, 1:SLOTS] = self.slots[:, 1:SLOTS] != self.slots[:, : SLOTS - 1]
        first = np.maximum.accumulate(np.where(new, np.arange(SLOTS + 1, dtype=I), I(0)), axis=1)
        ends = np.full(new.shape, SLOTS, I)
        ends[:, :-1] = np.where(new[:, 1:], np.arange(1, SLOTS + 1, dtype=I), I(SLOTS))
        many = np.minimum.accumulate(ends[:, ::-1], axis=1)[:, ::-1] - first
        self.spans = first | (many << 16)
        self.spans[:, SLOTS] = SLOTS
        self.ready = True

    def locate(self, ids: np.ndarray) -> np.ndarray:
        """The spans of ids (a row a lane), for the writer. One table of all ids serves each lane in turn."""
        out = np.empty(ids.shape, I)
        table = np.full(int(max(ids.max(), self.slots.max())) + 1, SLOTS, I)
        for lane in range(len(ids)):
            slots = self.slots[lane, :SLOTS]
            table[slots] = self.spans[lane, :SLOTS]
            table.take(ids[lane], out=out[lane])
            table[slots] = SLOTS
        return out


def _frame(ids: np.ndarray) -> bytes:
    """ids: at most LANES blocks, below 2 ** 32. Wide ids are numbered within the frame, so that tables stay small."""
    total = len(ids)
    n = -(-total // BLOCK)
    longest = min(BLOCK, total)
    wide = int(ids.max()) >= 1 << 20
    names = np.unique(ids) if wide else np.zeros(0, np.int64)
    crc = [zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) for i in range(n)]
    if wide:
        ids = np.searchsorted(names, ids)
    grid = np.full(n * longest, ids[-1], I)  # the last block is filled up with its last id
    grid[:total] = ids
    grid = grid.reshape(n, longest)
    table = _Table.of(grid.reshape(-1)[:total])
    entries = table.entries(int(grid.max()))
    others = len(table.ids)
    steps = np.ascontiguousarray(grid.T)
    out, model = _Writer(n, longest * (3 if len(names) == 0 and grid.max() < 65535 else 5) + 16), _Models(n)
    begin = 0
    for t in range(longest):
        if t in REBUILD:
            begin = t
            stop = min([r for r in REBUILD if r > t] + [longest])
            model.rebuild(grid[:, :t])
            spans = np.ascontiguousarray(model.locate(grid[:, t:stop]).T)
        now = steps[t]
        model.predict()
        hit2 = model.p2 == now
        m2 = _mask(hit2)
        m1 = _mask(model.p1 == now) & ~m2
        lost = ~(m2 | m1)
        if model.ready:
            span = spans[t - begin]
            many = span >> 16
            zero, wide0 = model.zero + (span & I(0xFFFF)) * model.unit, many * model.unit
            escape = lost & _mask(many == 0)
            wide0 += (65536 - model.esc) & escape
        else:
            zero, wide0, escape = model.esc, 65536 - model.esc, lost
        out.put(((model.w2 & m1) | (zero & lost)).astype(U), ((model.w2 & m2) | (model.w1 & m1) | (wide0 & lost)).astype(U))
        if (lanes := np.flatnonzero(escape)).size:
            entry = entries.take(now[lanes])
            out.put_some(lanes, table.start.take(entry), table.width.take(entry))
            if (lanes := lanes[entry == others]).size:
                v = now[lanes]
                big = v >= 65535
                out.put_raw(lanes, np.minimum(v, 65535))
                if big.any():
                    out.put_raw(lanes[big], v[big] >> 16)
                    out.put_raw(lanes[big], v[big] & 65535)
        model.update(now, hit2, m2, m1)
    size = out.finish()
    head = np.empty((n, 2), "<u4")
    head[:, 0], head[:, 1] = crc, size
    body = out.words[np.arange(out.words.shape[1]) < size[:, None]].astype("<u2").tobytes()
    packed = table.packed()
    return struct.pack("<QIIII", total, n, len(names), len(table.ids), len(packed)) + packed + names.astype("<u4").tobytes() + head.tobytes() + body


def encode(ids: np.ndarray) -> bytes:
    """Magic, number of frames, their lengths, frames. A frame: counts, the table, the list of ids if any is 2 ** 20 or more, for each
    block its CRC-32 and number of words, then all words."""
    ids = np.asarray(ids)
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= 1 << 32):
        raise ValueError("ids must fit into 32 bits")
    room = BLOCK * LANES
    frames = [_frame(ids[a : a + room]) for a in range(0, len(ids), room)]
    return MAGIC + struct.pack("<I", len(frames)) + b"".join(struct.pack("<Q", len(f)) for f in frames) + b"".join(frames)


def _ids(frame: memoryview) -> np.ndarray:
    total, n, named, entries, packed = struct.unpack_from("<QIIII", frame, 0)
    if not total or n != -(-total // BLOCK):
        raise ValueError("the frame's counts do not agree")
    longest, at = min(BLOCK, total), 24 + packed
    table = _Table.unpacked(frame[24:at], entries)
    own = np.append(table.ids, 0).astype(I)
    names = np.frombuffer(frame, "<u4", named, at).astype(np.int64)
    at += 4 * named
    head = np.frombuffer(frame, "<u4", n * 2, at).reshape(n, 2)
    lengths = head[:, 1].astype(np.int64)
    at += 8 * n
    words = np.zeros((n, int(lengths.max()) + 4), np.uint16)
    words[np.arange(words.shape[1]) < lengths[:, None]] = np.frombuffer(frame, "<u2", int(lengths.sum()), at)
    source, model = _Reader(words), _Models(n)
    steps = np.zeros((longest, n), I)
    for t in range(longest):
        if t in REBUILD:
            model.rebuild(steps[:t].T)
        model.predict()
        v = source.peek()
        hit2 = v < model.w2
        m2 = _mask(hit2)
        m1 = _mask(v < model.zero) & ~m2
        lost = ~(m2 | m1)
        if model.ready:
            # exact once cut off: numerators below 2 ** 16, denominators below 2 ** 7
            slot = ((v - model.zero).astype(np.float32) / model.unit.astype(np.float32)).astype(I)
            at = model.at_slot + np.minimum(np.maximum(slot, I(0)), I(SLOTS))
            span = model.spans.reshape(-1).take(at)
            many = span >> 16
            now = (model.p2 & m2) | (model.p1 & m1) | (model.slots.reshape(-1).take(at) & lost)
            zero, wide0 = model.zero + (span & I(0xFFFF)) * model.unit, many * model.unit
            escape = lost & _mask(many == 0)
            wide0 += (65536 - model.esc) & escape
        else:
            now = (model.p2 & m2) | (model.p1 & m1)
            zero, wide0, escape = model.esc, 65536 - model.esc, lost
        source.take(((model.w2 & m1) | (zero & lost)).astype(U), ((model.w2 & m2) | (model.w1 & m1) | (wide0 & lost)).astype(U))
        if (lanes := np.flatnonzero(escape)).size:
            entry = source.take_some(lanes, table)
            now[lanes] = own.take(entry)
            if (lanes := lanes[entry == entries]).size:
                value = source.take_raw(lanes)
                big = value == 65535
                if big.any():
                    value[big] = source.take_raw(lanes[big]) << 16
                    value[big] |= source.take_raw(lanes[big])
                now[lanes] = value
        steps[t] = now
        model.update(now, hit2, m2, m1)
    ids = np.ascontiguousarray(steps.T).reshape(-1)[:total]
    if named:
        ids = names[np.minimum(ids, named - 1)]
    ids = ids.astype(np.uint32)
    for i in range(n):
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].tobytes()) != head[i, 0]:
            raise ValueError(f"block {i}: the checksum does not hold")
    return ids


def decode(data: bytes) -> np.ndarray:
    """The ids as uint32; raises if a block's checksum does not hold."""
    if data[:6] != MAGIC:
        raise ValueError("not of this format")
    (n,) = struct.unpack_from("<I", data, 6)
    lengths = struct.unpack_from(f"<{n}Q", data, 10)
    at, out, view = 10 + 8 * n, [], memoryview(data)
    for length in lengths:
        out.append(_ids(view[at : at + length]))
        at += length
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
