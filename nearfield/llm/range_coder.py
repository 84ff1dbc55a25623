"""An adaptive context-mixing range coder for token ids.

Ids are cut into blocks that are coded independently: every block starts with fresh models and carries a checksum. Up to
LANES blocks are coded side by side, one id of each at a time, as arrays; what that takes is bounded, however many there are.

For each id, an order-2 and an order-1 model each predict one id from the ids before it, with a confidence. Which of them
is right, if any, is coded with a mixture of two adaptive distributions, one given the confidences and one given the
recent outcomes, whose weights follow the better one. An id that neither predicts is coded by an adaptive order-0 model,
four bits at a time. Probabilities have 15 bits; the coder keeps a 48-bit interval and moves 16 bits at a time.
"""

import zlib

import numpy as np

BITS, TOP = 15, 1 << 15
ORDER1, ORDER2, LITERAL_ROWS = 1 << 10, 1 << 11, 783
#: Blocks that are coded at a time.
LANES = 1536
_LOW = np.uint64((1 << 48) - 1)
_U = np.uint64
#: Where a row of cumulative chances moves when a value comes (by value); neighbours stay apart by 32, and so a chance
#: of 16 in 32768 is left to every value after any number of moves.
_AT = np.arange(16)
_NIBBLE_TARGET = np.where(_AT[None, :] > _AT[:, None], TOP - 32 * (16 - _AT[None, :]), 32 * _AT[None, :]).astype(np.int16)
_HISTORY = 27


class _Model:
    """The adaptive models of ``lanes`` blocks. Arrays are flat, and read by ``take``: lanes are many and far apart."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes, dtype=np.int64)
        self.guess1, self.trust1 = np.zeros(lanes * ORDER1, np.int32), np.zeros(lanes * ORDER1, np.int8)
        self.guess2, self.trust2 = np.zeros(lanes * ORDER2, np.int32), np.zeros(lanes * ORDER2, np.int8)
        # Cumulative chances of the outcomes 0 (order 2 is right), and 0 or 1 (order 1 is right); 2 is the rest.
        self.by_trust = np.tile(np.array([[TOP // 3], [2 * TOP // 3]], np.int32), (1, lanes * 32))
        self.by_past = np.tile(np.array([[TOP // 3], [2 * TOP // 3]], np.int32), (1, lanes * _HISTORY))
        self.weight = np.full(lanes, 128, np.int32)
        self.past = np.zeros(lanes, np.int64)
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.rows = np.tile(np.arange(16, dtype=np.int16) * (TOP // 16), (lanes * LITERAL_ROWS, 1))
        self.whole_rows = self.rows.view("V32").ravel()

    def predict(self, k: int):
        """For the first ``k`` lanes: both guesses with their confidences, and the bounds between outcomes."""
        one, two, lane = self.one[:k], self.two[:k], self.lane[:k]
        self.at1 = lane * ORDER1 + ((one * 40503 >> 3) & (ORDER1 - 1))
        self.at2 = lane * ORDER2 + ((one * 40503 + two * 60493 >> 4) & (ORDER2 - 1))
        self.g1, self.t1 = self.guess1.take(self.at1), self.trust1.take(self.at1)
        self.g2, self.t2 = self.guess2.take(self.at2), self.trust2.take(self.at2)
        self.row_a = (self.t2 * 8 + self.t1 * 2 + (self.g1 == self.g2)).astype(np.int64) * len(self.lane) + lane
        self.row_b = self.past[:k] * len(self.lane) + lane
        self.a = [x.take(self.row_a) for x in self.by_trust]
        self.b = [x.take(self.row_b) for x in self.by_past]
        w = self.weight[:k]
        first, second = (((w * a + (256 - w) * b) >> 8) * (TOP - 96) >> 15 for a, b in zip(self.a, self.b))
        return first + 32, second + 64

    def settle(self, ids: np.ndarray, outcome: np.ndarray):
        """Learns which outcome and which ids came."""
        k = len(ids)
        first, second, rest = (x - y for x, y in zip((self.a[0], self.a[1] - self.a[0], self.b[1]), (self.b[0], self.b[1] - self.b[0], self.a[1])))
        better = np.where(outcome == 2, rest, np.where(outcome == 1, second, first)) > 0
        self.weight[:k] = np.clip(self.weight[:k] + np.where(better, 3, -3), 16, 240)
        for i in (0, 1):
            goal = (outcome <= i) * np.int32(TOP)
            self.by_trust[i][self.row_a] = self.a[i] + ((goal - self.a[i]) >> 4)
            self.by_past[i][self.row_b] = self.b[i] + ((goal - self.b[i]) >> 5)
        self.past[:k] = (self.past[:k] * 3 + outcome) % _HISTORY
        for at, guess, trust, g, t in ((self.at1, self.guess1, self.trust1, self.g1, self.t1), (self.at2, self.guess2, self.trust2, self.g2, self.t2)):
            after = np.where(g == ids, np.minimum(t + 1, 3), t >> 1).astype(np.int8)
            guess[at] = np.where(after == 0, ids, g)
            trust[at] = np.maximum(after, 1)
        self.two[:k] = self.one[:k]
        self.one[:k] = ids

    def literal_rows(self, lanes: np.ndarray, number: int, before: np.ndarray):
        """Rows of the order-0 model of ``lanes`` for the ``number``-th four bits after the bits ``before``, and their chances."""
        if number < 2:
            place = before + number
        elif number == 2:
            place = before + 17
        else:
            place = 273 + (before * 2654435761 >> 12) % (LITERAL_ROWS - 273)
        # All lanes' rows of a place lie together: lanes at the same place are read one after the other.
        row = place * len(self.lane) + lanes
        return row, self.rows.take(row, axis=0)

    def learn_nibble(self, row: np.ndarray, chances: np.ndarray, nibble: np.ndarray):
        goal = _NIBBLE_TARGET.take(nibble, axis=0)
        goal -= chances
        goal >>= 4
        goal += chances
        self.whole_rows[row] = goal.view("V32").ravel()


def _nibble_bounds(chances: np.ndarray, nibble: np.ndarray):
    """The interval of a value of four bits."""
    at = np.arange(0, 16 * len(nibble), 16) + nibble
    flat = chances.reshape(-1)
    high = np.where(nibble == 15, np.int32(TOP), flat.take(at + 1, mode="clip"))
    return flat.take(at), high


def _nibble_of(chances: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value of four bits whose interval holds ``value``: how many lower bounds do not exceed it, less one."""
    ones = (chances <= value.astype(np.int16)[:, None]).view(np.uint64)
    ones = (ones[:, 0] + ones[:, 1]) * _U(0x0101010101010101) >> _U(56)
    return ones.astype(np.int64) - 1


class _Encoder:
    def __init__(self, lanes: int, most: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64)
        self.words, self.size = np.zeros((lanes, most), np.uint32), np.zeros(lanes, np.int64)

    def make_room(self):
        """For 8 ids, of up to 8 words each."""
        if int(self.size.max()) + 72 > self.words.shape[1]:
            self.words = np.concatenate((self.words, np.zeros_like(self.words)), axis=1)

    def put(self, low, high, lanes):
        """Narrows the intervals of ``lanes`` to [low, high) of TOP."""
        step = self.range.take(lanes) >> _U(BITS)
        low = low.astype(np.uint64)
        at = self.low.take(lanes) + step * low
        span = step * (high.astype(np.uint64) - low)
        flat, width = self.words.reshape(-1), self.words.shape[1]
        over = np.flatnonzero(at > _LOW)
        if len(over):
            over = lanes.take(over)
            flat[over * width + self.size.take(over) - 1] += np.uint32(1)
            at &= _LOW
        short = np.flatnonzero(span < _U(1 << 32))
        if len(short):
            cut = at.take(short)
            at[short] = (cut << _U(16)) & _LOW
            span[short] <<= _U(16)
            short = lanes.take(short)
            flat[short * width + self.size.take(short)] = cut >> _U(32)
            self.size[short] += 1
        self.low[lanes], self.range[lanes] = at, span

    def finish(self) -> list[bytes]:
        self.make_room()
        lane = np.arange(len(self.low))
        for shift in (32, 16, 0):
            self.words[lane, self.size] = ((self.low >> _U(shift)) & _U(0xFFFF)).astype(np.uint32)
            self.size += 1
        for j in range(int(self.size.max()) - 1, 0, -1):  # carries that passed on
            self.words[:, j - 1] += self.words[:, j] >> np.uint32(16)
            self.words[:, j] &= np.uint32(0xFFFF)
        out = self.words.astype("<u2")
        return [out[i, : self.size[i]].tobytes() for i in range(len(out))]


class _Decoder:
    def __init__(self, blocks: list[bytes]):
        self.width = max(len(b) for b in blocks) // 2 + 2
        words = np.zeros((len(blocks), self.width), np.uint16)
        for i, b in enumerate(blocks):
            words[i, : len(b) // 2] = np.frombuffer(b, dtype="<u2")
        self.range = np.full(len(blocks), 1 << 48, np.uint64)
        first = words[:, :3].astype(np.uint64)
        self.code = (first[:, 0] << _U(32)) | (first[:, 1] << _U(16)) | first[:, 2]
        self.words, self.at = words.reshape(-1), np.arange(len(blocks)) * self.width + 3

    def value(self, lanes: np.ndarray) -> np.ndarray:
        self.step, self.now = self.range.take(lanes) >> _U(BITS), self.code.take(lanes)
        return np.minimum(self.now // self.step, _U(TOP - 1)).astype(np.int32)

    def drop(self, low, high, lanes):
        """Takes the value in [low, high) off ``lanes``, as ``value`` saw them."""
        low = low.astype(np.uint64)
        code = self.now - self.step * low
        span = self.step * (high.astype(np.uint64) - low)
        short = np.flatnonzero(span < _U(1 << 32))
        if len(short):
            moved = lanes.take(short)
            at = self.at.take(moved)
            code[short] = (code.take(short) << _U(16)) | self.words.take(at, mode="clip")  # a damaged block may run out
            self.at[moved] = at + 1
            span[short] <<= _U(16)
        self.code[lanes], self.range[lanes] = code, span


def _nibble_count(largest: int) -> int:
    return max(1, (int(largest).bit_length() + 3) // 4)


def _active(sizes: np.ndarray):
    """For each step, how many lanes go on; lanes are ordered by falling size."""
    return [int((sizes > t).sum()) for t in range(int(sizes[0]))] if len(sizes) else []


def _lengths(n: int, block: int) -> np.ndarray:
    return np.array([block] * (n // block) + [n % block] * (n % block > 0), dtype=np.int64)


def encode(ids: np.ndarray, block: int) -> list[bytes]:
    """Blocks of ``block`` ids each (the last one may be shorter): number of ids, checksum of the ids, width in four
    bits (little-endian, 4 + 4 + 1 bytes), then the code."""
    if not len(ids):
        return []
    nibbles, group = _nibble_count(ids.max()), LANES * block
    return [b for at in range(0, len(ids), group) for b in _encode_lanes(ids[at : at + group], block, nibbles)]


def _encode_lanes(ids: np.ndarray, block: int, nibbles: int) -> list[bytes]:
    sizes = _lengths(len(ids), block)
    padded = np.zeros(len(sizes) * block, np.int32)
    padded[: len(ids)] = ids
    steps = np.ascontiguousarray(padded.reshape(len(sizes), block).T)
    model, coder = _Model(len(sizes)), _Encoder(len(sizes), block + 72)
    for t, k in enumerate(_active(sizes)):
        if t % 8 == 0:
            coder.make_room()
        now = steps[t, :k].astype(np.int64)
        first, second = model.predict(k)
        outcome = np.where((model.g2 == now) & (model.t2 > 0), 0, np.where((model.g1 == now) & (model.t1 > 0), 1, 2))
        coder.put(np.where(outcome == 0, 0, np.where(outcome == 1, first, second)), np.where(outcome == 0, first, np.where(outcome == 1, second, TOP)), model.lane[:k])
        literal = np.flatnonzero(outcome == 2)
        value, before = now.take(literal), np.zeros(len(literal), np.int64)
        for i in range(nibbles if len(literal) else 0):
            nibble = (value >> (4 * (nibbles - 1 - i))) & 15
            row, chances = model.literal_rows(literal, i, before)
            coder.put(*_nibble_bounds(chances, nibble), literal)
            model.learn_nibble(row, chances, nibble)
            before = before * 16 + nibble
        model.settle(now, outcome)
    head = np.zeros(len(sizes), dtype=_HEAD)
    head["n"], head["nibbles"] = sizes, nibbles
    head["crc"] = [zlib.crc32(ids[i * block : i * block + n].astype("<u4").tobytes()) for i, n in enumerate(sizes)]
    return [head[i : i + 1].tobytes() + code for i, code in enumerate(coder.finish())]


_HEAD = np.dtype([("n", "<u4"), ("crc", "<u4"), ("nibbles", "u1")])


def decode(blocks: list[bytes]) -> np.ndarray:
    """The ids of ``blocks`` that one call of ``encode`` made; raises when a checksum doesn't fit."""
    parts = [_decode_lanes(blocks[at : at + LANES]) for at in range(0, len(blocks), LANES)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _decode_lanes(blocks: list[bytes]) -> np.ndarray:
    head = np.concatenate([np.frombuffer(b[: _HEAD.itemsize], dtype=_HEAD) for b in blocks])
    sizes, nibbles = head["n"].astype(np.int64), int(head["nibbles"][0])
    model, coder = _Model(len(blocks)), _Decoder([b[_HEAD.itemsize :] for b in blocks])
    out = np.zeros((int(sizes[0]), len(blocks)), np.int32)
    for t, k in enumerate(_active(sizes)):
        first, second = model.predict(k)
        lanes = model.lane[:k]
        value = coder.value(lanes)
        outcome = (value >= first).astype(np.int64) + (value >= second)
        coder.drop(np.where(outcome == 0, 0, np.where(outcome == 1, first, second)), np.where(outcome == 0, first, np.where(outcome == 1, second, TOP)), lanes)
        literal = np.flatnonzero(outcome == 2)
        before = np.zeros(len(literal), np.int64)
        for i in range(nibbles if len(literal) else 0):
            row, chances = model.literal_rows(literal, i, before)
            nibble = _nibble_of(chances, coder.value(literal))
            coder.drop(*_nibble_bounds(chances, nibble), literal)
            model.learn_nibble(row, chances, nibble)
            before = before * 16 + nibble
        now = np.where(outcome == 0, model.g2, model.g1).astype(np.int64)
        now[literal] = before
        out[t, :k] = now
        model.settle(now, outcome)
    parts = [out[:n, i] for i, n in enumerate(sizes)]
    for n, crc, ids in zip(sizes, head["crc"], parts):
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block of token ids is damaged")
    return np.concatenate(parts).astype(np.int64)
