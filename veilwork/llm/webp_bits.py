"""Prefix codes and bit streams of lossless WebP (VP8L): low bits first, canonical codes."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

# ---- fixed values: the format ----------------------------------------------------------------------
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
MAX_BITS = 15
N_LENGTHS, N_DISTANCES = 24, 40
#: Repeats of a code length: symbol, least count, extra bits.
REPEATS = {16: (3, 2), 17: (3, 3), 18: (11, 7)}
# ---- end of the fixed values -----------------------------------------------------------------------

#: A complete code for code lengths that the writer always uses: thirteen symbols of four bits, six of five.
WRITER_LENGTHS = [5, 5, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 5, 5, 5, 4, 4, 5]


def near_places() -> list[tuple[int, int]]:
    """The 120 nearest places before a pixel that have short distance codes, by distance, then by \\|x\\|, positive first."""
    places = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(places, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


NEAR = near_places()


@lru_cache(maxsize=256)
def near_codes(width: int) -> dict[int, int]:
    """Distance in pixels -> its shortest code."""
    out: dict[int, int] = {}
    for code, (x, y) in enumerate(NEAR, 1):
        out.setdefault(max(1, x + y * width), code)
    return out


def distance_of(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def prefix_of(value: int) -> tuple[int, int, int]:
    """A length or distance code (1 and up) as symbol, number of extra bits, extra bits."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    extra = top - 1
    return 2 * top + ((v >> extra) & 1), extra, v & ((1 << extra) - 1)


def value_of(symbol: int, read) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + read(extra) + 1


# ---- code lengths and codes ------------------------------------------------------------------------


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a prefix code for symbols with these counts, at most ``MAX_BITS``; one symbol alone gets length 1."""
    out = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].tolist()
    n, none = len(weight), 1 << 62
    while True:
        # leaves and inner nodes both come in order of weight, so the two lightest are at the front of their queues
        leaf, inner, parent = [*weight, none, none], [none] * (n + 1), [0] * (2 * n - 1)
        i = j = 0
        for node in range(n, 2 * n - 1):
            a, b = leaf[i], inner[j]
            if a <= b:
                parent[i] = node
                i += 1
                if leaf[i] <= b:
                    inner[node - n] = a + leaf[i]
                    parent[i] = node
                    i += 1
                else:
                    inner[node - n] = a + b
                    parent[n + j] = node
                    j += 1
            else:
                parent[n + j] = node
                j += 1
                if a <= inner[j]:
                    inner[node - n] = a + b
                    parent[i] = node
                    i += 1
                else:
                    inner[node - n] = b + inner[j]
                    parent[n + j] = node
                    j += 1
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:n]) <= MAX_BITS:
            out[used] = depth[:n]
            return out
        weight = [max(1, w >> 2) for w in weight]


@lru_cache(maxsize=16)
def reversal(bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, dtype=np.int64)
    for b in range(bits):
        out |= ((np.arange(1 << bits) >> b) & 1) << (bits - 1 - b)
    return out


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes with their bits in stream order; a lone symbol's code is empty."""
    used = np.flatnonzero(lengths)
    out = np.zeros(len(lengths), dtype=np.uint64)
    if len(used) < 2:
        return out
    order = used[np.lexsort((used, lengths[used]))]
    size = lengths[order].astype(np.int64)
    top = int(size[-1])
    first = np.concatenate([[0], np.cumsum(1 << (top - size))[:-1]])
    out[order] = (reversal(top)[first]).astype(np.uint64)  # high bits beyond the code are 0
    return out


def codes_of_each(lengths: np.ndarray) -> np.ndarray:
    """``codes_of`` of each row."""
    out = np.zeros(lengths.shape, dtype=np.uint64)
    row, symbol = np.nonzero(lengths)
    if not len(row):
        return out
    size = lengths[row, symbol].astype(np.int64)
    order = np.argsort(row << 4 | size, kind="stable")
    row, symbol, size = row[order], symbol[order], size[order]
    share = 1 << (MAX_BITS - size)
    before = np.cumsum(share) - share
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    before -= np.repeat(before[begins], np.diff(begins, append=len(row)))
    out[row, symbol] = reversal(MAX_BITS)[before].astype(np.uint64)
    return out


def table_of(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """``symbol << 4 | length`` for each value of the next bits, and how many bits that are."""
    used = np.flatnonzero(lengths)
    if not len(used):
        raise ValueError("a prefix code without symbols")
    if len(used) == 1:
        return np.array([int(used[0]) << 4], dtype=np.int32), 0
    order = used[np.lexsort((used, lengths[used]))]
    size = lengths[order].astype(np.int64)
    top = int(size[-1])
    straight = np.repeat((order << 4 | size).astype(np.int32), 1 << (top - size))
    if len(straight) != 1 << top:
        raise ValueError("a prefix code that isn't complete")
    return straight[reversal(top)], top


# ---- streams ---------------------------------------------------------------------------------------


class Writer:
    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.size
        self.size += bits

    def put_all(self, values: np.ndarray, bits: np.ndarray) -> None:
        """Many values (uint64, under 64 bits each) at once."""
        if not len(values):
            return
        lead = self.size & 63
        ends = np.cumsum(bits) + lead
        at = ends - bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = np.zeros((int(ends[-1]) >> 6) + 2, dtype=np.uint64)
        head = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[head]] = np.bitwise_or.reduceat(values << shift, head)
        over = np.flatnonzero((shift.astype(np.int64) + bits) > 64)
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
        kept = self.size - lead
        low = self.value >> kept
        out[0] |= np.uint64(low)
        self.value = (self.value & ((1 << kept) - 1)) | int.from_bytes(out.tobytes(), "little") << kept
        self.size = kept + int(ends[-1])

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.size // 8), "little")


def bytes_of_each(writers: list[Writer], values: np.ndarray, bits: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """What each writer holds and then its ``counts`` of the values (as in ``put_all``, one writer's after the other's)."""
    ends = np.cumsum(bits)
    last = np.cumsum(counts) - 1
    total = np.diff(ends[last], prepend=0)
    lead = np.array([w.size & 63 for w in writers])
    words = (lead + total >> 6) + 2
    begin = np.cumsum(words) - words
    at = ends - bits + np.repeat((begin << 6) + lead - (ends[last] - total), counts)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros(int(words.sum()), dtype=np.uint64)
    head = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[head]] = np.bitwise_or.reduceat(values << shift, head)
    over = np.flatnonzero((at & 63) + bits > 64)
    out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    done = []
    for w, a, n, more, k in zip(writers, begin.tolist(), words.tolist(), total.tolist(), lead.tolist()):
        kept = w.size - k
        out[a] |= np.uint64(w.value >> kept)
        low = (w.value & ((1 << kept) - 1)).to_bytes(kept >> 3, "little")
        done.append(low + out[a : a + n].tobytes()[: -(-(k + more) // 8)])
    return done


class Reader:
    """Bits from ``at`` on; bits beyond the end are 0."""

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at
        self.mark: tuple | None = None  # of the last code: where it starts and its last run of zeros does, the lengths before that, and their code
        self.chunk, self.value = -1, 0

    def peek(self, bits: int) -> int:
        k = self.at >> 10
        if k != self.chunk:
            self.chunk, self.value = k, int.from_bytes(self.raw[k << 7 : (k << 7) + 136], "little")
        return (self.value >> (self.at & 1023)) & ((1 << bits) - 1)

    def bits(self, start: int, end: int) -> int:
        """The bits of a stretch, as one number."""
        return int.from_bytes(self.raw[start >> 3 : (end + 7) >> 3], "little") >> (start & 7) & ((1 << (end - start)) - 1)

    def read(self, bits: int) -> int:
        out = self.peek(bits)
        self.at += bits
        return out

    def symbol(self, table: list[int] | np.ndarray, bits: int) -> int:
        e = int(table[self.peek(bits)])
        self.at += e & 15
        return e >> 4


# ---- codes in streams ------------------------------------------------------------------------------

_WRITER_CODES = codes_of(np.array(WRITER_LENGTHS, dtype=np.uint8)).tolist()


@lru_cache(maxsize=512)
def _written(raw: bytes, zeros: int) -> tuple[int, int]:
    """A code whose lengths are ``raw`` (the last one not 0) and then ``zeros`` times 0."""
    lengths = np.frombuffer(raw, np.uint8)
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and (not used or used[-1] < 256):
        w = Writer()
        first = used[0] if used else 0
        w.put(1, 1)
        w.put(max(0, len(used) - 1), 1)
        wide = first > 1
        w.put(wide, 1)
        w.put(first, 8 if wide else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return w.value, w.size
    value, size = _listed(raw)
    tail, more = _run(0, zeros)
    return value | tail << size, size + more


@lru_cache(maxsize=512)
def _listed(raw: bytes) -> tuple[int, int]:
    digits = [_digits(m.group()) for m in _EQUAL.finditer(raw)]
    digits.reverse()  # low bits first
    text = "".join(digits)
    value, size = _HEAD
    return value | int(text or "0", 2) << size, size + len(text)


_EQUAL = re.compile(rb"(.)\1*", re.DOTALL)


@lru_cache(maxsize=4096)
def _digits(run: bytes) -> str:
    value, size = _run(run[0], len(run))
    return format(value, f"0{size}b")


@lru_cache(maxsize=4096)
def _run(v: int, n: int) -> tuple[int, int]:
    """``n`` equal code lengths."""
    w = Writer()
    if v and n:
        w.put(_WRITER_CODES[v], WRITER_LENGTHS[v])
        n -= 1
    while n:
        kind, step = v, 1
        if v == 0 and n >= 11:
            kind, step = 18, min(n, 138)
        elif n >= 3:
            kind, step = (16, min(n, 6)) if v else (17, n)
        w.put(_WRITER_CODES[kind], WRITER_LENGTHS[kind])
        if kind in REPEATS:
            least, extra = REPEATS[kind]
            w.put(step - least, extra)
        n -= step
    return w.value, w.size


@lru_cache(maxsize=1)
def _many_table() -> list[tuple[int, tuple[int, ...], int]]:
    """For each value of the next 12 bits in the writer's own code of lengths: bits, lengths that are whole in them and
    precede any repeat, and the last of those that isn't 0."""
    table, bits = _small_table(bytes(WRITER_LENGTHS))
    out = []
    for v in range(1 << 12):
        at, some, lately = 0, [], 0
        while at < 12:
            e = table[(v >> at) & ((1 << bits) - 1)]
            if e >> 4 > 15 or at + (e & 15) > 12:
                break
            at += e & 15
            some.append(e >> 4)
            lately = some[-1] or lately
        out.append((at, tuple(some), lately))
    return out


def _head() -> tuple[int, int]:
    """What precedes the code lengths: the code that they are written in, and that all of them follow."""
    w = Writer()
    w.put(0, 1)
    w.put(len(CODE_LENGTH_ORDER) - 4, 4)
    for s in CODE_LENGTH_ORDER:
        w.put(WRITER_LENGTHS[s], 3)
    w.put(0, 1)
    return w.value, w.size


_HEAD = _head()
_WRITER_KINDS = bytes(WRITER_LENGTHS)


def write_code(w: Writer, lengths: np.ndarray) -> None:
    raw = lengths.tobytes()
    short = raw.rstrip(b"\0")
    w.put(*_written(short, len(raw) - len(short)))


def read_code(r: Reader, alphabet: int, like: tuple | None = None) -> np.ndarray:
    """Code lengths of an alphabet's symbols. ``like``: the reader's mark of an earlier code; where this one has the same
    bits up to there, they aren't read again."""
    out = np.zeros(alphabet, dtype=np.uint8)
    begun, r.mark = r.at, None
    lengths: list[int] = []
    last, left = 8, alphabet
    if like and len(like[2]) <= alphabet and r.bits(begun, begun + like[1] - like[0]) == r.bits(like[0], like[1]):
        r.at += like[1] - like[0]
        lengths += like[2]
        last, left, kinds = next((x for x in reversed(lengths) if x), 8), alphabet - len(lengths), like[3]
    elif r.bits(begun, begun + _HEAD[1]) == _HEAD[0]:
        r.at += _HEAD[1]
        kinds = _WRITER_KINDS
    elif r.read(1):
        two = r.read(1)
        symbols = [r.read(8 if r.read(1) else 1)]
        if two:
            symbols.append(r.read(8))
        out[symbols] = 1
        return out
    else:
        some_kinds = bytearray(19)
        for i in range(4 + r.read(4)):
            some_kinds[CODE_LENGTH_ORDER[i]] = r.read(3)
        left = 2 + r.read(2 + 2 * r.read(3)) if r.read(1) else alphabet
        kinds = bytes(some_kinds)
    all_written = left == alphabet - len(lengths)
    table, bits = _small_table(kinds)
    low = (1 << bits) - 1
    start = r.at
    value, at = r.bits(start, start + 640), 0
    many = _many_table() if all_written and kinds == _WRITER_KINDS else None
    near_end = alphabet - 3 if many else -1
    mark, zeros_to = None, -1
    while len(lengths) < alphabet and left:
        if at > 600:  # a symbol takes 14 bits at most
            start += at
            value, at = r.bits(start, start + 640), 0
        if len(lengths) <= near_end:
            n, some, lately = many[value & 4095]
            if n:  # up to three lengths at once
                lengths += some
                last = lately or last
                left -= len(some)
                value >>= n
                at += n
                continue
        left -= 1
        e = table[value & low]
        n, s = e & 15, e >> 4
        if s < 16:
            lengths.append(s)
            last = s or last
        else:
            if s > 16 and len(lengths) != zeros_to:
                mark = start + at, len(lengths)
            least, extra = REPEATS[s]
            lengths += [last if s == 16 else 0] * (least + ((value >> n) & ((1 << extra) - 1)))
            zeros_to = len(lengths) if s > 16 else -1
            n += extra
        value >>= n
        at += n
    r.at = start + at
    if len(lengths) > alphabet:
        raise ValueError("too many code lengths")
    if mark and all_written and not like:
        r.mark = begun, mark[0], lengths[: mark[1]], kinds
    out[: len(lengths)] = lengths
    return out


@lru_cache(maxsize=64)
def _small_table(raw: bytes) -> tuple[list[int], int]:
    table, bits = table_of(np.frombuffer(raw, np.uint8))
    return table.tolist(), bits
