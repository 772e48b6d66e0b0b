"""Lossless WebP: a decoder for the whole format, and an encoder.

Pixels are ARGB in ``uint32``, in rows. Images with one set of prefix codes are decoded without a step per symbol: the pixel that would start at each
bit of a stretch of the stream is looked up for all bits at once, and the true starts
are then followed from one to the next; what a colour cache gives is found afterwards, for
all pixels at once. Other images (and the small ones inside, which
hold palettes and the blocks of transforms) go symbol by symbol.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .webp_bits import (
    N_DISTANCES,
    N_LENGTHS,
    Reader,
    Writer,
    bytes_of_each,
    code_lengths,
    codes_of,
    codes_of_each,
    distance_of,
    near_codes,
    prefix_of,
    read_code,
    table_of,
    value_of,
    write_code,
)

# ---- fixed values: the format ----------------------------------------------------------------------
SIGNATURE = 0x2F
MAX_SIDE = 1 << 14
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
CACHE_MUL = 0x1E35A7BD
OPAQUE = 0xFF000000
# ---- end of the fixed values -----------------------------------------------------------------------

#: Bits of the stream that are looked up at a time.
STRETCH = 1 << 16
#: Shortest copy (pixels) that the encoder writes.
MIN_COPY = 16
MAX_COPY = 4096


def channels(px: np.ndarray) -> np.ndarray:
    """``(n, 4)`` bytes: blue, green, red, alpha."""
    return np.ascontiguousarray(px, dtype="<u4").view(np.uint8).reshape(-1, 4)


def pixels(ch: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(ch, dtype=np.uint8).reshape(-1, 4).view("<u4").ravel()


def blocks_of(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


# ---- decoding: pixels ------------------------------------------------------------------------------


class Codes:
    """The five prefix codes of one group."""

    def __init__(self, r: Reader, cache_bits: int):
        extra = 1 << cache_bits if cache_bits else 0
        self.cache_bits = cache_bits
        self.lengths: list[np.ndarray] = []
        self.tables: list[tuple[np.ndarray, int]] = []
        self.same = [-1] * 5  # an earlier code that this one is a copy of
        start = 0
        for k, n in enumerate((256 + N_LENGTHS + extra, 256, 256, 256, N_DISTANCES)):
            begun = r.at
            if k == 2 and r.bits(begun, begun + begun - start) == r.bits(start, begun):
                r.at += begun - start  # blue is written as red is
                self.same[2] = 1
                self.lengths.append(self.lengths[1])
                self.tables.append(self.tables[1])
                continue
            x = read_code(r, n, mark if k == 1 else None)
            if k == 0:
                mark = r.mark
            self.lengths.append(x)
            if k == 1 and not self.lengths[0][256:].any() and np.array_equal(x, self.lengths[0][:256]):
                self.same[1] = 0
                self.tables.append(self.tables[0])
            else:
                self.tables.append(table_of(x) if x.any() else (np.zeros(1, np.int32), 0))
            start = begun
        self._lists: list | None = None

    def lists(self) -> list:
        if self._lists is None:
            self._lists = [(t.tolist(), b) for t, b in self.tables]
        return self._lists


def read_pixels(r: Reader, width: int, height: int, main: bool) -> np.ndarray:
    return _pixels_of(r, width, height, *_read_codes(r, width, height, main))


def _read_codes(r: Reader, width: int, height: int, main: bool) -> tuple:
    """What precedes the pixels: the codes of each group, the group of each block, bits of the blocks and of the cache."""
    cache_bits = r.read(4) if r.read(1) else 0
    group_bits, group_of, n_groups = 0, None, 1
    if main and r.read(1):
        group_bits = r.read(3) + 2
        entropy = read_pixels(r, blocks_of(width, group_bits), blocks_of(height, group_bits), False)
        group_of = ((entropy >> 8) & 0xFFFF).astype(np.int64)
        n_groups = int(group_of.max()) + 1
    return [Codes(r, cache_bits) for _ in range(n_groups)], group_of, group_bits, cache_bits


def _pixels_of(r: Reader, width: int, height: int, groups: list[Codes], group_of, group_bits: int, cache_bits: int) -> np.ndarray:
    if len(groups) == 1 and width * height > 64:
        begun = r.at
        px = _read_stretches(r, width, width * height, groups[0])
        if px is not None:
            return px
        r.at = begun
    return _read_symbols(r, width, width * height, groups, group_of, group_bits, cache_bits)


def _read_symbols(r: Reader, width: int, total: int, groups: list[Codes], group_of, group_bits: int, cache_bits: int) -> np.ndarray:
    out: list[int] = []
    cache = [0] * (1 << cache_bits) if cache_bits else []
    shift = 32 - cache_bits
    lists = [[(t, (1 << b) - 1) for t, b in g.lists()] for g in groups]
    group_at = None
    if group_of is not None:
        y, x = np.divmod(np.arange(total), width)
        group_at = group_of[(y >> group_bits) * blocks_of(width, group_bits) + (x >> group_bits)].tolist()
    seen = done = 0  # pixels that the cache knows, and all
    (first, m0), (reds, m1), (blues, m2), (alphas, m3), _ = lists[0]
    group, base, words, at, limit = 0, 0, [], 0, -1  # ``at``: bits after byte ``base``
    while done < total:
        if at > limit:
            base = (r.at if limit < 0 else 8 * base + at) >> 3
            at = (r.at if limit < 0 else at) & 7
            words, limit = _words(r.raw, base)
        if group_at is not None and group_at[done] != group:
            group = group_at[done]
            (first, m0), (reds, m1), (blues, m2), (alphas, m3), _ = lists[group]
        e = first[words[at >> 3] >> (at & 7) & m0]
        at += e & 15
        s = e >> 4
        if s < 256:
            red = reds[words[at >> 3] >> (at & 7) & m1]
            at += red & 15
            blue = blues[words[at >> 3] >> (at & 7) & m2]
            at += blue & 15
            alpha = alphas[words[at >> 3] >> (at & 7) & m3]
            at += alpha & 15
            out.append(alpha >> 4 << 24 | red >> 4 << 16 | s << 8 | blue >> 4)
            done += 1
            continue
        if cache_bits:
            for p in out[seen:]:
                cache[(p * CACHE_MUL & 0xFFFFFFFF) >> shift] = p
            seen = done
        if s >= 256 + N_LENGTHS:
            out.append(cache[s - 256 - N_LENGTHS])
            done += 1
        else:
            r.at = 8 * base + at
            _copy(out, *_read_copy(r, s, groups[group].lists()[4], width), total)
            at, done = r.at - 8 * base, len(out)
    if limit >= 0:
        r.at = 8 * base + at
    return np.array(out, dtype=np.uint32)


def _words(raw: bytes, base: int) -> tuple[list[int], int]:
    """The 32 bits from each byte on, zeros beyond the end, and the last bit at which a pixel may start."""
    piece = raw[base : base + STRETCH // 2 + 64]
    b = np.frombuffer(piece + bytes(67), np.uint8).astype(np.uint32)
    got = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    return got.tolist(), min(4 * STRETCH, 8 * len(piece))


def _read_copy(r: Reader, s: int, code, width: int) -> tuple[int, int]:
    length = value_of(s - 256, r.read)
    return length, distance_of(value_of(r.symbol(*code), r.read), width)


def _copy(out: list[int], length: int, distance: int, total: int) -> None:
    start = len(out) - distance
    if start < 0 or len(out) + length > total:
        raise ValueError("a copy from outside the image")
    for i in range(start, start + length):
        out.append(out[i])


def _windows(raw: np.ndarray, start: int, bits: int) -> np.ndarray:
    """The 15 bits from each of ``bits`` places on, from byte ``start`` of ``raw`` (padded)."""
    n = bits // 8
    b = raw[start : start + n + 2].astype(np.intp)
    three = b[:n] | b[1 : n + 1] << 8 | b[2 : n + 2] << 16
    return ((three[:, None] >> np.arange(8)) & 0x7FFF).ravel()


def _read_stretches(r: Reader, width: int, total: int, codes: Codes) -> np.ndarray | None:
    """None: a place of the colour cache is read that holds nothing yet."""
    out = np.empty((total, 4), dtype=np.uint8)
    slots = np.full(total, -1, dtype=np.int64) if codes.cache_bits else None  # of the cache, for pixels taken from there
    jumps: list[tuple[int, int, int]] = []  # copies: at, length, distance
    _stretches(r, width, total, codes, 0, out, slots, jumps)
    return _resolved(pixels(out), slots, jumps, codes.cache_bits)


def _resolved(px: np.ndarray, slots: np.ndarray | None, jumps: list[tuple[int, int, int]], cache_bits: int) -> np.ndarray | None:
    if cache_bits:
        return _from_cache(px, slots, jumps, cache_bits)
    _repeat(px, jumps)
    return px


def _stretches(r: Reader, width: int, total: int, codes: Codes, done: int, out: np.ndarray, slots: np.ndarray | None, jumps: list) -> None:
    """Literals to ``out``, slots of the cache to ``slots`` and copies to ``jumps``, from pixel ``done`` on."""
    raw = np.frombuffer(r.raw, np.uint8)
    lone_alpha, cache_bits = codes.tables[3][1] == 0, codes.cache_bits
    while done < total:
        base = r.at >> 3
        want = min(STRETCH, 8 * (len(raw) - base) + 64)
        pad = base + want // 8 + 80 - len(raw)
        piece = raw[base : base + want // 8 + 80]
        if pad > 0:
            piece = np.concatenate([piece, np.zeros(pad, np.uint8)])
        bits = (want // 8 + 64) * 8
        w = _windows(piece, 0, bits)
        e = []
        for k in range(3):
            table, n = codes.tables[k]
            e.append(e[codes.same[k]] if codes.same[k] >= 0 else table.astype(np.intp).take(w & ((1 << n) - 1)))
        size = []
        for k, x in enumerate(e):
            size.append(size[codes.same[k]] if codes.same[k] >= 0 else x & 15)
        limit = bits - 64
        at = np.arange(limit)
        red_at = at + size[0][:limit]
        blue_at = red_at + size[1].take(red_at)
        after = blue_at + size[2].take(blue_at)
        if lone_alpha:
            alpha_at = None
        else:
            table, n = codes.tables[3]
            alpha = table[w & ((1 << n) - 1)]
            alpha_at, after = after, after + (alpha & 15)[after]
        last_bit = want - 64 if want == STRETCH else limit
        after[last_bit:] = 0
        if codes.lengths[0][256:].any():
            symbol = e[0][:limit] >> 4
            if cache_bits:
                after = np.where(symbol >= 256 + N_LENGTHS, red_at, after)
                after[last_bit:] = 0
                symbol = np.where(symbol >= 256 + N_LENGTHS, 0, symbol)
            after[symbol >= 256] = 0
        follow, p = memoryview(after), r.at - 8 * base
        starts: list[int] = []
        take, first = starts.append, done
        green = codes.tables[0]
        if green[1] == 0 and int(green[0][0]) >> 4 < 256 and codes.tables[1][1] == codes.tables[2][1] == 0 and lone_alpha:
            starts, done = [p] * (total - done), total  # no bits at all: one colour
        spans: list[tuple[int, int]] = []  # where literals go: first pixel, number
        while done < total and p < last_bit:
            before = len(starts)
            for _ in range(total - done):
                q = follow[p]
                if not q:
                    break
                take(p)
                p = q
            if len(starts) > before:
                spans.append((done, len(starts) - before))
                done += len(starts) - before
            if done < total and p < last_bit:
                r.at = 8 * base + p
                length, distance = _read_copy(r, r.symbol(*codes.tables[0]), codes.tables[4], width)
                if distance > done or done + length > total:
                    raise ValueError("a copy from outside the image")
                jumps.append((done, length, distance))
                done += length
                p = r.at - 8 * base
        if first < done and not spans and starts:
            spans = [(first, len(starts))]
        r.at = 8 * base + p
        if starts:
            s = np.array(starts, dtype=np.int64)
            got = np.empty((len(s), 4), dtype=np.uint8)
            symbols = e[0][s] >> 4
            got[:, 1] = symbols & 255
            got[:, 2] = e[1][red_at[s]] >> 4
            got[:, 0] = e[2][blue_at[s]] >> 4
            got[:, 3] = int(codes.tables[3][0][0]) >> 4 if alpha_at is None else alpha[alpha_at[s]] >> 4
            k = 0
            for a, n in spans:
                out[a : a + n] = got[k : k + n]
                if cache_bits:
                    slots[a : a + n] = symbols[k : k + n] - (256 + N_LENGTHS)
                k += n
        if r.at > 8 * len(raw) and done < total:
            raise ValueError("the stream ends early")


#: Images read side by side, and the fewest that are; steps kept before their pixels are written.
LANES, FEW_LANES, LANE_STEPS = 4096, 40, 256
#: Bytes of files and pixels taken together (or a single image): bounds memory.
LANE_BYTES, LANE_PIXELS = 1 << 23, 1 << 23
#: A copy's first symbol in the tables of images read side by side, whose places of the cache begin at 256.
LANE_COPY = 256 + (1 << 11)


def _lane_table(codes: Codes, k: int) -> np.ndarray:
    table = codes.tables[k][0]
    if not k and codes.lengths[0][256:].any():
        symbol = table >> 4
        moved = np.where(symbol < 256 + N_LENGTHS, symbol - 256 + LANE_COPY, symbol - N_LENGTHS)
        table = np.where(symbol < 256, table, moved << 4 | table & 15)
    return table.astype(np.uint16)


def _read_together(jobs: list[tuple[Reader, int, int, Codes]]) -> list[np.ndarray | None]:
    """Pixels of images with one set of codes and one alpha, as ``_read_stretches`` has them: a pixel of every image at
    a step, as long as enough of them have some left."""
    jobs_at = np.cumsum([0, *(total for _, _, total, _ in jobs)])
    px = np.empty(int(jobs_at[-1]), dtype=np.uint32)
    cached = any(codes.cache_bits for *_, codes in jobs)
    slots = np.full(len(px) if cached else 0, -1, dtype=np.int64)
    jumps: list[list[tuple[int, int, int]]] = [[] for _ in jobs]
    tables, n_entries = [], 0
    raws, base, n_bytes = [], [], 0
    table_at = np.empty((3, len(jobs)), dtype=np.int64)
    low = np.empty((3, len(jobs)), dtype=np.int64)
    for i, (r, _, _, codes) in enumerate(jobs):
        for k, (same, (_, bits)) in enumerate(zip(codes.same, codes.tables[:3])):
            low[k, i] = (1 << bits) - 1
            if same >= 0:
                table_at[k, i] = table_at[same, i]
                continue
            table_at[k, i] = n_entries
            tables.append(_lane_table(codes, k))
            n_entries += len(tables[-1])
        base.append(n_bytes)
        raws.append(r.raw + bytes(len(r.raw) % 2))
        n_bytes += len(raws[-1])
    table = np.concatenate(tables)
    two = np.frombuffer(b"".join(raws) + bytes(8), "<u2").astype(np.uint64)
    words = two[:-3].copy()  # the 64 bits from every second byte on
    for k in (1, 2, 3):
        words |= two[k : len(two) - 3 + k] << np.uint64(16 * k)
    words = words.view(np.int64)
    lane = np.arange(len(jobs))
    first_bit = 8 * np.array(base)
    at = first_bit + [r.at for r, *_ in jobs]
    pos, end = jobs_at[:-1], jobs_at[1:]
    kept: list[tuple] = []

    def flush() -> None:
        if kept:
            p, g, red, blue = (np.concatenate(x) for x in zip(*kept))
            symbol = g >> 4
            if cached:
                slots[p] = symbol - 256  # a copy's is replaced with the copy
            px[p] = red >> 4 << 16 | (symbol & 255) << 8 | blue >> 4
            kept.clear()

    (t0, t1, t2), (m0, m1, m2) = table_at, low
    while len(lane) >= FEW_LANES:
        steps = int((end - pos).min())
        while steps > 0:
            steps -= 1
            v = words.take(at >> 4, mode="clip")
            v >>= at & 15
            g = table.take((v & m0) + t0).astype(np.int64)
            n = g & 15
            v >>= n
            red = table.take((v & m1) + t1).astype(np.int64)
            more = red & 15
            v >>= more
            blue = table.take((v & m2) + t2).astype(np.int64)
            more += blue & 15
            kept.append((pos, g, red, blue))
            pos = pos + 1
            top = int(g.max())
            if top >= 256 << 4:
                more *= g < 256 << 4
            at = at + n
            at += more
            if top >= LANE_COPY << 4:
                for i in np.flatnonzero(g >= LANE_COPY << 4).tolist():
                    job = int(lane[i])
                    r, width, total, codes = jobs[job]
                    done = int(pos[i] - 1 - jobs_at[job])
                    r.at = int(at[i] - first_bit[i])
                    length, distance = _read_copy(r, 256 + (int(g[i]) >> 4) - LANE_COPY, codes.tables[4], width)
                    if distance > done or done + length > total:
                        raise ValueError("a copy from outside the image")
                    jumps[job].append((done, length, distance))
                    at[i] = r.at + first_bit[i]
                    pos[i] += length - 1
                    steps = min(steps, int(end[i] - pos[i]))
            if len(kept) >= LANE_STEPS:
                flush()
        going = pos < end
        for i in np.flatnonzero(~going).tolist():
            r = jobs[int(lane[i])][0]
            r.at = int(at[i] - first_bit[i])
            if r.at > 8 * len(r.raw):
                raise ValueError("the stream ends early")
        lane, first_bit, at, pos, end, t0, t1, t2, m0, m1, m2 = (x[going] for x in (lane, first_bit, at, pos, end, t0, t1, t2, m0, m1, m2))
    flush()
    alpha = np.array([int(codes.tables[3][0][0]) >> 4 for *_, codes in jobs], dtype=np.uint32) << np.uint32(24)
    px |= np.repeat(alpha, np.diff(jobs_at))
    for i, job in enumerate(lane.tolist()):
        r, width, total, codes = jobs[job]
        a, z = int(jobs_at[job]), int(jobs_at[job + 1])
        r.at = int(at[i] - first_bit[i])
        _stretches(r, width, total, codes, int(pos[i]) - a, channels(px[a:z]), slots[a:z], jumps[job])
    out = []
    for job, (_, _, _, codes) in enumerate(jobs):
        own = slice(int(jobs_at[job]), int(jobs_at[job + 1]))
        out.append(_resolved(px[own], slots[own], jumps[job], codes.cache_bits))
    return out


def _repeat(out: np.ndarray, jumps: list[tuple[int, int, int]]) -> None:
    for a, length, distance in jumps:  # in order, so that copies of copies hold
        if distance >= length:
            out[a : a + length] = out[a - distance : a - distance + length]
        else:
            piece = out[a - distance : a]
            out[a : a + length] = np.concatenate([piece] * -(-length // distance))[:length]


def _from_cache(px: np.ndarray, slots: np.ndarray, jumps: list[tuple[int, int, int]], bits: int) -> np.ndarray | None:
    """Each pixel is a literal, a copy of an earlier one, or (with a slot of 0 and up) the last one before it in that
    slot, which is a literal, a copy or such a one itself; all are followed back to literals together."""
    of = np.arange(len(px))
    _repeat(of, jumps)
    slot = np.where(slots >= 0, slots, (px * np.uint32(CACHE_MUL)) >> np.uint32(32 - bits)).astype(np.uint16)[of]
    order = np.argsort(slot, kind="stable")
    s = slot[order]
    before = np.full(len(px), -1, dtype=np.int64)
    same = s[1:] == s[:-1]
    before[order[1:][same]] = order[:-1][same]
    taken = np.flatnonzero((slots >= 0) & (of == np.arange(len(px))))
    if (before[taken] < 0).any():
        return None
    of[taken] = before[taken]
    while True:
        back = of[of]
        if np.array_equal(back, of):
            return px[of]
        of = back


# ---- decoding: transforms --------------------------------------------------------------------------


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def predictions(mode: np.ndarray, left, top, right, corner) -> np.ndarray:
    """Predicted channels (int16, one row a pixel) for each pixel's mode; ``right``: above to the right, ``corner``: above to the left."""
    out = np.empty_like(left)
    for m in set(mode.tolist()):
        hit = np.flatnonzero(mode == m)
        out[hit] = _prediction(m, left[hit], top[hit], right[hit], corner[hit])
    return out


def _prediction(m: int, left, top, right, corner) -> np.ndarray:
    if 1 <= m <= 4:
        return (left, top, right, corner)[m - 1]
    if m == 5:
        return _average(_average(left, right), top)
    if m == 6:
        return _average(left, corner)
    if m == 7:
        return _average(left, top)
    if m == 8:
        return _average(corner, top)
    if m == 9:
        return _average(top, right)
    if m == 10:
        return _average(_average(left, corner), _average(top, right))
    if m == 11:
        take_left = np.abs(top - corner).sum(axis=1) < np.abs(left - corner).sum(axis=1)
        return np.where(take_left[:, None], left, top)
    if m == 12:
        return np.minimum(np.maximum(left + top - corner, 0), 255)
    if m == 13:
        half = _average(left, top)
        return np.minimum(np.maximum(half + _toward_zero(half - corner), 0), 255)
    black = np.zeros_like(left)
    black[:, 3] = 255
    return black


def _toward_zero(x: np.ndarray) -> np.ndarray:
    """Half of x, rounded toward zero."""
    return np.where(x < 0, -((-x) >> 1), x >> 1)


def pixel_modes(width: int, height: int, bits: int, block: np.ndarray) -> np.ndarray:
    """The predictor of each pixel; borders have fixed ones."""
    across = blocks_of(width, bits)
    y, x = np.divmod(np.arange(width * height), width)
    mode = ((block[(y >> bits) * across + (x >> bits)] >> 8) & 0xF).astype(np.int64)
    mode[x == 0] = 2
    mode[y == 0] = 1
    mode[0] = 0
    return mode


def undo_predictor(px: np.ndarray, width: int, height: int, bits: int, block: np.ndarray) -> np.ndarray:
    return undo_predictors([(px, height, bits, block)], width)


def undo_predictors(images: list[tuple], width: int) -> np.ndarray:
    """Of ``(pixels, height, bits, block)``, one after the other. Pixels along ``x + 2 y = const`` depend on earlier such
    lines only, so a line is done at once, in all images."""
    mode = np.concatenate([pixel_modes(width, height, bits, block) for _, height, bits, block in images])
    out = channels(np.concatenate([px for px, *_ in images])).astype(np.int16)
    y, x = np.divmod(np.concatenate([np.arange(width * height) for _, height, *_ in images]), width)
    line = x + 2 * y
    order = np.argsort(line, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(line[order])) + 1):
        # places outside the image are read somewhere inside; the borders' modes don't use them
        left, top, right, corner = (out[np.maximum(at - d, 0)] for d in (1, width, width - 1, width + 1))
        out[at] = (out[at] + predictions(mode[at], left, top, right, corner)) & 255
    return pixels(out.astype(np.uint8))


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.int8).astype(np.int32) * c.astype(np.uint8).astype(np.int8).astype(np.int32)) >> 5


def cross_colour(px: np.ndarray, width: int, height: int, bits: int, block: np.ndarray, undo: bool) -> np.ndarray:
    y, x = np.divmod(np.arange(width * height), width)
    t = channels(block)[(y >> bits) * blocks_of(width, bits) + (x >> bits)]
    green_to_red, green_to_blue, red_to_blue = t[:, 0], t[:, 1], t[:, 2]
    ch = channels(px).astype(np.int32)
    sign = 1 if undo else -1
    red = (ch[:, 2] + sign * _delta(green_to_red, ch[:, 1])) & 255
    original = red if undo else ch[:, 2]
    blue = (ch[:, 0] + sign * (_delta(green_to_blue, ch[:, 1]) + _delta(red_to_blue, original))) & 255
    out = ch.astype(np.uint8)
    out[:, 2], out[:, 0] = red, blue
    return pixels(out)


def green(px: np.ndarray, sign: int) -> np.ndarray:
    """Green added to (or, with -1, taken from) red and blue, both at once with a bit to carry into (borrow from)."""
    own = px >> np.uint32(8) & np.uint32(0xFF)
    both = own << np.uint32(16) | own
    other = px & np.uint32(0xFF00FF)
    other = other + both if sign > 0 else (other | np.uint32(0x1000100)) - both
    return px & np.uint32(0xFF00FF00) | other & np.uint32(0xFF00FF)


def palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def undo_palette(px: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    bits = palette_bits(len(table))
    index = ((px >> 8) & 255).astype(np.int64)
    if bits:
        each = 8 >> bits
        index = (index[:, None] >> (np.arange(1 << bits) * each)) & ((1 << each) - 1)
        index = index.reshape(height, -1)[:, :width].ravel()
    return np.concatenate([table, np.zeros(256, np.uint32)])[index]


def _opened(raw: bytes) -> tuple[Reader, int, int, int, list]:
    """A file up to its pixels: reader, width, height, width of the stored image, transforms to undo."""
    riff, _, webp, kind, size = struct.unpack_from("<4sI4s4sI", raw)
    if riff != b"RIFF" or webp != b"WEBP" or kind != b"VP8L":
        raise ValueError("not a lossless WebP file")
    r = Reader(raw[20 : 20 + size])
    if r.read(8) != SIGNATURE:
        raise ValueError("not a lossless WebP stream")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise ValueError("an unknown version of the stream")
    undo, wide = [], width
    while r.read(1):
        kind = r.read(2)
        if kind in (PREDICTOR, CROSS):
            bits = r.read(3) + 2
            undo.append((kind, wide, bits, read_pixels(r, blocks_of(wide, bits), blocks_of(height, bits), False)))
        elif kind == PALETTE:
            n = r.read(8) + 1
            steps = channels(read_pixels(r, n, 1, False)).astype(np.int64)
            table = pixels((np.cumsum(steps, axis=0) & 255).astype(np.uint8))
            undo.append((kind, wide, 0, table))
            wide = blocks_of(wide, palette_bits(n))
        else:
            undo.append((kind, wide, 0, None))
    return r, width, height, wide, undo


def _undone(images: list[np.ndarray], heights: list[int], undo: list[list]) -> list[np.ndarray]:
    """Images without their transforms (which are taken from the lists); those that wait for predictors get them together."""
    out = list(images)
    while True:
        waiting: dict[int, list[int]] = {}
        for i, steps in enumerate(undo):
            while steps and steps[-1][0] != PREDICTOR:
                kind, w, bits, data = steps.pop()
                if kind == CROSS:
                    out[i] = cross_colour(out[i], w, heights[i], bits, data, True)
                elif kind == GREEN:
                    out[i] = green(out[i], 1)
                else:
                    out[i] = undo_palette(out[i], w, heights[i], data)
            if steps:
                waiting.setdefault(steps[-1][1], []).append(i)
        if not waiting:
            return out
        for w, some in waiting.items():
            how = [(out[i], heights[i], *undo[i].pop()[2:]) for i in some]
            px = undo_predictor(how[0][0], w, *how[0][1:]) if len(some) == 1 else undo_predictors(how, w)
            for i, got in zip(some, np.split(px, np.cumsum([len(x) for x, *_ in how])[:-1])):
                out[i] = got


def decode(raw: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and pixels of a lossless WebP file."""
    r, width, height, wide, undo = _opened(raw)
    return width, height, _undone([read_pixels(r, wide, height, True)], [height], [undo])[0]


def decode_each(raws: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    """``decode`` of each file; many are read together."""
    held, size, area = [], 0, 0
    for raw in raws:
        sides = int.from_bytes(raw[21:25], "little")
        own = ((sides & 0x3FFF) + 1) * ((sides >> 14 & 0x3FFF) + 1)
        if held and (len(held) == LANES or size + len(raw) > LANE_BYTES or area + own > LANE_PIXELS):
            yield from _decode_together(held)
            held, size, area = [], 0, 0
        held.append(raw)
        size, area = size + len(raw), area + own
    if held:
        yield from _decode_together(held)


def _decode_together(raws: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    opened, jobs = [], []
    for raw in raws:
        r, width, height, wide, undo = _opened(raw)
        how = _read_codes(r, wide, height, True)
        opened.append((r, width, height, wide, undo, how))
        codes = how[0][0]
        together = len(how[0]) == 1 and wide * height > 64 and codes.tables[3][1] == 0 and codes.tables[0][1] > 0
        jobs.append((r, wide, wide * height, codes) if together else None)
    begun = [r.at for r, *_ in opened]
    some = [job for job in jobs if job]
    read = iter(_read_together(some) if len(some) >= FEW_LANES else [None] * len(some))
    images = []
    for at, job, (r, _, height, wide, _, how) in zip(begun, jobs, opened):
        px = next(read) if job else None
        if px is None:
            r.at = at
            px = _pixels_of(r, wide, height, *how)
        images.append(px)
    heights = [x[2] for x in opened]
    return list(zip([x[1] for x in opened], heights, _undone(images, heights, [x[4] for x in opened])))


# ---- encoding --------------------------------------------------------------------------------------


def find_copies(px: np.ndarray, least: int = MIN_COPY) -> list[tuple[int, int, int]]:
    """``(start, length, distance)`` of stretches of ``least`` pixels or more that repeat earlier ones at one distance."""
    return find_copies_each(px, np.zeros(len(px), dtype=np.int64), 1, least)[0]


def find_copies_each(px: np.ndarray, image: np.ndarray, n: int, least: int = MIN_COPY) -> list[list[tuple[int, int, int]]]:
    """``find_copies`` of each of ``n`` images, one after the other; ``image``: which one a pixel is of."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    if len(px) <= least:
        return out
    with np.errstate(over="ignore"):
        key, have = (px + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
        while have < least:
            step = min(have, least - have)
            key = key[:-step] * np.uint64(0xC2B2AE3D27D4EB4F) + key[step:]
            have += step
        of, inside = image[: len(key)], image[: len(key)] == image[least - 1 :]
        # most stretches are found to be alone by a part of the key, sorted with their places
        low = np.uint64(len(px).bit_length())
        ordered = np.sort((key + of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> low << low | np.arange(len(key), dtype=np.uint64))
    high = ordered >> low
    same = high[1:] == high[:-1]
    if not same.any():
        return out
    some = np.zeros(len(key), dtype=bool)
    place = (ordered & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    some[place[1:][same]] = True
    some[place[:-1][same]] = True
    some = np.flatnonzero(some & inside)
    order = some[np.lexsort((key[some], of[some]))]
    same = (key[order[1:]] == key[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    back = np.zeros(len(px), dtype=np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    edge = np.flatnonzero(np.diff(back, prepend=-1, append=-1))
    begin, end = np.searchsorted(image, np.arange(n)).tolist(), 0
    for a, z, d in zip(edge.tolist(), edge[1:].tolist(), back[edge[:-1]].tolist()):
        a, z = max(a, end), z + least - 1
        if d and z - a >= least and np.array_equal(px[a:z], px[a - d : z - d]):
            i = int(image[a])
            out[i] += [(s - begin[i], min(MAX_COPY, z - s), d) for s in range(a, z, MAX_COPY)]
            end = z
    return out


_LAST: list = [None, []]


def copies_of(px: np.ndarray) -> list[tuple[int, int, int]]:
    """``find_copies``, kept for the last pixels: files of one image that are compared share them."""
    if _LAST[0] is not px:
        _LAST[:] = px, find_copies(px)
    return _LAST[1]


def _write_shared(w: Writer, px: np.ndarray, width: int, found: list[tuple[int, int, int]]) -> None:
    """Literals and copies where one code serves red and blue, and green too if there are no copies."""
    ch = channels(px)
    near, copies = near_codes(width), []
    if found:
        literal = np.ones(len(px), dtype=bool)
        for a, length, d in found:
            literal[a : a + length] = False
            copies.append((prefix_of(length), prefix_of(near.get(d, d + 120))))
        ch = channels(px[literal])
    if copies:
        rest = code_lengths(np.bincount(ch[:, 0:3:2].ravel(), minlength=256))
        counts = np.bincount(ch[:, 1], minlength=256 + N_LENGTHS)
        for lp, _ in copies:
            counts[256 + lp[0]] += 1
        first = code_lengths(counts)
        distances = code_lengths(np.bincount([dp[0] for _, dp in copies], minlength=N_DISTANCES))
    else:
        rest = code_lengths(np.bincount(ch[:, :3].ravel(), minlength=256))
        first = np.concatenate([rest, np.zeros(N_LENGTHS, np.uint8)])
        distances = np.zeros(N_DISTANCES, np.uint8)
    if len(ch) and (ch[:, 3] == ch[0, 3]).all():
        alpha = np.zeros(256, np.uint8)
        alpha[ch[0, 3]] = 1
    else:
        alpha = code_lengths(np.bincount(ch[:, 3], minlength=256))
    for x in (first, rest, rest, alpha, distances):
        write_code(w, x)
    both = _coded(rest)
    head = _coded(first) if copies else both
    value = size = np.zeros(len(ch), dtype=np.uint64)
    for k, coded in ((1, head), (2, both), (0, both), (3, _coded(alpha))):
        if k == 3 and np.count_nonzero(alpha) < 2:
            continue
        c = coded[ch[:, k]]
        v, z = c >> np.uint64(8), c & np.uint64(255)
        value, size = (v, z) if k == 1 else (value | v << size, size + z)
    if copies:
        far, extra, bits = _coded(distances).tolist(), [], []
        for lp, dp in copies:
            v, z = 0, 0
            for c, n in ((int(head[256 + lp[0]]), None), (lp[2], lp[1]), (far[dp[0]], None), (dp[2], dp[1])):
                c, n = (c >> 8, c & 255) if n is None else (c, n)
                v |= c << z
                z += n
            extra.append(v)
            bits.append(z)
        start = np.array([a for a, _, _ in found])
        lengths = np.array([n for _, n, _ in found])
        at = start - (np.cumsum(lengths) - lengths)  # literals before each copy
        value = np.insert(value, at, np.array(extra, dtype=np.uint64))
        size = np.insert(size, at, np.array(bits, dtype=np.uint64))
    w.put_all(value, size.astype(np.int64))


def _coded(lengths: np.ndarray) -> np.ndarray:
    """``code << 8 | bits`` of each symbol."""
    if np.count_nonzero(lengths) < 2:
        return np.zeros(len(lengths), dtype=np.uint64)
    return codes_of(lengths) << np.uint64(8) | lengths.astype(np.uint64)


def write_pixels(w: Writer, px: np.ndarray, width: int, main: bool, cache_bits: int = 0, copies: bool = True, groups: int = 0) -> None:
    """``groups``: bits of the blocks that take turns with two sets of codes (0: one set)."""
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    n = len(px)
    group_of = None
    if main:
        w.put(1 if groups else 0, 1)
        if groups:
            w.put(groups - 2, 3)
            y, x = np.divmod(np.arange(n), width)
            across, down = blocks_of(width, groups), blocks_of(n // width, groups)
            turn = np.arange(across * down) % 2
            write_pixels(w, (turn << 8).astype(np.uint32), across, False)
            group_of = turn[(y >> groups) * across + (x >> groups)]
    found = copies_of(px) if copies else []
    if not (cache_bits or groups):
        _write_shared(w, px, width, found)
        return
    ch = channels(px)
    plain = np.ones(n, dtype=bool)  # not of a copy, then neither from the cache
    for a, length, _ in found:
        plain[a : a + length] = False
    emitted = plain.copy()
    symbol = ch[:, 1].astype(np.int64)  # of the green alphabet
    if cache_bits:
        slot = ((px * np.uint32(CACHE_MUL)) >> np.uint32(32 - cache_bits)).astype(np.uint16)
        hit = _known(px, slot) & plain
        symbol[hit] = 256 + N_LENGTHS + slot[hit].astype(np.int64)
        plain &= ~hit
    near = near_codes(width)
    copy = []
    for a, length, d in found:
        lp, dp = prefix_of(length), prefix_of(near.get(d, d + 120))
        symbol[a] = 256 + lp[0]
        copy.append((a, lp, dp))
    emitted[[a for a, _, _ in found]] = True
    at, n_groups = np.flatnonzero(emitted), 1 if group_of is None else int(group_of.max(initial=0)) + 1
    if len(at) < n:
        symbol, plain, px, group_of = symbol[at], plain[at], px[at], group_of if group_of is None else group_of[at]
    value, size = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    place = {a: k for k, a in enumerate(at.tolist())} if copy else {}
    for g in range(n_groups):
        mine = slice(None) if group_of is None else np.flatnonzero(group_of == g)
        lit = np.flatnonzero(plain) if group_of is None else mine[plain[mine]]
        own = [x for x in copy if group_of is None or group_of[place[x[0]]] == g]
        s, literal = symbol[mine], channels(px[lit])
        counts = [
            np.bincount(s, minlength=256 + N_LENGTHS + (1 << cache_bits if cache_bits else 0)),
            *(np.bincount(literal[:, k], minlength=256) for k in (2, 0, 3)),
            np.bincount([dp[0] for _, _, dp in own], minlength=N_DISTANCES) if own else np.zeros(N_DISTANCES, np.int64),
        ]
        # samples of one kind fill the three channels, so they share a code
        pooled = counts[0].copy()
        if pooled[256:].any():
            shared, rest = code_lengths(pooled), code_lengths(counts[1] + counts[2])
        else:
            pooled[:256] += counts[1] + counts[2]
            shared = code_lengths(pooled)
            rest = shared[:256]
        lengths = [shared, rest, rest, code_lengths(counts[3]), code_lengths(counts[4])]
        for x in lengths:
            write_code(w, x)
        head, both, far = (_coded(x) for x in (shared, rest, lengths[4]))
        c = head[s]
        value[mine], size[mine] = c >> np.uint64(8), c & np.uint64(255)
        v, z = value[lit], size[lit].astype(np.uint64)
        for k, coded in ((2, both), (0, both), (3, _coded(lengths[3]))):
            if k == 3 and np.count_nonzero(lengths[3]) < 2:
                continue
            c = coded[literal[:, k]]
            v |= (c >> np.uint64(8)) << z
            z += c & np.uint64(255)
        value[lit], size[lit] = v, z
        for a, lp, dp in own:
            k, c = place[a], int(far[dp[0]])
            v, z = int(value[k]), int(size[k])
            for bits_in, n_bits in ((lp[2], lp[1]), (c >> 8, c & 255), (dp[2], dp[1])):
                v |= bits_in << z
                z += n_bits
            value[k], size[k] = v, z
    w.put_all(value, size)


def _known(px: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Which pixels equal the last one before them in their slot."""
    order = np.argsort(slot, kind="stable")
    s, p = slot[order], px[order]
    out = np.zeros(len(px), dtype=bool)
    out[order[1:]] = (s[1:] == s[:-1]) & (p[1:] == p[:-1])
    return out


def palette_of(px: np.ndarray) -> np.ndarray | None:
    """Colours in order, if they are few enough for indices to pay."""
    for part in (px[:1024], px):
        table = np.sort(part)
        table = table[np.concatenate([[True], table[1:] != table[:-1]])]
        if len(table) > 256:
            return None
    return table if len(table) <= 16 or len(table) <= min(256, len(px) // 8) else None


def may_have_palette(px: np.ndarray, image: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` images, one after the other, have few enough colours for ``palette_of``."""
    key = np.sort(image.astype(np.uint64) << np.uint64(32) | px)
    first = key[np.concatenate([[True], key[1:] != key[:-1]])]
    colours = np.bincount((first >> np.uint64(32)).astype(np.int64), minlength=n)
    return (colours <= 16) | (colours <= np.minimum(256, np.bincount(image, minlength=n) // 8))


def put_palette(w: Writer, px: np.ndarray, width: int, table: np.ndarray) -> tuple[np.ndarray, int]:
    """Write the palette; the indices as pixels, and their width."""
    w.put(1, 1)
    w.put(PALETTE, 2)
    w.put(len(table) - 1, 8)
    steps = np.diff(channels(table).astype(np.int64), axis=0, prepend=0) & 255
    write_pixels(w, pixels(steps.astype(np.uint8)), len(table), False)
    index, bits = np.searchsorted(table, px), palette_bits(len(table))
    if bits:
        per, wide = 1 << bits, blocks_of(width, bits)
        rows = np.zeros((len(px) // width, wide * per), dtype=np.int64)
        rows[:, :width] = index.reshape(-1, width)
        index = (rows.reshape(-1, per) << (np.arange(per) * (8 >> bits))).sum(axis=1)
        width = wide
    return (OPAQUE | index << 8).astype(np.uint32), width


def encode(px: np.ndarray, width: int, transforms: tuple = (), palette: bool | None = None, cache_bits: int = 0, copies: bool = True, groups: int = 0) -> bytes:
    """A lossless WebP file. ``transforms``: of ``(PREDICTOR | CROSS, bits, block pixels)`` and ``(GREEN,)``, in order;
    ``palette``: None means where it pays."""
    height = len(px) // width
    w = _begun(width, height, bool((px < OPAQUE).any()))
    for kind, *how in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind == GREEN:
            px = green(px, -1)
            continue
        bits, block = how
        w.put(bits - 2, 3)
        write_pixels(w, block, blocks_of(width, bits), False)
        px = predicted(px, width, height, bits, block) if kind == PREDICTOR else cross_colour(px, width, height, bits, block, False)
    table = palette_of(px) if palette in (None, True) and not transforms else None
    inner = width
    if table is not None:
        px, inner = put_palette(w, px, width, table)
    w.put(0, 1)
    write_pixels(w, px, inner, True, cache_bits, copies, groups)
    return _file(w.bytes())


def _begun(width: int, height: int, alpha: bool) -> Writer:
    w = Writer()
    w.put(SIGNATURE, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int(alpha), 1)
    w.put(0, 3)
    return w


def _file(body: bytes) -> bytes:
    body += b"\0" * (len(body) % 2)
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(body), b"WEBP", b"VP8L", len(body)) + body


def predicted(px: np.ndarray, width: int, height: int, bits: int, block: np.ndarray) -> np.ndarray:
    mode, ch, at = pixel_modes(width, height, bits, block), channels(px).astype(np.int16), np.arange(width * height)
    left, top, right, corner = (ch[np.maximum(at - d, 0)] for d in (1, width, width - 1, width + 1))
    return pixels(((ch - predictions(mode, left, top, right, corner)) & 255).astype(np.uint8))


# ---- encoding: what pays ---------------------------------------------------------------------------

#: Bits of the blocks that get a predictor and colour multipliers of their own, or take turns with two sets of codes.
PLAN_BITS = 4
#: Multipliers (32: one) and sizes of the colour cache that are compared.
PLAN_MULTIPLIERS = (0, 8, 16, 32, -8, -16, -32)
PLAN_CACHES = (4, 7, 10)
#: Rows of pixels looked at together, of one image or several: bounds memory.
PLAN_ROWS = 512
#: Bits, about, that a symbol takes in a code's header, one of a cache's few used places, a block's pixel, and a transform.
SYMBOL_COST, CACHE_COST, BLOCK_COST, TRANSFORM_COST = 4, 12, 3, 250
XLOGX = np.arange(1 << 14) * np.log2(np.maximum(np.arange(1 << 14), 1))


@lru_cache(maxsize=64)
def plan_blocks(width: int, rows: int) -> np.ndarray:
    """The block of each pixel."""
    y, x = np.divmod(np.arange(width * rows), width)
    return (y >> PLAN_BITS) * blocks_of(width, PLAN_BITS) + (x >> PLAN_BITS)


def entropy(counts: np.ndarray) -> np.ndarray:
    """Bits that the symbols of each histogram (last axis) take."""
    n = np.add.reduce(counts, axis=-1)
    if n.max() < len(XLOGX):
        return XLOGX[n] - np.add.reduce(XLOGX[counts], axis=-1)
    return n * np.log2(np.maximum(n, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(axis=-1)


def histograms(planes: list[np.ndarray], image: np.ndarray, n: int) -> np.ndarray:
    """How often each value is in the planes of each of ``n`` images; ``image``: which one a pixel is of."""
    at, of = np.empty((len(planes), len(image)), dtype=np.int64), image << 8
    for plane, y in zip(planes, at):
        np.add(of, plane, out=y)
    return np.bincount(at.ravel(), minlength=n << 8).reshape(n, 256)


def costs(planes: list[np.ndarray], image: np.ndarray, n: int) -> np.ndarray:
    """Bits that the samples of each of ``n`` images and the header of their code take, about."""
    counts = histograms(planes, image, n)
    return entropy(counts) + SYMBOL_COST * np.count_nonzero(counts, axis=1)


def colours(px: np.ndarray) -> list[np.ndarray]:
    ch = channels(px)
    return [ch[:, k] for k in range(3)]


def least(choices: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """Which of the choices (first axis: their samples, in planes) takes the fewest bits in each of the ``n`` blocks."""
    at, out = block << 8, np.empty((len(choices), n))
    for x, y in zip(choices, out):
        counts = np.bincount((at + x).ravel(), minlength=n << 8)
        np.add.reduce(XLOGX.take(counts, mode="clip").reshape(n, 256), axis=-1, out=y)
    return out.argmax(axis=0)  # a block has as many samples by each choice


def residuals(ch: np.ndarray, width: int) -> np.ndarray:
    """What each of the 14 predictors leaves of the colours (three planes, int16) of an opaque image, its first column and row apart."""
    n = ch.shape[1]
    around = np.concatenate([np.zeros((3, width + 1), np.int16), ch], axis=1)
    left, top, right, corner = around[:, width : width + n], around[:, 1 : 1 + n], around[:, 2 : 2 + n], around[:, :n]
    over, side = top - corner, left - corner
    half = _average(left, top)
    out = np.empty((14, 3, n), dtype=np.uint8)
    a, b = np.abs(over), np.abs(side)
    take_left = a[0] + a[1] + a[2] < b[0] + b[1] + b[2]
    above = _average(top, right)
    for m, p in enumerate((
        0, left, top, right, corner, _average(_average(left, right), top), _average(left, corner), half, _average(corner, top), above,
        _average(_average(left, corner), above), np.where(take_left, left, top), np.minimum(np.maximum(left + over, 0), 255),
        np.minimum(np.maximum(half + _toward_zero(half - corner), 0), 255),
    )):
        np.subtract(ch, p, out=out[m], casting="unsafe")
    return out


def stretches(heights: list[int], width: int) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """Rows from and to, the block of each of their pixels, and how many blocks: images one below the other, some at
    a time, or a part of a high one."""
    at, held, blocks, n = 0, 0, [], 0
    for h in heights:
        for a in range(0, h, PLAN_ROWS):
            rows = min(PLAN_ROWS, h - a)
            if held and held + rows > PLAN_ROWS:
                yield at, at + held, np.concatenate(blocks), n
                at, held, blocks, n = at + held, 0, [], 0
            blocks.append(plan_blocks(width, rows) + n)
            n += blocks_of(width, PLAN_BITS) * blocks_of(rows, PLAN_BITS)
            held += rows
    yield at, at + held, np.concatenate(blocks), n


def plan_predictors(px: np.ndarray, width: int, heights: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The block images with the predictor that leaves the least in each block, and what they leave."""
    heights = heights or [len(px) // width]
    top = np.zeros(len(px) // width, dtype=bool)
    top[np.cumsum([0, *heights[:-1]])] = True
    modes, rest = [], []
    for a, z, block, n in stretches(heights, width):
        above = min(a, 1)  # with the row above
        ch = np.array(colours(px[(a - above) * width : z * width]), dtype=np.int16)
        left = residuals(ch, width)[:, :, above * width :]
        fixed = np.repeat(top[a:z], width)  # the first row and column have fixed predictors
        got = least(left, np.where(fixed, n, block), n + 1)[:n]  # those pixels are a block of their own
        mode = got[block]
        mode[::width] = 2
        mode[fixed] = 1
        mode[np.flatnonzero(top[a:z]) * width] = 0
        out = np.zeros((len(mode), 4), dtype=np.uint8)
        at = np.arange(len(mode))
        for k in range(3):
            out[:, k] = left[mode, k, at]
        modes.append(got)
        rest.append(pixels(out))
    return np.uint32(OPAQUE) | np.concatenate(modes).astype(np.uint32) << np.uint32(8), np.concatenate(rest)


def plan_cross(px: np.ndarray, width: int, heights: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The block images with the colour multipliers that leave the least in each block, and what they leave."""
    tried = np.array(PLAN_MULTIPLIERS, dtype=np.int8).view(np.uint8)
    deltas = _delta(tried[:, None], np.arange(256, dtype=np.uint8)).astype(np.uint8)
    chosen, rest = [], []
    for a, z, block, n in stretches(heights, width):
        part = px[a * width : z * width]
        at = np.arange(len(part))
        blue, own, red = (x.copy() for x in colours(part))
        by_green, by_red = deltas.take(own, axis=1), deltas.take(red, axis=1)
        to_red, to_blue = (least(x - by_green, block, n) for x in (red, blue))
        red = red - by_green[to_red[block], at]
        blue = blue - by_green[to_blue[block], at]
        by_red_to_blue = least(blue - by_red, block, n)
        out = np.full((n, 4), 255, dtype=np.uint8)
        for k, got in enumerate((to_red, to_blue, by_red_to_blue)):
            out[:, k] = tried[got]
        chosen.append(pixels(out))
        ch = channels(part).copy()
        ch[:, 2], ch[:, 0] = red, blue - by_red[by_red_to_blue[block], at]
        rest.append(pixels(ch))
    return np.concatenate(chosen), np.concatenate(rest)


def plan(px: np.ndarray, width: int) -> dict:
    """Options of ``encode`` by which this opaque image takes the fewest bits, about."""
    return plans([px], width)[0]


def plans(images: list[np.ndarray], width: int) -> list[dict]:
    """Of each of some opaque images (64 at most): predictors or none, then subtracted green, cross-colour or none, then a
    colour cache, two sets of codes or none of them. Each choice is made after those before it, for all images at once."""
    k, heights, px = len(images), [len(x) // width for x in images], np.concatenate(images)
    image = np.repeat(np.arange(k), [len(x) for x in images])
    n_blocks = np.array([blocks_of(width, PLAN_BITS) * blocks_of(h, PLAN_BITS) for h in heights])
    ends = np.cumsum(n_blocks).tolist()
    extra = TRANSFORM_COST + BLOCK_COST * n_blocks

    def cost(x: np.ndarray) -> np.ndarray:
        return costs(colours(x), image, k)

    block, rest = plan_predictors(px, width, heights)
    left = [px, rest, green(px, -1), green(rest, -1)]
    bare = [cost(x) for x in left]
    tried = [bare[0], bare[1] + extra, bare[2] + 8, bare[3] + extra + 8]
    first = tried[1] < tried[0]
    m, crossed = plan_cross(np.where(first[image], rest, px), width, heights)
    some = np.add.reduceat(m != OPAQUE, [0, *ends[:-1]]) > 0
    left.append(crossed)
    bare.append(cost(crossed))
    tried.append(np.where(some, bare[4] + extra + np.where(first, extra, 0), np.inf))
    choice = np.argmin(tried, axis=0)
    x = px
    for c in set(choice.tolist()) - {0}:
        x = np.where((choice == c)[image], left[c], x)
    pooled = np.array(bare)[choice, np.arange(k)]
    saved, bits_of = np.zeros(k), [0] * k
    hashed = x * np.uint32(CACHE_MUL)
    for bits in PLAN_CACHES:
        slot = (image << bits | hashed >> np.uint32(32 - bits)).astype(np.uint16 if k << bits <= 1 << 16 else np.int64)
        hit = _known(x, slot)
        lone = np.flatnonzero(~hit)
        (blue, own, red), of = colours(x[lone]), image[lone]
        head = histograms([own], of, k)
        places = np.bincount(slot[hit], minlength=k << bits).reshape(k, 1 << bits)
        header = SYMBOL_COST * np.count_nonzero(head, axis=1) + CACHE_COST * np.count_nonzero(places, axis=1)
        less = pooled - entropy(np.concatenate([head, places], axis=1)) - header - costs([blue, red], of, k)
        for i in np.flatnonzero(less > saved).tolist():
            saved[i], bits_of[i] = less[i], bits
    turn = np.concatenate([plan_blocks(width, h) & 1 for h in heights]).astype(bool)
    turns = costs(colours(x), image << 1 | turn, 2 * k)
    groups = pooled - turns[1::2] - turns[::2] - n_blocks - TRANSFORM_COST > saved
    out: list[dict] = []
    for i in range(k):
        own = slice(ends[i] - int(n_blocks[i]), ends[i])
        predictor, cross = (PREDICTOR, PLAN_BITS, block[own]), (CROSS, PLAN_BITS, m[own])
        before = (predictor,) if first[i] else ()
        transforms = ((), (predictor,), ((GREEN,),), (predictor, (GREEN,)), (*before, cross))[choice[i]]
        coding = {"groups": PLAN_BITS} if groups[i] else {"cache_bits": bits_of[i]} if bits_of[i] else {}
        out.append(({"transforms": transforms} if transforms else {}) | coding)
    return out


def encode_best(px: np.ndarray, width: int) -> bytes:
    return encode_each([px], width)[0]


def encode_each(images: list[np.ndarray], width: int) -> list[bytes]:
    """Of each opaque image the shorter of two files: with palette, copies or plain codes, and with the tools of ``plans``."""
    out, held, rows = [], [], 0
    for k, px in enumerate(images):
        held.append(px)
        rows += len(px) // width
        if k + 1 == len(images) or len(held) == 64 or rows + len(images[k + 1]) // width > PLAN_ROWS:
            out += _shorter(held, width, plans(held, width))
            held, rows = [], 0
    return out


def _shorter(images: list[np.ndarray], width: int, hows: list[dict]) -> list[bytes]:
    k, px = len(images), np.concatenate(images)
    image = np.repeat(np.arange(k), [len(x) for x in images])
    copies, few = find_copies_each(px, image, k), may_have_palette(px, image, k)
    with_palette = [bool(f) and palette_of(x) is not None for x, f in zip(images, few)]
    shared = SharedCodes(px, image, copies, width)
    out: list[list[bytes]] = [[] for _ in images]
    left = []  # to be written without the tools, and without a palette
    for i, (x, how) in enumerate(zip(images, hows)):
        _LAST[:] = x, copies[i]
        other = encode(x, width, **how) if how else b""
        if with_palette[i]:
            _LAST[:] = x, copies[i]
            out[i].append(encode(x, width))
        # 160 bits and the codes are around the samples: the exact size isn't less
        elif not how or copies[i] or 8 * len(other) >= 160 + shared.bits(i):
            left.append(i)
        out[i] += [other] * bool(how)
    for i, raw in zip(left, shared.files(left)):
        out[i].insert(0, raw)
    return [min(x, key=len) for x in out]


class SharedCodes:
    """Opaque images, one after the other, as ``encode`` writes them without tools and palette (``_write_shared``). Codes
    are made an image at a time, streams for many at once."""

    def __init__(self, px: np.ndarray, image: np.ndarray, copies: list[list[tuple[int, int, int]]], width: int):
        n, near = len(copies), near_codes(width)
        self.width, total = width, np.bincount(image, minlength=n)
        self.heights = (total // width).tolist()
        begin = (np.cumsum(total) - total).tolist()
        literal, starts = np.ones(len(px), dtype=bool), []
        for a, found in zip(begin, copies):
            for at, length, _ in found:
                literal[a + at : a + at + length] = False
                starts.append(a + at)
        written = literal.copy()
        written[starts] = True
        at = np.flatnonzero(written)
        self.literal, self.image, self.px = literal[at], image[at], px[at]
        of, ch = self.image[self.literal], channels(self.px[self.literal])
        greens, others = histograms([ch[:, 1]], of, n), histograms([ch[:, 0], ch[:, 2]], of, n)
        self.counts = greens + others
        self.first = np.zeros((n, 256 + N_LENGTHS), dtype=np.uint8)
        self.rest, self.far = (np.zeros((n, m), dtype=np.uint8) for m in (256, N_DISTANCES))
        self.prefixes = [[(prefix_of(length), prefix_of(near.get(d, d + 120))) for _, length, d in found] for found in copies]
        self.heads: list[tuple[int, int]] = []
        for i, prefixes in enumerate(self.prefixes):
            if prefixes:
                self.rest[i] = code_lengths(others[i])
                extra, far = ([p[k][0] for p in prefixes] for k in (0, 1))
                self.first[i] = code_lengths(np.concatenate([greens[i], np.bincount(extra, minlength=N_LENGTHS)]))
                self.far[i] = code_lengths(np.bincount(far, minlength=N_DISTANCES))
            else:
                self.rest[i] = self.first[i, :256] = code_lengths(self.counts[i])
            w = Writer()
            for x in (self.first[i], self.rest[i], self.rest[i]):
                write_code(w, x)
            self.heads.append((w.value, w.size))

    def bits(self, i: int) -> int:
        """Bits that the samples of an image without copies and their codes take."""
        return self.heads[i][1] + int(self.counts[i] @ _sizes(self.rest[i : i + 1])[0])

    def files(self, some: list[int]) -> list[bytes]:
        """The files of some of the images, in order."""
        if not some:
            return []
        literal, image, px = self.literal, self.image, self.px
        if len(some) < len(self.heads):
            own = np.isin(image, some)
            literal, image, px = literal[own], np.searchsorted(some, image[own]), px[own]
        first, rest, far = (_coded_each(x[some]) for x in (self.first, self.rest, self.far))
        wide, head, both = first.shape[1], first.ravel(), rest.ravel()
        value, size = np.zeros((2, len(image)), dtype=np.uint64)
        lit = slice(None) if literal.all() else np.flatnonzero(literal)
        of, ch, v, z = image[lit], channels(px[lit]), np.uint64(0), np.uint64(0)
        for c in (head[of * wide + ch[:, 1]], both[(of << 8) + ch[:, 2]], both[(of << 8) + ch[:, 0]]):
            v, z = v | (c >> np.uint64(8)) << z, z + (c & np.uint64(255))
        value[lit], size[lit] = v, z
        extra: list[int] = []
        bits: list[int] = []
        for i, job in enumerate(some):
            for lp, dp in self.prefixes[job]:
                c, d = int(first[i, 256 + lp[0]]), int(far[i, dp[0]])
                v, z = 0, 0
                for more, n in ((c >> 8, c & 255), (lp[2], lp[1]), (d >> 8, d & 255), (dp[2], dp[1])):
                    v |= more << z
                    z += n
                extra.append(v)
                bits.append(z)
        if extra:
            value[~literal], size[~literal] = extra, bits
        writers = []
        for job in some:
            w = _begun(self.width, self.heights[job], False)
            w.put(0, 3)  # no transform, no colour cache, one set of codes
            w.put(*self.heads[job])
            write_code(w, _LONE_ALPHA)
            write_code(w, self.far[job])
            writers.append(w)
        return [_file(x) for x in bytes_of_each(writers, value, size.astype(np.int64), np.bincount(image, minlength=len(some)))]


_LONE_ALPHA = np.eye(256, dtype=np.uint8)[255]


def _sizes(lengths: np.ndarray) -> np.ndarray:
    """Code lengths of each row; a lone symbol's is 0."""
    return np.where(np.count_nonzero(lengths, axis=1)[:, None] < 2, 0, lengths).astype(np.int64)


def _coded_each(lengths: np.ndarray) -> np.ndarray:
    """``_coded`` of each row."""
    sizes = _sizes(lengths)
    return codes_of_each(sizes) << np.uint64(8) | sizes.astype(np.uint64)


def files(raw: bytes) -> Iterator[bytes]:
    """The files of a stored value: one after the other."""
    at = 0
    while at < len(raw):
        size = 8 + struct.unpack_from("<I", raw, at + 4)[0]
        yield raw[at : at + size]
        at += size
