"""Byte-level BPE with vectorised pre-tokenisation.

Boundaries are found without a regular expression. Every code point gets a class
(letter, number, white space, other) from a table; one look ahead turns classes into
the symbols of a small automaton; and since composing transition functions is
associative, the automaton runs as a blocked scan over function numbers: the
composition closure of the symbols' functions has a few dozen members, so a step is a
lookup in a composition table, done for all blocks at once.

The resulting slices go to a cache of merged pieces. Unknown slices are merged together,
a round at a time: each round looks up all adjacent pairs and merges every piece's
lowest-ranked, leftmost pair.

Defined cases: null and empty texts have no ids; equal rows are encoded each. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks
from .piece_store import PieceStore, expand, per_text

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Symbols: classes with what follows taken into account.
L, N, O, A1, A2, SP, WSL, WS = range(8)
#: States: nothing open, in letters, in numbers, in others, after an attached space, in white space, one or two letters of a contraction left.
NONE, IN_L, IN_N, IN_O, AFTER_SP, IN_WS, C1, C2 = range(8)
BLOCK = 64
CACHE_PIECES = 600_000
#: Longer pieces (bytes) are merged one at a time with a heap.
LONG_PIECE = 64


@functools.cache
def class_table() -> bytes:
    """The class of each code point as the ``tiktoken`` library's own engine sees it, compressed."""
    import tiktoken

    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for cls, pat in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        probe = tiktoken.Encoding("probe", pat_str=pat, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        hit = bytes(probe.encode_ordinary(chars)).decode()
        table[np.frombuffer(hit.encode("utf-32-le"), "<u4")] = cls
    return zlib.compress(table.tobytes())


# ---- the automaton ------------------------------------------------------------------------------


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a token starts at this symbol."""
    if symbol == L:
        if state in (C1, C2):
            return (NONE if state == C1 else C1), False
        return IN_L, state not in (IN_L, AFTER_SP)
    if symbol == N:
        return IN_N, state not in (IN_N, AFTER_SP)
    if symbol == O or symbol in (A1, A2) and state in (IN_O, AFTER_SP):
        return IN_O, state not in (IN_O, AFTER_SP)
    if symbol in (A1, A2):
        return (C1 if symbol == A1 else C2), True
    if symbol == SP:
        return AFTER_SP, True
    return (NONE, True) if symbol == WSL else (IN_WS, state != IN_WS)


def _closure() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Functions on states closed under composition: their values, composition table, symbols' numbers, starts."""
    funcs = [tuple(range(8))] + [tuple(_step(q, s)[0] for q in range(8)) for s in range(8)]
    symbol = np.arange(1, 9, dtype=np.uint8)
    reset = [tuple(_step(NONE, s)[0] for _ in range(8)) for s in range(8)]
    known = {}
    for f in funcs + reset:
        known.setdefault(f, len(known))
    symbol = np.array([known[f] for f in funcs[1:]], dtype=np.uint8)
    first = np.array([known[f] for f in reset], dtype=np.uint8)
    grown = True
    while grown:
        grown = False
        for f in list(known):
            for g in list(known):
                h = tuple(g[f[q]] for q in range(8))
                if h not in known:
                    known[h], grown = len(known), True
    assert len(known) <= 256
    values = np.array(sorted(known, key=known.get), dtype=np.uint8)
    table = np.array([[known[tuple(g[f[q]] for q in range(8))] for g in known] for f in known], dtype=np.uint8)
    return values, table, symbol, first


VALUES, COMPOSE, SYMBOL_F, FIRST_F = _closure()
STARTS = np.array([[_step(q, s)[1] for s in range(8)] for q in range(8)])


def scan(f: np.ndarray) -> np.ndarray:
    """Function numbers -> the state after each of them, from NONE; associative, in blocks."""
    n = len(f)
    if n <= BLOCK:
        out, q = np.empty(n, dtype=np.uint8), NONE
        for i, k in enumerate(f.tolist()):
            q = int(VALUES[k, q])
            out[i] = q
        return out
    rows = -(-n // BLOCK)
    cols = np.zeros(rows * BLOCK, dtype=np.uint8)
    cols[:n] = f
    cols = np.ascontiguousarray(cols.reshape(rows, BLOCK).T)
    flat, width = COMPOSE.ravel(), COMPOSE.shape[1]
    for j in range(1, BLOCK):
        cols[j] = flat[cols[j - 1].astype(np.intp) * width + cols[j]]
    entry = np.concatenate([[NONE], scan(cols[-1])[:-1]]).astype(np.uint8)
    return np.ascontiguousarray(VALUES[cols, entry].T).ravel()[:n]


def boundaries(text: str, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where tokens start in the concatenation ``text`` of texts with these lengths (code points)."""
    n = len(text)
    if not n:
        return np.zeros(0, dtype=np.int64)
    code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    cls = table[code]
    ends = np.cumsum(lengths)
    heads = (ends - lengths)[lengths > 0]
    last = np.zeros(n, dtype=bool)
    last[ends[lengths > 0] - 1] = True
    follows = np.empty(n, dtype=np.uint8)  # class of the next code point of the same text; its end counts as space
    follows[:-1] = cls[1:]
    follows[last] = SPACE
    sym = cls.copy()  # L, N and O have the numbers of their classes
    space = cls == SPACE
    sym[space] = WS
    at = np.flatnonzero(space & (follows != SPACE))
    sym[at] = np.where(code[at] == 32, SP, WSL)
    for i in np.flatnonzero((code == 39) & (follows == LETTER)).tolist():
        if text[i + 1] in "stmd":
            sym[i] = A1
        elif not last[i + 1] and text[i + 1 : i + 3] in ("re", "ve", "ll"):
            sym[i] = A2
    f = SYMBOL_F[sym]
    f[heads] = FIRST_F[sym[heads]]
    state = np.empty(n, dtype=np.uint8)
    state[1:] = scan(f)[:-1]
    state[heads] = NONE
    return np.flatnonzero(STARTS[state, sym])


# ---- merging ------------------------------------------------------------------------------------


class Merger:
    """Pair merging by rank; ``merge`` takes many byte strings at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.stride = max(ranks.values()) + 1
        pairs = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a * self.stride + b] = r
        self.pairs = pairs
        key = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        val = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        self.tables = []  # each holds what the one before had no free slot for
        bits = max(8, len(key).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        for mul in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD):
            slot = self._slot(key, mul)
            keys, vals = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, self.stride, dtype=np.int64)
            keys[slot], vals[slot] = key, val
            left = keys[slot] != key
            self.tables.append((mul, keys, vals))
            key, val = key[left], val[left]
            if not len(key):
                break
        self.rest = dict(zip(key.tolist(), val.tolist()))

    def _slot(self, key: np.ndarray, mul: int) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(mul)) >> self.shift).astype(np.intp)

    def look_up(self, key: np.ndarray) -> np.ndarray:
        """Rank of the merged pair, or ``stride`` if there is none."""
        out = np.full(len(key), self.stride, dtype=np.int64)
        for mul, keys, vals in self.tables:
            slot = self._slot(key, mul)
            hit = keys[slot] == key
            out[hit] = vals[slot[hit]]
        if self.rest:
            for i, k in enumerate(key.tolist()):
                out[i] = self.rest.get(k, out[i])
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        done: list[list[int] | None] = [None] * len(pieces)
        work = []
        for k, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                done[k] = [r]
            elif len(p) > LONG_PIECE:
                done[k] = self.merge_long(p)
            else:
                work.append(k)
        raw = b"".join([pieces[k] for k in work])
        tok = self.byte[np.frombuffer(raw, np.uint8)]
        word = np.repeat(np.arange(len(work)), [len(pieces[k]) for k in work])
        rank = np.full(len(tok), self.stride, dtype=np.int64)  # of the pair that starts here
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.look_up(tok[inner] * self.stride + tok[inner + 1])
        while len(tok):
            head = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(tok)))
            over = low >= self.stride
            if over.any():
                for h, z, w in zip(head[over].tolist(), size[over].tolist(), word[head[over]].tolist()):
                    done[work[w]] = tok[h : h + z].tolist()
                stay = np.repeat(~over, size)
                tok, word, rank = tok[stay], word[stay], rank[stay]
                low, size = low[~over], size[~over]
                if not len(tok):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, size))
            hit = hit[np.flatnonzero(np.diff(word[hit], prepend=-1))]  # leftmost of each piece
            tok[hit] = low
            keep = np.ones(len(tok), dtype=bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # after removal
            tok, word, rank = tok[keep], word[keep], rank[keep]
            for i in (at, at - 1):
                i = i[i >= 0]
                ok = np.zeros(len(i), dtype=bool)
                inside = i + 1 < len(tok)
                ok[inside] = word[i[inside]] == word[i[inside] + 1]
                rank[i[ok]] = self.look_up(tok[i[ok]] * self.stride + tok[i[ok] + 1])
                if i is not at and len(i) == len(at):
                    continue
                rank[i[~ok & (i + 1 >= len(tok))]] = self.stride
            gone = at[(at + 1 >= len(tok)) | (word[np.minimum(at + 1, len(tok) - 1)] != word[at])]
            rank[gone] = self.stride
        sizes = np.array([len(d) for d in done], dtype=np.int64)
        return np.array([i for d in done for i in d], dtype=np.uint32), sizes

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece, in n log n."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        look = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := look(ids[i] * self.stride + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], k = r, -1, nxt[j]
            nxt[i] = k
            if k < n:
                prv[k] = i
                if (q := look(r * self.stride + ids[k])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[k]))
            if (p := prv[i]) >= 0 and (q := look(ids[p] * self.stride + r)) is not None:
                heapq.heappush(heap, (q, p, ids[p], r))
        return [x for x in ids if x >= 0]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, classes: bytes):
        self.table = np.frombuffer(zlib.decompress(classes), dtype=np.uint8)
        ranks = load_ranks(path)
        self.merger = Merger(ranks)
        bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            bytes_of[r] = t
        self.width = np.array([len(t) for t in bytes_of], dtype=np.int64)
        self.start = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.numbers: dict[str, int] = {}
        self.store = PieceStore()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if self.store.count > CACHE_PIECES:
            self.numbers, self.store = {}, PieceStore()
        text = "".join(texts)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        starts = boundaries(text, lengths, self.table)
        cuts = starts.tolist()
        slices = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]
        fresh = list(set(slices).difference(self.numbers))
        if fresh:
            self.numbers.update(zip(fresh, self.store.add(*self.merger.merge([p.encode() for p in fresh]))))
        ids, sizes = self.store.gather(np.fromiter(map(self.numbers.__getitem__, slices), np.int64, len(slices)))
        edges = np.concatenate([[0], np.cumsum(lengths)])
        return ids, per_text(sizes, np.diff(np.searchsorted(starts, edges)))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offsets of each id's start, and the end: what maps a place in the decoded bytes to an id."""
        return np.concatenate([[0], np.cumsum(self.width[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> np.ndarray:
        """The bytes of the ids, each written at its offset."""
        offsets = self.offsets(ids) if offsets is None else offsets
        return self.bytes[np.repeat(self.start[ids] - offsets[:-1], self.width[ids]) + np.arange(int(offsets[-1]))]


_CODERS: dict[str, ByteBpe] = {}


def coder(path: str, classes: bytes) -> ByteBpe:
    if path not in _CODERS:
        _CODERS[path] = ByteBpe(path, classes)
    return _CODERS[path]


def encode(docs: DataFrame, ranks: str, with_ids: bool = True) -> DataFrame:
    """``(doc_id, ids, offsets, n_tokens, ids_sha256, decoded_sha256)`` for each row of ``docs``; ids as little-endian
    32-bit integers, and so the offset of each id's first byte in the decoded text.

    ``ranks``: path of the rank file, which every executor has. ``with_ids`` off leaves ids and offsets out.
    """
    classes = class_table()

    def some(keys: pd.Series, texts: list[str], bpe: ByteBpe) -> pd.DataFrame:
        ids, n = bpe.encode(texts)
        raw = ids.astype("<u4").data.cast("B")
        ends = np.cumsum(n).tolist()
        cuts = list(zip([0, *ends], ends))
        offsets = bpe.offsets(ids)
        decoded, at = bpe.decode(ids, offsets).data, offsets[np.concatenate([[0], np.cumsum(n)]).astype(np.int64)]
        out = {"doc_id": keys}
        if with_ids:
            inner = (offsets[:-1] - np.repeat(at[:-1], n)).astype("<u4").data.cast("B")
            out["ids"] = [bytes(raw[4 * a : 4 * z]) for a, z in cuts]
            out["offsets"] = [bytes(inner[4 * a : 4 * z]) for a, z in cuts]
        out["n_tokens"] = n
        out["ids_sha256"] = [hashlib.sha256(raw[4 * a : 4 * z]).hexdigest() for a, z in cuts]
        out["decoded_sha256"] = [hashlib.sha256(decoded[a:z]).hexdigest() for a, z in zip(at.tolist(), at[1:].tolist())]
        return pd.DataFrame(out)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(ranks, classes)
        for b in batches:
            texts = b["text"].tolist()
            for part in blocks(texts):
                yield some(b["doc_id"].iloc[part].reset_index(drop=True), texts[part], bpe)

    schema = "doc_id long, " + "ids binary, offsets binary, " * with_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(each, schema)


__all__ = ["ByteBpe", "Merger", "boundaries", "class_table", "coder", "encode", "expand", "scan"]
