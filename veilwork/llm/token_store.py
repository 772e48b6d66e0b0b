"""Token ids in binary files with Elias-Fano document boundaries.

A shard file holds one range of doc_id, its ids concatenated as unsigned 16- or 32-bit
little-endian integers, followed by the document boundaries as an Elias-Fano sequence
(n + 1 monotone offsets with universe u: about ``n * (2 + log2(u / n))`` bits) and the
doc_ids. A select structure, one sample per 256 set bits plus a word-wise popcount,
returns any offset without a table of 64-bit offsets.

Shards are rows of a binary Parquet table in the folder ``path``, so that any store that Spark writes to will
do. Their sizes, summed in levels, give the number of ids before each of them.

Defined cases: a null text is an empty one (only the end id); the string of an added token in a text is that
token, as the library has it; a null doc_id sorts first; equal rows are stored each; an empty table stores
nothing. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, running_base, shared_path
from .piece_store import PieceStore, PieceTable, expand, per_text, slice_hashes

MAGIC = b"VWTOK1"
#: Characters of text that one shard gets, about; a shard is held in memory by its writer and reader.
SHARD_CHARS = 6_000_000
#: Characters of text in one range of doc_id, about, where there are many; a range is one task's.
PART_CHARS = 64_000_000
#: Characters encoded at a time, about.
ENCODE_CHARS = 3_000_000
#: A shard's number is its range's, shifted by so many bits, and its place in the range.
SHARD_BITS = 20
SHARD_ROW = pa.schema([("shard", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
#: Distinct pieces that a worker remembers, and their ids.
CACHE_PIECES = 1_000_000
CACHE_IDS = 16_000_000
#: Longer pieces (bytes) aren't remembered.
LONG_PIECE = 128
#: Bytes of text whose pieces are looked up at a time, about; that takes some 100 bytes of memory for each of them.
STRETCH_BYTES = 1 << 18
#: Bits of the table of pieces when it is empty; it grows as pieces come.
TABLE_BITS = 16
#: Pieces given to the library as one text.
GROUP_PIECES = 200
SAMPLE = 256
END_ID = 0


# ---- Elias-Fano ---------------------------------------------------------------------------------


class EliasFano:
    """A monotone sequence of unsigned integers; ``get`` selects one value, ``values`` decodes all."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = v & np.uint64((1 << bits) - 1)
        spread = ((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) // 64 + 1) * 64 if n else 0, dtype=np.uint8)
        high[ones] = 1
        packed = np.packbits(spread.ravel(), bitorder="little")
        return cls(n, bits, packed, np.packbits(high, bitorder="little").view("<u8"), ones[::SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        chunk = self.low[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes()
        return (int.from_bytes(chunk, "little") >> (at & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Position of the i-th set bit in the upper part."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word, bit = divmod(at, 64)
        rest = int(self.high[word]) >> bit << bit
        while (k := rest.bit_count()) <= left:
            left -= k
            word += 1
            rest = int(self.high[word])
        for _ in range(left):
            rest &= rest - 1
        return word * 64 + (rest & -rest).bit_length() - 1

    def get(self, i: int) -> int:
        return (self.select(i) - i) << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits)
            out |= bits.reshape(self.n, self.low_bits) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview) -> tuple[EliasFano, int]:
        n, bits, a, b, c = struct.unpack_from("<QBQQQ", raw)
        at = struct.calcsize("<QBQQQ")
        low = np.frombuffer(raw, np.uint8, a, at)
        high = np.frombuffer(raw, "<u8", b, at + a)
        samples = np.frombuffer(raw, "<u4", c, at + a + 8 * b)
        return cls(n, bits, low, high, samples), at + a + 8 * b + 4 * c


# ---- shard files --------------------------------------------------------------------------------


def pack_shard(doc_ids: np.ndarray, null_ids: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """``bounds``: n + 1 offsets into ``ids``."""
    wide = bool(len(ids)) and int(ids.max()) >= 1 << 16
    body = ids.astype("<u4" if wide else "<u2").tobytes()
    ef = EliasFano.encode(bounds).to_bytes()
    return b"".join(
        [
            MAGIC,
            struct.pack("<BQQQ", 4 if wide else 2, len(doc_ids), len(body), len(ef)),
            body,
            ef,
            doc_ids.astype("<i8").tobytes(),
            np.packbits(null_ids.astype(np.uint8), bitorder="little").tobytes(),
        ]
    )


class Shard:
    """A shard file read back."""

    def __init__(self, raw: bytes):
        view = memoryview(raw)
        if bytes(view[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a token shard")
        width, self.n, body, ef = struct.unpack_from("<BQQQ", view, len(MAGIC))
        at = len(MAGIC) + struct.calcsize("<BQQQ")
        self.ids = np.frombuffer(view, "<u4" if width == 4 else "<u2", body // width, at)
        self.bounds, _ = EliasFano.from_bytes(view[at + body : at + body + ef])
        at += body + ef
        self.doc_ids = np.frombuffer(view, "<i8", self.n, at)
        self.null_ids = np.unpackbits(np.frombuffer(view, np.uint8, offset=at + 8 * self.n), bitorder="little", count=self.n)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.get(i) : self.bounds.get(i + 1)]


# ---- encoding -----------------------------------------------------------------------------------

def _boundary_table() -> tuple[np.ndarray, np.ndarray]:
    """Classes of bytes, and the pairs of classes between which a token always starts (those of ASCII only)."""
    kind = np.zeros(256, dtype=np.uint8)
    for i in range(33, 127):
        kind[i] = 1 if chr(i).isalpha() else 2 if chr(i).isdigit() else 3
    kind[10] = 4
    pair = np.zeros((8, 8), dtype=bool)
    pair[1, [2, 3]] = pair[2, [1, 3]] = pair[[1, 2, 3], 4] = pair[4, [1, 2, 3]] = True
    return kind, pair.ravel()


KIND, STARTS = _boundary_table()


def starts_inside(raw: np.ndarray) -> np.ndarray:
    """Mask of the bytes that start a token by their class and the one before's."""
    kind, out = KIND[raw], np.zeros(len(raw), dtype=bool)
    out[1:] = STARTS[kind[:-1] << 3 | kind[1:]]
    return out


def starts_before_word(raw: np.ndarray) -> np.ndarray:
    """Mask of the spaces that a character other than white space follows, in UTF-8 bytes."""
    out = raw == 32
    out[-1:] = False
    at = np.flatnonzero(out)
    nxt = raw[at + 1]
    white = (nxt >= 9) & (nxt <= 13) | (nxt >= 28) & (nxt <= 32)
    wide = np.flatnonzero(np.isin(nxt, (0xC2, 0xE1, 0xE2, 0xE3)))
    if len(wide):  # white space of two or three bytes
        i = at[wide] + 1
        a, b = raw[i + 1], raw[np.minimum(i + 2, len(raw) - 1)]
        two = (raw[i] == 0xC2) & ((a == 0x85) | (a == 0xA0))
        general = (a == 0x80) & ((b <= 0x8A) | (b == 0xA8) | (b == 0xA9) | (b == 0xAF)) | (a == 0x81) & (b == 0x9F)
        three = (raw[i] == 0xE1) & (a == 0x9A) & (b == 0x80) | (raw[i] == 0xE2) & general | (raw[i] == 0xE3) & (a == 0x80) & (b == 0x80)
        white[wide] = two | three
    out[at[white]] = False
    return out


class PieceEncoder:
    """Encodes texts with a byte-level ``tokenizers`` file as the library does, each distinct piece once.

    The vocabulary's pre-tokeniser never joins characters across a space that a
    non-space follows, nor letters, digits and what comes after them, nor a line's end and
    its neighbours. Texts split there into pieces whose ids are independent. Pieces are told
    apart by two 64-bit hashes, and long ones aren't remembered. A text that holds the string
    of an added token goes to the library whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, models

        self.tok = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rest = {k: v for k, v in model.items() if k not in ("type", "vocab", "merges") and v is not None}
        self.tok.model = models.BPE(model["vocab"], merges, cache_capacity=0, **rest)  # pieces are distinct
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # a token's characters stand for one byte each
        self.width = np.zeros(max(model["vocab"].values()) + 2, dtype=np.int32)
        for t, i in model["vocab"].items():
            self.width[i] = len(t)
        self.clear()

    def clear(self) -> None:
        self.table, self.store = PieceTable(TABLE_BITS), PieceStore()

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def _put(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Encode these slices of ``raw``; their places in the store. Those that begin with a space are encoded
        many at once, and the bytes of the ids tell where each one's ids end."""
        slots = np.empty(len(start), np.int64)
        spaced = raw[start] == 32
        alone, many = np.flatnonzero(~spaced), np.flatnonzero(spaced)
        if len(alone):
            texts = [raw[a : a + n].tobytes() for a, n in zip(start[alone].tolist(), size[alone].tolist())]
            slots[alone] = self.store.add(*self._encode(texts))
        if len(many):
            joined, ends = raw[expand(start[many], size[many])].tobytes(), np.cumsum(size[many])
            cuts = [0, *ends[GROUP_PIECES - 1 : -1 : GROUP_PIECES].tolist(), len(joined)]
            ids, _ = self._encode([joined[a:z] for a, z in zip(cuts, cuts[1:])])
            last = np.searchsorted(np.cumsum(self.width[ids], dtype=np.int64), ends, side="left") + 1
            slots[many] = self.store.add(ids, np.diff(last, prepend=0))
        return slots

    def _plain(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that ``edges`` cut ``raw`` into, and how many each has."""
        cut = starts_before_word(raw) | starts_inside(raw)
        begins = edges[:-1][np.diff(edges) > 0]
        last = begins[begins > 0] - 1
        cut[last[raw[last] == 32]] = False  # a text's last space has nothing after it
        cut[begins] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(raw)))
        firsts = [0]
        while firsts[-1] < len(start):
            firsts.append(int(np.searchsorted(start, start[firsts[-1]] + STRETCH_BYTES)))
        got = [self._pieces(raw, start[a:z], size[a:z]) for a, z in zip(firsts, firsts[1:])]
        if not got:
            return np.zeros(0, np.uint32), np.zeros(len(edges) - 1, np.int64)
        ids, sizes = (np.concatenate(x) for x in zip(*got))
        return ids, per_text(sizes, np.diff(np.searchsorted(start, edges)))

    def _pieces(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these slices of ``raw``, which start within ``STRETCH_BYTES``, and how many each has."""
        low, short = int(start[0]), np.flatnonzero(size <= LONG_PIECE)
        a, b = slice_hashes(raw[low : low + STRETCH_BYTES + LONG_PIECE], start[short] - low, size[short])
        slots = np.full(len(start), -1, np.int64)
        slots[short] = found = self.table.find(a, b)
        kept = np.flatnonzero(found < 0)
        if len(kept):
            first, inverse = np.unique(a[kept], return_index=True, return_inverse=True)[1:]
            rows = kept[first]
            same = b[kept] == b[rows][inverse]
            got = self._put(raw, start[short[rows]], size[short[rows]])
            self.table.put(a[rows], b[rows], got)
            slots[short[kept[same]]] = got[inverse[same]]
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = self._put(raw, start[new], size[new])
        return self.store.gather(slots)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        if self.table.count > CACHE_PIECES or self.store.used > CACHE_IDS:
            self.clear()
        whole = np.zeros(len(texts), dtype=bool)
        for t in self.added:
            whole |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self._plain(*bytes_of(texts))
        ids, sizes = self._plain(*bytes_of(texts.filter(pa.array(~whole))))
        apart, n_apart = self._encode([t.encode() for t in texts.filter(pa.array(whole)).to_pylist()])
        n, start = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        n[~whole], n[whole] = sizes, n_apart
        start[~whole], start[whole] = np.cumsum(sizes) - sizes, len(ids) + np.cumsum(n_apart) - n_apart
        return np.concatenate([ids, apart])[expand(start, n)], n


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the edges between them."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[edges[0] : edges[-1]], edges - edges[0]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after each document; the n + 1 boundaries."""
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(bounds[-1], end_id, dtype=np.uint32)
    keep = np.ones(len(out), dtype=bool)
    keep[bounds[1:] - 1] = False
    out[keep] = ids
    return out, bounds


def parts_for(spark: SparkSession, chars: int, shard_chars: int) -> int:
    """Ranges of doc_id: enough to keep the cores busy, else ``PART_CHARS`` each, so that the sample which
    finds their bounds stays small beside the table."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(-(-chars // shard_chars), max(4 * cores, -(-chars // PART_CHARS))))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_chars: int = SHARD_CHARS) -> None:
    """Encode ``docs`` (doc_id, text) and write shards in ascending doc_id order to ``path``.

    A task takes one range of doc_id, sorted, and writes a shard for every ``shard_chars`` characters of it.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = (
        docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(parts_for(docs.sparkSession, chars, shard_chars), *order)
        .sortWithinPartitions(*order)
    )

    def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, no = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        nulls: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            out, bounds = with_end(np.concatenate(ids), np.concatenate(sizes), end_id)
            raw = pack_shard(np.concatenate(keys), np.concatenate(nulls), out, bounds)
            for held in (ids, sizes, keys, nulls):
                held.clear()
            row = {"shard": [part << SHARD_BITS | no], "n_ids": [len(out)], "data": [raw]}
            return pa.RecordBatch.from_pydict(row, schema=SHARD_ROW)

        chars = 0
        for b in batches:
            text, doc_id = b.column("text"), b.column("doc_id")
            length = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, z in spans_of(length, ENCODE_CHARS):
                got, n = enc(text.slice(a, z - a))
                ids.append(got)
                sizes.append(n)
                key = doc_id.slice(a, z - a)
                keys.append(key.fill_null(0).to_numpy().copy())  # a view would hold the whole batch
                nulls.append(key.is_null().to_numpy(zero_copy_only=False))
                chars += int(length[a:z].sum())
                if chars >= shard_chars:
                    yield shard()
                    chars, no = 0, no + 1
        if ids:
            yield shard()

    ranged.mapInArrow(shards_of, "shard long, n_ids long, data binary").write.option("compression", "zstd").option(
        "parquet.enable.dictionary", "false"
    ).parquet(path)


def spans_of(length: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Slices of consecutive texts with about ``limit`` characters each; a longer text makes one of its own."""
    ends = np.cumsum(length)
    a = 0
    while a < len(length):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
        yield a, z
        a = z


def firsts(files: DataFrame) -> DataFrame:
    """``(shard, first)``: the number of ids before each shard, from the shards' sizes, one small row for each shard."""
    return running_base(files.select("shard", "n_ids"), "shard", "n_ids", "first")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` for each stored document, from the files.

    Shards are decoded where they are read; only a small row for each document meets the shards' firsts.
    """
    files = spark.read.parquet(path)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, raw in zip(b.column("shard").to_pylist(), b.column("data").to_pylist()):
                s = Shard(raw)
                bounds = s.bounds.values()
                words, cuts = s.ids.astype("<u4").data.cast("B"), (4 * bounds).tolist()
                crc = [zlib.crc32(words[a:z]) for a, z in zip(cuts, cuts[1:])]
                doc_id = pa.array(s.doc_ids, mask=s.null_ids.astype(bool))
                row = [pa.array(np.full(s.n, no)), doc_id, pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(row, ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.select("shard", "data").mapInArrow(
        each, "shard long, doc_id long, start long, n_tokens long, ids_crc32 long"
    )
    return rows.join(firsts(files), "shard").select(
        "doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )


def stored_documents(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` to ``path`` (a new shared folder by default) and read every document back."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_documents(spark, path)


__all__ = ["EliasFano", "Shard", "pack_shard", "read_documents", "remove", "stored_documents", "write_tokens"]
