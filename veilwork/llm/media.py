"""Media columns: bytes as lossless WebP images, read back as pixel arrays.

A payload is cut into rows of 64 RGB pixels (192 bytes). Values longer than one image may
be high are several files in a row. For every value all tools of the format are weighed
(``webp.plan``: predictors, cross-colour, subtracted green, colour cache, two sets of codes),
and it is stored with them or with a palette, copies or plain codes, whichever is shorter;
text seldom gains from predictors, often from a cache. One value in ``EVERY``, chosen by its
content, is written with all tools whether they pay or not, so that stored tables prove every
path of the reader. ``store`` writes the files to a binary Parquet
column in a folder that all executors share; ``read_back`` decodes what is stored there
and computes features from the pixels.

Defined cases: a null text is an empty one, and an empty one is one row of spaces; equal
texts give equal files and features; null and repeated doc_ids keep a result row each;
an empty table stores nothing. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .common import blocks, shared_path

WIDTH = 64
ROW = 3 * WIDTH
PAD = b" "
#: One value in so many is written with all tools of the format, even where they don't pay.
EVERY = 64
#: Bits of the blocks that have a predictor and colour multipliers of their own, and of the colour cache.
BLOCK_BITS, CACHE_BITS = 4, 6


def padded(raw: bytes) -> bytes:
    """``raw`` and spaces up to a positive multiple of a row."""
    return raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), PAD)


def all_tools(n_pixels: int) -> dict:
    """Options of ``webp.encode`` that use every transform, the colour cache and two sets of codes; blocks take turns."""
    down = webp.blocks_of(n_pixels // WIDTH, BLOCK_BITS)
    k = np.arange(webp.blocks_of(WIDTH, BLOCK_BITS) * down, dtype=np.uint32)
    predictors = np.uint32(webp.OPAQUE) | (k % np.uint32(14)) << np.uint32(8)
    multipliers = np.uint32(webp.OPAQUE) | (k * np.uint32(0x1F2B35)) & np.uint32(0xFFFFFF)
    transforms = ((webp.PREDICTOR, BLOCK_BITS, predictors), (webp.CROSS, BLOCK_BITS, multipliers), (webp.GREEN,))
    return {"transforms": transforms, "cache_bits": CACHE_BITS, "groups": BLOCK_BITS}


def to_webp(payload: bytes, every: int = EVERY) -> bytes:
    """One file, or several in a row where one can't be so high."""
    return to_webps([payload], every)[0]


def to_webps(payloads: list[bytes], every: int = EVERY) -> list[bytes]:
    out: list[list[bytes]] = [[] for _ in payloads]
    images, of, step = [], [], WIDTH * webp.MAX_SIDE
    for k, payload in enumerate(payloads):
        rgb = np.frombuffer(payload, np.uint8).reshape(-1, 3)
        ch = np.empty((len(rgb), 4), dtype=np.uint8)
        ch[:, :3] = rgb[:, ::-1]
        ch[:, 3] = 255
        px = webp.pixels(ch)
        parts = [px[a : a + step] for a in range(0, len(px), step)]
        if zlib.crc32(payload) % every == 0:
            out[k] = [webp.encode(x, WIDTH, **all_tools(len(x))) for x in parts]
        else:
            images += parts
            of += [k] * len(parts)
    for k, raw in zip(of, webp.encode_each(images, WIDTH)):
        out[k].append(raw)
    return [b"".join(x) for x in out]


def from_webp(media: bytes) -> np.ndarray:
    """``(height, width, 3)`` samples: red, green, blue."""
    return next(from_webps([media]))


def from_webps(media: list[bytes]) -> Iterator[np.ndarray]:
    """``from_webp`` of each value; many are read together."""
    files = [list(webp.files(m)) for m in media]
    decoded = webp.decode_each([raw for parts in files for raw in parts])
    for parts in files:
        images = []
        for _ in parts:
            width, height, px = next(decoded)
            images.append(webp.channels(px)[:, 2::-1].reshape(height, width, 3))
        yield images[0] if len(images) == 1 else np.concatenate(images)


def features(image: np.ndarray) -> str:
    """Size, mean of each channel, and a hash: which columns are brighter than the mean."""
    height, width, _ = image.shape
    columns = image.sum(axis=0, dtype=np.int64)
    means = columns.sum(axis=0) // (height * width)
    bright = columns.sum(axis=1)
    bits = np.packbits(bright * width > bright.sum())
    return f"{width}x{height}:{means[0]},{means[1]},{means[2]}:{bits.tobytes().hex()}"


def store(docs: DataFrame, path: str) -> None:
    """Write ``(doc_id, n_bytes, media)`` for each row of ``docs`` (doc_id, text) to ``path``."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for part in blocks(texts):
                raw = [t.encode() for t in texts[part]]
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[part], "n_bytes": [len(r) for r in raw], "media": to_webps([padded(r) for r in raw])})

    docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(
        each, "doc_id long, n_bytes long, media binary"
    ).write.option("compression", "uncompressed").parquet(path)


def read_back(stored: DataFrame, with_pixels: bool = True) -> DataFrame:
    """Size, digests and features of each stored value, and its samples (``pixels``: row by row, RGB)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("height", "pixels", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature")}
            for media, image in zip(b["media"], from_webps(b["media"].tolist())):
                payload = image.tobytes()
                row = (
                    image.shape[0],
                    payload,
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-16:]),
                    hashlib.sha256(media).hexdigest(),
                    features(image),
                )
                for k, v in zip(out, row):
                    out[k].append(v)
            frame = pd.DataFrame(out) if with_pixels else pd.DataFrame({k: v for k, v in out.items() if k != "pixels"})
            frame.insert(0, "doc_id", b["doc_id"].to_numpy(dtype=object))
            frame.insert(1, "n_bytes", b["n_bytes"].to_numpy())
            frame.insert(2, "media_bytes", [len(m) for m in b["media"]])
            yield frame

    schema = (
        "doc_id long, n_bytes long, media_bytes long, height int, "
        + "pixels binary, " * with_pixels
        + "payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"
    )
    return stored.select("doc_id", "n_bytes", "media").mapInPandas(each, schema)


def media_columns(docs: DataFrame, path: str | None = None, with_pixels: bool = True) -> DataFrame:
    """Store ``docs`` in ``path`` (a new shared folder by default) and read every value back."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "media")
    store(docs, path)
    return read_back(spark.read.parquet(path), with_pixels)
