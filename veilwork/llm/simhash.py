"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints: 64 bits, a bit is the majority of that bit over the XXH64 of all word
shingles. Two fingerprints are linked if at most ``radius`` bits differ.

Candidates: give each bit a nonzero vector of radius + 1 bits. A table belongs to each of
the ``2 ** (radius + 1) - 1`` nonzero vectors v; its mask holds the bits whose vector has
an odd product with v. The vectors of any ``radius`` bits span fewer than radius + 1
dimensions, so some v is orthogonal to all of them, and in its table both fingerprints
fall into one bucket: no pair within the radius is missed, and a mask still holds about
half of the bits.

Only distinct fingerprints enter. Buckets of two are settled from their minimum and
maximum. Larger ones are cut into blocks, and each pair of blocks goes to one task,
which walks from fingerprint to fingerprint and emits a spanning forest, not all pairs.
Components then come from alternating stars; neither links nor components meet on the
driver.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any
other; equal rows share a component; a null doc_id is nobody's smallest (a component of
such documents only has none). ``keep_one`` keeps the document with the smallest doc_id,
of several texts with that id the one with the smallest hash, and a document without an
id only if no other has one. Extra columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import found_in, packed, stash, unpacked
from .components import components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Fingerprints of one bucket that one task compares with as many others, about.
BLOCK_ROWS = 4096


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(text, seed)]
    else:
        starts = [0, *ends]
        hashes = [xxh64_intdigest(text[a : z - 1], seed) for a, z in zip(starts, ends[shingle - 1 :])]
    rows = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    count = np.zeros(64, dtype=np.int64)
    for k in range(0, len(rows), 255):  # sums of 255 bits fit a byte
        count += np.unpackbits(rows[k : k + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * count > len(rows), bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([fingerprint(bytes(t), shingle) for t in b], dtype="int64")

    return of(F.coalesce(text, F.lit("")).cast("binary"))


def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = 7) -> list[int]:
    """One mask for each nonzero vector of radius + 1 bits."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(bits)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def spanning_links(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A forest that connects what links of at most ``radius`` bits connect."""
    out: list[tuple[int, int]] = []
    left = prints.view(np.uint64)
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            u = reached.pop()
            near = np.bitwise_count(left ^ u) <= radius
            if near.any():
                hit = left[near]
                a = int(u.astype(np.int64))
                out += [(a, b) for b in hit.astype(np.int64).tolist()]
                reached.extend(hit)
                left = left[~near]
    return out


def bucket_rows(prints: DataFrame, radius: int) -> DataFrame:
    """``(t, key, fp)``: each fingerprint in each of its buckets."""
    rows = [
        F.struct(F.lit(t).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for t, m in enumerate(covering_masks(radius))
    ]
    return prints.select("fp", F.inline(F.array(*rows)).alias("t", "key"))


def links(prints: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(u, v)`` over the distinct fingerprints ``prints`` (fp): enough links to connect all that are linked."""
    rows = bucket_rows(prints, radius)
    sizes = stash(
        rows.groupBy("t", "key")
        .agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
        .where((F.col("n") > 2) | (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius))
        .where(F.col("n") > 1),
        "buckets",
    )
    pairs = sizes.where(F.col("n") == 2).select("u", "v")
    blocks = F.ceil(F.col("n") / F.lit(block_rows)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    large = (
        rows.join(sizes.where(F.col("n") > 2).select("t", "key", blocks.alias("s")), ["t", "key"])
        .withColumn("i", own)
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        .select("t", "key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp")
    )
    keys = ["t", "key", "i", "j"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b])
            if not len(b):
                continue
            k, fp = b[keys].to_numpy(np.int64), b["fp"].to_numpy(np.int64)
            cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            last = int(cut[-1]) if len(cut) else 0
            held = b.iloc[last:]
            out = [e for g in np.split(fp[:last], cut[:-1]) for e in spanning_links(g, radius)] if last else []
            if out:
                yield pd.DataFrame(out, columns=["u", "v"])
        if held is not None and (out := spanning_links(held["fp"].to_numpy(np.int64), radius)):
            yield pd.DataFrame(out, columns=["u", "v"])

    walked = large.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(walk, "u long, v long")
    return pairs.unionByName(walked)


def grouped(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_hash, fp, head)`` for each row of ``docs``; ``head``: what names the first document of its
    component, a struct of ``no_id``, ``doc_id`` and ``text_hash`` (smallest id, then smallest hash; no id comes last)."""
    marked = stash(
        docs.select(
            "doc_id", F.xxhash64("text").alias("text_hash"), fingerprint_column(F.col("text"), shingle).alias("fp")
        ),
        "prints",
    )
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    prints = stash(marked.groupBy("fp").agg(F.min(name).alias("first"), F.count("*").alias("n_rows")), "distinct-prints")
    roots = components(links(prints.select("fp"), radius))
    # a fingerprint without links is its own component and needs no join by root
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    n = 2 * roots.count()
    members = members.join(prints, members["node"] == prints["fp"]).select("fp", "root", "first")
    members = stash(members, "linked-prints", rows=n)
    heads = members.groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("n"))
    headed = found_in(members, stash(heads, "component-heads", rows=n), "root", "n", n).select(F.col("fp").alias("node"), "head")
    of_print = prints.join(headed, prints["fp"] == headed["node"], "left").select(
        "fp", "n_rows", F.coalesce("head", "first").alias("head")
    )
    of_print = stash(of_print, "print-components")
    return found_in(marked, of_print, "fp", "n_rows").select("doc_id", "text_hash", "fp", "head")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``."""
    return grouped(docs, radius, shingle).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("head.doc_id").alias("component_id"),
    )


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The first document of each component. A document is told apart by its id and its text: equal rows are one."""
    same = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    gone = (
        grouped(docs, radius, shingle)
        .where(~same)
        .select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
        .distinct()
    )
    on = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("hash"))
    return packed(docs).join(gone, on, "left_anti").select(*unpacked(docs.columns))
