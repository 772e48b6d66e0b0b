"""Substring dedup by prefix-partitioned suffix trees over words.

A word goes if some window of ``WINDOW`` words over it has a word sequence that also
starts earlier (in a smaller document, or earlier in the same one).

1. Every window is filed under its anchor, the smallest hash of the ``ANCHOR``-word
   sequences in it: equal windows have equal anchors. Neighbouring starts with one
   anchor form a segment, so about a ninth as many rows as words are shuffled, without
   their words.
2. Per anchor, equal segments are settled at once: all but the first go whole. Where an
   anchor has different segments (or one that repeats inside itself) their first copies
   are fetched with their words; unique anchors, nearly all, are leaves and end here.
3. What is left is split by prefix into groups that fit a task: the anchor is the
   prefix, or, where it has more than ``GROUP_ROWS`` segments, the whole window is.
   Each group's suffix subtree is built down to ``WINDOW`` words by prefix doubling;
   its nodes at that depth with two leaves or more are the repeats, and every leaf but
   the first is marked.

Blocks of documents settle their own equal segments, and batches their equal windows,
before the shuffles, so a passage in many documents costs a row per block; and a window's
copies are settled as they stream by, however many there are. Words stand for themselves by 64-bit hashes.

Defined cases: a null text has no words; a document is told apart by its id and its
text, so equal rows are one document and don't repeat each other; a null doc_id counts
as the largest; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, repeated, stash

WINDOW = 20
ANCHOR = 5
#: Starts in one segment at most.
SEGMENT = 64
#: Segments of one anchor that one subtree takes; beyond, its windows are split by their whole word sequence.
GROUP_ROWS = 5_000
#: Words whose subtrees are built at a time, about.
TREE_WORDS = 500_000
#: Bytes of text whose words are looked at together: bounds a worker's memory.
BLOCK_BYTES = 1_000_000
#: Longer words are hashed one by one.
LONG_WORD = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
LAST_ID = (1 << 63) - 1


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts, and each text's number of words. ``raw``: the texts' UTF-8 bytes, one after
    the other; ``at``: where each starts, and the end. No word becomes an object of its own and none is kept."""
    from xxhash import xxh64_intdigest

    raw = raw[at[0] : at[-1]]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[at - at[0]] = True
    word = np.zeros(len(raw) + 2, dtype=bool)  # between two gaps
    np.logical_not((raw == 32) | (raw - np.uint8(9) < 5), out=word[1:-1])
    start = np.flatnonzero(word[1:-1] & (cut[:-1] | ~word[:-2]))
    size = np.flatnonzero(word[1:-1] & (cut[1:] | ~word[2:])) + 1 - start
    lengths = np.diff(np.searchsorted(start, at - at[0]))
    eight = np.ndarray(len(raw) + 1, "<u8", np.append(raw, np.zeros(8, np.uint8)), strides=(1,))  # from each byte on
    h, left = mixed(size.astype(np.uint64)), size
    todo = np.flatnonzero(size <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        todo = todo[left[todo] > k]
        if not len(todo):
            break
        beyond = np.maximum(8 - (left[todo] - k), 0).astype(np.uint64) * np.uint64(8)
        with np.errstate(over="ignore"):
            h[todo] = mixed(h[todo] + (eight[start[todo] + k] << beyond))
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        h[k] = xxh64_intdigest(raw[start[k] : start[k] + size[k]].tobytes(), 1)
    return h, lengths


def joined_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``raw`` and ``at`` of ``word_hashes``."""
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``raw`` and ``at`` of a string column without nulls, as they lie there."""
    _, at, raw = column.buffers()
    at = np.frombuffer(at, np.int64 if pa.types.is_large_string(column.type) else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(raw or b"", np.uint8), at


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def sequence_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on (0 if there are fewer), by doubling."""
    out, done, at, have, scale = None, 0, h, 1, BASE
    while True:
        if size & have:
            if out is None:
                out, done = at, have
            else:
                out, done = joined(out, at, done), done + have
        if have * 2 > size:
            break
        at, have = joined(at, at, have), have * 2
    return out


def joined(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` words by ``a`` and then ``b``'s, from each place on."""
    out = np.zeros_like(a)
    with np.errstate(over="ignore"):
        if size < len(a):
            out[: len(a) - size] = a[: len(a) - size] + b[size:] * powers(size + 1)[-1]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of ``size`` values from each place on, as far as there are any."""
    have, out = 1, x.copy()
    while have < size:
        step = min(have, size - have)
        if step < len(out):
            out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def first_of_equal(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by ``keys`` and then ``order``; a mask of those that open a new key."""
    at = np.lexsort([*order[::-1], *keys[::-1]])
    new = np.ones(len(at), dtype=bool)
    if len(at):
        new[1:] = np.logical_or.reduce([k[at[1:]] != k[at[:-1]] for k in keys])
    return at, new


# ---- segments -----------------------------------------------------------------------------------


def segments(h: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """Segments of documents whose word hashes are concatenated: ``doc, lo, n, m`` (anchor), ``c`` (content), ``inner``."""
    total = len(h)
    doc_start = np.cumsum(lengths) - lengths
    grams = mixed(sequence_hashes(h, ANCHOR))
    anchor = sliding_min(grams, window - ANCHOR + 1)
    whole = sequence_hashes(h, window)
    n_starts = np.maximum(lengths - window + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), n_starts)
    s = np.arange(len(doc)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts) + doc_start[doc]
    m = anchor[s]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)
    if len(s):
        offset = np.arange(len(s)) - np.repeat(run, np.diff(np.append(run, len(s))))
        new |= offset % SEGMENT == 0
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(s)))
    seg = np.repeat(np.arange(len(head)), n)
    inner = np.zeros(len(head), dtype=bool)
    w = whole[s]
    for d in range(1, min(SEGMENT, len(s))):
        hit = np.flatnonzero(w[d:] == w[:-d])
        if len(hit):
            hit = hit[seg[hit] == seg[hit + d]]
            inner[seg[hit]] = True
    lo = s[head]
    with np.errstate(over="ignore"):
        up = powers(total + 1)
        sums = np.concatenate([[np.uint64(0)], np.add.accumulate(h * up[:-1])]) if total else np.zeros(1, np.uint64)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        c = mixed((sums[lo + n + window - 1] - sums[lo]) * powers(total + 1, inverse)[lo] + n.astype(np.uint64))
    d = doc[head]
    return {"doc": d, "lo": lo - doc_start[d], "n": n, "m": m[head], "c": c, "inner": inner}


SEGMENT_ROW = "kind byte, m long, c long, k1 long, k2 long, lo int, n int, inner boolean"
GONE, OPEN = 0, 1


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).cast("long").alias("k1"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("k2"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def distinct_rows(rows: DataFrame) -> DataFrame:
    """One row for equal rows of ``keyed``, with their number and how many of them have an id."""
    same = [F.max("doc_id").alias("doc_id"), F.first("text").alias("text")]
    return rows.groupBy("k1", "k2").agg(*same, F.count("doc_id").alias("n_ids"), F.count("*").alias("n_rows"))


def row_frame(kind, m, c, k1, k2, lo, n, inner) -> pd.DataFrame:
    count = len(lo)
    return pd.DataFrame(
        {
            "kind": np.full(count, kind, dtype=np.int8),
            "m": m.view(np.int64),
            "c": c.view(np.int64),
            "k1": k1,
            "k2": k2,
            "lo": lo.astype(np.int32),
            "n": n.astype(np.int32),
            "inner": inner,
        }
    )


def segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not len(b):
            continue
        raw, at = text_column(b.column("text"))
        ids = [b.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2")]
        a = 0
        while a < len(b):
            z = max(a + 1, int(np.searchsorted(at, at[a] + BLOCK_BYTES, side="right")) - 1)
            got = segments(*word_hashes(raw, at[a : z + 1]))
            k1, k2 = (k[a:z][got["doc"]] for k in ids)
            order, new = first_of_equal([got["m"], got["c"]], [k1, k2, got["lo"]])
            rows = {k: got[k][order] for k in ("m", "c", "lo", "n", "inner")} | {"k1": k1[order], "k2": k2[order]}
            for frame in (row_frame(OPEN, **{k: v[new] for k, v in rows.items()}), gone_rows(rows, new)):
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)
            a = z


def gone_rows(rows: dict[str, np.ndarray], first: np.ndarray) -> pd.DataFrame:
    """All rows but the first of each key, unless they are the same place of the same document as it or the row before."""
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    same, again = np.ones(len(first), dtype=bool), ~first
    for k in ("k1", "k2", "lo"):
        same &= rows[k] == rows[k][head]
        again[1:] &= rows[k][1:] == rows[k][:-1]
    out = {k: v[~same & ~again] for k, v in rows.items()}
    out["m"] = mixed(out["k2"].view(np.uint64) + out["lo"].astype(np.uint64))  # spreads them
    return row_frame(GONE, **out)


def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by (m, c, k1, k2, lo): what goes, and the first copies of segments whose anchor has others."""
    held: pd.DataFrame | None = None  # the last first copy, of which it isn't known yet whether another follows
    held_shared = False
    last: tuple | None = None  # first row of the last (m, c)
    for b in batches:
        yield b[b["kind"] == GONE]
        b = b[b["kind"] == OPEN]
        if not len(b):
            continue
        if last is not None:
            b = pd.concat([last, b], ignore_index=True)
        m, c = b["m"].to_numpy(), b["c"].to_numpy()
        first = np.ones(len(b), dtype=bool)
        first[1:] = (m[1:] != m[:-1]) | (c[1:] != c[:-1])
        rows = {k: b[k].to_numpy() for k in ("m", "c", "k1", "k2", "lo", "n", "inner")}
        rows["m"], rows["c"] = rows["m"].view(np.uint64), rows["c"].view(np.uint64)
        yield gone_rows(rows, first)
        carried = last is not None
        last = b.iloc[[int(np.flatnonzero(first)[-1])]]
        firsts = b[first]
        firsts = firsts.iloc[1:] if carried else firsts
        if not len(firsts):
            continue
        if held is not None:
            firsts = pd.concat([held, firsts], ignore_index=True)
        m = firsts["m"].to_numpy()
        shared = firsts["inner"].to_numpy(dtype=bool).copy()
        twin = m[1:] == m[:-1]
        shared[1:] |= twin
        shared[:-1] |= twin
        shared[0] |= held_shared if held is not None else False
        yield firsts[:-1][shared[:-1]]
        held, held_shared = firsts.iloc[[-1]], bool(shared[-1])
    if held is not None and held_shared:
        yield held


# ---- subtrees -----------------------------------------------------------------------------------


def node_of(words: np.ndarray, starts: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """For each suffix of ``words`` that starts at ``starts`` its node at ``depth``: numbers in suffix order, by prefix doubling."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    have, node, done = 1, None, 0
    while True:
        if depth & have:
            node = rank if node is None else _ranked(node, rank, done)
            done += have
        if have * 2 > depth:
            break
        rank, have = _ranked(rank, rank, have), have * 2
    return node[starts]


def _ranked(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    later = np.full(len(a), -1, dtype=np.int64)
    if shift < len(a):
        later[: len(a) - shift] = b[shift:]
    return np.unique(a * (int(b.max(initial=0)) + 2) + later + 1, return_inverse=True)[1].astype(np.int64)


CONTENT_ROW = "key long, k1 long, k2 long, lo int, words binary"


def marked_leaves(words: list[bytes], k1: np.ndarray, k2: np.ndarray, lo: np.ndarray, window: int = WINDOW) -> pd.DataFrame:
    """``(k1, k2, lo)`` of the window starts that aren't their node's first leaf."""
    flat = np.frombuffer(b"".join(words), np.uint64)
    size = np.array([len(w) // 8 for w in words], dtype=np.int64)
    n = size - window + 1
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    node = node_of(flat, (np.cumsum(size) - size)[row] + offset, window)
    leaf = {"k1": k1[row], "k2": k2[row], "lo": lo[row] + offset}
    at, first = first_of_equal([node], list(leaf.values()))
    leaf = {k: v[at] for k, v in leaf.items()}
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    later = np.logical_or.reduce([v != v[head] for v in leaf.values()])
    return pd.DataFrame({k: v[later] for k, v in leaf.items()})


def lone_windows(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of content rows sorted by (key, k1, k2, lo): rows of one window that only repeat their key's first row, and
    those of them that stand in another place. They need no tree, however many there are."""
    key = b["key"].to_numpy(np.int64)
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    words = b["words"].to_numpy(dtype=object)
    again = np.fromiter((len(w) == 8 * WINDOW for w in words), bool, len(words)) & ~first & (words == words[head])
    moved = np.zeros(len(key), dtype=bool)
    for k in ("k1", "k2", "lo"):
        v = b[k].to_numpy(np.int64)
        moved |= v != v[head]
    return again, again & moved


def subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From content rows sorted by (key, k1, k2, lo): ``(k1, k2, span)`` of the words to remove."""

    def single(b: pd.DataFrame) -> pd.DataFrame:
        lo = b["lo"].to_numpy(np.int64)
        return pd.DataFrame({"k1": b["k1"], "k2": b["k2"], "span": packed(lo, np.ones(len(lo), np.int64))})

    def build(b: pd.DataFrame) -> pd.DataFrame:
        got = marked_leaves(b["words"].tolist(), *(b[k].to_numpy(np.int64) for k in ("k1", "k2", "lo")))
        return pd.DataFrame({"k1": got["k1"], "k2": got["k2"], "span": packed(got["lo"].to_numpy(), np.ones(len(got), np.int64))})

    held: list[pd.DataFrame] = []
    size = 0
    last: pd.DataFrame | None = None  # the last key's first row, which is held already
    for b in batches:
        settled = (b["words"].map(len) == 0).to_numpy(dtype=bool)
        yield single(b[settled])
        b = b[~settled]
        if not len(b):
            continue
        if last is not None:
            b = pd.concat([last, b], ignore_index=True)
        again, moved = lone_windows(b)
        yield single(b[moved])
        key = b["key"].to_numpy()
        heads, carried = b.iloc[[int(np.searchsorted(key, key[-1], side="left"))]], last is not None
        b = b[~again].iloc[1:] if carried else b[~again]
        last = heads
        if not len(b):
            continue
        held.append(b)
        size += int(b["words"].map(len).sum()) // 8
        if size >= TREE_WORDS:
            b = pd.concat(held, ignore_index=True)
            key = b["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1], side="left"))  # the last key may go on
            if cut:
                yield build(b.iloc[:cut])
                b = b.iloc[cut:]
            held, size = [b], int(b["words"].map(len).sum()) // 8
    if held:
        yield build(pd.concat(held, ignore_index=True))


def packed(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A span of starts as one long."""
    return (lo.astype(np.int64) << 32) | n.astype(np.int64)


def content_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of the segments asked for; ``deep`` ones window by window, each keyed by all its words."""
    def settled(out: dict[str, list]) -> pd.DataFrame:
        """A window that a batch holds often leaves one row with words; the others need none."""
        b = pd.DataFrame(out)
        if len(b):
            b = b.sort_values(["key", "k1", "k2", "lo"], ignore_index=True)
            again, moved = lone_windows(b)
            b["words"] = b["words"].where(~again, b"")
            b["key"] = b["key"].where(~again, mixed((b["k2"] ^ b["lo"]).to_numpy(np.int64).view(np.uint64)).view(np.int64))  # spreads them
            b = b[~again | moved]
        return b

    def hashes(texts: list[str]) -> Iterator[np.ndarray]:
        """Of each text's words."""
        for part in blocks(texts):
            h, lengths = word_hashes(*joined_texts(texts[part]))
            yield from np.split(h, np.cumsum(lengths)[:-1])

    for b in batches:
        out: dict[str, list] = {k: [] for k in ("key", "k1", "k2", "lo", "words")}

        def put(key, k1, k2, lo, words):
            for k, v in zip(out, (key, k1, k2, lo, words)):
                out[k].append(v)

        for h, k1, k2, asked in zip(hashes(b["text"].tolist()), b["k1"], b["k2"], b["asked"]):
            whole = mixed(sequence_hashes(h, WINDOW)).view(np.int64)
            for a in asked:
                lo, n = a["lo"], a["n"]
                if a["deep"]:
                    for s in range(lo, lo + n):
                        put(int(whole[s]), k1, k2, s, h[s : s + WINDOW].tobytes())
                else:
                    put(a["m"], k1, k2, lo, h[lo : lo + n + WINDOW - 1].tobytes())
            if len(out["key"]) > 20_000:
                yield settled(out)
                out = {k: [] for k in out}
        yield settled(out)


# ---- the operator -------------------------------------------------------------------------------


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different rows of ``docs`` with keys, and ``(k1, k2, span)``: starts of repeated windows by document, packed."""
    rows = keyed(docs)
    found = rows.select("k1", "k2", "text").mapInArrow(segment_rows, SEGMENT_ROW)
    order = ["m", "c", "k1", "k2", "lo"]
    settled = stash(found.repartition("m").sortWithinPartitions(*order).mapInPandas(settle, SEGMENT_ROW), "segments")
    span = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))
    gone = settled.where(F.col("kind") == GONE).select("k1", "k2", span.alias("span"))
    asked = settled.where(F.col("kind") == OPEN)
    # a table of its own: both sides of the join are then plain exchanges, so a hot anchor's rows can be split
    hot = stash(asked.groupBy("m").count().where(F.col("count") > GROUP_ROWS).select("m", F.lit(True).alias("deep")), "hot-anchors")
    asked = (
        asked.join(hot, "m", "left")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("lo", "n", "m", F.coalesce("deep", F.lit(False)).alias("deep"))).alias("asked"))
    )
    rows = distinct_rows(rows)
    content = rows.join(asked, ["k1", "k2"]).mapInPandas(content_rows, CONTENT_ROW)
    leaves = content.repartition("key").sortWithinPartitions("key", "k1", "k2", "lo").mapInPandas(subtrees, "k1 long, k2 long, span long")
    return rows, gone.unionByName(leaves)


def covered(n_words: int, spans: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Mask of the words that windows starting in ``spans`` cover."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    lo, n = spans >> 32, spans & 0xFFFFFFFF
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + n + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def kept_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for whole in batches:
        for part in blocks(whole["text"].tolist(), 4 * BLOCK_BYTES):
            b = whole.iloc[part]
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(b["text"], b["spans"]):
                words = text.encode().split()
                n_words.append(len(words))
                if spans is None or not len(spans):
                    n_removed.append(0)
                else:
                    gone = covered(len(words), np.asarray(spans, dtype=np.int64))
                    n_removed.append(int(gone.sum()))
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                kept.append(b" ".join(words).decode())
            own = {k: b[k] for k in ("doc_id", "n_ids", "n_rows")}
            yield pd.DataFrame(own | {"n_words": n_words, "n_removed": n_removed, "kept": kept})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for each row of ``docs``; ``kept``: the words that stay, joined by one space."""
    rows, spans = repeats(docs)
    by_doc = spans.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))
    kept = (
        rows.join(by_doc, ["k1", "k2"], "left")
        .select("doc_id", "n_ids", "n_rows", "text", "spans")
        .mapInPandas(kept_rows, "doc_id long, n_ids long, n_rows long, n_words long, n_removed long, kept string")
    )
    own = F.when(F.col("copy") < F.col("n_ids"), F.col("doc_id")).alias("doc_id")
    return repeated(kept, "n_rows", "copy").select(own, "n_words", "n_removed", "kept")
