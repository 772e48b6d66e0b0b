"""Line dedup by levelled sorted runs of line hashes; DataFrame operations only.

A store holds runs: Parquet tables of ``(h1, h2, n_docs, max_doc)`` sorted by the
128-bit hash of the line key. Batches of documents arrive newest (largest doc_id)
first. Each batch is merge-anti-joined with the runs: keys that no run holds enter
the batch's own run with their owner (the largest doc_id that has them), keys that a
run already holds enter it as an increment of the document count only. ``fanout`` runs
of one level are compacted into one run of the next, so a key is rewritten a
logarithmic number of times and a probe meets few runs.

Defined cases: a null or empty text is one empty line; a null doc_id counts as no
document, its lines stay; equal rows count once and are all treated alike; a document
is told apart by its id and its text. Extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, forget, packed, stash, strip_ws, unpacked

MIN_KEY_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2


def line_key(line: Column) -> Column:
    return ascii_lower(strip_ws(line))


def line_hashes(docs: DataFrame, min_key_chars: int = MIN_KEY_CHARS) -> DataFrame:
    """One row ``(doc_id, row_hash, pos, h1, h2)`` for each line whose key is long enough."""
    lines = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_key_chars)).select(
        "doc_id",
        F.xxhash64("text").alias("row_hash"),
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"),
    )
    return (
        lines.where(F.length("line") >= min_key_chars)
        .select("doc_id", "row_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_key_chars)
        .select(
            "doc_id",
            "row_hash",
            "pos",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit("line"), F.col("key")).alias("h2"),
        )
    )


class LineRuns:
    """The levelled store. ``add`` takes the next batch of line hashes, newest documents first."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, hashes: DataFrame) -> None:
        own = hashes.groupBy("h1", "h2").agg(
            F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("max_doc")
        )
        held = [r.where(F.col("max_doc").isNotNull()).select("h1", "h2") for r in self.runs()]
        for k, r in enumerate(held):
            own = own.join(r.withColumn(f"in{k}", F.lit(True)), ["h1", "h2"], "left")
        if held:
            seen = F.coalesce(*[F.col(f"in{k}") for k in range(len(held))], F.lit(False))
            own = own.select("h1", "h2", "n_docs", F.when(~seen, F.col("max_doc")).alias("max_doc"))
        self._put(0, own)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(stash(run.sortWithinPartitions("h1", "h2"), f"line-run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, self.merged(old))
            forget(*old)

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        both = runs[0]
        for r in runs[1:]:
            both = both.unionByName(r)
        return both.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def frequent(self, min_docs: int) -> DataFrame:
        return self.merged(self.runs()).where(F.col("n_docs") >= min_docs)


def kept_lines(lines: Column, dropped: Column) -> Column:
    """``lines`` without the 0-based positions in the sorted array ``dropped``; linear in both."""
    edge = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))
    piece = lambda i: F.slice(lines, F.get(edge, i) + 2, F.get(edge, i + 1) - F.get(edge, i) - 1)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(dropped)), piece))


def dropped_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_key_chars: int = MIN_KEY_CHARS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """``(doc_id, row_hash, dropped)``: positions of the lines that go, for each document that loses any."""
    # batches of about equally many documents, however their ids lie
    (cuts,) = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()
    batch = sum(((F.col("doc_id") > F.lit(c)).cast("int") for c in cuts or []), F.lit(0))
    hashes = stash(line_hashes(docs, min_key_chars).withColumn("batch", batch), "line-hashes", ["batch"])
    store = LineRuns(fanout)
    for b in reversed(range(batches)):
        store.add(hashes.where(F.col("batch") == b))
    # a table of its own: both sides of the join are then plain exchanges, so a hot line's rows can be split
    frequent = stash(store.frequent(min_docs).select("h1", "h2", "max_doc"), "frequent-lines")
    hits = hashes.join(frequent, ["h1", "h2"]).where(F.col("doc_id") != F.col("max_doc"))
    return hits.groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def cut_lines(docs: DataFrame, **limits) -> DataFrame:
    """``(row, text, n_lines, n_dropped)``: the rows of ``docs`` as structs, and their texts cut to the lines that stay."""
    gone = dropped_lines(docs.select("doc_id", "text"), **limits)
    text = F.coalesce("row.text", F.lit(""))
    wide = packed(docs).join(gone, (F.col("row.doc_id") == F.col("doc_id")) & (F.xxhash64("row.text") == F.col("row_hash")), "left")
    stay = F.array_join(kept_lines(F.split(text, "\n", -1), F.col("dropped")), "\n")
    return wide.select(
        "row",
        F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(stay).alias("text"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def dedup_lines(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with ``text`` cut to the lines that stay, and ``n_lines``, ``n_dropped``.

    Columns named ``n_lines`` or ``n_dropped`` are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    values = [F.col("text") if c == "text" else v for c, v in zip(kept, unpacked(kept))]
    return cut_lines(docs, **limits).select(*values, "n_lines", "n_dropped")
