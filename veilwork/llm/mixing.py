"""Mixing sources to target weights with a time-varying curriculum.

Targets: every source gets a share of all words in proportion to its weight, but at
most ``max_epochs`` times its size; what is above is shared again by weight among the
others. That is a water level, found in closed form from the sources sorted by
``max_epochs * size / weight``.

Curriculum: a source's weight varies over training time t in [0, 1] as a piecewise
linear schedule. Its integral, scaled to the source's target, is the source's cumulative
demand; a document that starts after x words of its source's stream is met at the t
where that demand reaches x (the inverse of the integral). The training position of t is
the demand of all sources up to t, so positions run from 0 to the mix's words and, in
order of position, the words taken before a document differ from its position by no
more than one document of each source. Documents are range-sorted by position. The
stream of a source is its documents in the order of md5(doc_id|text), repeated until the
target is met, the last document in part; every pass over a document has a position of
its own.

Running sums over a source are taken in levels: inside small md5 ranges, then over the
ranges, so a source that holds most rows is spread over many tasks. Equal rows (same id,
source and text) are one row with a count until the end, so they don't meet in a task.

Defined cases: null text has size 0; a null source is a source of its own, last in
order; a null doc_id is like an empty one in the order; equal rows each count. With no
words at all every target is 0 and positions are null. Sources are one row each in a
single small window; documents never meet in one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions.arrays import let

from .common import found_in, packed, repeated, running_base, stash, unpacked, word_count

WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3
#: Knots (t, relative weight), one schedule for each source in turn: rising, falling, level.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)))
#: Documents in one md5 range, about.
RANGE_DOCS = 200
#: Positions are cut to whole words a thousandth above, so that floating point keeps whole numbers whole.
WHOLE = 0.001


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_no, source_size, target, quota, total)`` from ``(source, size)`` rows; ``quota``: whole words."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("ratio", "source_no")
    s = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("source_no") % len(weights)))
        .withColumn("cap", F.col("source_size") * F.lit(max_epochs))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    s = (
        s.withColumn("total", F.sum("source_size").over(every))
        .withColumn("below", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("lam", (F.col("total") - F.col("below")) / F.col("rest"))
    )
    s = s.withColumn("lam", F.max(F.when(F.col("lam") <= F.col("ratio"), F.col("lam"))).over(every))
    target = F.least(F.col("weight") * F.col("lam"), F.col("cap").cast("double"))
    s = s.withColumn("target", target).withColumn("quota", F.round("target").cast("long"))
    return s.select("source", "source_no", "source_size", "target", "quota", "total")


def inverse_demand(x: Column, knots) -> Column:
    """t where the integral of the schedule, scaled to 1, reaches x in [0, 1]."""
    area = [(w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    whole, done, out = sum(area), 0.0, None
    parts = []
    for ((t0, w0), (t1, w1)), a in zip(zip(knots, knots[1:]), area):
        slope, y = (w1 - w0) / (t1 - t0), x * F.lit(whole) - F.lit(done)
        if slope == 0:
            t = F.lit(t0) + y / F.lit(w0)
        else:
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + y * F.lit(2 * slope)))
            t = F.lit(t0) + (root - F.lit(w0)) / F.lit(slope)
        done += a
        parts.append((done / whole, t))
    for upto, t in reversed(parts):
        out = t if out is None else F.when(x <= F.lit(upto), t).otherwise(out)
    return out


def demand(t: Column, knots) -> Column:
    """The integral of the schedule up to t, scaled to 1."""
    whole = sum((w0 + w1) / 2 * (t1 - t0) for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    parts = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        d = F.least(F.greatest(t - F.lit(t0), F.lit(0.0)), F.lit(t1 - t0))
        parts.append(d * (F.lit(w0) + d * F.lit((w1 - w0) / (t1 - t0) / 2)))
    return sum(parts[1:], parts[0]) / F.lit(whole)


def sized(docs: DataFrame, *keys: str, **more: Column) -> DataFrame:
    """``(doc_id, source, size, order, *keys, copies)`` and aggregates ``more``, a row for equal rows of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    order = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    rows = docs.withColumn("size", word_count(F.col("text"))).withColumn("order", order)
    aggs = [F.count("*").alias("copies"), *(c.alias(n) for n, c in more.items())]
    return rows.groupBy("doc_id", "source", "size", "order", *keys).agg(*aggs)


def placed(groups: DataFrame, *keys: str, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """``groups`` (source, size, order, copies, ...) with their source's numbers and ``start``: the words of their source before them."""
    host = F.xxhash64(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    groups = stash(groups.withColumn("host", host), "mix")
    n = groups.count()
    ranges = 1 << max(4, math.ceil(math.log2(max(1, n / RANGE_DOCS))))
    high = F.conv(F.substring("order", 1, 8), 16, 10).cast("long")
    groups = groups.withColumn("range", F.floor(high * F.lit(ranges) / F.lit(1 << 32)).cast("long"))
    words = F.col("size") * F.col("copies")
    parts = stash(groups.groupBy("host", "source", "range").agg(F.sum(words).alias("part")), "mix-ranges", rows=n)
    src = source_targets(parts.select("source", F.col("part").alias("size")), weights, max_epochs)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for i in range(len(schedules)):
        of = F.when(F.col("source_no") % len(schedules) == i, F.col("quota"))
        src = src.withColumn(f"quota{i}", F.coalesce(F.sum(of).over(every), F.lit(0)))
    src = src.withColumn("host", host).drop("source")
    ranges_of = parts.groupBy("host").agg(F.count("*").alias("n_ranges"))
    held = found_in(parts.select("host", "range"), stash(src.join(ranges_of, "host"), "mix-sources", rows=n), "host", "n_ranges")
    based = held.join(running_base(parts, "range", "part", "base", ("host",)), ["host", "range"])
    order = ["order", "doc_id", "size", *keys]
    inside = Window.partitionBy("host", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = groups.withColumn("inner", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    return (
        inner.join(stash(based, "mix-bases", rows=n), ["host", "range"])
        .withColumn("start", F.col("base") + F.col("inner"))
        .drop("host", "range", "base", "inner")
    )


def passes(start: Column, schedules=SCHEDULES) -> Column:
    """``array<struct<pass, words, position>>``: each time the mix meets the document that starts at ``start``."""
    quota, size = F.col("quota"), F.col("source_size")

    def place(k: Column) -> Column:
        x = F.least(F.lit(1.0), (start + k * size) / quota)
        at = None
        for i, knots in reversed(list(enumerate(schedules))):
            t = inverse_demand(x, knots)
            at = t if at is None else F.when(F.col("source_no") % len(schedules) == i, t).otherwise(at)
        return let(
            at,
            lambda t: F.floor(
                sum((F.col(f"quota{i}") * demand(t, k) for i, k in enumerate(schedules)), F.lit(WHOLE))
            ).cast("long"),
        )

    whole = F.when(size > 0, F.floor(quota / size)).otherwise(F.lit(0)).cast("long")
    last = F.greatest(F.lit(0), F.least(F.col("size"), quota - whole * size - start))
    words = lambda k: F.when(k < whole, F.col("size")).otherwise(last).cast("long")
    return F.transform(
        F.filter(F.sequence(F.lit(0).cast("long"), whole), lambda k: words(k) > 0),
        lambda k: F.struct(k.alias("pass"), words(k).alias("words"), place(k).alias("position")),
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, schedules=SCHEDULES) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, position, passes)`` for each row of ``docs``.

    ``taken`` counts the words that the mix takes from the document, repeats included;
    ``position`` is the training word at which it is first met (null if never);
    ``passes`` has a (pass, words, position) for each time it is met.
    """
    groups = placed(sized(docs), weights=weights, max_epochs=max_epochs, schedules=schedules)
    each = repeated(groups, "copies", "copy")
    start = F.col("start") + F.col("copy") * F.col("size")
    return each.withColumn("passes", passes(start, schedules)).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.aggregate("passes", F.lit(0).cast("long"), lambda s, p: s + p["words"]).alias("taken"),
        F.get(F.col("passes.position"), F.lit(0)).alias("position"),
        "passes",
    )


def by_first_position(docs: DataFrame, **how) -> DataFrame:
    """``mix`` with a row for each document, in order of ``position``; documents that the mix leaves out come last."""
    return mix(docs, **how).orderBy(F.col("position").asc_nulls_last(), "doc_id", "size")


def curriculum(docs: DataFrame, **how) -> DataFrame:
    """The whole mix in training order: a row for each pass over a document, with ``pass``, ``words`` and its own
    ``position``; documents that the mix leaves out come last, with nulls."""
    each = mix(docs, **how).drop("position").withColumn("passes", F.explode_outer("passes"))
    each = each.select(*[c for c in each.columns if c != "passes"], "passes.*")
    return each.orderBy(F.col("position").asc_nulls_last(), "doc_id", "size", "pass")


def mixed_documents(docs: DataFrame, schedules=SCHEDULES, **how) -> DataFrame:
    """``docs`` as the mix takes them, in training order: each row once for each pass, at that pass's position.

    A last pass that the target cuts, one document of each source, is kept if at least half of it is taken.
    Rows that agree in id, source and text but not in other columns are told apart by a hash of all their columns.
    """
    rows = stash(packed(docs, F.monotonically_increasing_id().alias("_n")), "mix-rows")
    field = lambda f: F.col(f"row.`{f.name}`")
    plain = [F.map_entries(field(f)) if f.dataType.typeName() == "map" else field(f) for f in docs.schema]
    own = rows.select("_n", "row.doc_id", "row.source", "row.text", F.xxhash64(*plain).alias("_hash"))
    at = repeated(placed(sized(own, "_hash", _n=F.min("_n")), "_hash", schedules=schedules, **how), "copies", "copy")
    start = F.col("start") + F.col("copy") * F.col("size")
    met = at.select("_n", "copy", "size", F.explode(passes(start, schedules)).alias("p")).where(2 * F.col("p.words") >= F.col("size"))
    met = stash(met.select("_n", "copy", F.col("p.pass").alias("pass"), F.col("p.position").alias("position")), "mix-passes")
    return rows.join(met, "_n").orderBy("position", "_n", "copy", "pass").select(*unpacked(docs.columns))
