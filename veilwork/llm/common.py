"""Pieces that several operators share: the shared folder, words, row columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words, as a character class body.
WS = r"\x20\x09-\x0D"
#: The same characters, for trimming.
WS_CHARS = " \t\n\x0b\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or, in a local session only, one made here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veilwork-"))
        at = sc._jsc.sc().getCheckpointDir()
    return at.get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


#: Narrow rows that one task may as well take together.
TASK_ROWS = 500_000


def tasks_for(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def stash(df: DataFrame, name: str, partition_by: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts the lineage, outlives executors.

    ``rows``: how many narrow rows there are at most; few of them go to few files.
    """
    spark = df.sparkSession
    df = df if rows is None else df.coalesce(tasks_for(rows))
    path = shared_path(spark, name)
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def forget(*stashed: DataFrame) -> None:
    """Delete tables of ``stash`` that nothing reads any more."""
    for df in stashed:
        remove(df.sparkSession, df.stash_path)


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """``docs`` as one struct column ``row``, so that no name of it clashes with what an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col(f"row.`{c}`").alias(c) for c in columns]


def repeated(df: DataFrame, times: str, name: str, block: int = 1 << 16) -> DataFrame:
    """Each row ``times`` times, numbered from 0 in ``name``; in two steps, so that no array is long."""
    low = F.col("_block") * F.lit(block)
    return (
        df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / F.lit(block)).cast("long"))))
        .withColumn(name, F.explode(F.sequence(low, F.least(low + F.lit(block), F.col(times)) - 1)))
        .drop("_block")
    )


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does that fast unless a character outside ASCII may have a case."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(
        c.rlike(r"[^\x00-\x7F\p{Ll}\p{Lo}\p{P}\p{Nd}\p{Z}]"), F.translate(c, upper, upper.lower())
    ).otherwise(F.lower(c))


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")


def text_or_empty(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))


#: Keys that hold more than this part of all rows are hot; there are no more than HOT of them.
HOT = 1000


def found_in(rows: DataFrame, table: DataFrame, key: str, count: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``table`` (inner), which has each ``key`` once with the number of its rows in ``count``.

    Hot keys, at most ``HOT`` as each has more than its part of all rows, are broadcast; the rest meet in a shuffle
    in which no key has many rows. Both tables are read twice, so they should be stored ones.
    """
    most = (table.agg(F.sum(count)).first()[0] or 0 if total is None else total) // HOT
    hot = F.broadcast(table.where(F.col(count) > most).drop(count))
    cold = table.where(F.col(count) <= most).drop(count)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def running_base(parts: DataFrame, index: str, value: str, name: str, by: tuple = (), bits: int = 10) -> DataFrame:
    """``(by, index, name)``: the sum of ``value`` over the rows of the same ``by`` with a smaller ``index``.

    ``parts`` has a row for each (by, index), the index a long from 0 on, ``by`` without nulls. Sums are taken in
    three levels of ``2 ** bits`` neighbours, so only a millionth of the rows of one ``by`` meet in a task.
    """
    up, top = "_up", "_top"
    rows = parts.select(*by, index, F.col(value).alias("_v"), F.shiftright(index, bits).alias(up), F.shiftright(index, 2 * bits).alias(top))
    middle = rows.groupBy(*by, up, top).agg(F.sum("_v").alias("_v"))
    high = middle.groupBy(*by, top).agg(F.sum("_v").alias("_v"))

    def based(df: DataFrame, within: list, order: str, out: str) -> DataFrame:
        w = Window.partitionBy(*within, *([] if within else [F.lit(0)])).orderBy(order)
        return df.withColumn(out, F.coalesce(F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_v")

    low = based(rows, [*by, up], index, "_b0").drop(top)
    middle, high = based(middle, [*by, top], up, "_b1"), based(high, [*by], top, "_b2")
    return low.join(middle.join(high, [*by, top]), [*by, up]).select(
        *by, index, (F.col("_b0") + F.col("_b1") + F.col("_b2")).alias(name)
    )


def first_by_hash(df: DataFrame, key: str, n: int, rows: int) -> DataFrame:
    """About the ``n`` rows with the smallest hash of ``key``, at most ``n``, of a table with ``rows`` rows.

    A threshold on the hash leaves some ``4 * n`` rows before any are compared, so that
    what meets in one task doesn't grow with the table.
    """
    h = F.xxhash64(key)
    share = min(1.0, 4 * n / max(1, rows))
    if share < 1:
        df = df.where(h < F.lit(int(-(1 << 63) + share * (1 << 64))))
    return df.orderBy(h, key).limit(n)


def blocks(texts: list, limit: int = 1_000_000):
    """Slices of ``texts`` with about ``limit`` characters each (a longer text makes one of its own): bounds a worker's memory."""
    start, room = 0, 0
    for k, t in enumerate(texts):
        if room and room + len(t) > limit:
            yield slice(start, k)
            start, room = k, 0
        room += len(t)
    if start < len(texts):
        yield slice(start, len(texts))
