"""Connected components of a graph of long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, found_in, stash, tasks_for

#: Rounds grow with the logarithm of the longest path; more than this many can't be.
MAX_ROUNDS = 60


def _together(rows: DataFrame, n: int) -> DataFrame:
    """Few rows in one task; many stay where they are, as dealing them by key would pile up a hub's."""
    return rows.repartition(1) if tasks_for(n) == 1 else rows


def _with_low(rows: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """``rows`` with their centre's smallest neighbour ``m``. A hub's rows stay where they are, unless all rows are one task's."""
    if tasks_for(n) == 1:
        return rows.join(low.drop("n"), "u")
    return found_in(rows, stash(low, "star-centres", rows=n), "u", "n", n)


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = _together(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), n)
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    up = _with_low(both.where(F.col("v") > F.col("u")), low, n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return up.where(F.col("u") != F.col("v")).distinct()


def _small_star(e: DataFrame, n: int) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    down = _together(down, n)
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_low(down, low, n).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _together(low.select("u", F.col("m").alias("v")).unionByName(moved), n).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (u, v) that isn't its component's smallest id.

    Rounds are written to the shared folder, so each starts from a table; the number of
    rounds grows with the logarithm of the longest path.
    """
    e = stash(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "links")
    before = _mark(e)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        n = 2 * before[0]  # rows that meet in a star at most
        large = stash(_large_star(e, n), "links", rows=n)
        forget(e)
        e = stash(_small_star(large, n), "links", rows=n)
        forget(large)
        after = _mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not found in {MAX_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
