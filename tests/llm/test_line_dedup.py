import random

import pytest
from pyspark.sql import functions as F

from veilwork.llm import line_dedup as ld

from .conftest import ROWS, sorted_rows

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANK))


def brute(rows, least=3):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(h := holders.get(key(x), ())) < least or max(h) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def result(docs, **how):
    got = ld.dedup_lines(docs, **how).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")))
    return sorted_rows(got)


def test_odd_rows(odd, clashing, empty):
    expected = brute([(r[0], r[1]) for r in ROWS])
    assert result(odd) == expected
    assert result(clashing) == expected
    assert sorted(set(ld.dedup_lines(clashing).columns)) == sorted(clashing.columns)
    assert ld.dedup_lines(empty).collect() == []


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (9, 3)])
def test_runs_and_compactions_equal_brute_force(spark, batches, fanout):
    rnd = random.Random(batches)
    pool = [f"line number {k} with enough letters in it" for k in range(60)] + ["short", "", "  Line Number 3 WITH enough letters in it \t"]
    rows = [(rnd.randrange(10_000), "\n".join(rnd.choices(pool, k=rnd.randrange(8)))) for _ in range(150)]
    rows = list({i: (i, t) for i, t in rows}.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(docs, batches=batches, fanout=fanout) == brute(rows)


def test_levels_stay_few(spark):
    store = ld.LineRuns(2)
    for b in range(8):
        store.add(spark.createDataFrame([(b, b * 10, 1)], "doc_id long, h1 long, h2 long"))
    assert len(store.runs()) == 1 and len(store.levels) == 4


def test_new_runs_hold_no_owner_of_known_keys(spark):
    store = ld.LineRuns(10)
    store.add(spark.createDataFrame([(9, 1, 1), (8, 2, 2)], "doc_id long, h1 long, h2 long"))
    store.add(spark.createDataFrame([(3, 1, 1), (2, 3, 3)], "doc_id long, h1 long, h2 long"))
    newer = {r.h1: r.max_doc for r in store.runs()[1].collect()}
    assert newer == {1: None, 3: 2}
    assert {(r.h1, r.n_docs, r.max_doc) for r in store.frequent(2).collect()} == {(1, 2, 9)}


def test_ids_at_the_ends_of_longs(spark):
    line = "a line that is long enough to count"
    rows = [(-(1 << 63), line), (0, line), ((1 << 63) - 1, line), ((1 << 63) - 2, line)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_one_far_id_does_not_spoil_the_batches(spark):
    line = "a line that is long enough to count"
    rows = [(i, f"{line}\nand line number {i} of its own kind") for i in range(200)] + [((1 << 62), line), (-(1 << 62), line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in ld.dedup_lines(docs).collect()}
    assert got == {i: int(i != 1 << 62) for i, _ in rows}
