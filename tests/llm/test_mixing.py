import hashlib
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilwork.llm import mixing as mx

from .conftest import ROWS, sorted_rows


def targets(sizes):
    """Water filling by repetition."""
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    open_, out, left = set(sizes), {}, float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    per = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        per[s] += n
    target = targets(per)
    out, at = [], defaultdict(int)
    order = sorted(range(len(rows)), key=lambda k: (hashlib.md5(f"{'' if rows[k][0] is None else rows[k][0]}|{rows[k][1] or ''}".encode()).hexdigest(), rows[k][0] or 0, size[k]))
    for k in order:
        i, _, s = rows[k]
        quota = int(target[s] + 0.5)
        whole = quota // per[s] if per[s] else 0
        taken = whole * size[k] + max(0, min(size[k], quota - whole * per[s] - at[s]))
        at[s] += size[k]
        out.append((i, size[k], per[s], pytest.approx(target[s]), taken))
    return sorted(out, key=lambda r: repr(r[:3]))


def result(docs):
    return sorted(map(tuple, mx.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=lambda r: repr(r[:3]))


def test_odd_rows(odd, clashing, empty):
    expected = brute([(r[0], r[1], r[3]) for r in ROWS])
    assert result(odd) == expected
    assert result(clashing) == expected
    assert mx.mix(empty).collect() == []
    assert mx.mixed_documents(empty).collect() == []


def test_documents_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = result(docs)
    assert got == brute([(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert sorted_rows(mx.mix(docs)) == sorted_rows(mx.mix(docs.repartition(7)))
    assert all(t <= 3 * n for _, n, _, _, t in got)


def test_curriculum_is_in_order_and_follows_the_schedules(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r for r in mx.curriculum(docs, weights=(1.0, 1.0, 1.0)).collect() if r.position is not None]
    assert [r.position for r in got] == sorted(r.position for r in got)
    half = len(got) // 2
    early = sum(r.source == "a" for r in got[:half])
    assert early < half * 0.45  # the first source's weight rises, the second's falls


@settings(deadline=None, max_examples=25)
@given(st.floats(0.01, 3), st.floats(0.01, 3), st.floats(0.01, 3), st.floats(0, 1))
def test_inverse_demand(w0, w1, w2, t):
    knots = ((0.0, w0), (0.4, w1), (1.0, w2))
    part = lambda a, b, s: (a + (a + (b - a) * s)) / 2 * s
    whole = part(w0, w1, 1) * 0.4 + part(w1, w2, 1) * 0.6
    x = (part(w0, w1, t / 0.4) * 0.4 if t <= 0.4 else part(w0, w1, 1) * 0.4 + part(w1, w2, (t - 0.4) / 0.6) * 0.6) / whole
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    (row,) = spark.range(1).select(mx.inverse_demand(F.lit(x), knots).alias("t")).collect()
    assert row.t == pytest.approx(t, abs=1e-4)


@pytest.fixture(autouse=True)
def session(spark):
    return spark


def test_mixed_documents_keep_their_columns(clashing):
    got = mx.mixed_documents(clashing)
    assert got.columns == clashing.columns
    assert {r.doc_id for r in got.collect()} <= {r[0] for r in ROWS}


def test_every_pass_has_its_own_position(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r for r in mx.curriculum(docs).collect() if r.position is not None]
    assert [r.position for r in got] == sorted(r.position for r in got)
    first = {r.doc_id: r for r in mx.mix(docs).collect()}
    assert sum(r.words for r in got) == sum(r.taken for r in first.values()) == 3000
    assert all(r.position == first[r.doc_id].position for r in got if r["pass"] == 0)
    # the third source has weight 3 of 6 and a level schedule: 1.5 passes, spread over the whole training
    c = [r for r in got if r.source == "c"]
    assert len(c) == 150 and max(r["pass"] for r in c) == 1
    early = [sum(q * 750 <= r.position < (q + 1) * 750 for r in c) for q in range(4)]
    assert min(early) >= 30 and sum(early) == 150


def test_running_sums_follow_the_positions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in mx.curriculum(docs).collect() if r.position is not None]
    longest, done = {}, 0
    for r in got:
        longest[r.source] = max(longest.get(r.source, 0), r.size)
    room = sum(longest.values())
    for r in got:
        assert 0 <= done - r.position + 1 <= room - longest[r.source] + r.size + 2
        done += r.words
    assert done == sum(r.taken for r in mx.mix(docs).collect())


def test_many_equal_rows(spark):
    rows = [(5, "some words here", "a")] * 1000 + [(i, "w " * 10, "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    assert result(docs) == brute(rows)
    got = {r.source: r["count"] for r in mx.mixed_documents(docs).groupBy("source").count().collect()}
    taken = {r.source: r.n for r in mx.mix(docs).groupBy("source").agg(F.sum(F.expr("aggregate(passes, 0, (s, p) -> s + int(2 * p.words >= size))")).alias("n")).collect()}
    assert got == taken


def test_a_hot_source_among_many(spark):
    rows = [(i, "w " * (1 + i % 5), "hot" if i % 3 else f"s{i % 50}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert result(docs) == brute(rows)


def test_mixed_documents_come_in_training_order(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    expected = [(r.position, r.doc_id) for r in mx.curriculum(docs).collect() if r.words]
    got = [r.doc_id for r in mx.mixed_documents(docs).collect()]
    at = {}
    for p, i in expected:
        at.setdefault(i, []).append(p)
    places = [at[i].pop(0) for i in got]
    assert places == sorted(places) and not any(at.values())


def test_rows_of_several_sources_that_share_an_id_follow_their_targets(spark):
    rows = [(None, "w " * 10, "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: r["count"] for r in mx.mixed_documents(docs).groupBy("source").count().collect()}
    assert got == {"a": 50, "b": 100, "c": 150}
