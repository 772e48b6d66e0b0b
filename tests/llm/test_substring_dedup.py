import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from veilwork.llm import substring_dedup as sd

from .conftest import ROWS, sorted_rows


def brute(rows, window=sd.WINDOW):
    """Every window against a set of those before it; a document is its id and text, null ids come last."""
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows})
    seen, out = set(), {}
    for null, i, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                gone[s : s + window] = [True] * window
            seen.add(k)
        out[None if null else i, t] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return sorted(((i, *out[i, t or ""]) for i, t in rows), key=repr)


def random_rows(seed, n, vocabulary, length):
    rnd = random.Random(seed)
    passages = [[f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randint(15, 70))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        while len(words) < rnd.randint(1, length):
            words += rnd.choice(passages)[rnd.randrange(5) :] if rnd.random() < 0.5 else [f"w{rnd.randrange(vocabulary)}" for _ in range(9)]
        rows.append((i, " ".join(words)))
    return rows + rows[:3]


@pytest.mark.parametrize("seed,vocabulary", [(1, 2), (2, 40), (3, 5000)])
def test_equals_brute_force(spark, seed, vocabulary):
    rows = random_rows(seed, 60, vocabulary, 300)
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted_rows(got) == brute(rows)


def test_hot_anchors_are_split_by_whole_windows(spark, monkeypatch):
    monkeypatch.setattr(sd, "GROUP_ROWS", 2)
    rows = random_rows(4, 40, 30, 200)
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted_rows(got) == brute(rows)


def test_small_batches_and_trees(spark, monkeypatch):
    monkeypatch.setattr(sd, "GROUP_ROWS", 1)
    rows = random_rows(6, 80, 12, 150)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted_rows(sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)


def test_odd_rows(odd, clashing, empty):
    expected = brute([(r[0], r[1]) for r in ROWS])
    assert sorted_rows(sd.remove_repeats(odd)) == expected
    assert sorted_rows(sd.remove_repeats(clashing)) == expected
    assert sd.remove_repeats(empty).collect() == []


def test_nodes_are_classes_of_equal_sequences():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, 500).astype(np.uint64)
    starts = np.arange(0, 480)
    for depth in (1, 3, 20):
        node = sd.node_of(words, starts, depth)
        keys = [tuple(words[s : s + depth]) for s in starts]
        assert len(set(zip(node.tolist(), keys))) == len(set(keys)) == len(set(node.tolist()))


def test_sequence_hashes_tell_sequences_apart():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    h[30:55] = h[:25]
    got = sd.sequence_hashes(h, 20)
    assert (got[:6] == got[30:36]).all() and len(set(got[:41].tolist())) == 41 - 6


def test_a_thousand_equal_rows(spark):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    a, b = (" ".join(rnd.choices(words, k=120)) for _ in range(2))
    rows = [(1, a), *[(5, b + " " + a)] * 1000, *[(None, a)] * 3, (7, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = sd.remove_repeats(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 120, 0, 1), (5, 240, 120, 1000), (7, 120, 120, 1), (None, 120, 120, 3)], key=repr)
    one = docs.where("doc_id <> 5").union(docs.where("doc_id = 5").limit(1))
    spans = lambda d: sd.repeats(d)[1].distinct().count()
    assert sd.repeats(docs)[1].count() <= 4 * spans(one)


def test_a_worker_keeps_no_words():
    """F1 of round 2: what a worker needs comes from a block of text, whatever the number of different words."""
    texts = [" ".join(f"{i:x}-{k:x}" for k in range(1000)) for i in range(300)]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["k1", "k2", "text"])
    tracemalloc.start()
    try:
        rows = sum(len(out) for out in sd.segment_rows(iter([batch])))
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert rows > 20_000 and kept < 5_000_000


def test_word_hashes_follow_the_words():
    texts = ["", " \t", "a", "ab cd ab", "x" * 200 + "\x0b" + "x" * 201, "z\x1c\x85\u2003q é", "", "12345678 123456789 \x00 \x00\x00", "tail"]
    words = [t.encode().split() for t in texts]
    h, lengths = sd.word_hashes(*sd.joined_texts(texts))
    assert lengths.tolist() == [len(w) for w in words]
    pairs = set(zip((w for ws in words for w in ws), h.tolist()))
    assert len(pairs) == len({w for w, _ in pairs}) == len({x for _, x in pairs})
    column = pa.array(["left out", *texts, "left out"]).slice(1, len(texts))
    again, same = sd.word_hashes(*sd.text_column(column))
    assert (again == h).all() and (same == lengths).all()
