import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from veilwork.llm import simhash as sh

from .conftest import ROWS, sorted_rows


def slow_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    prints = [slow_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            first[g] = min(first.get(g, i), i)
    return sorted(((i, f"{p:016x}", first.get(g)) for (i, _), p, g in zip(rows, prints, group)), key=repr)


def test_every_pair_within_the_radius_shares_a_bucket():
    masks = sh.covering_masks()
    rnd = random.Random(1)
    for _ in range(2000):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(0, 4)):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_chains_of_near_copies_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for g in range(12):
        words = [f"w{rnd.randrange(900)}" for _ in range(rnd.choice([30, 150]))]
        for _ in range(12):
            rows.append((len(rows), " ".join(words)))
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(900)}"
    got = sh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted_rows(got) == brute(rows)


def test_large_buckets_in_blocks(spark):
    rnd = np.random.default_rng(2)
    fp = int(rnd.integers(1 << 62))
    prints = {fp}
    for _ in range(400):
        fp ^= 1 << int(rnd.integers(64))
        prints.add(fp - (1 << 64) if fp >= 1 << 63 else fp)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    from veilwork.llm.components import components

    roots = {r.node: r.root for r in components(sh.links(df, block_rows=16)).collect()}
    assert len({roots.get(p, p) for p in prints}) == 1  # each differs from the one before by a bit


def test_odd_rows(odd, clashing, empty):
    expected = brute([(r[0], r[1]) for r in ROWS])
    assert sorted_rows(sh.near_duplicates(odd)) == expected
    assert sorted_rows(sh.near_duplicates(clashing)) == expected
    assert sh.near_duplicates(empty).collect() == []
    kept = sh.keep_one(clashing)
    assert kept.columns == clashing.columns and kept.count() < clashing.count()


def test_one_document_of_each_group_stays(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight", "red green blue grey black white pink brown")
    rows = [(5, a), (3, a), (3, b), (3, b), (None, b), (None, c), (None, c), (7, None), (2, ""), (None, " ")]
    got = sorted_rows(sh.keep_one(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == sorted([(3, a), (3, b), (3, b), (None, c), (None, c), (2, "")], key=repr)


@pytest.mark.parametrize("task_rows", [500_000, 50])
def test_a_hub_with_many_links(spark, monkeypatch, task_rows):
    from veilwork.llm import common

    monkeypatch.setattr(common, "TASK_ROWS", task_rows)
    monkeypatch.setattr(common, "HOT", 20)
    base = [f"w{k}" for k in range(400)]
    rows = [(10_000 - i, " ".join([*base[:k], f"x{i}", *base[k:]])) for i, k in enumerate(range(0, 400, 4))]
    rows += [(i, rows[0][1]) for i in range(20_000, 20_400)] + [(None, "alone and without an id")]
    got = sorted_rows(sh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)))
    assert got == brute(rows)


def test_components_that_do_not_end_are_an_error(spark, monkeypatch):
    from veilwork.llm import components as co

    monkeypatch.setattr(co, "MAX_ROUNDS", 1)
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError):
        co.components(path)
    monkeypatch.setattr(co, "MAX_ROUNDS", 60)
    assert {(r.node, r.root) for r in co.components(path).collect()} == {(i, 0) for i in range(1, 41)}
