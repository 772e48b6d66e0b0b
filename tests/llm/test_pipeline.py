"""The whole pipeline against its stages in plain Python, and its promises stage by stage."""

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline as cp
from veilwork.llm import toxicity as tx

from . import test_byte_bpe, test_line_dedup, test_mixing, test_simhash
from .conftest import CLASHES

SF = "/root/testdata/sf0.001"


def brute_mix(rows):
    taken = {}
    for i, n, _, _, t in test_mixing.brute(rows):
        taken[i] = int(np.floor(t / max(n, 1) + 0.5))
    return [(i, t) for i, t, _ in rows for _ in range(taken[i])]


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    weights, theta = tx.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scorer = tx.Scorer(weights)
    p = lambda t: 1 / (1 + np.exp(theta[0] - scorer.eta(t)))
    kept = [(r.doc_id, r.text, r.source) for r in docs if not (r.text or "").strip() or p(r.text) < tx.TOXIC_FROM]
    assert len(kept) < len(docs)
    source = {i: s for i, _, s in kept}
    kept = [(i, t) for i, _, _, t in test_line_dedup.brute([(i, t) for i, t, _ in kept])]
    groups = {i: c for i, _, c in test_simhash.brute(kept)}
    kept = [(i, t) for i, t in kept if groups[i] == i]
    mixed = brute_mix([(i, t, source[i]) for i, t in kept])
    expected = test_byte_bpe.brute(mixed)
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.run(spark, SF).collect()), key=repr)
    assert got == expected


def test_stages_keep_the_columns(spark, clashing, tmp_path):
    clashing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (12, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = clashing
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == clashing.columns
    assert docs.where(" or ".join(f"`{c}` <> 7" for c in CLASHES)).count() == 0
    assert docs.where("n_chars <> length(text)").count() == 0
    ids = cp.run(spark, str(tmp_path))
    assert ids.count() == docs.count()
    assert all(hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in ids.collect())


def test_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_names_are_plain(name):
    assert re.fullmatch(r"[a-z -]{3,40}", name)
