import math
import zlib

import numpy as np

from veilwork.llm import toxicity as tx

from .conftest import ROWS, sorted_rows


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    train, test = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    rows = tx.grade_documents(docs, train).join(test.withColumnRenamed("toxic", "truth"), "doc_id").select("truth", "toxic", "severity").collect()
    bad = [r for r in rows if r.truth == 1]
    good = [r for r in rows if r.truth == 0]
    assert len(bad) > 20
    assert sum(r.toxic for r in bad) >= 0.9 * len(bad)
    assert sum(r.toxic for r in good) <= 0.02 * len(good)
    assert np.mean([r.severity for r in bad]) > 1 > 0.3 > np.mean([r.severity for r in good])


def test_thresholds_are_ordered_and_grades_are_learned():
    rng = np.random.default_rng(0)
    x = rng.normal(size=2000)
    y = np.digitize(x + 0.3 * rng.logistic(size=2000), [-1, 0, 1])
    model = tx.Ordinal(np.arange(2000), np.zeros(2000, int), x, 2000, 1).fit(y)
    assert (np.diff(model.theta) > 0).all()
    assert abs(model.w[0] - 1 / 0.3) < 0.6 and np.allclose(model.theta * 0.3, [-1, 0, 1], atol=0.15)


def test_odd_rows(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (12, 0), (None, 1), (7, None), (99, 1), (3, 0)], "doc_id long, toxic int")
    got = tx.grade_documents(odd, labels).select("doc_id", "severity", "p_toxic", "toxic")
    assert got.count() == len(ROWS)
    assert got.where("doc_id in (4, 5, 6) and (severity <> 0 or toxic)").count() == 0
    assert sorted_rows(tx.grade_documents(clashing, labels).select("doc_id", "severity", "p_toxic", "toxic")) == sorted_rows(got)
    assert tx.grade_documents(empty, labels).collect() == []
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.grade_documents(odd, none).where("toxic or severity > 0").count() == 0
    assert tx.without_toxic(clashing, none).columns == clashing.columns
    assert sorted_rows(tx.without_toxic(clashing, none)) == sorted_rows(clashing)


def test_texts_without_words_have_no_grade(spark):
    rows = [(i, "vile horrid words here" if i % 2 else "kind mild words there") for i in range(200)]
    blank = [(300, "\n"), (301, " \u00a0 "), (302, None), (303, "")]
    docs = spark.createDataFrame(rows + blank, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(300, 1)], "doc_id long, toxic int")
    got = tx.grade_documents(docs, labels).collect()
    assert all(r.severity == 0 and not r.toxic for r in got if r.doc_id >= 300)
    assert all(r.toxic == bool(r.doc_id % 2) for r in got if r.doc_id < 300)


def test_scores_equal_a_plain_computation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    weights, theta = tx.fit(docs, labels)
    assert (np.diff(theta) > 0).all() and np.count_nonzero(weights)
    for r in tx.grade_documents(docs, labels).collect():
        words = (r.text or "").lower().split()
        total = 0.0
        for w in sorted(set(words)):
            bare = w.strip(tx.EDGES)
            if len(bare) >= 2:
                marks = {zlib.crc32(x.encode()) % tx.DIM for x in ("=" + bare, bare[:4], bare[:5], bare[:6])}
                total += (1 + math.log(words.count(w))) * sum(float(weights[m]) for m in marks)
        eta = total * 10 / math.sqrt(len(words) + tx.SMOOTH)
        above = [1 / (1 + math.exp(c - eta)) for c in theta] if words else [0.0] * len(theta)
        assert abs(r.severity - sum(above)) < 1e-6 and abs(r.p_toxic - above[0]) < 1e-6
        assert r.toxic == (r.p_toxic >= 0.5)
