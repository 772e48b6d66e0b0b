import re
from collections import Counter, defaultdict

import pytest

from veilwork.llm import quality as ql

from .conftest import ROWS, sorted_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_line_words_removed".split()


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in " ".join(WORD.findall(line)))


def brute(rows, max_docs=ql.MAX_DOCS):
    holders = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if WORD.search(line):
                holders[s, key(line)].add(t)
    above = {k for k, texts in holders.items() if len(texts) > max_docs}
    out = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        repeated = {p + k for p, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        gone = sum(len(WORD.findall(x)) for x in lines if (s, key(x)) in above)
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        out.append(
            (i, len(w), sum(map(len, w)), len(re.findall(ql.SYMBOLS, t)), len(lines) - len(set(lines)), len(repeated), failed, not failed and len(w) - gone >= 0.5 * len(w), gone)
        )
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_docs", [0, 1, 2, 20])
def test_odd_rows(odd, clashing, empty, max_docs):
    expected = brute([(r[0], r[1], r[3]) for r in ROWS], max_docs)
    assert sorted_rows(ql.rate(odd, max_docs).select(*COLUMNS)) == expected
    assert sorted_rows(ql.rate(clashing, max_docs).select(*COLUMNS)) == expected
    assert ql.rate(empty, max_docs).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], 2)
    assert sorted_rows(ql.rate(docs, 2).select(*COLUMNS)) == expected


def test_boilerplate_goes_and_depleted_documents_with_it(spark):
    common = "the same footer line of this host " * 4
    body = lambda i: " ".join(f"own{i}word{k}" for k in range(60))
    rows = [(i, body(i) + "\n" + common.upper(), "host") for i in range(5)]
    rows += [(9, " ".join(f"v{k}" for k in range(20)) + "\n" + common + "\n" + common, "host"), (10, body(10) + "\n" + common, "other")]
    got = {r.doc_id: r.text for r in ql.cleaned(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=3).collect()}
    assert got == {**{i: body(i) for i in range(5)}, 10: rows[-1][1]}


def test_copies_do_not_condemn_a_document(spark):
    text = " ".join(f"w{k}" for k in range(80))
    got = ql.rate(spark.createDataFrame([(i, text, "a") for i in range(50)], "doc_id long, text string, source string"))
    assert got.where("kept").count() == 50


def test_limits_are_alike_on_hosts_of_every_size(spark):
    line = lambda i, n: "\nshared by some" if i < n else ""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + line(i, 21), "large") for i in range(3000)]
    rows += [(5000 + i, " ".join(f"v{i}x{k}" for k in range(60)) + line(i, 21), "small") for i in range(21)]
    rows += [(6000 + i, " ".join(f"u{i}x{k}" for k in range(60)) + line(i, 20), "below") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = {r.doc_id: r.n_line_words_removed for r in ql.rate(docs).where("n_line_words_removed > 0").collect()}
    assert gone == {i: 3 for i in [*range(21), *range(5000, 5021)]}
