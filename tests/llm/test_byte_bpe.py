import hashlib

import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from veilwork.llm import byte_bpe as bb
from veilwork.llm.queries import tokenizer_file

from .conftest import ROWS, sorted_rows

PATH = tokenizer_file("byte_bpe_multi_50k.tiktoken")
CODER = bb.coder(PATH, bb.class_table())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bb.load_ranks(PATH), special_tokens={})
ALPHABET = st.one_of(st.sampled_from(" \n\t\r'stmdreveLl.,-19aé  ß😀٣"), st.characters(exclude_categories=["Cs"]))


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(ALPHABET, max_size=80), min_size=1, max_size=5))
def test_encoding_equals_the_library(texts):
    ids, n = CODER.encode(texts)
    ends = np.cumsum(n).tolist()
    for t, a, z in zip(texts, [0, *ends], ends):
        assert ids[a:z].tolist() == LIBRARY.encode_ordinary(t)
        assert CODER.decode(ids[a:z]).tobytes() == t.encode()
        assert CODER.offsets(ids[a:z])[-1] == len(t.encode())


@settings(deadline=None, max_examples=200)
@given(st.text(st.sampled_from(" \n\t\r'stmdreveLl.,-19aéßñЖ中٣Ⅷ\u00a0\u2003😀!?…"), max_size=300))
def test_boundaries_equal_the_pattern(text):
    got = bb.boundaries(text, np.array([len(text)]), CODER.table).tolist()
    assert got == [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)]


def test_long_pieces():
    text = "ab" * 5000 + " " + "x" * 3000 + " " * 2000 + "!?" * 900
    assert CODER.encode([text])[0].tolist() == LIBRARY.encode_ordinary(text)


def brute(rows):
    out = []
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        raw = np.array(ids, dtype="<u4").tobytes()
        out.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_documents(spark, odd, clashing, empty):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted_rows(bb.encode(docs, PATH, False)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    expected = brute([(r[0], r[1]) for r in ROWS])
    assert sorted_rows(bb.encode(odd, PATH), "ids", "offsets") == expected
    assert sorted_rows(bb.encode(clashing, PATH), "ids", "offsets") == expected
    assert bb.encode(empty, PATH).collect() == []


def test_offsets_find_each_token_in_the_text(odd):
    for r in bb.encode(odd, PATH).collect():
        ids, at = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.offsets, "<u4")
        raw = CODER.decode(ids).tobytes()
        cuts = [*at.tolist(), len(raw)]
        assert [raw[a:z] for a, z in zip(cuts, cuts[1:])] == [CODER.decode(ids[k : k + 1]).tobytes() for k in range(len(ids))]
