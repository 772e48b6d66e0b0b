import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilwork.llm import token_store as ts
from veilwork.llm.common import running_base
from veilwork.llm.piece_store import PieceTable
from veilwork.llm.queries import tokenizer_file

from .conftest import ROWS, sorted_rows

PATH = tokenizer_file("byte_bpe_50k.json")
TEXTS = st.text(st.one_of(st.sampled_from(" \n\t.,'ab<|éA1 \x85\xa0\u3000"), st.characters(exclude_categories=["Cs"])), max_size=60)


def library():
    return Tokenizer.from_file(PATH)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 100_000), max_size=700))
def test_elias_fano_keeps_every_value(steps):
    values = np.cumsum(np.array(steps, dtype=np.int64))
    ef, _ = ts.EliasFano.from_bytes(memoryview(ts.EliasFano.encode(values).to_bytes()))
    assert ef.values().tolist() == values.tolist()
    assert [ef.get(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.full(10_000, 900))
    assert len(ts.EliasFano.encode(values).to_bytes()) < 10_000 * 14 / 8


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(TEXTS, st.lists(st.one_of(TEXTS, st.just("<|endoftext|>")), max_size=5).map("".join)), max_size=6))
def test_encoder_equals_the_library(texts):
    ids, sizes = ts.encoder(PATH)(pa.array(texts, pa.string()))
    expected = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_a_long_text_takes_bounded_memory_beside_its_pieces():
    import tracemalloc

    text = " ".join(f"w{i % 5000}" for i in range(500_000))
    enc = ts.PieceEncoder(PATH)
    enc(pa.array(["w0 and w1"]))
    tracemalloc.start()
    ids, sizes = enc(pa.array([text]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.tolist() == library().encode(text, add_special_tokens=False).ids
    assert peak < 40 * len(text)  # 66 before stretches


def test_stretches_equal_the_library(monkeypatch):
    monkeypatch.setattr(ts, "STRETCH_BYTES", 50)
    texts = ["ab cd ab " * 90 + "x" * 700 + " ab" * 40, "", "é1 " * 60 + "y" * 49, "z" * 400, " "]
    for t in (texts, [""], []):
        ids, sizes = ts.PieceEncoder(PATH)(pa.array(t, pa.string()))
        expected = [library().encode(x, add_special_tokens=False).ids for x in t]
        assert sizes.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


def test_a_small_table_takes_many_pieces_at_once():
    keys = np.random.default_rng(3).integers(1, 1 << 63, (2, 5000), dtype=np.uint64)
    table = PieceTable(4)
    for a, z in ((0, 3), (3, 4000), (4000, 5000)):
        table.put(keys[0, a:z], keys[1, a:z], np.arange(a, z))
    assert table.find(*keys).tolist() == list(range(5000)) and 2 * table.count <= table.mask + 1


def brute(rows):
    tok, out, start = library(), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_stored_documents_equal_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = ts.stored_documents(docs, PATH)
    assert sorted_rows(got) == sorted(brute([(r.doc_id, r.text) for r in docs.collect()]), key=repr)


def test_odd_rows(odd, clashing, empty):
    rows = sorted(ts.stored_documents(clashing, PATH).collect(), key=lambda r: r.start)
    expected = brute([(r[0], r[1]) for r in ROWS])
    # rows of one doc_id may stand in either order
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows if r.doc_id) == sorted((i, n, c) for i, _, n, c in expected if i)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert rows[0].doc_id is None and rows[1].doc_id is None
    assert ts.stored_documents(empty, PATH).collect() == []


def test_added_tokens_and_many_shards_equal_the_library(spark):
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b", "two  <|endoftext|>  more", "", None, "x " * 50] * 3
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = ts.shared_path(spark, "tokens-test")
    ts.write_tokens(docs, path, PATH, shard_chars=60)
    assert spark.read.parquet(path).count() > 5
    assert sorted_rows(ts.read_documents(spark, path)) == sorted(brute(rows), key=repr)


def test_running_base_over_levels(spark):
    rows = [(b, i, (7 * i + b) % 11) for b in (0, 1) for i in range(0, 90, 1 + b)]
    got = running_base(spark.createDataFrame(rows, "b int, i long, v long"), "i", "v", "base", ("b",), bits=2)
    assert sorted_rows(got) == sorted(((b, i, sum(v for c, j, v in rows if c == b and j < i)) for b, i, _ in rows), key=repr)
