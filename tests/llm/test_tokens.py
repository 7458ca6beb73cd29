"""Encoding, decoding and record files against the library and against exact round trips."""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import bpe, queries, records

SMALL = "/root/testdata/sf0.001"
PATH = queries.tokenizer_path()
ODD = [
    "", None, " ", "\n\t", "word", "Ünïcode — “quotes”… ½ ①", "İstanbul ΑΣ ﬁ", "é H̱ İ, ab̀, x̀.", "don't it's we'll 's't", "<|endoftext|>x<|STARTOFTEXT|> a<|startoftext|>.", "中文字" * 50,
    "a" * 5000, "!?.," * 700, "no break space", "x.,. .,", "A.B,c.", "\U0001d518🙂" * 30, "12345 6,789.0", "é,à.", "thetion" * 900,
]


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(PATH)


def library(coder, text):
    ids = coder.tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, coder.tokenizer.decode(ids, skip_special_tokens=False)


def tree(coder, text, piece):
    leaves = bpe.halves(text, piece)
    assert "".join(leaves) == text and all(len(leaf) <= piece for leaf in leaves)
    return bpe.concatenated(coder, leaves, [coder.placed(leaf) for leaf in leaves])[:, 0].tolist()


@pytest.mark.parametrize("piece", [3, 17, 200])
def test_trees_of_odd_texts(coder, piece):
    for text in ODD:
        assert tree(coder, text or "", piece) == library(coder, text)[0], text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehinorstT  '.,!<|>ﬁéß́İΣ0 7中🙂\n ", max_size=300), st.sampled_from([1, 5, 40]))
def test_trees_of_any_text(text, piece):
    coder = bpe.kept(("encoder", PATH, True), lambda: bpe.Encoder(PATH))
    assert tree(coder, text, piece) == library(coder, text)[0]
    ids, decoded = library(coder, text)
    assert coder.chunked([text.encode()], True) == [(np.array(ids, "<u4").tobytes(), decoded)]


def test_chunks_beyond_what_is_kept(coder, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 6)
    small = bpe.Encoder(PATH)
    texts = [t or "" for t in ODD] + ["one two three, four. five six Seven eight"] * 2
    for _ in range(2):
        for text, (ids, decoded) in zip(texts, small.chunked([t.encode() for t in texts], True)):
            assert (np.frombuffer(ids, "<u4").tolist(), decoded) == library(coder, text)
    assert len(small.ids_of) <= 3


@pytest.mark.parametrize("piece", [bpe.PIECE, 50])
def test_encode_column(spark, coder, piece):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, "null id", "x"), (4, "word", "clash"), (77, "some longer text, with words. " * 40, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = bpe.encode(df, PATH, piece=piece)
    assert found.columns == ["doc_id", "ids", "decoded"]
    got = sorted(((r.doc_id, bpe.tokens(r.ids).tolist(), r.decoded) for r in found.collect()), key=str)
    assert got == sorted(((i, *library(coder, t)) for i, t, _ in rows), key=str)
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_round_trip_query(spark, coder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = queries.QUERIES["op5_bpe_round_trip"](spark, SMALL).collect()
    assert len(found) == len(texts)
    for r in found:
        ids, decoded = library(coder, texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_record_query(spark, coder):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    found = {r.doc_id: r for r in queries.QUERIES["op9_token_records"](spark, SMALL).collect()}
    start = 0
    for i, text in rows:
        ids = [*library(coder, text)[0], 1]
        r = found[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert len(found) == len(rows)


def test_frames():
    for number, ids in ((5, [1, 2, 65_535]), (None, []), (-7, [65_536, 3]), (0, [0])):
        data = b"xx" + records.frame(number, np.array(ids, np.int64)) + b"yy"
        back, got, end = records.unframe(data, 2)
        assert (back, got.tolist(), end) == (number, ids, len(data) - 2)
        for at in (3, 11, len(data) - 4):
            broken = bytearray(data)
            broken[at] ^= 1
            with pytest.raises(ValueError, match="damaged"):
                records.unframe(bytes(broken), 2)


def test_files_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(records, "READ_RECORDS", 3)
    rows = [(None, "first"), (3, "x"), (3, None), (3, "x"), (-2, "neg"), (9, "ninth"), (4, "")] + [(5, f"hot {i}") for i in range(40)]
    place = records.new_folder(spark)
    laid = records.in_order(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, id int"))
    encoded = bpe.encode_in_place(laid, PATH)
    files = records.write_sequences(encoded, place, end_id=1)
    found = sorted((r.start, r.id, len(r.ids) // 4) for r in records.read_sequences(files, place).collect())
    assert len(found) == len(rows)
    ids = [i for _, i, _ in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [s for s, _, _ in found] == [sum(n for _, _, n in found[:k]) for k in range(len(found))]
    nothing = records.write_sequences(encoded.limit(0), records.new_folder(spark))
    assert records.read_sequences(nothing, place).count() == 0


def test_only_committed_files_are_read(spark):
    rows = spark.createDataFrame([(i, np.arange(i, dtype="<u4").tobytes()) for i in range(6)], "id long, ids binary").coalesce(1)
    place = records.new_folder(spark)
    files = records.write_sequences(rows, place)
    records.write_sequences(rows, place)
    found = records.read_sequences(files, place).orderBy("id").select("id", "start", F.octet_length("ids")).collect()
    assert [tuple(r) for r in found] == [(i, i * (i - 1) // 2, 4 * i) for i in range(6)]


def test_long_texts_of_a_shuffled_frame(spark, coder):
    """Pieces meet their own text, though a frame that is read twice may come in another order."""
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").repartition(5)
    found = bpe.encode(documents, PATH, piece=200, decode=False).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert len(found) == len(texts)
    assert all(bpe.tokens(r.ids).tolist() == library(coder, texts[r.doc_id])[0] for r in found)


@pytest.mark.parametrize("most", [bpe.WORDS_KEPT, 40, 0])
def test_ids_by_hash_are_those_of_the_library(spark, coder, monkeypatch, most):
    monkeypatch.setattr(bpe, "WORDS_KEPT", most)
    words = bpe.WordIds(bpe.Encoder(PATH, False))
    texts = ODD + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()]
    for _ in range(2):
        for at in range(0, len(texts), 7):
            part = texts[at : at + 7]
            for text, ids in zip(part, words.rows(pa.array(part, pa.string()))):
                assert np.frombuffer(ids, "<u4").tolist() == library(coder, text)[0], text
    assert words.rows(pa.array([], pa.string())) == [] and words.rows(pa.array([None, ""], pa.string())) == [b"", b""]
