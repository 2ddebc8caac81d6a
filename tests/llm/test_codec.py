import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketry.llm.bpe import Joiner, Reader, encoder
from docketry.llm.encoding import decode_column, encode_column
from docketry.llm.packing import lengths, pack
from docketry.llm.queries import op2_bpe_codec, op7_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return np.concatenate([*next(encoder(PATH).rows(pa.array([text], pa.string()))), np.zeros(0, "<u4")]).tolist()


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_every_letter_as_the_library():
    for c in [*range(0x600), *range(0x600, 0x3100, 5), *range(0x3100, 0x110000, 499)]:
        if not 0xD800 <= c < 0xE000:
            text = f"Ab{chr(c)}b c're{chr(c)} "
            assert ids_of(text) == expected(text), hex(c)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abehintorsTΣσςÉéñß1 '!<|>\n\t\x1c\x85\u0301\u2019İ語😀"), max_size=60))
def test_random_texts_as_the_library(text):
    text += random.choice(["", "<|endoftext|>", " <|startoftext|>x"])
    assert ids_of(text) == expected(text)
    assert Joiner(encoder(PATH)).feed(np.array(expected(text), "<u4")) == LIBRARY.decode(expected(text), skip_special_tokens=False)


@pytest.mark.parametrize("word", ["a" * 30_000, "".join(random.Random(3).choices("abehintors", k=40_000))])
def test_long_words_stream_with_bounded_memory(word):
    coder = encoder(PATH)
    assert coder.word(word.encode()) == expected(word)
    symbols = [*(coder.inner[b] for b in word[:-1].encode()), coder.final[ord(word[-1])]]
    assert [*coder.stream(symbols, window=64)] == expected(word)


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr("docketry.llm.bpe.PIECE", 100)
    text = "the quick été, it's 12\n" * 60
    assert ids_of(text) == expected(text)


def test_decoder_states_do_not_depend_on_portions():
    ids = np.array(expected("Été it's 語 a"), "<u4")
    whole = Reader(encoder(PATH)).feed(ids, final=True)
    reader = Reader(encoder(PATH))
    assert "".join(reader.feed(ids[i:i + 1]) for i in range(len(ids))) + reader.feed(ids[:0], final=True) == whole
    assert whole == "été it 's 語 a"


def test_columns_with_nulls_and_empty(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "the cat"), (3, "the cat")], "doc_id bigint, text string")
    got = rows.withColumn("ids", encode_column(F.col("text"), PATH)).withColumn("back", decode_column(F.col("ids"), PATH)).collect()
    assert [r.ids for r in got] == [[], [], expected("the cat"), expected("the cat")]
    assert got[0].back == "" and got[2].back == "the</w> cat</w>"


def test_op2_whole_table(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    got = op2_bpe_codec(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = expected(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_lengths():
    assert lengths(1) == [1] and lengths(4096 * 2 + 5) == [4096, 4096, 4, 1]
    with pytest.raises(ValueError):
        lengths(5, limit=3000)


def test_op7_whole_table(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    pieces: dict = {}
    sequences = set()
    for r in op7_packing(spark, SF).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.add(r.sequence_id)
        assert r.offset == 0 and r.length <= 4096 and r.length & (r.length - 1) == 0
    assert len(sequences) == sum(map(len, pieces.values()))
    assert pieces.keys() == docs.keys()
    for doc, found in pieces.items():
        ids, at = [*expected(docs[doc]), 2], 0
        for r in sorted(found, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_pack_edges(spark):
    schema = "doc_id bigint, text string, ids int, length string"
    rows = spark.createDataFrame([(1, None, 0, ""), (None, "", 1, ""), (2, "the cat", 2, ""), (2, "the cat", 2, "")], schema)
    got = [(r.doc_id, r.start, r.ids) for r in pack(rows, PATH).collect()]
    assert got[:2] == [(1, 0, [2]), (None, 0, [2])] and len(got) == 6  # 3 = 2 + 1 tokens, twice
    assert pack(rows.limit(0), PATH).count() == 0
