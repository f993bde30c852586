"""Encoding over distinct words against the library on whole texts."""

import random
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from flowkeel.llm import bpe
from flowkeel.llm import text as T
from tests.llm.odd import SCHEMA, bag, documents, rows

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [" ", "  ", "\n", "\r\n", "\t", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "​",
            "–", "'s", "'ll", "'", "a", "Be", "é", "ß", "漢", "\U0001f600", "1", "23", "!", "...", "<|endoftext|>", "<|end", "\x00", "́"]


@lru_cache
def loaded(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def library(path, text):
    t = loaded(path)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def random_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(1, 30))) for _ in range(n)]


def test_odd_documents(spark):
    got = bag(bpe.encode_and_decode(documents(spark), BYTES))
    assert got == sorted(((r[0], *library(BYTES, r[1])) for r in rows()), key=repr)


def test_any_characters(spark):
    data = [(i, t) for i, t in enumerate(random_texts(600))]
    got = bag(bpe.encode_and_decode(spark.createDataFrame(data, "doc_id long, text string"), BYTES))
    assert got == sorted(((i, *library(BYTES, t)) for i, t in data), key=repr)


def test_other_tokenizers_encode_whole_texts(spark):
    assert bpe.splits_at_blanks(BYTES) and not bpe.splits_at_blanks(WORDS)
    got = bag(bpe.encode(documents(spark), WORDS))
    assert got == sorted(((r[0], library(WORDS, r[1])[0]) for r in rows()), key=repr)
    with pytest.raises(ValueError, match="byte-level"):
        bpe.pieces(WORDS)


def test_words_cover_the_texts_and_are_few():
    column = pa.array([" the cat the cat", None, "", "\n\n the  cat"])
    data, at = T.text_buffers(column)
    starts = bpe.word_starts(data, at)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [
        " the", " cat", " the", " cat", "\n\n the  cat"]


def test_each_word_is_encoded_once(monkeypatch):
    column = pa.record_batch({"doc_id": pa.array(range(4000)), "text": pa.array(["same words again and again"] * 4000)})
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 20_000)
    blocks = list(bpe.splitter(False)(iter([column])))
    assert len(blocks) > 3
    rows = [(n, k, w["sizes"], w["text"]) for n, b in enumerate(blocks) for k, w in enumerate(b.column(4)[0].as_py()) if w]
    rows = pa.record_batch([pa.array(x) for x in zip(*sorted(rows, key=lambda r: r[1]), strict=True)], names=["block", "bucket", "sizes", "text"])
    seen = []

    class Counting:
        def encode_batch_fast(self, words, **kind):
            seen.extend(words)
            return loaded(BYTES).encode_batch_fast(words, **kind)

    monkeypatch.setattr(bpe, "tokenizer", lambda path: Counting())
    list(bpe.encoder(BYTES)(iter([rows])))
    assert sorted(seen) == [" again", " and", " words", "same"]


def test_numbers_in_rows_of_bytes():
    for values in ([], [0], [255], [256, 1, 70000], [2**31, 5]):
        assert bpe.expand(bpe.squeeze(np.array(values, np.int64))).tolist() == values


def test_decoding_of_given_ids(spark):
    got = bpe.decode(spark.createDataFrame([(1, [50256, 220, 31373]), (2, []), (3, None), (4, [-1, 31373, 99999])], "row long, ids array<int>"), BYTES)
    assert bag(got) == [(1, [50256, 220, 31373], "<|endoftext|> hello"), (2, [], ""), (3, None, ""), (4, [-1, 31373, 99999], "hello")]
    assert bpe.as_text(pa.array([b"a\xffb\xe2\x82"])).to_pylist() == ["a\ufffdb\ufffd"]


def test_no_documents(spark):
    assert bpe.encode_and_decode(spark.createDataFrame([], SCHEMA), BYTES).count() == 0
