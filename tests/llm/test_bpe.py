"""Operator 8 against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marquee.llm import bpe
from marquee.llm.op8_bpe import vocabulary

LETTERS = "abcdeÀéßñ中文😀́ '’sStTreR\t\n\r\x0b\x1c\x1f\x85\xa0 　​09²½٣.,!?<|>_-\x00"


@pytest.fixture(scope="module")
def model():
    return bpe.Bpe(bpe.read_config(vocabulary()))


def test_same_ids_as_the_library(model):
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    texts = ["", " ", "Hello world, it's  me.\n\n  x", "<|endoftext|>a<|endoftext|><|endoftext|> b", "<|endoftext", "a" * 3000,
             *["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 60))) for _ in range(3000)]]
    for text in texts:
        want = theirs.encode(text, add_special_tokens=False).ids
        ids = model.encode(text)
        assert [int.from_bytes(ids[k:k + 4], "little") for k in range(0, len(ids), 4)] == want, repr(text)
        assert model.decode(ids) == theirs.decode(want, skip_special_tokens=False) == text


def test_long_text_in_blocks(model, monkeypatch):
    text = "It's a  long text, with \n\n lines and 123 numbers. " * 50
    whole = model.encode(text)
    monkeypatch.setattr(bpe, "BLOCK", 64)
    assert model.encode(text) == whole and model.decode(whole) == text


def test_nulls_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (None, "hi there", 7), (2, "hi there", 7)], "doc_id long, text string, ids int")
    got = bpe.decode(bpe.encode(df.drop("ids"), vocabulary()), vocabulary()).collect()
    assert [(r.doc_id, r.text) for r in got] == [(1, ""), (2, ""), (None, "hi there"), (2, "hi there")]
    assert bpe.encode(df.limit(0), vocabulary()).collect() == []
