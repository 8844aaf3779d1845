"""Ids against the tokenizer library's own encoding of whole texts."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievemark.llm.tokenize import cut_table, encode_corpus, encode_texts, load_encoder, vocabulary_path
from sievemark.session import table


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_random_text(whole):
    r = random.Random(4)
    alphabet = list(" \n\t\r'\"abcsdtlvremXQZ.,!?0123éñ世界   　​<|>-_🙂́")
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(80))) for _ in range(8000)]
    texts += [None, "", " ", "\n\n", "<|endoftext|>", "a'll !'ll 'LL", "x" * 20000, " \n" * 5000, "q" + "é" * 3000, "zqxj" * 900]
    assert encode_texts(pa.array(texts), vocabulary_path()).to_pylist() == whole(texts)


def test_documents(spark, data, whole):
    d = table(spark, data, "documents")
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(d.withColumn("ids", F.lit(1))).collect()}
    rows = d.select("doc_id", "text").collect()
    assert got == dict(zip([r["doc_id"] for r in rows], whole([r["text"] for r in rows])))
    assert encode_corpus(d.limit(0)).count() == 0
    assert encode_corpus(d, batch_bytes=1).count() == len(rows)


def test_slices_and_cuts(whole):
    a = pa.array(["one two", "", None, "three, four"])
    assert encode_texts(a[1:], vocabulary_path()).to_pylist() == whole(["", None, "three, four"])
    assert encode_texts(a[:0], vocabulary_path()).to_pylist() == []
    t = cut_table({b"ab": 0, b" c": 1})
    assert not t[ord("a") * 256 + ord("b")] and t[ord("b") * 256 + ord(" ")] and not t[ord(" ") * 256 + ord("x")] and not t[ord("!") * 256 + ord("'")]
    assert load_encoder(vocabulary_path())[1].sum() > 1000
