"""Word codes, and texts whose bytes are no UTF-8."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sievemark.llm.chunking import split_oversized
from sievemark.llm.decontaminate import find_leaks
from sievemark.llm.pii import redact
from sievemark.llm.quality import classify_forms
from sievemark.llm.words import shingles, valid_text, word_codes


def test_codes_depend_on_words_alone():
    texts = ["Alpha beta, gamma", None, "", "beta GAMMA alpha beta", "x" * 3_000_000 + " alpha"]
    codes, offsets = word_codes(pa.array(texts))
    words = [w for t in texts if t for w in t.lower().replace(",", "").split()]
    assert offsets.tolist() == [0, 3, 3, 3, 7, 9] and len(set(codes.tolist())) == len(set(words)) == 4
    assert [codes[words.index(w)] for w in words] == codes.tolist()
    assert np.array_equal(word_codes(pa.array(texts).slice(3, 1))[0], codes[3:7])
    s, whole = shingles(codes, offsets, 2)
    assert whole.tolist() == [True, True, False, True, True, True, False, True] and s[1] == s[3] and len(set(s[whole].tolist())) == 4


def test_broken_bytes(spark):
    assert valid_text(pa.array(["é"])).to_pylist() == ["é"]
    d = spark.range(3).select(F.col("id").alias("doc_id"), F.expr("concat(cast(X'ff41fe' as string), repeat(' the word of a line.\n', 200), cast(X'c3' as string))").alias("text"), F.lit("en").alias("lang"))
    items = spark.createDataFrame([(1, "the word of a line. " * 6)], "item_id bigint, passage string")
    assert {r[0] for r in find_leaks(d, items).collect()} == {0, 1, 2}
    assert classify_forms(d).count() == 3 and redact(d, "text").count() == 3
    assert split_oversized(d, "text").select("doc_id").distinct().count() == 3
