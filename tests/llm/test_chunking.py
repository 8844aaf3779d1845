import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievemark.llm.chunking import split_oversized, split_text


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([3, 15, 60, 150, 500]), st.integers(401, 2500))
def test_pieces(seed, sentence, n):
    r = random.Random(seed)
    words = [r.choice(["call", "light", "tray", "resident", "alarm", "x1"]) + ("." if r.random() < 1 / sentence else "") + r.choice([" ", " ", "  ", "\n" if r.random() < 0.05 else " "]) for _ in range(n)]
    text = "".join(words)
    whole, pieces = split_text(text)
    tokens = text.split()
    assert pieces[0][0] == 0 and pieces[-1][1] == len(tokens)
    for a, z, kind, piece in pieces:
        assert 0 < z - a <= 400 and piece.split() == tokens[a:z] and piece in text
    for (_, z, _, _), (b, _, _, _) in zip(pieces, pieces[1:]):
        assert z - b == 40
    if whole == "natural" and sentence <= 60:
        assert all(k != "forced" for _, _, k, _ in pieces)


def test_whole_cut():
    assert split_text("word " * 900)[0] == "forced"
    assert split_text(("word " * 399 + "end. ") * 3)[0] == "natural"
    assert split_text(("word " * 400 + 'end?" ') * 2)[0] == "forced"
    assert split_text(("word " * 390 + "end.) ") * 3)[0] == "natural"


def test_stretch_that_fits_is_not_broken():
    kinds = [k for _, _, k, _ in split_text("a " * 299 + "b. " + "c " * 379 + "d. " + "e " * 200)[1]]
    assert "forced" not in kinds


def test_table(spark):
    rows = [("a", "word. " * 500), ("b", "word " * 400), ("c", None), ("d", ""), ("e", "w\n" * 401), ("a", "word. " * 500), ("f", "x" * 5000)]
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id string, narrative string, cut int, piece string")
    out = split_oversized(df).collect()
    assert {r["doc_id"] for r in out} == {"a", "e"} and len([r for r in out if r["doc_id"] == "a"]) == 4
    assert split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, limit=50, overlap=40)
