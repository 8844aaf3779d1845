"""Words of many texts at once: whole Arrow columns in, flat numpy arrays out, no loop over texts or words."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 20  #: bytes hashed at once


def replace(texts: pa.Array, pattern: str, by: str) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern, by)


def valid_text(texts: pa.Array) -> pa.Array:
    """The texts as large_string; where bytes are no UTF-8, a replacement character stands for them."""
    t = texts.cast(pa.large_string())
    try:
        text_bytes(pc.fill_null(t, ""))[0].tobytes().decode("utf-8")
    except UnicodeDecodeError:
        t = pa.array([None if x is None else x.decode("utf-8", "replace") for x in t.cast(pa.large_binary()).to_pylist()], pa.large_string())
    return t


def plain_words(texts: pa.Array) -> pa.Array:
    """Texts without case, punctuation, spacing and markup: words of letters and digits between single blanks. Null becomes empty."""
    t = pc.fill_null(valid_text(texts), "")
    wide = pc.invert(pc.string_is_ascii(t))
    if pc.any(wide).as_py():  # full-width letters, ligatures and split accents are the letters they stand for
        t = pc.replace_with_mask(t, wide, pa.array([unicodedata.normalize("NFKC", x) for x in t.filter(wide).to_pylist()], pa.large_string()))
        t = replace(t, "[­​‌‍⁠﻿]+", "")
    t = replace(t, r"</?[A-Za-z][^<>]*>", " ")
    coded = pc.match_substring_regex(t, r"&#?\w")
    if pc.any(coded).as_py():
        t = pc.replace_with_mask(t, coded, pa.array([html.unescape(x) for x in t.filter(coded).to_pylist()], pa.large_string()))
    t = pc.utf8_lower(replace(t, "['’]+", ""))
    for _ in range(2):  # groups of thousands; neighbouring groups share a digit, so a second round joins the rest
        t = replace(t, r"(\d),(\d{3})", r"\1\2")
    return replace(t, r"[^\p{L}\p{N}]+", " ")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string array without nulls, and the texts' offsets in them (from 0)."""
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs of true bytes; no run crosses the edge of a text."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    return start.nonzero()[0], end.nonzero()[0] + 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit number for the bytes of each (non-empty) run."""
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    size = end - start
    power = np.multiply.accumulate(np.full(int(size.max()) + 1, _BASE))
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _CHUNK, side="right")))
        first = np.cumsum(size[at:to]) - size[at:to]
        place = np.arange(int(size[at:to].sum())) - np.repeat(first, size[at:to])
        value = (data[np.repeat(start[at:to], size[at:to]) + place].astype(np.uint64) + np.uint64(1)) * power[place]
        out[at:to] = np.add.reduceat(value, first)
        at = to
    return mix(out)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit number for every word, offsets of the texts in it)."""
    data, offsets = text_bytes(plain_words(texts))
    start, end = runs(data != 32, offsets)
    return hashed(data, start, end), np.searchsorted(start, offsets)


def shingles(codes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the k words from each place on, whether these lie in one text)."""
    n = max(0, len(codes) - k + 1)
    s = np.full(n, np.uint64(k))
    for j in range(k):
        s = mix(s) + codes[j : j + n]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return mix(s), text[:n] == text[k - 1 :] if n else np.zeros(0, bool)


def small_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes."""
    for b in batches:
        step = max(1, int(b.num_rows * size / max(1, b.nbytes)))
        yield from (b.slice(i, step) for i in range(0, b.num_rows, step))
