"""Encoding of a whole corpus with a public byte-level tokenizer.

Forced-boundary splitting: from the vocabulary a table over all pairs of neighbouring bytes is built
that says whether the pair stands inside any token. Where it does not, no merge can ever cross, so the
text may be cut there and the fragments encoded each for itself. A pair alone is not enough, since the
tokenizer first splits text by a pattern that looks at neighbours; a cut is therefore made only where
that pattern cannot see across it either: after an ASCII letter or digit, or between an ASCII
non-blank and ASCII white space. Fragments of a batch are counted once each (they repeat heavily),
encoded once, and their ids gathered back; all of that is array work, no loop over texts.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split pattern of the byte-level vocabularies. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A vocabulary file of the installed tokenizer package, else of /opt/tokenizers."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


@lru_cache(maxsize=4)
def load_encoder(path: str, pattern: str = PATTERN):  # noqa: ANN201
    """Encoder and cut table of a vocabulary, once for each worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoder = tiktoken.Encoding("sievemark", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return encoder, cut_table(ranks)


def cut_table(tokens: dict[bytes, int]) -> np.ndarray:
    """For each pair of neighbouring bytes (first * 256 + second) whether a cut between them is certain."""
    inside = np.zeros(65536, bool)
    for t in tokens:
        if len(t) > 1:
            b = np.frombuffer(t, np.uint8).astype(np.int32)
            inside[b[:-1] * 256 + b[1:]] = True
    code = np.arange(256)
    word = ((code >= 48) & (code <= 57)) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122))
    blank = np.isin(code, [9, 10, 11, 12, 13, 32])
    solid = (code > 32) & (code < 127)
    safe = word[:, None] | (solid[:, None] & blank[None, :])
    return ~inside & safe.reshape(-1)


def encode_texts(texts: pa.Array, path: str, pattern: str = PATTERN) -> pa.ListArray:
    """Ids of each text; null and empty texts give an empty list."""
    encoder, cuts = load_encoder(path, pattern)
    texts = pa.array([], pa.large_string()) if len(texts) == 0 else texts.cast(pa.large_string()).fill_null("")
    texts = pa.concat_arrays([texts])  # no slice: offsets begin at 0
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    start, end = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[start:end] if end > start else np.zeros(0, np.uint8)
    bounds = offsets - start
    if not len(data):
        return pa.array([[] for _ in range(len(texts))], pa.list_(pa.int32()))
    flag = np.zeros(len(data) + 1, bool)
    flag[1:-1] = cuts[data[:-1].astype(np.int32) * 256 + data[1:]]
    flag[bounds] = True
    at = flag.nonzero()[0]
    fragments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = fragments.dictionary_encode()
    index = coded.indices.to_numpy()
    encode = encoder._core_bpe.encode_ordinary if hasattr(encoder, "_core_bpe") else encoder.encode_ordinary
    ids = [encode(x.decode("utf-8")) for x in coded.dictionary.to_pylist()]
    n_ids = np.fromiter(map(len, ids), np.int64, len(ids))
    first = np.concatenate([[0], np.cumsum(n_ids)])
    flat = np.fromiter((i for x in ids for i in x), np.int32, int(first[-1]))
    length = n_ids[index]
    upto = np.concatenate([[0], np.cumsum(length)])
    gather = np.repeat(first[index] - upto[:-1], length) + np.arange(upto[-1])
    ends = upto[np.searchsorted(at, bounds)]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[gather]))


def encode_corpus(documents: DataFrame, path: str | None = None, pattern: str = PATTERN, text: str = "text", key: str = "doc_id", batch_bytes: int = 16 << 20) -> DataFrame:
    """doc_id and ids of every document, without special tokens.

    Null and empty texts give an empty list; a text that spells a special token is ordinary text; very
    long texts are encoded whole; repeated rows give repeated rows; other columns are ignored. A map
    over the rows with no shuffle; ``batch_bytes`` bounds what is encoded at once, unless one text is longer.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, int(b.num_rows * batch_bytes / max(1, b.nbytes)))
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                yield pa.RecordBatch.from_arrays([part.column(0), encode_texts(part.column(1), path, pattern)], names=[key, "ids"])

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"{key} {documents.schema[key].dataType.simpleString()}, ids array<int>")
