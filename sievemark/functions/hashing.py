"""BLAKE2b identifiers, which Spark has no built-in for, in Arrow batches; SHA-256 is built in."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemark.functions.text import key_part


def mix64(h: np.ndarray) -> np.ndarray:
    """64-bit numbers spread over all bits (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POISSON = np.cumsum(np.exp(-1.0) / np.array([math.factorial(k) for k in range(12)]))


def poisson_weights(keys: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(keys, n) Poisson(1) weights that depend on key, replicate and seed alone: a bootstrap that no partitioning changes."""
    replicate = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed % (1 << 63)))
    u = mix64(mix64(keys.astype(np.int64).view(np.uint64))[:, None] ^ replicate[None, :]) >> np.uint64(11)
    return np.searchsorted(_POISSON, u / float(1 << 53)).astype(float)


def blake2b(c: Column, length: int = 16, salt: str = "") -> Column:
    """Hex BLAKE2b of ``length`` digits (even, 8 to 64), with an optional salt before the text; null stays null."""
    if length % 2 or not 8 <= length <= 64:
        raise ValueError("length must be even and between 8 and 64")

    @F.pandas_udf("string")
    def digest(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hashlib.blake2b((salt + x).encode(), digest_size=length // 2).hexdigest())

    return digest(c)


def doc_id_key(ccn: Column, survey_date: Column, f_tag: Column, offset: Column) -> Column:
    return F.concat_ws("|", key_part(ccn), key_part(survey_date), key_part(f_tag), offset.cast("string"))


def stable_doc_id(ccn: Column, survey_date: Column, f_tag: Column, offset: Column, length: int = 16) -> Column:
    return blake2b(doc_id_key(ccn, survey_date, f_tag, offset), length)


def salted_hash(c: Column, salt: str, length: int = 16) -> Column:
    if not salt:
        raise ValueError("a salt is needed")
    return blake2b(c, length, salt + "|")
