"""Splitting oversized texts at natural boundaries.

Lexical-cohesion segmentation: at every natural boundary the words of a block before and a block after
it are compared; where the likeness falls into a valley the topic changes. From each piece's start the
deepest valley in the size window is taken as the cut, and the next piece begins an
overlap before it. Where the stretch after a cut would not fit behind such an overlap, the overlap is
put after the cut instead, so a stretch that fits a piece by itself need not be broken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.words import small_batches, valid_text

_TOKEN = re.compile(r"\S+")
_END = re.compile(r"[.?!][\"'”’»)\]}]?$")
_STRIP = re.compile(r"^\W+|\W+$")


@dataclass(frozen=True)
class Piece:
    first: int
    last: int  #: token after the last one
    kind: str  #: how it ends: natural, forced or end


def boundaries(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Token numbers that begin after a natural boundary, the ends of the text left out."""
    return np.array([i for i in range(1, len(spans)) if _END.search(text, spans[i - 1][0], spans[i - 1][1]) or any(c in "\n\r\v\f\x85  " for c in text[spans[i - 1][1] : spans[i][0]])], np.int64)


def valley_depths(tokens: list[str], at: np.ndarray, block: int = 60) -> np.ndarray:
    """Depth of the similarity valley at each boundary: how far the likeness climbs to the nearest peak on either side, added up."""
    if not len(at):
        return np.zeros(0)
    ids: dict[str, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) if len(w) > 3 else -1 for w in (_STRIP.sub("", t).lower() for t in tokens)], np.int64)
    like = np.zeros(len(at))
    for k, b in enumerate(at):
        first = max(0, b - block)
        _, local = np.unique(seq[first : b + block], return_inverse=True)  # numbers of these few words alone
        known = seq[first : b + block] >= 0
        left, right = (np.bincount(local[part][known[part]], minlength=len(local)) for part in (slice(0, b - first), slice(b - first, None)))
        norm = np.sqrt(float(left @ left) * float(right @ right))
        like[k] = (left @ right) / norm if norm else 0.0
    return _climb(like) + _climb(like[::-1])[::-1]


def _climb(like: np.ndarray) -> np.ndarray:
    """How far the values rise, going left from each place as long as they do not fall."""
    peak = like.copy()
    for i in range(1, len(like)):
        if like[i - 1] >= like[i]:
            peak[i] = peak[i - 1]
    return peak - like


def cut_pieces(n: int, at: np.ndarray, depth: np.ndarray, limit: int = 400, overlap: int = 40) -> list[Piece]:
    """Pieces of at most ``limit`` tokens; neighbours share ``overlap``.

    Each cut is the deepest valley of the window that a piece may fill (of equal ones the last) behind which
    the next stretch fits; where it would fit only behind the cut itself, the overlap is put after the cut.
    """
    pieces, start = [], 0
    following = np.append(at, n)
    while n - start > limit:
        low, high = np.searchsorted(at, start + overlap + 1), np.searchsorted(at, start + limit, side="right")
        best, shifted = -1, False
        for i in high - 1 - np.argsort(-depth[low:high][::-1], kind="stable"):
            b, stretch_end = int(at[i]), int(following[i + 1])
            if stretch_end <= b - overlap + limit or stretch_end - b > limit:
                best = b  # the next stretch fits behind the overlap, or never fits
                break
            if b + overlap <= start + limit and b + overlap < n:
                best, shifted = b, True
                break
        if best < 0 and high > low:
            best = int(at[high - 1])
        if best < 0:
            end = start + limit
            pieces.append(Piece(start, end, "forced"))
            start = end - overlap
        elif shifted:
            pieces.append(Piece(start, best + overlap, "natural"))
            start = best
        else:
            pieces.append(Piece(start, best, "natural"))
            start = best - overlap
    pieces.append(Piece(start, n, "end"))
    return pieces


def split_text(text: str, limit: int = 400, overlap: int = 40) -> tuple[str, list[tuple[int, int, str, str]]]:
    """(forced or natural for the whole text, [(first token, last token, kind, piece)])."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    at = boundaries(text, spans)
    edges = np.concatenate([[0], at, [len(spans)]])
    whole = "forced" if (np.diff(edges) > limit).any() else "natural"
    pieces = cut_pieces(len(spans), at, valley_depths([text[a:b] for a, b in spans], at), limit, overlap)
    return whole, [(p.first, p.last, p.kind, text[spans[p.first][0] : spans[p.last - 1][1]]) for p in pieces]


def split_oversized(texts: DataFrame, text: str = "narrative", key: str = "doc_id", limit: int = 400, overlap: int = 40) -> DataFrame:
    """Pieces of every text of more than ``limit`` tokens (runs of other than white space).

    Columns: key, cut (forced when a stretch between neighbouring natural boundaries is longer than the
    limit, else natural), piece_no, first_token, last_token (exclusive), piece_end (natural, forced, end)
    and piece. Null, empty and short texts give no row (they need no split); a text without any boundary
    is cut by force; repeated rows give repeated pieces; other columns are ignored. Tokens are counted
    in the JVM, so only oversized texts reach Python; no shuffle.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half the limit")
    kind = texts.schema[key].dataType.simpleString()
    long = texts.select(F.col(key), F.col(text)).where(F.length(text) > 2 * limit).where(F.regexp_count(F.col(text), F.lit(r"(?U)[^\s\u001c-\u001f]+")) > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 4 << 20):
            found = [split_text(t, limit, overlap) for t in valid_text(b.column(1)).to_pylist()]
            rows = [(i, whole, k, a, z, e, p) for i, (whole, pieces) in enumerate(found) for k, (a, z, e, p) in enumerate(pieces)]
            columns = list(zip(*rows)) if rows else [[]] * 7
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0], pa.int64())), *[pa.array(c, t) for c, t in zip(columns[1:], types)]], names=[key, "cut", "piece_no", "first_token", "last_token", "piece_end", "piece"])

    return long.mapInArrow(run, f"{key} {kind}, cut string, piece_no int, first_token int, last_token int, piece_end string, piece string")
