"""Evaluation passages that leaked into training text.

Prefix-filtered set join of word shingles. A leak holds a window of ``min_words`` words of an item (a
shorter item: all of it) with a bounded number of edits, so a known number of the window's shingles
survives. With the shingles ordered by rarity, a window therefore shares at least one of its rarest ones
(its prefix) with the document, however the edits fall.

* Items become postings of shingles once, in parallel. Two bitmaps of a bounded size (all shingles, prefix
  shingles) are all that is broadcast, whatever the number of items.
* One pass over the documents, whatever the number of items. Length bound: shorter documents hold no
  window. Count bound: enough known shingles within a window's reach. Prefix shingles at such places are
  the document's keys; documents without any end here.
* Keys and prefix postings meet in an equi-join. Where the postings are more than a checked number it is a
  shuffle join with salted keys, so a stock phrase in a third of all documents is spread.
* A hit names an item and a diagonal (positional bound): the stretch of the document and the part of the
  item around it are cut out, counted again on the band of the hit, and aligned, many pairs side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.words import shingles, small_batches, word_codes
from sievemark.session import checkpointed

BITS_PER_KEY, PROBES, MOST_BITS = 64, 4, 1 << 27
BAND, BLOCK = 16, 128  #: width of a band of diagonals; item words that one alignment looks at, besides its margins


@dataclass(frozen=True)
class LeakRule:
    """What counts as a leak: so many consecutive words of an item, or all of a shorter one, with one edit in ``per_edit`` words (rounded to the nearest).

    A match begins and ends with two words of the item as they stand. Words of the window beyond its ends
    count as edits too, but only beside edits inside, at most two for each: an unedited quotation must
    have all the words, while one that was edited may have been edited at its ends as well.
    """

    min_words: int = 20
    per_edit: int = 8

    def edits(self, n: int) -> int:
        return (2 * n + self.per_edit) // (2 * self.per_edit)

    def shape(self, n: int) -> tuple[int, int, int, int]:
        """(window, shingle, surely surviving shingles, edits) for an item of n words: the longest shingle of up to three words of which any survives."""
        w = min(n, self.min_words)
        e = self.edits(w)
        k = next((k for k in (3, 2, 1) if w - k + 1 - k * e >= 1), 1)
        return w, k, max(1, w - k + 1 - k * e), e


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def item_postings(items: DataFrame, rule: LeakRule) -> tuple[DataFrame, DataFrame]:
    """(item_key, item_id, words of every item; item_key, window, place, shingle, prefix of every shingle)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 4 << 20):
            codes, offsets = word_codes(pa.concat_arrays([b.column(2)]))
            n = np.diff(offsets)
            lists = []
            window = np.minimum(n, rule.min_words)
            for i in range(b.num_rows):
                s, _ = shingles(codes[offsets[i] : offsets[i + 1]], np.array([0, n[i]]), rule.shape(int(n[i]))[1] if n[i] else 1)
                lists.append(s.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(window, pa.int32()), _lists(codes.astype(np.int64), n, pa.int64()), _lists(np.concatenate([*lists, np.zeros(0, np.int64)]), np.array([len(x) for x in lists]), pa.int64())],
                names=["item_key", "item_id", "window", "words", "shingles"],
            )

    rows = items.where("passage is not null and item_id is not null").select(F.col("item_id").cast("bigint"), "passage").distinct()
    cutting = rows.select(F.xxhash64("item_id", "passage").alias("item_key"), "item_id", "passage").mapInArrow(cut, "item_key bigint, item_id bigint, window int, words array<bigint>, shingles array<bigint>")
    held = checkpointed(cutting.where("window > 0"))
    each = held.select("item_key", "window", F.posexplode("shingles").alias("place", "shingle"))
    rarity = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    ranked = each.join(rarity, "shingle").groupBy("item_key", "window").agg(F.array_sort(F.collect_list(F.struct("place", "n", "shingle"))).alias("row"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.column(2)[i].values
                n, code = row.field("n").to_numpy(), row.field("shingle").to_numpy()
                window = b.column(1)[i].as_py()
                w, k, kept, _ = rule.shape(window)
                width = w - k + 1
                rank = np.empty(len(n), np.int64)
                rank[np.lexsort((np.arange(len(n)), code, n))] = np.arange(len(n))
                view = np.lib.stride_tricks.sliding_window_view(rank, width)
                first = np.argsort(view, axis=1)[:, : width - kept + 1] + np.arange(len(view))[:, None]
                prefix = np.zeros(len(n), bool)
                prefix[first.ravel()] = True
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(n), pa.int64()), pa.array([window] * len(n), pa.int32()), row.field("place"), row.field("shingle"), pa.array(prefix)], names=["item_key", "window", "place", "shingle", "prefix"])

    return held.drop("shingles"), checkpointed(ranked.mapInArrow(choose, "item_key bigint, window int, place int, shingle bigint, prefix boolean"))


def _probe(codes: np.ndarray, bits: int, j: int) -> np.ndarray:
    """Place of the j-th bit of each code."""
    return ((codes >> np.uint64(16 * j)) ^ (codes << np.uint64(7 * j + 1))) & np.uint64(bits - 1)


def _holds(bitmap: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Codes that a bitmap may hold (all that it holds, and very few others)."""
    out = np.zeros(len(codes), bool)
    at = np.arange(len(codes))
    for j in range(PROBES):
        p = _probe(codes[at], len(bitmap) * 8, j)
        at = at[(bitmap[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
    out[at] = True
    return out


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """A bitmap of the column ``shingle``, at most ``MOST_BITS`` long (then with more false hits, never a missed one).

    Set bytes are put together by the executors; at most one number for each byte of the map comes here.
    """
    n = keys.agg(F.approx_count_distinct("shingle")).first()[0]
    bits = min(MOST_BITS, 1 << max(16, int(n * BITS_PER_KEY - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(0).to_numpy().astype(np.uint64)
            p = np.unique(np.concatenate([_probe(codes, bits, j) for j in range(PROBES)]))
            yield pa.RecordBatch.from_arrays([pa.array(p >> np.uint64(3), pa.int64()), pa.array(np.left_shift(1, (p & np.uint64(7)).astype(np.int64)), pa.int32())], names=["byte", "bit"])

    found = keys.select("shingle").mapInArrow(mark, "byte bigint, bit int").groupBy("byte").agg(F.expr("bit_or(bit)").alias("bit")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[found.column("byte").to_numpy()] = found.column("bit").to_numpy()
    return out


def near_enough(known: np.ndarray, reach: int, kept: int) -> np.ndarray:
    """Places inside some stretch of ``reach`` places that holds ``kept`` known ones."""
    n = len(known)
    if not n:
        return known
    upto = np.concatenate([[0], np.cumsum(known)])
    good = upto[np.minimum(np.arange(n) + reach, n)] - upto[:-1] >= kept
    edge = np.zeros(n + 1, np.int64)
    at = good.nonzero()[0]
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + reach, n), -1)
    return np.cumsum(edge[:-1]) > 0


def align_pairs(item: np.ndarray, doc: np.ndarray, window: np.ndarray, rule: LeakRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first document word, covered item words, edits) of the longest leak in each pair; covered is 0 where there is none.

    ``item`` is (b, n), ``doc`` (b, n + width), both padded with unequal numbers; width is that of the band
    of diagonals, and only cells of the band are looked at. For each number of edits every cell keeps the
    path that starts first in the item, so the longest stretch is found exactly.
    """
    b, n = item.shape
    width = doc.shape[1] - n
    layers = max(rule.edits(int(w)) for w in np.unique(window))
    never = np.int16(n + 1)
    limit = np.array([rule.edits(int(w)) for w in range(rule.min_words + 1)])[window][:, None]
    single = (window == 1)[:, None]
    head = np.where(single, 0, 1).astype(np.int16)
    none = np.full((b, width), never)
    start = [none] * (layers + 1)  # item words before the path
    at = [np.zeros((b, width), np.int16)] * (layers + 1)  # document words before it
    run = [none] * (layers + 1)  # start of the paths whose last step is a match
    before = np.zeros((b, width), bool)
    first, covered, edits = np.zeros(b, np.int64), np.zeros(b, np.int64), np.zeros(b, np.int64)
    diagonal = np.arange(width, dtype=np.int16)[None, :]

    def shifted(a: np.ndarray, by: int, fill: int) -> np.ndarray:
        out = np.full_like(a, fill)
        if by > 0:
            out[:, :-1] = a[:, 1:]
        else:
            out[:, 1:] = a[:, :-1]
        return out

    for i in range(n):
        match = item[:, i : i + 1] == doc[:, i : i + width]
        twice = match & before
        new, new_at, new_run = [], [], []
        less = np.full((b, width), never)
        for e in range(layers + 1):
            g, d = np.where(match, start[e], never), at[e]
            if e == 0:
                begin = (g == never) & np.where(single, match, twice)
                g, d = np.where(begin, np.int16(i) - head, g), np.where(begin, np.int16(i) - head + diagonal, d)
            new_run.append(g)
            # the path ends here: its last two steps are matches, and no path with fewer edits starts as early
            end = g if e == 0 else np.where(twice, run[e], never)
            span = np.where(end < less, i + 1 - end.astype(np.int32), 0)
            less = np.minimum(less, end)
            if span.max() > 0:
                hidden = np.maximum(0, window[:, None] - span)
                span = np.where((e + hidden <= limit) & (hidden <= 2 * e), span, 0)
                best = span.argmax(1)
                length = span[np.arange(b), best]
                up = length > covered
                covered[up], edits[up], first[up] = length[up], e, d[np.arange(b), best][up]
            if e:
                # changed, dropped, added
                for fs, fa in ((start[e - 1], at[e - 1]), (shifted(start[e - 1], 1, never), shifted(at[e - 1], 1, 0)), (shifted(new[e - 1], -1, never), shifted(new_at[e - 1], -1, 0))):
                    use = fs < g
                    g, d = np.where(use, fs, g), np.where(use, fa, d)
            new.append(g)
            new_at.append(d)
        start, at, run, before = new, new_at, new_run, match
    return first, covered, edits


def hold_enough(item: np.ndarray, doc: np.ndarray, rule: LeakRule) -> np.ndarray:
    """Pairs in whose band some window of the item has as many shingles as surely survive, each on any diagonal. For items of a whole window."""
    _, k, kept, _ = rule.shape(rule.min_words)
    n = item.shape[1]
    width = doc.shape[1] - n
    if n < rule.min_words:
        return np.ones(len(item), bool)
    same = np.lib.stride_tricks.sliding_window_view(doc, width, axis=1)[:, :n] == item[:, :, None]
    run = same[:, : n - k + 1]
    for j in range(1, k):
        run = run & same[:, j : n - k + 1 + j]
    upto = np.concatenate([np.zeros((len(item), 1), np.int64), np.cumsum(run.any(2), axis=1)], axis=1)
    size = min(rule.min_words - k + 1, n - k + 1)
    return (upto[:, size:] - upto[:, :-size]).max(1) >= kept


def find_leaks(documents: DataFrame, items: DataFrame, rule: LeakRule | None = None, text: str = "text", key: str = "doc_id", broadcast_rows: int = 500_000, salts: int = 32) -> DataFrame:
    """doc_id, item_id, first_word, covered_words, edits: one row for each document and item that leaked into it.

    ``covered_words`` and ``edits`` are of the longest stretch with as many edits as a window may have
    (seen through parts of ``BLOCK`` item words), first_word is its place in the document. Null, empty and
    wordless texts and passages leak nothing; passages under ``rule.min_words`` words, of one or two words
    too, must be held whole. Equal documents with the same key give one row, items with the same passage
    are all reported, repeated items once. No items or no documents: an empty result. Items and postings
    are broadcast up to ``broadcast_rows`` rows, else joined by shuffle.
    """
    rule = rule or LeakRule()
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    held, postings = item_postings(items, rule)
    windows = sorted(r[0] for r in held.select("window").distinct().collect())  # at most rule.min_words of them
    if not windows:
        return spark.createDataFrame([], f"{key} {kind}, item_id bigint, first_word int, covered_words int, edits int")
    shapes = [rule.shape(w) for w in windows]
    maps = spark.sparkContext.broadcast([tuple(bitmap_of(postings.where(c)) for c in (f"window = {w}", f"window = {w} and prefix")) for w in windows])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 2 << 20):
            codes, offsets = word_codes(pa.concat_arrays([b.column(2)]))
            places, keys = [], []
            for (w, k, kept, e), (every, prefix) in zip(shapes, maps.value):
                s, whole = shingles(codes, offsets, k)
                known = whole & _holds(every, s)
                if not known.any():
                    continue
                at = (known & near_enough(known, w - k + 1 + e, kept)).nonzero()[0]
                at = at[_holds(prefix, s[at])]
                places.append(at)
                keys.append(s[at])
            if not places or not sum(map(len, places)):
                continue
            place, code = np.concatenate(places), np.concatenate(keys)
            text_no = np.searchsorted(offsets, place, side="right") - 1
            order = np.argsort(text_no, kind="stable")
            place, code, text_no = place[order], code[order], text_no[order]
            have, n = np.unique(text_no, return_counts=True)
            words = np.concatenate([codes[offsets[i] : offsets[i + 1]] for i in have]).astype(np.int64)
            hit = pa.StructArray.from_arrays([pa.array(code.astype(np.int64)), pa.array(place - offsets[text_no], pa.int32())], names=["shingle", "at"])
            hits = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), hit)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(have)), b.column(1).take(pa.array(have)), _lists(words, np.diff(offsets)[have], pa.int64()), hits], names=[key, "doc_key", "words", "hits"])

    least = min(w - e for w, _, _, e in shapes)
    source = documents.where(F.length(text) >= 2 * least - 1).select(F.col(key), F.xxhash64(key, text).alias("doc_key"), F.col(text))
    probed = checkpointed(source.mapInArrow(probe, f"{key} {kind}, doc_key bigint, words array<bigint>, hits array<struct<shingle: bigint, at: int>>").dropDuplicates(["doc_key"]))

    hits = probed.select("doc_key", F.explode("hits").alias("h")).select("doc_key", "h.shingle", "h.at")
    prefixes = postings.where("prefix").select("shingle", "item_key", "window", "place")
    if prefixes.limit(broadcast_rows + 1).count() <= broadcast_rows:
        met = hits.join(F.broadcast(prefixes), "shingle")
    else:
        met = hits.withColumn("salt", F.pmod("doc_key", F.lit(salts)).cast("int")).join(prefixes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["shingle", "salt"])
    pairs = met.select("doc_key", "item_key", "window", F.expr(f"cast(floor((at - place) / {BAND}) as int)").alias("band"), F.expr(f"place div {BLOCK}").cast("int").alias("block")).distinct()
    # the part of the item around the hit, and the band of the document in which a window through it lies
    margin, drift = 2 * rule.min_words, rule.edits(rule.min_words)
    lo = F.greatest(F.lit(0), F.col("block") * BLOCK - margin)
    reach, width = BLOCK + 2 * margin, BAND + 2 * drift
    near = pairs.join(probed, "doc_key").withColumn("lo", lo).withColumn("from_word", (F.col("lo") + F.col("band") * BAND - drift).cast("int"))
    near = near.select(key, "doc_key", "item_key", "window", "lo", "from_word", F.slice("words", F.greatest(F.lit(0), F.col("from_word")) + 1, F.lit(reach + width)).alias("stretch"))
    parts = held.select("item_key", "item_id", F.col("words").alias("item_words"))
    parts = F.broadcast(parts) if parts.limit(broadcast_rows // 50 + 1).count() <= broadcast_rows // 50 else parts
    near = near.join(parts, "item_key").select(key, "doc_key", "item_id", "window", "from_word", F.slice("item_words", F.col("lo") + 1, F.lit(reach)).alias("part"), "stretch")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1 << 20):
            from_word = b.column("from_word").to_numpy().astype(np.int64)
            item = _padded(b.column("part"), 0)
            doc = _padded(b.column("stretch"), 1, np.maximum(0, -from_word), item.shape[1] + width)
            window = b.column("window").to_numpy().astype(np.int64)
            pick = ((window < rule.min_words) | hold_enough(item, doc, rule)).nonzero()[0]
            if not len(pick):
                continue
            first, covered, edits = align_pairs(item[pick], doc[pick], window[pick], rule)
            some = covered > 0
            leaked, first, covered, edits = pick[some], first[some], covered[some], edits[some]
            if len(leaked):
                t = pa.array(leaked)
                yield pa.RecordBatch.from_arrays(
                    [b.column(key).take(t), b.column("doc_key").take(t), b.column("item_id").take(t), pa.array(from_word[leaked] + first, pa.int32()), pa.array(covered, pa.int32()), pa.array(edits, pa.int32())],
                    names=[key, "doc_key", "item_id", "first_word", "covered_words", "edits"],
                )

    found = near.mapInArrow(verify, f"{key} {kind}, doc_key bigint, item_id bigint, first_word int, covered_words int, edits int")
    best = F.min(F.struct((-F.col("covered_words")).alias("c"), "edits", "first_word")).alias("b")
    return found.groupBy(key, "doc_key", "item_id").agg(best).select(key, "item_id", F.col("b.first_word").alias("first_word"), (-F.col("b.c")).alias("covered_words"), F.col("b.edits").alias("edits"))


def _padded(lists: pa.ListArray, pad: int, skip: np.ndarray | None = None, size: int = 0) -> np.ndarray:
    """Rows of equal length (``size``, else the longest), each behind ``skip`` pads, filled up with ``pad``."""
    lists = pa.concat_arrays([lists])
    offsets = lists.offsets.to_numpy()
    n = np.diff(offsets)
    skip = np.zeros(len(n), np.int64) if skip is None else skip
    out = np.full((len(n), size or max(1, int(n.max()) if len(n) else 1)), pad, np.int64)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], n) + skip[row]
    inside = place < out.shape[1]
    out[row[inside], place[inside]] = lists.values.to_numpy()[offsets[0] : offsets[-1]][inside]
    return out
