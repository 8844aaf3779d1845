"""Consensus of several annotators: confidence-aware truth discovery.

An annotator's error variance is known the less the fewer labels there are, so the weight is not one
over the observed variance but the lower chi-squared quantile over the summed squared label distances
(the upper bound of the variance's confidence interval). Truth and weights are found in turn: labels by
weighted vote, which minimises the weighted 0/1 distance, weights from the distances to these labels,
until the weights rest.

The votes of an item are one array, written once; a step is a map over these arrays that hands in sums by
annotator. Where an item has very many votes, or there are very many annotators, votes stay in long form
and weights in a table: partial sums by item and label, then by annotator, and nothing but the largest
change of a weight comes to the driver. Both ways do the same arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.contracts import FAILURE_ROLES, TECHNOLOGY_TYPES
from sievemark.session import checkpointed

FIELDS = {"technology_present": ("true", "false"), "technology_type": tuple(TECHNOLOGY_TYPES), "failure_role": tuple(FAILURE_ROLES)}
LABELS = {k: sorted(v) for k, v in FIELDS.items()}  #: a label's number is its place by name
NEAR = 1e-9  #: weights this close are equal


@lru_cache(maxsize=100_000)
def chi2_quantile(p: float, k: int) -> float:
    """Quantile of the chi-squared distribution with k degrees of freedom: Newton steps on the incomplete gamma series, kept inside a bracket."""
    a = k / 2

    def below(x: float) -> tuple[float, float]:
        """(share below x, density at x)."""
        h = x / 2
        if h <= 0:
            return 0.0, 0.0
        scale = math.exp(-h + a * math.log(h) - math.lgamma(a))
        if h > a + 12 * math.sqrt(a) + 20:
            return 1.0, scale / x
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= h / n
            total += term
        return min(1.0, total * scale), scale / x

    low, high = 0.0, float(k) + 1
    while below(high)[0] < p:
        low, high = high, high * 2
    x = (low + high) / 2
    for _ in range(200):
        share, density = below(x)
        low, high = (x, high) if share < p else (low, x)
        new = x - (share - p) / density if density > 0 else low
        new = new if low < new < high else (low + high) / 2
        if abs(new - x) <= 1e-12 * x or high - low <= 1e-12 * high:
            return new
        x = new
    return x


def canonical_label(c: Column) -> Column:
    """Lower case, trimmed, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")), r"(?U)[\s-]+", "_")


def latest_votes(annotations: DataFrame) -> DataFrame:
    """doc_id, annotator and the number of the label in each field (null: no vote): the latest row of each annotator and item.

    Rows without doc_id or annotator are no votes. Of rows with the same time the greatest labels
    count, so repeats change nothing; a row without time is older than any other. A null label or one
    outside the vocabulary is no vote in its field.
    """
    a = annotations.where("doc_id is not null and annotator is not null")
    labels = []
    for k, names in LABELS.items():
        place = F.array_position(F.array(*[F.lit(x) for x in names]), canonical_label(F.col(k))) - 1
        labels.append(F.when(place >= 0, place).cast("int").alias(k))
    last = a.groupBy("doc_id", "annotator").agg(F.max(F.struct("labelled_at", *labels)).alias("v"))
    return last.select("doc_id", "annotator", *[F.col("v")[k].alias(k) for k in FIELDS])


def _weight(alpha: float, n: np.ndarray, errors: np.ndarray, floor: float) -> np.ndarray:
    quantile = np.array([max(chi2_quantile(alpha / 2, int(x)), 1e-4) for x in n])
    return quantile / (errors + 0.5 + floor * n)


def _tally(item: np.ndarray, label: np.ndarray, weight: np.ndarray, items: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(items, labels) weight and number of votes."""
    at = item * size + label
    return np.round(np.bincount(at, weight, items * size), 9).reshape(items, size), np.bincount(at, minlength=items * size).reshape(items, size)


def _winners(w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The heaviest label of each item; equal weights: more votes, then the first by name."""
    top = w >= w.max(1, keepdims=True) - NEAR / 2  # both are rounded
    top &= n > 0
    votes = np.where(top, n, -1)
    return (top & (votes == votes.max(1, keepdims=True))).argmax(1)


def _distances(item: np.ndarray, label: np.ndarray, weight: np.ndarray, items: int, size: int, others: bool) -> np.ndarray:
    """Distance of every vote to the consensus (of the others, or of all)."""
    w, n = _tally(item, label, weight, items, size)
    if not others:
        return (label != _winners(w, n)[item]).astype(float)
    ranked = np.sort(w, axis=1)
    own = w[item, label]
    rival = np.where(own >= ranked[item, -1], ranked[item, -2], ranked[item, -1])
    rest = own - weight
    return np.where(np.abs(rest - rival) < NEAR, 0.5, np.where(rest > rival, 0.0, 1.0))


class _Arrays:
    """Votes as one array for each item; weights on the driver, an array for each field."""

    def __init__(self, votes: DataFrame, min_annotators: int, alpha: float, names: list) -> None:
        self.alpha, self.kind = alpha, votes.schema["annotator"].dataType
        grouped = votes.groupBy("doc_id").agg(F.collect_list(F.struct("annotator", *FIELDS)).alias("votes")).where(F.size("votes") >= min_annotators)
        self.items = checkpointed(grouped)
        self.names = names
        self.annotators = pa.array(self.names)
        self.weights = {k: np.ones(len(self.names)) for k in FIELDS}
        self.n = {k: np.zeros(len(self.names)) for k in FIELDS}
        self.errors = dict(self.n)

    @staticmethod
    def _open(b: pa.RecordBatch, annotators: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        lists = pa.concat_arrays([b.column("votes")])
        flat = lists.flatten()
        who = pc.index_in(flat.field("annotator"), annotators.cast(flat.field("annotator").type)).to_numpy(zero_copy_only=False).astype(np.int64)
        return pc.list_parent_indices(lists).to_numpy().astype(np.int64), who, {k: pc.fill_null(flat.field(k), -1).to_numpy().astype(np.int64) for k in FIELDS}

    def step(self, others: bool, floor: float) -> float:
        """New weights; the largest relative change of one."""
        weights, annotators, opened = self.weights, self.annotators, self._open

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros((2, len(annotators))) for k in FIELDS}
            for b in batches:
                item, who, labels = opened(b, annotators)
                for k in FIELDS:
                    cast = labels[k] >= 0
                    i, a, label = item[cast], who[cast], labels[k][cast]
                    d = _distances(i, label, weights[k][a], b.num_rows, len(LABELS[k]), others)
                    total[k] += np.stack([np.bincount(a, minlength=len(annotators)), np.bincount(a, d, len(annotators))])
            for f, k in enumerate(FIELDS):
                a = total[k][0].nonzero()[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), f), pa.int32()), pa.array(a, pa.int64()), pa.array(total[k][0][a]), pa.array(total[k][1][a])], names=["f", "a", "n", "e"])

        sums = self.items.mapInArrow(run, "f int, a bigint, n double, e double").groupBy("f", "a").agg(F.sum("n").alias("n"), F.sum("e").alias("e")).toArrow()
        f, a, n, e = (sums.column(x).to_numpy() for x in ("f", "a", "n", "e"))
        moved = 0.0
        for j, k in enumerate(FIELDS):
            m = f == j
            self.n[k], self.errors[k] = np.zeros(len(self.names)), np.zeros(len(self.names))
            self.n[k][a[m]], self.errors[k][a[m]] = n[m], e[m]
            if m.any():
                w = np.ones(len(self.names))
                w[a[m]] = _weight(self.alpha, n[m], e[m], floor)
                w[a[m]] /= w[a[m]].mean()
                moved = max(moved, float(np.abs(w / self.weights[k] - 1)[a[m]].max()))
                self.weights = self.weights | {k: w}
        return moved

    def consensus(self) -> DataFrame:
        weights, annotators, opened = self.weights, self.annotators, self._open

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                item, who, labels = opened(b, annotators)
                for k, names in LABELS.items():
                    cast = labels[k] >= 0
                    w, n = _tally(item[cast], labels[k][cast], weights[k][who[cast]], b.num_rows, len(names))
                    voted = (n.sum(1) > 0).nonzero()[0]
                    w, n = w[voted], n[voted]
                    top, votes = _winners(w, n) if len(voted) else np.zeros(0, np.int64), n.sum(1)
                    pairs = votes * (votes - 1)
                    agreement = pa.array((n * (n - 1)).sum(1) / np.maximum(1, pairs), mask=pairs == 0)
                    columns = [b.column(0).take(pa.array(voted)), pa.array([k] * len(voted), pa.string()), pa.array(names, pa.string()).take(pa.array(top)), pa.array(votes, pa.int64()), pa.array(w[np.arange(len(w)), top] / w.sum(1)), agreement]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "field_name", "label", "n_votes", "support", "agreement"])

        kind = self.items.schema["doc_id"].dataType.simpleString()
        return self.items.mapInArrow(run, f"doc_id {kind}, field_name string, label string, n_votes bigint, support double, agreement double")

    def reliability(self) -> DataFrame:
        rows = [(k, self.names[a], int(self.n[k][a]), float(self.errors[k][a] / self.n[k][a]), float(self.weights[k][a])) for k in FIELDS for a in self.n[k].nonzero()[0]]
        return self.items.sparkSession.createDataFrame(rows, f"field_name string, annotator {self.kind.simpleString()}, n_labels bigint, error_rate double, weight double")


class _Table:
    """Votes in long form, weights as a table; for items with very many votes or very many annotators."""

    def __init__(self, votes: DataFrame, min_annotators: int, alpha: float, _names: list) -> None:
        self.alpha = alpha
        enough = votes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_annotators).select("doc_id")
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("field_name"), F.col(k).alias("code")) for k in FIELDS]))
        self.votes = checkpointed(votes.join(enough, "doc_id", "left_semi").select("doc_id", "annotator", pairs.alias("p")).select("doc_id", "p.field_name", "annotator", "p.code").where("code is not null"))
        self.weights = checkpointed(self.votes.groupBy("field_name", "annotator").agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("e", F.lit(0.0)).withColumn("w", F.lit(1.0)))

    def _ranked(self, weighted: DataFrame) -> DataFrame:
        """The labels of each item, heaviest first; there are never more of them than the vocabulary has."""
        by_label = weighted.groupBy("doc_id", "field_name", "code").agg(F.round(F.sum("w"), 9).alias("w"), F.count(F.lit(1)).alias("n"))
        return by_label.groupBy("doc_id", "field_name").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), (-F.col("n")).alias("n"), "code"))).alias("labels"))

    def step(self, others: bool, floor: float) -> float:
        v = self.votes.join(self.weights.select("field_name", "annotator", "w"), ["field_name", "annotator"])
        top, second = F.col("labels")[0], F.get("labels", F.lit(1))
        mine = -F.filter("labels", lambda x: x["code"] == F.col("code"))[0]["w"]
        if others:
            rest, rival = mine - F.col("w"), F.when(mine >= -top["w"], F.coalesce(-second["w"], F.lit(0.0))).otherwise(-top["w"])
            distance = F.when(F.abs(rest - rival) < NEAR, 0.5).when(rest > rival, 0.0).otherwise(1.0)
        else:
            distance = (F.col("code") != top["code"]).cast("double")
        sums = v.join(self._ranked(v), ["doc_id", "field_name"]).groupBy("field_name", "annotator").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(distance).alias("e"))
        alpha = self.alpha

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_weight(alpha, b.column("n").to_numpy(), b.column("e").to_numpy(), floor))], names=[*b.schema.names, "raw"])

        raw = sums.mapInArrow(run, sums.schema.simpleString()[7:-1].replace(":", " ") + ", raw double")
        mean = raw.groupBy("field_name").agg(F.avg("raw").alias("m"))
        new = checkpointed(raw.join(F.broadcast(mean), "field_name").select("field_name", "annotator", "n", "e", (F.col("raw") / F.col("m")).alias("w")))  # one mean for each field
        moved = new.join(self.weights.select("field_name", "annotator", F.col("w").alias("old")), ["field_name", "annotator"]).agg(F.max(F.abs(F.col("w") / F.col("old") - 1))).first()[0]
        self.weights = new
        return moved or 0.0

    def consensus(self) -> DataFrame:
        add = lambda f: F.aggregate("labels", F.lit(0.0), lambda s, x: s + f(x))
        ranked = self._ranked(self.votes.join(self.weights.select("field_name", "annotator", "w"), ["field_name", "annotator"]))
        t = ranked.select("doc_id", "field_name", F.col("labels")[0].alias("top"), add(lambda x: -x["w"]).alias("all_w"), add(lambda x: -x["n"].cast("double")).alias("n"), add(lambda x: (x["n"] * (x["n"] + 1)).cast("double")).alias("same"))
        pairs = F.col("n") * (F.col("n") - 1)
        name = F.element_at(F.element_at(F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))]), F.col("field_name")), F.col("top.code") + 1)
        return t.select("doc_id", "field_name", name.alias("label"), F.col("n").cast("bigint").alias("n_votes"), (-F.col("top.w") / F.col("all_w")).alias("support"), F.when(pairs > 0, F.try_divide(F.col("same"), pairs)).alias("agreement"))

    def reliability(self) -> DataFrame:
        return self.weights.select("field_name", "annotator", F.col("n").cast("bigint").alias("n_labels"), (F.col("e") / F.col("n")).alias("error_rate"), F.col("w").alias("weight"))


def annotator_consensus(
    annotations: DataFrame, min_annotators: int = 3, alpha: float = 0.05, tolerance: float = 0.01, most_steps: int = 30, prior_error: float = 0.08, most_annotators: int = 200_000, most_votes: int = 100_000
) -> tuple[DataFrame, DataFrame]:
    """(consensus, reliability) of the items with at least ``min_annotators`` different annotators.

    First an annotator's distance is taken to the consensus of the *others* on each item, so that no one
    confirms their own weight, until no weight changes by more than ``tolerance``; then to the consensus
    itself, with ``prior_error`` added to every error rate, so that no one becomes infallible. Each part
    ends after ``most_steps`` at the latest (weights can swing between equal votes).

    consensus: doc_id, field_name, label, n_votes, support (weighted share of the label) and agreement
    (share of pairs of annotators with the same label; null with one vote). Ties go to the label with
    more votes, then to the first by name. reliability: field_name, annotator, n_labels, error_rate,
    weight (mean 1 over a field's annotators). Arrays by item are used while no item has more than
    ``most_votes`` votes and there are at most ``most_annotators``, else tables; the results are the same.
    No votes: two empty tables.
    """
    votes = checkpointed(latest_votes(annotations))
    size = votes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    names = sorted(r[0] for r in votes.select("annotator").distinct().limit(most_annotators + 1).collect())
    few = size <= most_votes and len(names) <= most_annotators
    state = (_Arrays if few else _Table)(votes, min_annotators, alpha, names)
    for others, floor in ((True, 0.0), (False, prior_error)):
        for _ in range(most_steps):
            if state.step(others, floor) <= tolerance:
                break
    return state.consensus(), state.reliability()
