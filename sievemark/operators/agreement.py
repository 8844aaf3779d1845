"""Agreement of predictions with gold labels, between variants and between models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.contracts import ExtractionError
from sievemark.session import checkpointed


def binary_cells(df: DataFrame, gold: Column, pred: Column) -> DataFrame:
    """n, tp, fp, fn, tn; null counts as false."""
    g, p = F.coalesce(gold, F.lit(False)), F.coalesce(pred, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))


def binary_scores(cells: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1 (0 on a zero denominator), kappa (null when undefined) and both prevalences."""
    n = F.col("n")
    zero = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0)).cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    po = F.try_divide(tp + tn, n)
    pe = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), (n * n).cast("double"))
    return cells.select(
        *cells.columns, po.alias("accuracy"), zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"), F.try_divide(tp + fn, n).alias("gold_prevalence"), F.try_divide(tp + fp, n).alias("pred_prevalence"),
    )


def confusion(df: DataFrame, gold: str, pred: str, labels: list[str] | None = None) -> DataFrame:
    """gold, pred, n; with ``labels`` every pair of them, and pairs outside left out."""
    c = df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        return c
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "gold string, pred string")
    return grid.join(c, ["gold", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def class_scores(cells: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 of each label of a confusion table."""
    both = F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(True).alias("is_gold")), F.struct(F.col("pred").alias("label"), F.lit(False).alias("is_gold"))))
    long = cells.select("gold", "pred", "n", both.alias("x")).select("x.label", "x.is_gold", "n", (F.col("gold") == F.col("pred")).alias("hit"))
    s = long.groupBy("label").agg(F.coalesce(F.sum(F.when(F.col("is_gold"), F.col("n"))), F.lit(0)).alias("support"), F.coalesce(F.sum(F.when(~F.col("is_gold"), F.col("n"))), F.lit(0)).alias("predicted"), F.coalesce(F.sum(F.when(F.col("is_gold") & F.col("hit"), F.col("n"))), F.lit(0)).alias("tp"))
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), F.nullif(b, F.lit(0).cast("bigint"))), F.lit(0.0))
    return s.where("label is not null").select("label", "support", zero(F.col("tp"), F.col("predicted")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"), zero(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"))


def macro_f1(cells: DataFrame) -> DataFrame:
    return class_scores(cells).agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_labels"))


def cohens_kappa(cells: DataFrame) -> DataFrame:
    """n, agreement and kappa of a confusion table; kappa is null when chance agreement is 1."""
    c = cells.where("gold is not null and pred is not null")
    g, p = c.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("g")), c.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("p"))
    chance = g.join(p, "label").agg(F.coalesce(F.sum((F.col("g") * F.col("p")).cast("double")), F.lit(0.0)).alias("gp"))
    t = c.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n"))), F.lit(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("gp") / (F.col("n") * F.col("n"))
    return t.crossJoin(chance).select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))  # one row by one row


def gold_overlap(sample: DataFrame, gold: DataFrame, minimum: float = 0.9, strict: bool = False) -> DataFrame:
    """n_sample, n_overlap, overlap; with ``strict`` an overlap under the minimum raises."""
    out = sample.select("doc_id").distinct().join(gold.select("doc_id").distinct().withColumn("_g", F.lit(1)), "doc_id", "left").agg(F.count(F.lit(1)).alias("n_sample"), F.count("_g").alias("n_overlap")).withColumn("overlap", F.try_divide("n_overlap", "n_sample"))
    if strict:
        r = out.first()
        if (r["overlap"] or 0) < minimum:
            raise ExtractionError(f"only {r['n_overlap']} of {r['n_sample']} sampled rows have labels")
    return out


def gold_aligned(sample: DataFrame, gold: DataFrame, coder: int = 0) -> DataFrame:
    """doc_id, gold_present and gold_role of one coder for every sampled row; rows without label are false and none."""
    g = gold.where(F.col("annotator") == coder).groupBy("doc_id").agg(F.max("technology_present").alias("p"), F.max("failure_role").alias("r"))
    return sample.select("doc_id").join(g, "doc_id", "left").select("doc_id", F.coalesce("p", F.lit(False)).alias("gold_present"), F.coalesce("r", F.lit("none")).alias("gold_role"))


def variant_prevalence(df: DataFrame, variants: list[str]) -> DataFrame:
    """variant, n, prevalence of boolean columns, in one pass."""
    x = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.coalesce(F.col(v), F.lit(False)).alias("y")) for v in variants]))
    return df.select(x.alias("x")).groupBy("x.variant").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x.y").cast("double")).alias("prevalence"))


def variant_pairs(df: DataFrame, variants: list[str]) -> DataFrame:
    """variant_a, variant_b, agreement and kappa of each pair, from four counts a pair in one pass."""
    pairs = [(a, b) for i, a in enumerate(variants) for b in variants[i + 1 :]]
    v = lambda c: F.coalesce(F.col(c), F.lit(False))
    x = F.explode(F.array(*[F.struct(F.lit(a).alias("variant_a"), F.lit(b).alias("variant_b"), v(a).alias("g"), v(b).alias("p")) for a, b in pairs]))
    cells = df.select(x.alias("x")).groupBy("x.variant_a", "x.variant_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x.g") & F.col("x.p")).alias("tp"), F.count_if(~F.col("x.g") & F.col("x.p")).alias("fp"), F.count_if(F.col("x.g") & ~F.col("x.p")).alias("fn"), F.count_if(~F.col("x.g") & ~F.col("x.p")).alias("tn"))
    return binary_scores(cells).select("variant_a", "variant_b", F.col("accuracy").alias("agreement"), "kappa")


def prompt_sensitivity(df: DataFrame, variants: list[str]) -> DataFrame:
    """min, max and spread of prevalence and the mean agreement of all pairs, in one pass over the rows."""
    if len(variants) < 2:
        raise ExtractionError("two variants are needed")
    v = lambda c: F.coalesce(F.col(c), F.lit(False))
    means = df.agg(*[F.avg(v(c).cast("double")).alias(c) for c in variants], *[F.avg((v(a) == v(b)).cast("double")).alias(f"{a}~{b}") for i, a in enumerate(variants) for b in variants[i + 1 :]])
    low, high = F.least(*variants), F.greatest(*variants)
    agree = [F.col(f"`{a}~{b}`") for i, a in enumerate(variants) for b in variants[i + 1 :]]
    return means.select(low.alias("min_prevalence"), high.alias("max_prevalence"), (high - low).alias("prevalence_spread"), (sum(agree[1:], agree[0]) / len(agree)).alias("mean_agreement"))


def facility_rates(df: DataFrame, a: str, b: str, facility: str = "ccn", minimum: int = 5) -> DataFrame:
    y = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    return df.groupBy(facility).agg(F.count(F.lit(1)).alias("n"), y(a).alias("rate_a"), y(b).alias("rate_b")).where(F.col("n") >= minimum).where(F.col(facility).isNotNull())


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """n and rho with midranks; null for under two rows or a constant column.

    Ranks come from cumulative counts of the distinct values. These are partitioned by range, so every part
    is ordered by itself; only the parts' totals are brought together.
    """

    def ranked(c: str) -> DataFrame:
        v = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
        parts = checkpointed(v.repartitionByRange("_v").withColumn("_p", F.spark_partition_id()))
        total = parts.groupBy("_p").agg(F.sum("_k").alias("_t"))
        before = F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each part
        inside = F.coalesce(F.sum("_k").over(Window.partitionBy("_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = parts.withColumn("_i", inside).join(F.broadcast(total.select("_p", before.alias("_b"))), "_p")
        return placed.select("_v", (F.col("_b") + F.col("_i") + (F.col("_k") + 1) / 2).alias(f"_r_{c}"))

    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x), F.col(y))
    rx, ry = ranked(x), ranked(y)
    r = base.join(rx, base[x] == rx["_v"]).drop("_v").join(ry, base[y] == ry["_v"]).drop("_v")
    spread = F.nullif(F.stddev_pop(f"_r_{x}") * F.stddev_pop(f"_r_{y}"), F.lit(0.0))
    return r.agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 2, F.try_divide(F.covar_pop(f"_r_{x}", f"_r_{y}"), spread)).alias("rho"))


def self_consistency(first: DataFrame, second: DataFrame, fields: list[str]) -> DataFrame:
    """n and the share of rows where each field is equal in two runs (null equals null)."""
    s = second.select("doc_id", *[F.col(f).alias(f"{f}_2") for f in fields])
    return first.select("doc_id", *fields).join(s, "doc_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f).eqNullSafe(F.col(f"{f}_2")).cast("double")).alias(f) for f in fields])


def sensitivity_specificity(cells: DataFrame) -> DataFrame:
    return cells.select("*", F.try_divide("tp", F.nullif(F.col("tp") + F.col("fn"), F.lit(0).cast("bigint"))).alias("sensitivity"), F.try_divide("tn", F.nullif(F.col("tn") + F.col("fp"), F.lit(0).cast("bigint"))).alias("specificity"))


def bootstrap_cells(cells: dict[str, int], statistic: Callable[[dict[str, int]], float | None], n_boot: int = 1000, seed: int = 0, alpha: float = 0.05) -> dict:
    """Percentile interval of a statistic of confusion counts; undefined draws are skipped and counted."""
    names = sorted(cells)
    n = np.array([cells[k] for k in names])
    total = int(n.sum())
    point = statistic(cells)
    draws, skipped = [], 0
    if total:
        for d in np.random.default_rng(seed).multinomial(total, n / total, size=n_boot):
            v = statistic(dict(zip(names, d.tolist())))
            if v is None or not np.isfinite(v):
                skipped += 1
            else:
                draws.append(v)
    lo, hi = np.percentile(draws, [100 * alpha / 2, 100 * (1 - alpha / 2)]) if draws else (None, None)
    return {"point": point, "lo": None if lo is None else float(lo), "hi": None if hi is None else float(hi), "n_boot": n_boot, "skipped": skipped}


def f1_of(c: dict[str, int]) -> float:
    d = 2 * c["tp"] + c["fp"] + c["fn"]
    return 2 * c["tp"] / d if d else 0.0


def kappa_of(c: dict[str, int]) -> float | None:
    n = sum(c[k] for k in ("tp", "fp", "fn", "tn"))
    if not n:
        return None
    pe = ((c["tp"] + c["fp"]) * (c["tp"] + c["fn"]) + (c["fn"] + c["tn"]) * (c["fp"] + c["tn"])) / n**2
    return None if pe >= 1 else ((c["tp"] + c["tn"]) / n - pe) / (1 - pe)
