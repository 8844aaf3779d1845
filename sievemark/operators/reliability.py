"""Coder reliability from long tables (unit, coder, value); a matrix is never built."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievemark.contracts import AnalysisError

MOST_VALUES = 1000  #: different values of a code, whose pairs are looked at
METRICS = ("nominal", "ordinal", "interval", "ratio")


def first_codes(codes: DataFrame, order: str | None = None) -> DataFrame:
    """One value for each unit and coder: the last by ``order`` (then the greatest); null values are missing codes."""
    c = codes.where("value is not null")
    pick = F.max(F.struct(order, "value"))["value"] if order else F.max("value")
    return c.groupBy("unit", "coder").agg(pick.alias("value"))


def coder_matrix(codes: DataFrame, most_coders: int = 1000) -> DataFrame:
    """unit and one column for each coder (its name as text) with their code, null where they gave none. Units are rows, as they are many."""
    coders = sorted(r[0] for r in codes.select(F.col("coder").cast("string")).distinct().limit(most_coders + 1).collect())
    if len(coders) > most_coders:
        raise AnalysisError(f"more than {most_coders} coders; keep the long form")
    return codes.withColumn("coder", F.col("coder").cast("string")).groupBy("unit").pivot("coder", coders).agg(F.max("value"))


def value_counts(codes: DataFrame) -> DataFrame:
    """unit, value, n and m (codes of the unit), units with a single code left out."""
    n = codes.groupBy("unit", "value").agg(F.count(F.lit(1)).alias("n"))
    m = codes.groupBy("unit").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return n.join(m, "unit")


def coincidences(codes: DataFrame) -> DataFrame:
    """value_a, value_b, o: the coincidence of each pair of values, o = sum over units of n_a (n_b - [a = b]) / (m - 1).

    The join is of a unit's value *counts*, at most one row for each value of the vocabulary, not of its coders.
    """
    v = value_counts(codes)
    a = v.select("unit", F.col("value").alias("value_a"), F.col("n").alias("n_a"), "m")
    b = v.select("unit", F.col("value").alias("value_b"), F.col("n").alias("n_b"))
    same = (F.col("value_a") == F.col("value_b")).cast("int")
    return a.join(b, "unit").groupBy("value_a", "value_b").agg(F.sum(F.col("n_a") * (F.col("n_b") - same) / (F.col("m") - 1)).alias("o"))


def with_distance(o: DataFrame, metric: str = "nominal") -> DataFrame:
    """Adds the marginals n_a, n_b, the total and the squared difference of each pair of values."""
    if metric not in METRICS:
        raise AnalysisError(f"unknown metric {metric}")
    m = o.groupBy("value_a").agg(F.sum("o").alias("marginal"))
    upto = F.sum("marginal").over(Window.orderBy("value_a"))  # one row for each value of the vocabulary
    m = m.withColumn("upto", upto).withColumn("total", F.sum("marginal").over(Window.partitionBy()))
    a = m.select("value_a", F.col("marginal").alias("n_a"), F.col("upto").alias("u_a"), "total")
    b = m.select(F.col("value_a").alias("value_b"), F.col("marginal").alias("n_b"), F.col("upto").alias("u_b"))
    # pairs that never coincide still count in the expected disagreement: complete the value pairs
    if m.limit(MOST_VALUES + 1).count() > MOST_VALUES:
        raise AnalysisError(f"more than {MOST_VALUES} different values; use categories")
    pairs = a.crossJoin(F.broadcast(b))  # at most MOST_VALUES rows on each side
    p = pairs.join(o, ["value_a", "value_b"], "left").withColumn("o", F.coalesce("o", F.lit(0.0)))
    equal = F.col("value_a") == F.col("value_b")
    if metric == "nominal":
        d = F.when(equal, 0.0).otherwise(1.0)
    elif metric == "ordinal":
        low, high = F.least("u_a", "u_b"), F.greatest("u_a", "u_b")
        first_n = F.when(F.col("u_a") <= F.col("u_b"), F.col("n_a")).otherwise(F.col("n_b"))
        between = high - low + first_n - (F.col("n_a") + F.col("n_b")) / 2
        d = F.when(equal, 0.0).otherwise(between * between)
    elif metric == "interval":
        d = F.pow(F.col("value_a").cast("double") - F.col("value_b").cast("double"), 2)
    else:
        s = F.col("value_a").cast("double") + F.col("value_b").cast("double")
        d = F.coalesce(F.pow(F.try_divide(F.col("value_a").cast("double") - F.col("value_b").cast("double"), s), 2), F.lit(0.0))
    return p.withColumn("d", d)


def alpha_terms(codes: DataFrame, metric: str = "nominal") -> DataFrame:
    """One row: n_values, total, observed and expected disagreement, alpha (1 when only one value occurs, null without pairable codes)."""
    p = with_distance(coincidences(codes), metric)
    same = (F.col("value_a") == F.col("value_b")).cast("int")
    t = p.agg(
        F.countDistinct("value_a").alias("n_values"), F.max("total").alias("total"), F.sum(F.col("o") * F.col("d")).alias("observed"),
        (F.sum((F.col("n_a") * F.col("n_b") - same * F.col("n_a")) * F.col("d"))).alias("_e"),
    )
    t = t.withColumn("expected", F.try_divide("_e", F.col("total") - 1)).drop("_e")
    alpha = F.when(F.coalesce(F.col("total"), F.lit(0.0)) <= 1, F.lit(None)).when(F.col("n_values") == 1, 1.0).when(F.col("expected") == 0, F.when(F.col("observed") == 0, 1.0).otherwise(float("-inf"))).otherwise(1 - F.try_divide("observed", "expected"))
    return t.withColumn("alpha", alpha.cast("double"))


def alpha_by_category(codes: DataFrame, categories: list[str]) -> DataFrame:
    """category, alpha of each category against all others, for all of them in one pass."""
    c = codes.select("unit", "coder", F.explode(F.array(*[F.struct(F.lit(k).alias("category"), (F.col("value") == k).cast("int").alias("value")) for k in categories])).alias("x"))
    n = c.groupBy("x.category", "unit").agg(F.count(F.lit(1)).alias("m"), F.sum("x.value").alias("k")).where("m > 1")
    t = n.groupBy("category").agg(F.sum("m").cast("double").alias("total"), F.sum("k").cast("double").alias("n1"), F.sum(2 * F.col("k") * (F.col("m") - F.col("k")) / (F.col("m") - 1)).alias("observed"))
    n0 = F.col("total") - F.col("n1")
    expected = 2 * F.col("n1") * n0 / (F.col("total") - 1)
    return t.select("category", F.when(F.col("total") <= 1, None).when((F.col("n1") == 0) | (n0 == 0), 1.0).otherwise(1 - F.try_divide(F.col("observed"), expected)).alias("alpha"))


def pair_decomposition(codes: DataFrame, metric: str = "nominal") -> DataFrame:
    """weight, d, n_pairs: the unordered pairs of codes by weight 1 / (m - 1) and squared difference; alpha = 1 - 2 sum(n w d) / expected.

    Pairs are counted from value counts, never listed.
    """
    v = value_counts(codes)
    d = with_distance(coincidences(codes), metric).select("value_a", "value_b", "d")
    a, b = v.select("unit", "m", F.col("value").alias("value_a"), F.col("n").alias("n_a")), v.select("unit", F.col("value").alias("value_b"), F.col("n").alias("n_b"))
    pairs = a.join(b, "unit").where("value_a <= value_b")
    n = F.when(F.col("value_a") == F.col("value_b"), F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise((F.col("n_a") * F.col("n_b")).cast("double"))
    return pairs.withColumn("n", n).where("n > 0").join(F.broadcast(d), ["value_a", "value_b"]).groupBy((1 / (F.col("m") - 1)).alias("weight"), "d").agg(F.sum("n").alias("n_pairs"))


def alpha_bootstrap(codes: DataFrame, metric: str = "nominal", n_boot: int = 10_000, alpha_min: float = 0.8, seed: int = 0, ladder: tuple[float, ...] = ()) -> dict:
    """Point alpha, percentile interval, q (share of draws under ``alpha_min``) and q_ladder (the same for each step of ``ladder``).

    Pairs are resampled with the expected disagreement fixed. Draws are multinomial over the distinct
    (weight, difference) combinations, which hold all that matters; few come to the driver.
    """
    t = alpha_terms(codes, metric).first()
    if t["alpha"] is None:
        raise AnalysisError("no pairable codes")
    if not t["expected"]:
        return {"point": t["alpha"], "lo": None, "hi": None, "q": None, "degenerate": True, "n_pairs": 0}
    rows = pair_decomposition(codes, metric).collect()
    n = np.array([r["n_pairs"] for r in rows])
    wd = np.array([r["weight"] * r["d"] for r in rows])
    total = int(round(n.sum()))
    draws = np.random.default_rng(seed).multinomial(total, n / n.sum(), size=n_boot) @ wd
    alphas = 1 - 2 * draws / t["expected"]
    lo, hi = np.percentile(alphas, [2.5, 97.5])
    return {"point": t["alpha"], "lo": float(lo), "hi": float(hi), "q": float((alphas < alpha_min).mean()), "q_ladder": {f"{x:g}": float((alphas < x).mean()) for x in ladder}, "degenerate": False, "n_pairs": total}
