"""Estimators: standardising, fixed effects, logistic regression, corrected prevalence, and their bootstraps.

Rows are reduced to sums (per facility, per covariate pattern or per cell) by one aggregation; only
these sums, or a p by p system, reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.contracts import AnalysisError
from sievemark.functions.hashing import poisson_weights
from sievemark.session import checkpointed


def numeric(c: str) -> Column:
    """A covariate as double; what is no number counts as 0."""
    return F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))


def standardise(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """Adds standardised columns with the population deviation (1 where it is 0)."""
    m = df.agg(*[F.avg(numeric(c)).alias(f"m_{c}") for c in columns], *[F.stddev_pop(numeric(c)).alias(f"s_{c}") for c in columns]).first()
    z = {}
    for c in columns:
        mean, sd = m[f"m_{c}"] or 0.0, m[f"s_{c}"] or 0.0
        z[c + suffix] = (numeric(c) - F.lit(float(mean))) / F.lit(float(sd) if sd else 1.0)
    return df.withColumns(z)


def group_moments(df: DataFrame, y: str, xs: list[str], group: list[str]) -> DataFrame:
    """n and sums of y, x, x x' and x y of each group: all a within estimator needs."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy")]
    aggs += [F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)]
    aggs += [F.sum(F.col(x) * F.col(y)).alias(f"xy{i}") for i, x in enumerate(xs)]
    aggs += [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"xx{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]
    return df.groupBy(*group).agg(*aggs)


def within_system(moments: DataFrame, p: int, by: list[str] | None = None) -> DataFrame:
    """Within sums over groups: a{i}_{j} = sum(xx - n x̄x̄'), b{i} = sum(xy - n x̄ȳ), n, n_groups."""
    aggs = [F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_groups")]
    aggs += [F.sum(F.col(f"xx{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)]
    aggs += [F.sum(F.col(f"xy{i}") - F.col(f"s{i}") * F.col("sy") / F.col("n")).alias(f"b{i}") for i in range(p)]
    return moments.groupBy(*(by or [])).agg(*aggs)


def solve_within(row: dict, p: int) -> list[float | None]:
    """Coefficients by minimum norm; one without variation inside any group is not identified and null (D6)."""
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(p)] for i in range(p)])
    b = np.array([row[f"b{i}"] or 0.0 for i in range(p)])
    live = np.diag(a) > 1e-9 * max(1.0, float(np.abs(a).max()))
    out: list[float | None] = [None] * p
    if live.any():
        beta = np.linalg.pinv(a[np.ix_(live, live)]) @ b[live]
        for i, v in zip(np.flatnonzero(live), beta):
            out[int(i)] = float(v)
    return out


def fe_slope(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """The one-covariate fixed-effects slope as a plan: n, n_groups, beta (null when not identified)."""
    s = within_system(group_moments(df.where(F.col(group).isNotNull()), y, [x], [group]), 1)
    return s.select("n", "n_groups", F.try_divide("b0", F.nullif(F.col("a0_0"), F.lit(0.0))).alias("beta"))


def equity_model(frame: DataFrame, covariates: list[str], outcome: Column, facility: str = "ccn", gate: dict | None = None, n_boot: int = 500, seed: int = 0) -> DataFrame:
    """covariate, beta, lo, hi, significant, status of a facility fixed-effects model on the technology rows.

    Covariates are standardised over these rows. Facilities are resampled as integer weights on their
    moments (one row a facility), replicates in parallel by ``mapInPandas``; under 20 usable draws give
    no interval.
    """
    if gate and not gate.get("equity_permitted", gate.get("passed", False)):
        raise AnalysisError("the gate does not permit the equity model")
    spark = frame.sparkSession
    t = frame.where(F.coalesce("technology_present", F.lit(False)) & F.col(facility).isNotNull()).withColumn("_y", outcome.cast("double"))
    z = standardise(t, covariates)
    names = [c + "_z" for c in covariates]
    p = len(names)
    moments = group_moments(z, "_y", names, [facility])
    row = within_system(moments, p).first()
    if not row["n"]:
        raise AnalysisError("no technology rows")
    beta = solve_within(row.asDict(), p)
    # per facility: the within sums, which add up under integer weights
    parts = moments.select(F.xxhash64(facility).alias("h"), *[(F.col(f"xx{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)], *[(F.col(f"xy{i}") - F.col(f"s{i}") * F.col("sy") / F.col("n")).alias(f"b{i}") for i in range(p)])
    width = p * (p + 1) // 2 + p
    n_fac = row["n_groups"]
    # a Poisson(1) weight for each facility and replicate is the cluster bootstrap's limit and needs no collection
    schema = ", ".join(["replicate int", *[f"v{i} double" for i in range(width)]])

    def weigh(batches):  # noqa: ANN001, ANN202
        total = np.zeros((n_boot, width))
        for b in batches:
            v = b.to_numpy()
            total += poisson_weights(b["h"].to_numpy(), n_boot, seed).T @ v[:, 1:].astype(float)
        yield pd.DataFrame(np.column_stack([np.arange(n_boot), total]), columns=["replicate", *[f"v{i}" for i in range(width)]]).astype({"replicate": "int32"})

    sums = parts.mapInPandas(weigh, schema).groupBy("replicate").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(width)]).collect()
    keys = [f"a{i}_{j}" for i in range(p) for j in range(i, p)] + [f"b{i}" for i in range(p)]
    draws = [solve_within({k: r[f"v{i}"] for i, k in enumerate(keys)}, p) for r in sums]
    out = []
    for i, c in enumerate(covariates):
        d = [x[i] for x in draws if x[i] is not None]
        lo, hi = (float(v) for v in np.percentile(d, [2.5, 97.5])) if len(d) >= 20 and beta[i] is not None else (None, None)
        out.append((c, beta[i], lo, hi, None if lo is None else bool(lo > 0 or hi < 0), "estimated" if beta[i] is not None else "not_identified", int(row["n"]), int(n_fac)))
    return spark.createDataFrame(out, "covariate string, beta double, lo double, hi double, significant boolean, status string, n bigint, n_facilities bigint")


def matched_severity(df: DataFrame, y: str, x: str, group: str, stratum: Column, minimum: int = 30) -> DataFrame:
    """The slope inside each severity stratum with enough rows and both outcomes: stratum, n, n_groups, beta."""
    d = df.where(F.col(group).isNotNull()).withColumn("stratum", F.coalesce(stratum, F.lit(-1.0)))
    s = within_system(group_moments(d, y, [x], ["stratum", group]), 1, ["stratum"])
    size = d.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"), F.min(y).alias("_lo"), F.max(y).alias("_hi")).where((F.col("_n") >= minimum) & (F.col("_lo") != F.col("_hi")))
    return s.join(size, "stratum").select("stratum", "n", "n_groups", F.try_divide("b0", F.nullif(F.col("a0_0"), F.lit(0.0))).alias("beta"))


MOST_CELLS = 2_000_000  #: cells of two effects that the driver sweeps


def two_way_slope(df: DataFrame, y: str, x: str, a: str, b: str, rounds: int = 30) -> float | None:
    """Slope with two fixed effects (such as state and year), by alternating demeaning of the cell table (a, b); refused over ``MOST_CELLS`` cells."""
    table = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy"))
    cells = table.limit(MOST_CELLS + 1).toPandas()
    if len(cells) > MOST_CELLS:
        raise AnalysisError(f"{a} and {b} have more than {MOST_CELLS} cells")
    n, ia, ib = cells["n"].to_numpy(float), pd.factorize(cells[a])[0], pd.factorize(cells[b])[0]

    def swept(s: np.ndarray) -> np.ndarray:
        mean, fit = s / n, np.zeros(len(n))
        for _ in range(rounds):
            for g in (ia, ib):
                fit += (np.bincount(g, (mean - fit) * n) / np.bincount(g, n))[g]
        return fit

    fx, fy = swept(cells["sx"].to_numpy(float)), swept(cells["sy"].to_numpy(float))
    sx, sy = cells["sx"].to_numpy(float), cells["sy"].to_numpy(float)
    sxx = (cells["xx"] - 2 * fx * sx + n * fx**2).sum()
    sxy = (cells["xy"] - fx * sy - fy * sx + n * fx * fy).sum()
    return float(sxy / sxx) if sxx > 1e-12 else None


def logistic_fits(rows: DataFrame, p: int, n_boot: int = 0, seed: int = 0, ridge: float = 1e-6, tol: float = 1e-8, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Logistic coefficients (intercept first) of all rows, then of ``n_boot`` replicates with Poisson weights, and which of them are good.

    ``rows``: h (a number of the row, for its weights), y (0 or 1) and x0 to x{p-1}. Newton steps for all fits
    at once: each is one aggregation, whose tasks hand in a gradient and a p by p matrix for every fit; rows
    are never collected. Fits of one class, or that do not come to rest, are not good.
    """
    q, fits = p + 1, n_boot + 1
    beta = np.zeros((fits, q))
    size = q + q * q + 2
    names = [f"x{j}" for j in range(p)]

    def run(batches):  # noqa: ANN001, ANN202
        total = np.zeros((fits, size))
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                x, y = np.column_stack([np.ones(len(part)), part[names].to_numpy(float)]), part["y"].to_numpy(float)
                weight = np.column_stack([np.ones(len(part)), poisson_weights(part["h"].to_numpy(), n_boot, seed)])
                mu = 1 / (1 + np.exp(-np.clip(x @ beta.T, -30, 30)))
                outer = (x[:, :, None] * x[:, None, :]).reshape(len(part), -1)
                total += np.column_stack([(weight * (y[:, None] - mu)).T @ x, (weight * np.maximum(mu * (1 - mu), 1e-10)).T @ outer, weight.T @ y, weight.sum(0)])
        yield pd.DataFrame({"fit": np.arange(fits, dtype=np.int32), "v": list(total)})

    settled = np.zeros(fits, bool)
    good = np.ones(fits, bool)
    for _ in range(steps):
        sums = rows.mapInPandas(run, "fit int, v array<double>").groupBy("fit").agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(size)]).toPandas().sort_values("fit")
        if not len(sums):
            return beta, np.zeros(fits, bool)
        s = sums.drop(columns="fit").to_numpy(float)
        good = (s[:, -2] > 0) & (s[:, -2] < s[:, -1])
        step = np.linalg.solve(s[:, q:-2].reshape(fits, q, q) + ridge * np.eye(q), (s[:, :q] - ridge * beta)[:, :, None])[:, :, 0]
        step[~good | settled] = 0
        beta = beta + step
        settled |= np.abs(step).max(1) < tol
        if settled.all():
            break
    return beta, good & settled


def error_audit(df: DataFrame, wrong: Column, covariates: list[str], n_boot: int = 1000, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """covariate, beta, lo, hi, flagged: which covariates predict that a judgement was wrong.

    Replicates weight every row by a Poisson number of its key. One-class draws are skipped, under 20
    usable ones flag nothing.
    """
    z = standardise(df.withColumn("_w", F.coalesce(wrong, F.lit(False)).cast("int")), covariates)
    number = F.xxhash64(key) if key in df.columns else F.xxhash64(*df.columns)
    rows = checkpointed(z.select(number.alias("h"), F.col("_w").alias("y"), *[F.col(c + "_z").alias(f"x{j}") for j, c in enumerate(covariates)]))
    spark = df.sparkSession
    schema = "covariate string, beta double, lo double, hi double, flagged boolean, n_draws int"
    classes = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    if classes[0] in (0, classes[1]):
        return spark.createDataFrame([(c, None, None, None, False, 0) for c in covariates], schema)
    beta, good = logistic_fits(rows, len(covariates), n_boot, seed)
    draws = beta[1:][good[1:], 1:]
    out = []
    for j, c in enumerate(covariates):
        lo, hi = (float(v) for v in np.percentile(draws[:, j], [2.5, 97.5])) if len(draws) >= 20 else (None, None)
        out.append((c, float(beta[0, j + 1]), lo, hi, bool(lo is not None and (lo > 0 or hi < 0)), len(draws)))
    return spark.createDataFrame(out, schema)


def rogan_gladen(apparent: float, sensitivity: float, specificity: float) -> float:
    """Prevalence corrected for the instrument's errors, clipped to [0, 1]; an instrument near chance is refused."""
    power = sensitivity + specificity - 1
    if abs(power) < 0.05:
        raise AnalysisError("sensitivity and specificity are too near chance")
    return float(min(1.0, max(0.0, (apparent + specificity - 1) / power)))


def corrected_prevalence(apparent: float, cells: dict[str, int], n_boot: int = 2000, seed: int = 0) -> dict:
    """Point, percentile interval and skipped draws, the gold counts resampled; an error where they do not identify the instrument's errors."""
    names = ("tp", "fp", "fn", "tn")
    n = np.array([cells[k] for k in names])

    def one(c: np.ndarray) -> float:
        tp, fp, fn, tn = c
        if tp + fn == 0 or tn + fp == 0:
            raise AnalysisError("the gold labels lack one of the two classes")
        return rogan_gladen(apparent, tp / (tp + fn), tn / (tn + fp))

    def drawn(c: np.ndarray) -> float | None:
        try:
            return one(c)
        except AnalysisError:
            return None

    point = one(n)
    draws = [drawn(d) for d in np.random.default_rng(seed).multinomial(int(n.sum()), n / n.sum(), size=n_boot)]
    good = [d for d in draws if d is not None]
    lo, hi = np.percentile(good, [2.5, 97.5]) if good else (None, None)
    return {"point": point, "lo": None if lo is None else float(lo), "hi": None if hi is None else float(hi), "skipped": len(draws) - len(good)}
