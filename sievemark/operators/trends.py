"""Prevalence over time, the illegibility gap and the adequacy of tags."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.contracts import TAXONOMY_LEVELS, AnalysisError, require_columns


def bootstrap_rate(k: int, n: int, n_boot: int = 1000, seed: int = 0) -> tuple[float | None, float | None]:
    """Percentile interval of a proportion; (k, n) says all, so draws are binomial."""
    if not n:
        return None, None
    lo, hi = np.percentile(np.random.default_rng(seed).binomial(n, k / n, n_boot) / n, [2.5, 97.5])
    return float(lo), float(hi)


def _technology() -> Column:
    return F.coalesce("technology_present", F.lit(False))


def _exposure(denominator: str) -> Column:
    return F.countDistinct("survey_id") if denominator == "surveys" else F.count(F.lit(1))


def prevalence(frame: DataFrame, by: list[str] | None = None, denominator: str = "surveys") -> DataFrame:
    """n_citations, n_technology, share, exposure and rate_per_exposure, overall or for each period; null periods are left out."""
    by = by or []
    require_columns(frame, ["technology_present", *by])
    if denominator == "surveys" and "survey_id" not in frame.columns:
        denominator = "rows"
    f = frame
    for c in by:
        f = f.where(F.col(c).isNotNull())
    g = f.groupBy(*by).agg(F.count(F.lit(1)).alias("n_citations"), F.count_if(_technology()).alias("n_technology"), _exposure(denominator).alias("exposure"))
    return g.select(*by, "n_citations", "n_technology", F.try_divide("n_technology", "n_citations").alias("share"), "exposure", F.coalesce(F.try_divide("n_technology", "exposure"), F.lit(0.0)).alias("rate_per_exposure"))


def prevalence_rollup(frame: DataFrame, year: str = "year", quarter: str = "quarter") -> DataFrame:
    """Overall, by year and by quarter in one pass: level (0 overall, 1 year, 2 quarter) and the counts."""
    f = frame.withColumn("_y", F.coalesce(F.col(year), F.lit(-1))).withColumn("_q", F.coalesce(F.col(quarter), F.lit(-1)))
    g = f.rollup("_y", "_q").agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n_citations"), F.count_if(_technology()).alias("n_technology"))
    level = F.when(F.col("_g") == 3, 0).when(F.col("_g") == 1, 1).otherwise(2)
    return g.select(level.alias("level"), F.nullif("_y", F.lit(-1)).alias(year), F.nullif("_q", F.lit(-1)).alias(quarter), "n_citations", "n_technology").where((F.col("level") == 0) | F.col(year).isNotNull())


def with_intervals(rows: DataFrame, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Adds lo and hi to a table of period counts (n_citations, n_technology), draws seeded by row."""
    spark, data = rows.sparkSession, rows.collect()  # one row for each period
    out = [(*r, *bootstrap_rate(r["n_technology"], r["n_citations"], n_boot, seed + i)) for i, r in enumerate(data)]
    return spark.createDataFrame(out, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", lo double, hi double")


def series(frame: DataFrame, by: str = "year") -> DataFrame:
    """t (0-based), label and y of the technology counts by period."""
    p = prevalence(frame, [by], "rows").select(F.col(by).cast("string").alias("label"), F.col("n_technology").cast("double").alias("y"), F.col(by).alias("_o"))
    from pyspark.sql.window import Window

    return p.select((F.row_number().over(Window.orderBy("_o")) - 1).cast("bigint").alias("t"), "label", "y")  # one row a period


def gap(frame: DataFrame) -> DataFrame:
    """Of the technology rows: n, strict (level is not full) and lenient (level is none) rates. ``frame`` has level."""
    t = frame.where(_technology())
    return t.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("level") != "full").cast("double")).alias("strict_rate"), F.avg((F.col("level") == "none").cast("double")).alias("lenient_rate"))


def require_technology(frame: DataFrame) -> DataFrame:
    if frame.where(_technology()).limit(1).count() == 0:
        raise AnalysisError("no technology rows")
    return frame


def gap_by_level(frame: DataFrame) -> DataFrame:
    """Every level with its number of technology rows, 0 included, in one aggregation."""
    t = frame.where(_technology())
    counts = t.agg(*[F.count_if(F.col("level") == k).alias(k) for k in TAXONOMY_LEVELS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(k).alias("n")) for k in TAXONOMY_LEVELS])).alias("x")).select("x.*")


def gap_breakdown(frame: DataFrame, fields: tuple[str, ...] = ("technology_type", "failure_role")) -> DataFrame:
    """field_name, value, n, strict_rate, lenient_rate for every value of several fields, in one pass."""
    t = frame.where(_technology()).select("level", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.coalesce(F.col(f), F.lit("nan")).alias("value")) for f in fields])).alias("x"))
    return t.groupBy("x.field_name", "x.value").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("level") != "full").cast("double")).alias("strict_rate"), F.avg((F.col("level") == "none").cast("double")).alias("lenient_rate"))


def tag_adequacy(frame: DataFrame) -> DataFrame:
    t = frame.where(_technology())
    return t.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("level") == "full").cast("double")).alias("share_full"), F.avg((F.col("level") == "partial").cast("double")).alias("share_partial"))


def roles_never_legible(frame: DataFrame) -> DataFrame:
    """Failure roles no technology row of which has a full tag, with their number of rows."""
    t = frame.where(_technology() & F.col("failure_role").isNotNull())
    return t.groupBy("failure_role").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("level") == "full").alias("_full")).where("not _full").drop("_full")


def top_tags(frame: DataFrame, k: int = 10, tag: str = "f_tag") -> DataFrame:
    """The ``k`` tags most used by technology rows, ties by name."""
    return frame.where(_technology() & F.col(tag).isNotNull()).groupBy(tag).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), tag).limit(k)


def technology_flow(frame: DataFrame) -> DataFrame:
    """technology_type to level: n and share of the type's rows."""
    t = frame.where(_technology()).groupBy(F.coalesce("technology_type", F.lit("nan")).alias("technology_type"), "level").agg(F.count(F.lit(1)).alias("n"))
    total = t.groupBy("technology_type").agg(F.sum("n").alias("of"))
    return t.join(total, "technology_type").select("technology_type", "level", "n", (F.col("n") / F.col("of")).alias("share"))


def severity_gradient(frame: DataFrame, letter: Column) -> DataFrame:
    """Technology share by grid letter."""
    return frame.withColumn("letter", letter).where("letter is not null").groupBy("letter").agg(F.count(F.lit(1)).alias("n"), F.avg(_technology().cast("double")).alias("share"))
