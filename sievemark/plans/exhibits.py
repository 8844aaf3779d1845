"""Exhibits as tables: each made from the result tree or a frame, each on its own."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.operators import taxonomy
from sievemark.sources.writers import write_exhibit


def _result(results: dict, stage: str) -> dict | None:
    s = results.get("stages", {}).get(stage, {})
    return s.get("result") if s.get("status") == "ok" else None


def vocabulary_census(counts: DataFrame) -> DataFrame:
    """term_group, term, total, top_tags: a row for each term, then summary rows (totals of the groups and their ratio)."""
    top = taxonomy.top_groups(counts, 3).groupBy("term").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "f_tag"))), lambda x: x["f_tag"]), ", ").alias("top_tags"))
    terms = taxonomy.term_census(counts).select("term_group", "term", F.col("total").cast("double").alias("total")).join(top, "term", "left").select("term_group", "term", "total", F.coalesce("top_tags", F.lit("")).alias("top_tags"))
    r = taxonomy.census_ratio(counts)
    x = F.explode(F.array(*[F.struct(F.lit("summary").alias("term_group"), F.lit(n).alias("term"), F.round(F.col(c).cast("double"), 1).alias("total"), F.lit("").alias("top_tags")) for n, c in (("pre-digital total", "numerator"), ("digital total", "denominator"), ("ratio", "ratio"))]))
    return terms.unionByName(r.select(x.alias("x")).select("x.*"))


def validation_table(spark: SparkSession, results: dict) -> DataFrame:
    """check_name, observed, lo, hi, passed, rule; then the q ladder, the least category, self-consistency, refusals and parse failures."""
    v, gate = _result(results, "validate") or {}, results.get("gate") or {"checks": {}}
    rows = []
    for name, c in gate["checks"].items():
        ci = (v.get("model_vs_human") or {}).get({"model_f1": "f1", "model_kappa": "kappa"}.get(name, ""), {}) or {}
        rows.append((name, c["observed"], ci.get("lo"), ci.get("hi"), c["passed"], c["rule"]))
    more = [(f"q_alpha_under_{k}", q) for k, q in ((v.get("human_alpha_bootstrap") or {}).get("q_ladder") or {}).items()]
    more += [("per_category_alpha_least", (v.get("per_category_alpha") or {}).get("min_alpha"))]
    more += [(f"self_consistency_{k}", x) for k, x in (v.get("self_consistency") or {}).items() if k != "n"]
    more += [(k, None if v.get(k) is None else float(v[k])) for k in ("n_refusals", "n_parse_failures")]
    rows += [(k, x, None, None, None, "reported") for k, x in more]
    return spark.createDataFrame(rows, "check_name string, observed double, lo double, hi double, passed boolean, rule string")


def gap_table(spark: SparkSession, results: dict) -> DataFrame:
    rows = [(x["value"], x["n"], round(x["strict_rate"], 3), round(x["lenient_rate"], 3)) for x in (_result(results, "rq2") or {}).get("breakdown", []) if x["field_name"] == "technology_type"]
    return spark.createDataFrame(rows, "technology_type string, n bigint, strict_rate double, lenient_rate double").orderBy(F.desc("n"), "technology_type")


def equity_table(spark: SparkSession, results: dict) -> DataFrame:
    schema = "covariate string, beta double, lo double, hi double, status string"
    r = _result(results, "rq3")
    if r is None:
        return spark.createDataFrame([("withheld", None, None, None, results.get("stages", {}).get("rq3", {}).get("reason", "not run"))], schema)
    return spark.createDataFrame([(x["covariate"], x["beta"], x["lo"], x["hi"], x["status"]) for x in r["coefficients"]], schema)


def forecast_table(spark: SparkSession, results: dict) -> DataFrame:
    r = _result(results, "rq4") or {}
    rows: list[tuple[str, str]] = [("best", str(r.get("best")))] if r else [("status", "withheld")]
    for f in r.get("fits", []):
        rows += [(f"{f['model']}.{k}", f"{v:.6g}" if isinstance(v, float) else str(v)) for k, v in f.items() if k != "model"]
    rows += [(f"backtest.{k}", str(v)) for k, v in (r.get("backtest") or {}).items()]
    return spark.createDataFrame(rows, "name string, value string")


def prevalence_figure(spark: SparkSession, results: dict) -> DataFrame:
    rows = [(int(x["year"]), x["share"], x["lo"], x["hi"]) for x in (_result(results, "rq1") or {}).get("by_year", [])]
    return spark.createDataFrame(rows, "year int, share double, lo double, hi double").orderBy("year")


def gap_figure(spark: SparkSession, results: dict) -> DataFrame:
    rows = [(x["value"], x["strict_rate"], x["n"]) for x in (_result(results, "rq2") or {}).get("breakdown", []) if x["field_name"] == "failure_role"]
    return spark.createDataFrame(rows, "failure_role string, strict_rate double, n bigint").orderBy(F.desc("strict_rate"), "failure_role")


def projection_figure(spark: SparkSession, results: dict) -> DataFrame:
    """Both the total and the illegible failures, each beside the band of the total (D16)."""
    rows = [(x["scenario"], x["step"], x["failures"], x["failures_illegible"], x["lo"], x["hi"]) for x in ((_result(results, "rq4") or {}).get("projection") or {}).get("rows", []) if x["status"] == "projected"]
    return spark.createDataFrame(rows, "scenario string, step int, failures double, failures_illegible double, lo double, hi double")


def census_table(spark: SparkSession, results: dict) -> DataFrame:
    """term_group, term, total, n_groups of the census of words."""
    rows = [(x["term_group"], x["term"], x["total"], x["n_groups"]) for x in (_result(results, "study1") or {}).get("census", [])]
    return spark.createDataFrame(rows, "term_group string, term string, total bigint, n_groups bigint").orderBy("term_group", F.desc("total"), "term")


def overall_figure(spark: SparkSession, results: dict) -> DataFrame:
    """What share of all citations names a technology, and what share of these is illegible: measure, n, share."""
    o, g = (_result(results, "rq1") or {}).get("overall") or {}, (_result(results, "rq2") or {}).get("gap") or {}
    rows = [("technology", o.get("n_citations"), o.get("share")), ("illegible_strict", g.get("n"), g.get("strict_rate")), ("illegible_lenient", g.get("n"), g.get("lenient_rate"))]
    return spark.createDataFrame([r for r in rows if r[1] is not None], "measure string, n bigint, share double")


EXHIBITS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {"table1_census": census_table, "figure1_overall": overall_figure, "table2_validation": validation_table, "table3_gap": gap_table, "table4_equity": equity_table, "table5_forecast": forecast_table, "figure2_prevalence": prevalence_figure, "figure3_gap": gap_figure, "figure4_projection": projection_figure}


#: stage that an exhibit is made from
SOURCES = {"table1_census": "study1", "figure1_overall": "rq1", "table2_validation": "validate", "table3_gap": "rq2", "table4_equity": "rq3", "table5_forecast": "rq4", "figure2_prevalence": "rq1", "figure3_gap": "rq2", "figure4_projection": "rq4"}


def availability(results: dict) -> dict[str, list[str]]:
    """Exhibits whose stage has a result, and those without."""
    have = {name: _result(results, stage) is not None for name, stage in SOURCES.items()}
    return {"available": sorted(k for k, v in have.items() if v), "unavailable": sorted(k for k, v in have.items() if not v)}


def render_all(spark: SparkSession, results: dict, folder: str) -> dict[str, Any]:
    """Write every exhibit; one that cannot be made is reported and does not stop the others."""
    out = {}
    for name, make in EXHIBITS.items():
        try:
            write_exhibit(make(spark, results), folder, name, name.replace("_", " "))
            out[name] = "written"
        except Exception as e:  # noqa: BLE001
            out[name] = f"unavailable: {e}"[:200]
    return out
