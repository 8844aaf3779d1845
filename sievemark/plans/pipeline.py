"""Stages of a study: what may run, in which order, with results kept stage by stage."""

from __future__ import annotations

import logging
import platform
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.contracts import Config, EngineError, Thresholds, prompt_hash, stage_seed
from sievemark.functions.text import build_prompt
from sievemark.operators import forecast, stats, taxonomy, trends
from sievemark.operators.corpus import analysis_frame, assert_unique, build_corpus, canonical_keys, cast_failures
from sievemark.operators.judgements import extraction_stats, parse_responses, pilot, run_backend
from sievemark.plans.exhibits import availability
from sievemark.plans.gate import evaluate_gate, optional_check
from sievemark.plans.validation import validate_measurement
from sievemark.session import checkpointed
from sievemark.sources.writers import save_json, timed

log = logging.getLogger("sievemark")
STATUSES = ("ok", "failed", "skipped", "withheld", "pending", "missing_input", "not_requested")


@dataclass
class Run:
    """What a stage sees: session, settings, input tables, seed and the results so far."""

    spark: SparkSession
    config: Config
    tables: dict[str, DataFrame]
    seed: int = 0
    results: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[Run], dict]
    needs: tuple[str, ...] = ()
    gated: bool = False
    equity: bool = False


def _frame(r: Run) -> DataFrame:
    f = canonical_keys(analysis_frame(r.tables["corpus"], r.tables["extracted"], r.config.extraction.get("on_parse_failure", "false")))
    return taxonomy.with_level(f, r.tables["taxonomy"]) if "taxonomy" in r.tables else f


def run_corpus(r: Run) -> dict:
    """The corpus from archive records (tables ``records``, and ``citations`` and ``providers`` where given); a given corpus is taken as it is."""
    if "records" not in r.tables:
        return {"source": "given", "failed_casts": {x["column"]: x["n_failed"] for x in cast_failures(r.tables["corpus"]).collect() if x["n_failed"]}}
    cfg = r.config.corpus
    r.tables["corpus"] = checkpointed(build_corpus(r.tables["records"], r.tables.get("citations"), r.tables.get("providers"), cfg.get("min_tokens", 40), cfg.get("drop_boilerplate", True)))
    assert_unique(r.tables["corpus"])
    return {"source": "records", "n": r.tables["corpus"].count()}


def run_extract(r: Run) -> dict:
    """Judgements of the configured backend; given ones are taken as they are. ``extraction.pilot`` limits a trial run to so many narratives."""
    if "extracted" not in r.tables:
        cfg = r.config.extraction
        corpus = r.tables["corpus"].select("doc_id", "narrative")
        corpus = pilot(corpus, cfg["pilot"]) if cfg.get("pilot") else corpus
        asked = corpus.withColumn("prompt", build_prompt(cfg["prompt"], F.coalesce("narrative", F.lit(""))))
        answers = run_backend(asked, "prompt", cfg.get("backend", "keyword"), cfg.get("batch_size", 256))
        r.tables["extracted"] = checkpointed(parse_responses(answers, "response", "narrative").drop("prompt", "narrative", "response").withColumn("prompt_hash", F.lit(prompt_hash(cfg["prompt"]))))
    return extraction_stats(r.tables["extracted"]).first().asDict()


def run_study1(r: Run) -> dict:
    counts = taxonomy.term_counts(r.tables["corpus"], r.config.analysis.get("census_terms") or {"digital": ["alarm", "sensor"], "pre_digital": ["call light", "side rail"]})
    return {"census": [x.asDict() for x in taxonomy.term_census(counts).collect()], "ratio": taxonomy.census_ratio(counts).first().asDict(), "levels": {x["level"]: x["n_tags"] for x in taxonomy.level_counts(r.tables["taxonomy"]).collect()}}


def run_validate(r: Run) -> dict:
    return validate_measurement(r.tables, r.config, r.seed)


def run_rq1(r: Run) -> dict:
    f = _frame(r)
    rows = trends.with_intervals(trends.prevalence(f, ["year"], r.config.analysis.get("exposure_denominator", "surveys")).orderBy("year"), seed=r.seed)
    s = trends.series(f).orderBy("t").collect()
    return {"overall": trends.prevalence(f).first().asDict(), "by_year": [x.asDict() for x in rows.collect()], "series": {"t": [x["t"] for x in s], "label": [x["label"] for x in s], "y": [x["y"] for x in s]}}


def run_rq2(r: Run) -> dict:
    f = _frame(r)
    return {"gap": trends.gap(f).first().asDict(), "by_level": [x.asDict() for x in trends.gap_by_level(f).collect()], "breakdown": [x.asDict() for x in trends.gap_breakdown(f).collect()], "adequacy": trends.tag_adequacy(f).first().asDict()}


def run_rq3(r: Run) -> dict:
    f = _frame(r)
    covariates = r.config.analysis.get("equity_attrs") or ["severity_level", "n_tokens"]
    return {"coefficients": [x.asDict() for x in stats.equity_model(f, covariates, F.col("illegible"), gate=r.results.get("gate"), n_boot=r.config.analysis.get("n_boot", 500), seed=r.seed).collect()]}


def run_rq4(r: Run) -> dict:
    import numpy as np

    s = r.results["stages"]["rq1"]["result"]["series"]
    t, y = np.array(s["t"], float), np.array(s["y"], float)
    periods = r.spark.createDataFrame(list(zip(t.tolist(), y.tolist())), "t double, y double")
    c = forecast.compare(t, y)
    best = next(f for f in c["fits"] if f.model == c["best"])
    test, reason = optional_check(lambda: forecast.backtest(periods, r.config.forecast.get("backtest_cutoff_index", 40), best.model, r.config.forecast.get("backtest_mape_max", 0.3)))
    out = {"best": c["best"], "fits": [{"model": f.model, **f.params, "rmse": f.rmse, "aic": f.aic} for f in c["fits"]], "backtest": test, "backtest_reason": reason}
    ident = forecast.identifiability(periods).first().asDict()
    out["identifiability"] = ident
    if r.config.forecast.get("require_identifiable_m", True) and not ident["identifiable"]:
        out["projection"] = {"status": "not_identifiable"}  # the fit and the backtest stand (D11)
        return out
    p = forecast.project(r.spark, best, t, y, forecast.scenarios_from(r.config.forecast.get("scenarios")), r.config.forecast.get("horizon_periods", 20), r.config.forecast.get("n_bootstrap", 200), seed=r.seed)
    out["projection"] = {"status": "ok", "rows": [x.asDict() for x in p.collect()]}
    return out


REGISTRY = (
    Stage("corpus", run_corpus),
    Stage("extract", run_extract, ("corpus",)),
    Stage("study1", run_study1),
    Stage("validate", run_validate),
    Stage("rq1", run_rq1, gated=True),
    Stage("rq2", run_rq2, gated=True),
    Stage("rq3", run_rq3, gated=True, equity=True),
    Stage("rq4", run_rq4, ("rq1",), gated=True),
)


def resolve(names: str | list[str]) -> list[str]:
    known = [s.name for s in REGISTRY]
    wanted = known if names in ("all", ["all"]) else [names] if isinstance(names, str) else list(names)
    unknown = [n for n in wanted if n not in known]
    if unknown:
        raise EngineError(f"unknown stages: {', '.join(unknown)}")
    return [n for n in known if n in wanted]


def blocked(stage: Stage, results: dict) -> tuple[str, str] | None:
    """(status, reason) when a stage must not run."""
    for n in stage.needs:
        status = results["stages"].get(n, {}).get("status", "not_requested")
        if status != "ok":
            return "skipped", f"{n} is {status}"
    gate = results.get("gate")
    if stage.gated and not (gate and gate.get("passed")):
        return "withheld", "the validation gate has not passed"
    if stage.equity and not gate.get("equity_permitted"):
        return "withheld", "differential error bars the equity analysis"
    return None


def provenance(spark: SparkSession, config: Config) -> dict:
    return {"spark": spark.version, "python": platform.python_version(), "config_fingerprint": config.fingerprint(), "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}


def run_pipeline(spark: SparkSession, config: Config, tables: dict[str, DataFrame], stages: str | list[str] = "all", out: str | None = None, previous: dict | None = None) -> dict:
    """Run stages in order. A failing stage does not stop the others; results are flushed after each.

    ``previous``: an earlier result tree, whose gate and stages count as done, so a later stage can run alone (D9).
    """
    results: dict[str, Any] = {"provenance": provenance(spark, config), "base_seed": config.seed, "requested_stages": resolve(stages), "gate": (previous or {}).get("gate"), "stages": dict((previous or {}).get("stages", {}))}
    for s in REGISTRY:
        if s.name not in results["requested_stages"]:
            results["stages"].setdefault(s.name, {"status": "not_requested"})
            continue
        stop = blocked(s, results)
        if stop:
            results["stages"][s.name] = {"status": stop[0], "reason": stop[1]}
        else:
            start = time.monotonic()
            try:
                with timed(s.name, log):
                    r = s.run(Run(spark, config, tables, stage_seed(config.seed, s.name), results))
                results["stages"][s.name] = {"status": "ok", "result": r, "seconds": round(time.monotonic() - start, 1)}
            except KeyError as e:
                results["stages"][s.name] = {"status": "missing_input", "reason": str(e)}
            except NotImplementedError as e:
                results["stages"][s.name] = {"status": "pending", "reason": str(e)}
            except Exception as e:  # noqa: BLE001
                log.exception("stage %s", s.name)
                results["stages"][s.name] = {"status": "failed", "reason": f"{type(e).__name__}: {e}"[:500]}
        if s.name == "validate" and results["stages"]["validate"]["status"] == "ok":
            results["gate"] = evaluate_gate(results["stages"]["validate"]["result"], Thresholds.from_mapping(config.validation.get("thresholds")))
        if out:
            save_json(results, out)
    results["summary"] = summarise(results)
    if out:
        save_json(results, out)
    return results


def summarise(results: dict) -> dict:
    by: dict[str, list[str]] = {}
    for n, s in results["stages"].items():
        by.setdefault(s["status"], []).append(n)
    return {"by_status": {k: sorted(v) for k, v in sorted(by.items())}, "gate_passed": bool((results.get("gate") or {}).get("passed")), "exhibits": availability(results)}


def exit_code(results: dict, strict: bool = False) -> int:
    """1 for a failure (or, when strict, something pending), 3 for missing input, 2 for something withheld, else 0."""
    have = {s["status"] for s in results["stages"].values()}
    if "failed" in have or (strict and "pending" in have):
        return 1
    return 3 if "missing_input" in have else 2 if "withheld" in have else 0
