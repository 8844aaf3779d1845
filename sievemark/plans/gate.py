"""The validation gate: measured diagnostics against pre-registered limits."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.contracts import EngineError, Thresholds

CORE = ("human_reliability", "model_f1", "model_kappa", "prompt_stability", "cross_model")


def nested(value: Any, *keys: str) -> Any:
    for k in keys:
        if not isinstance(value, dict) or value.get(k) is None:
            return None
        value = value[k]
    return value


def optional_check(f: Callable[[], Any]) -> tuple[Any, str | None]:
    """(result, None), or (None, reason) when the check cannot be made."""
    try:
        return f(), None
    except (EngineError, ValueError) as e:
        return None, str(e)


def gate_checks(results: dict, limits: Thresholds | None = None) -> list[tuple[str, float | None, bool | None, str]]:
    """(check, observed, passed, rule); a check without input has passed null."""
    t = limits or Thresholds()
    q = nested(results, "human_alpha_bootstrap", "q")
    if isinstance(q, dict):
        q = q.get(f"{t.alpha_min:g}")
    audit = results.get("differential_error")
    n_flags = len(audit.get("flagged") or []) if isinstance(audit, dict) and audit else None
    wanted = [
        ("human_reliability", q, "<=", t.alpha_q_max, f"share of bootstrap draws with alpha under {t.alpha_min:g}"),
        ("model_f1", nested(results, "model_vs_human", "f1", "point"), ">=", t.f1_min, "binary F1"),
        ("model_kappa", nested(results, "model_vs_human", "kappa", "point"), ">=", t.kappa_min, "Cohen's kappa"),
        ("prompt_stability", nested(results, "prompt_sensitivity", "prevalence_spread"), "<=", t.prompt_max_spread, "spread of prevalence over prompts"),
        ("cross_model", nested(results, "model_sensitivity", "facility_rho"), ">=", t.cross_model_rho_min, "rank correlation of facility rates"),
        ("differential_error", n_flags, "<=", t.differential_error_max_flags, "flagged covariates"),
        ("per_category_alpha_min", nested(results, "per_category_alpha", "min_alpha"), ">=", t.alpha_min, "least per-category alpha"),
    ]
    out = []
    for name, observed, sign, limit, what in wanted:
        if observed is not None and not math.isfinite(observed):
            observed = None
        passed = None if observed is None else observed <= limit if sign == "<=" else observed >= limit
        out.append((name, None if observed is None else float(observed), passed, f"{what} {sign} {limit:g}"))
    return out


def evaluate_gate(results: dict, limits: Thresholds | None = None) -> dict:
    """passed (all core checks), equity_permitted, per_role_claims_permitted, checks and reasons.

    The per-category minimum narrows what may be claimed but gives no reason of its own (D7).
    """
    checks = gate_checks(results, limits)
    ok = {name: passed is True for name, _, passed, _ in checks}
    passed = all(ok[c] for c in CORE)
    reasons = [f"{n}: {'not evaluated' if p is None else f'observed {o:g} fails'} ({rule})" for n, o, p, rule in checks if p is not True and n != "per_category_alpha_min"]
    return {
        "passed": passed, "equity_permitted": passed and ok["differential_error"], "per_role_claims_permitted": passed and ok["per_category_alpha_min"],
        "checks": {n: {"observed": o, "passed": p, "rule": r} for n, o, p, r in checks}, "reasons": reasons,
    }


def gate_table(spark: SparkSession, results: dict, limits: Thresholds | None = None) -> DataFrame:
    return spark.createDataFrame(gate_checks(results, limits), "check_name string, observed double, passed boolean, rule string")


def gate_verdict(checks: DataFrame) -> DataFrame:
    """passed: every core check is there and passed."""
    core = checks.where(F.col("check_name").isin(*CORE))
    return core.agg((F.bool_and(F.coalesce("passed", F.lit(False))) & (F.count(F.lit(1)) == len(CORE))).alias("passed"), F.count_if("passed").alias("n_passed"))
