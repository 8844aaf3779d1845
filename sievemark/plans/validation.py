"""The validation stage: every diagnostic of the measurement, on the drawn sample.

Inputs are tables: ``annotations`` (doc_id, annotator, labels), ``extracted`` (judgements of the model) and, where
they exist, ``predictions`` (doc_id, variant, technology_present: the model under other prompts), ``second_model``
(doc_id, technology_present) and ``second_pass`` (doc_id and labels of an identical second run). A check whose
table is not there is not evaluated, and the gate takes it as not satisfied.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.contracts import FAILURE_ROLES, ExtractionError
from sievemark.functions.keys import facility_key
from sievemark.operators import agreement, reliability, stats, stratified

LABEL_FIELDS = ("technology_present", "technology_type", "failure_role")
ALPHA_LADDER = (0.9, 0.8, 0.7, 0.667)


def latest_labels(annotations: DataFrame) -> DataFrame:
    """One row for each narrative and annotator: the last one, roles trimmed and in lower case."""
    a = annotations.withColumn("failure_role", F.lower(F.trim("failure_role")))
    last = F.max(F.struct("labelled_at" if "labelled_at" in a.columns else F.lit(0).alias("labelled_at"), "technology_present", "failure_role")).alias("v")
    return a.groupBy("doc_id", "annotator").agg(last).select("doc_id", "annotator", "v.technology_present", "v.failure_role")


def coder_codes(labels: DataFrame, value: Column) -> DataFrame:
    return labels.select(F.col("doc_id").alias("unit"), F.col("annotator").alias("coder"), value.alias("value")).where("value is not null")


def one_judgement(extracted: DataFrame) -> DataFrame:
    """doc_id, technology_present (false where nothing parsed), failure_role (none where nothing parsed)."""
    best = F.max(F.struct(F.coalesce("parse_ok", F.lit(False)).alias("ok"), F.coalesce("confidence", F.lit(-1.0)).alias("c"), *LABEL_FIELDS)).alias("j")
    j = extracted.groupBy("doc_id").agg(best)
    held = lambda k, other: F.coalesce(F.when(F.col("j.ok"), F.col(f"j.{k}")), F.lit(other)).alias(k)
    return j.select("doc_id", held("technology_present", False), held("technology_type", "none"), held("failure_role", "none"))


class Diagnostics:
    """Runs checks by name; what cannot be evaluated is kept with its reason."""

    def __init__(self) -> None:
        self.values: dict[str, Any] = {}
        self.missing: dict[str, str] = {}

    def add(self, name: str, make: Callable[[], Any]) -> None:
        from sievemark.plans.gate import optional_check

        self.values[name], reason = optional_check(make)
        if reason:
            self.missing[name] = reason


def validate_measurement(tables: dict[str, DataFrame], config: Any, seed: int = 0) -> dict:  # noqa: ANN401
    """All diagnostics of the gate, computed on a stratified sample of the corpus.

    Labels must cover ``validation.min_gold_overlap`` (0.9) of the sample, else the stage fails: a partial
    join looks like a failed model.
    """
    cfg, n_boot = config.validation, config.validation.get("n_bootstrap", 1000)
    corpus = tables["corpus"]
    sample = stratified.stratified_sample(corpus, config.corpus.get("validation_sample_n", 1200), seed, config.corpus.get("sampling", {}).get("min_per_severity_level"))
    sample = sample.withColumn("ccn", facility_key(F.col("ccn"))).persist()
    on_sample = lambda df: df.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")  # noqa: E731  # as many ids as the setting says
    covered = agreement.gold_overlap(sample, tables["annotations"]).first()
    if covered["n_sample"] and covered["overlap"] < cfg.get("min_gold_overlap", 0.9):
        raise ExtractionError(f"labels cover {covered['overlap']:.1%} of the sample; {cfg.get('min_gold_overlap', 0.9):.0%} are needed")
    labels, judged, extracted = on_sample(latest_labels(tables["annotations"])).persist(), one_judgement(on_sample(tables["extracted"])).persist(), on_sample(tables["extracted"])
    present = coder_codes(labels, F.col("technology_present").cast("int"))
    gold = labels.groupBy("doc_id").agg((F.avg(F.col("technology_present").cast("int")) > 0.5).alias("gold_present"), F.mode("failure_role", deterministic=True).alias("gold_role"))
    both = gold.join(judged, "doc_id").persist()
    cells = agreement.binary_cells(both.where("gold_present is not null"), F.col("gold_present"), F.col("technology_present")).first().asDict()
    counts = {k: cells[k] for k in ("tp", "fp", "fn", "tn")}
    d = Diagnostics()
    d.add("human_alpha", lambda: reliability.alpha_terms(present).first()["alpha"])
    d.add("human_alpha_bootstrap", lambda: reliability.alpha_bootstrap(present, "nominal", cfg.get("alpha_bootstrap", 10_000), cfg.get("alpha_min", 0.8), seed, ALPHA_LADDER))
    d.add("per_category_alpha", lambda: _per_category(coder_codes(labels, F.col("failure_role"))))
    d.values["model_vs_human"] = {"cells": cells, "f1": agreement.bootstrap_cells(counts, agreement.f1_of, n_boot, seed + 1), "kappa": agreement.bootstrap_cells(counts, agreement.kappa_of, n_boot, seed + 2)}
    rate = agreement.sensitivity_specificity(both.sparkSession.createDataFrame([cells])).first()
    d.values["error_rates"] = {"sensitivity": rate["sensitivity"], "specificity": rate["specificity"], "n_gold": cells["n"]}
    roles = agreement.confusion(both.where(F.col("gold_role").isin(*FAILURE_ROLES)), "gold_role", "failure_role", list(FAILURE_ROLES))
    d.add("failure_role_agreement", lambda: agreement.macro_f1(roles).first().asDict() | agreement.cohens_kappa(roles).first().asDict())
    d.add("prompt_sensitivity", lambda: _prompts(on_sample(_needed(tables, "predictions"))))
    d.add("model_sensitivity", lambda: _second_model(judged, on_sample(_needed(tables, "second_model")), sample, cfg.get("min_facility_docs", 5)))
    d.add("self_consistency", lambda: agreement.self_consistency(judged, on_sample(_needed(tables, "second_pass")), [f for f in LABEL_FIELDS if f in tables["second_pass"].columns]).first().asDict())
    covariates = [c for c in config.analysis.get("equity_attrs") or ["severity_level", "n_tokens", "certified_beds"] if c in sample.columns]
    audited = both.join(sample.select("doc_id", *covariates), "doc_id")
    d.add("differential_error", lambda: {"flagged": [r["covariate"] for r in stats.error_audit(audited, F.col("gold_present") != F.col("technology_present"), covariates, n_boot, seed).collect() if r["flagged"]]})
    failed = extracted.agg(F.count_if(F.col("parse_error") == "refusal").alias("r"), F.count_if(~F.coalesce("parse_ok", F.lit(False))).alias("f")).first()
    out = d.values | {"n_sample": covered["n_sample"], "gold_overlap": covered["overlap"], "n_refusals": failed["r"], "n_parse_failures": failed["f"], "checks_not_evaluated": d.missing}
    for df in (sample, labels, judged, both):
        df.unpersist()
    return out


def _needed(tables: dict[str, DataFrame], name: str) -> DataFrame:
    if name not in tables:
        raise ExtractionError(f"no table {name}")
    return tables[name]


def _per_category(codes: DataFrame) -> dict:
    by = [r.asDict() for r in reliability.alpha_by_category(codes, list(FAILURE_ROLES)).collect()]
    return {"by_category": by, "min_alpha": min((r["alpha"] for r in by if r["alpha"] is not None), default=None)}


def _prompts(predictions: DataFrame) -> dict:
    """Spread of prevalence over the prompt variants, on the narratives that all of them judged."""
    names = sorted(r[0] for r in predictions.select("variant").distinct().limit(51).collect())
    if not 2 <= len(names) <= 50:
        raise ExtractionError(f"{len(names)} prompt variants; 2 to 50 can be compared")
    wide = predictions.groupBy("doc_id").pivot("variant", names).agg(F.bool_or(F.coalesce("technology_present", F.lit(False))))
    return agreement.prompt_sensitivity(wide.dropna(subset=names), names).first().asDict()


def _second_model(judged: DataFrame, second: DataFrame, sample: DataFrame, minimum: int) -> dict:
    other = second.groupBy("doc_id").agg(F.bool_or(F.coalesce("technology_present", F.lit(False))).alias("second"))
    rows = judged.join(other, "doc_id").join(sample.select("doc_id", "ccn"), "doc_id")
    rho = agreement.spearman(agreement.facility_rates(rows, "technology_present", "second", "ccn", minimum), "rate_a", "rate_b").first()
    return {"facility_rho": rho["rho"], "n_facilities": rho["n"]}
