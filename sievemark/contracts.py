"""Schemas, closed vocabularies, errors and settings shared by the operators."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import types as T


class EngineError(Exception):
    """Base of all errors of this package."""


class ConfigError(EngineError): ...


class CorpusError(EngineError): ...


class ExtractionError(EngineError): ...


class AnalysisError(EngineError): ...


class ForecastError(EngineError): ...


class ReleaseError(EngineError): ...


# Closed vocabularies.
TECHNOLOGY_TYPES = (
    "call_light", "camera_monitoring", "e_medication_administration", "electronic_health_record", "fall_alarm_or_sensor",
    "predictive_or_ai_decision_support", "remote_or_tele_monitoring", "wander_elopement_system", "other", "none",
)
FAILURE_ROLES = ("absent", "incidental", "juxtaposition_error", "malfunction", "misconfiguration", "not_responded_to", "over_reliance", "overcompleteness", "workaround", "none")
TAXONOMY_LEVELS = ("full", "partial", "none")

CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.StringType()), T.StructField("ccn", T.StringType()), T.StructField("survey_date", T.StringType()), T.StructField("year", T.LongType()), T.StructField("quarter", T.LongType()),
        T.StructField("f_tag", T.StringType()), T.StructField("scope_severity", T.StringType()), T.StructField("severity_level", T.DoubleType()), T.StructField("scope_level", T.DoubleType()),
        T.StructField("actual_harm", T.BooleanType()), T.StructField("immediate_jeopardy", T.BooleanType()), T.StructField("is_complaint", T.BooleanType()), T.StructField("state", T.StringType()),
        T.StructField("narrative", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("ownership_type", T.StringType()), T.StructField("certified_beds", T.LongType()),
    ]
)

#: The fields a release may hold, and those it must never hold.
RELEASE_FIELDS = {
    "doc_id": "string", "ccn": "string", "year": "integer", "quarter": "integer", "state": "string", "f_tag": "string", "scope_severity": "string", "technology_present": "boolean", "technology_type": "string",
    "failure_role": "string", "harm_linked": "boolean", "evidence_span_start": "integer", "evidence_span_end": "integer", "confidence": "number", "model_id": "string", "model_revision": "string", "prompt_hash": "string",
}
PERMITTED = {"quarter": (1, 2, 3, 4), "technology_type": TECHNOLOGY_TYPES, "failure_role": FAILURE_ROLES}
FORBIDDEN_FIELDS = ("narrative", "evidence_span", "text", "resident_name", "surveyor_name", "raw_response", "narrative_text")


@dataclass(frozen=True)
class Thresholds:
    """Pre-registered limits of the validation gate. Fixed values."""

    alpha_min: float = 0.80
    alpha_q_max: float = 0.05
    f1_min: float = 0.80
    kappa_min: float = 0.60
    prompt_max_spread: float = 0.05
    cross_model_rho_min: float = 0.70
    differential_error_max_flags: int = 0

    @classmethod
    def from_mapping(cls, values: dict[str, Any] | None) -> Thresholds:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (values or {}).items() if k in known})


@dataclass(frozen=True)
class ReleasePolicy:
    min_cell: int = 10
    quasi_identifiers: tuple[str, ...] = ("state", "year", "quarter", "technology_type")
    max_text: int = 64
    hash_ccn: bool = False
    salt: str = ""
    licence: str = "CC-BY-4.0"


SECTIONS = ("data", "corpus", "extraction", "validation", "analysis", "forecast", "deposit")


@dataclass(frozen=True)
class Config:
    """Settings by section; unknown top-level keys are an error, missing sections are empty."""

    seed: int = 20260101
    device: str = "cpu"
    data: dict = field(default_factory=dict)
    corpus: dict = field(default_factory=dict)
    extraction: dict = field(default_factory=dict)
    validation: dict = field(default_factory=dict)
    analysis: dict = field(default_factory=dict)
    forecast: dict = field(default_factory=dict)
    deposit: dict = field(default_factory=dict)

    @classmethod
    def from_mapping(cls, values: dict[str, Any]) -> Config:
        unknown = set(values) - {"seed", "device", *SECTIONS}
        if unknown:
            raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
        for s in SECTIONS:
            if not isinstance(values.get(s, {}) or {}, dict):
                raise ConfigError(f"section {s} is no mapping")
        return cls(**{k: (v or {}) if k in SECTIONS else v for k, v in values.items()})

    @classmethod
    def load(cls, path: str | Path) -> Config:
        text = Path(path).read_text(encoding="utf-8")
        if str(path).endswith(".json"):
            return cls.from_mapping(json.loads(text))
        import yaml

        return cls.from_mapping(yaml.safe_load(text) or {})

    def fingerprint(self) -> str:
        """First twelve hex digits of the SHA-256 of the canonical JSON."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:12]


def stage_seed(base: int, stage: str) -> int:
    """Seed of a stage: 32-bit BLAKE2b of base and name."""
    return int.from_bytes(hashlib.blake2b(f"{base}|{stage}".encode(), digest_size=4).digest(), "big")


def prompt_hash(template: str) -> str:
    return hashlib.blake2b(template.encode(), digest_size=6).hexdigest()


def require_columns(df, names) -> None:  # noqa: ANN001
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise AnalysisError(f"missing columns: {', '.join(missing)}")
