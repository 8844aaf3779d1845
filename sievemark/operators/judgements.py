"""Model judgements: parsing and validating responses, a keyword backend, batch inference."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.contracts import FAILURE_ROLES, TECHNOLOGY_TYPES, ExtractionError
from sievemark.functions.text import first_label, locate_span, looks_like_refusal

KEYS = ("technology_present", "technology_type", "failure_role", "harm_linked", "evidence_span", "confidence")
#: Fixed values, in the order in which they count.
TECHNOLOGY_KEYWORDS = (
    ("call light", "call_light"), ("call bell", "call_light"), ("bed alarm", "fall_alarm_or_sensor"), ("alarm", "fall_alarm_or_sensor"), ("sensor", "fall_alarm_or_sensor"), ("camera", "camera_monitoring"),
    ("wanderguard", "wander_elopement_system"), ("elopement", "wander_elopement_system"), ("electronic health record", "electronic_health_record"), ("emar", "e_medication_administration"),
    ("telehealth", "remote_or_tele_monitoring"), ("predictive", "predictive_or_ai_decision_support"),
)
ROLE_KEYWORDS = (
    ("not functioning", "malfunction"), ("malfunction", "malfunction"), ("did not respond", "not_responded_to"), ("unanswered", "not_responded_to"), ("not answered", "not_responded_to"), ("relied on", "over_reliance"),
    ("not turned on", "misconfiguration"), ("disabled", "workaround"), ("was not in place", "absent"), ("wrong resident", "juxtaposition_error"), ("adjacent", "juxtaposition_error"),
    ("standard text", "overcompleteness"), ("documented as completed", "overcompleteness"), ("templated", "overcompleteness"),
)


def response_schema() -> dict:
    """JSON schema of a response."""
    text = {"type": "string"}
    props = {"technology_present": {"type": "boolean"}, "technology_type": text | {"enum": list(TECHNOLOGY_TYPES)}, "failure_role": text | {"enum": list(FAILURE_ROLES)}, "harm_linked": {"type": "boolean"}, "evidence_span": text, "confidence": {"type": "number", "minimum": 0, "maximum": 1}}
    return {"type": "object", "properties": props, "required": list(KEYS), "additionalProperties": False}


def parse_responses(df: DataFrame, response: str = "response", narrative: str | None = None) -> DataFrame:
    """Adds parse_ok, parse_error and the judged fields; the first failing check names the error.

    Types are exact (the text "true" is no boolean), but a confidence may be written as text or boolean.
    With ``narrative`` the evidence span's 0-based offsets are added. Null responses fail as empty ones.
    """
    body = F.nullif(F.regexp_extract(F.coalesce(F.col(response), F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))
    d = df.withColumn("_body", body).withColumn("_v", F.try_parse_json("_body"))
    kind = lambda k: F.expr(f"schema_of_variant(try_variant_get(_v, '$.{k}', 'variant'))")
    text = lambda k: F.expr(f"try_variant_get(_v, '$.{k}', 'string')")
    # a missing key gives null, a JSON null gives VOID
    missing = F.filter(F.array(*[F.when(kind(k).isNull(), F.lit(k)) for k in KEYS]), lambda x: x.isNotNull())
    confidence = F.when(kind("confidence") == "BOOLEAN", F.when(text("confidence") == "true", 1.0).otherwise(0.0)).otherwise(text("confidence").try_cast("double"))
    present = F.expr("try_variant_get(_v, '$.technology_present', 'boolean')")
    d = d.withColumn("_missing", missing).withColumn("_confidence", confidence)
    error = (
        F.when(F.col("_body").isNull() & looks_like_refusal(F.col(response)), "refusal")
        .when(F.col("_body").isNull(), "no JSON object found")
        .when(F.col("_v").isNull() | ~F.coalesce(F.json_array_length(F.concat(F.lit("["), "_body", F.lit("]"))) == 1, F.lit(False)), "invalid JSON")  # one value and nothing after it
        .when(~F.schema_of_variant("_v").startswith("OBJECT"), "response is not an object")
        .when(F.size("_missing") > 0, F.concat(F.lit("missing keys: "), F.array_join("_missing", ", ")))
        .when(kind("technology_present") != "BOOLEAN", "technology_present not boolean")
        .when(kind("harm_linked") != "BOOLEAN", "harm_linked not boolean")
        .when(~F.coalesce((kind("technology_type") == "STRING") & text("technology_type").isin(*TECHNOLOGY_TYPES), F.lit(False)), F.concat(F.lit("unknown technology_type "), F.coalesce(text("technology_type"), F.lit("null"))))
        .when(~F.coalesce((kind("failure_role") == "STRING") & text("failure_role").isin(*FAILURE_ROLES), F.lit(False)), F.concat(F.lit("unknown failure_role "), F.coalesce(text("failure_role"), F.lit("null"))))
        .when(F.col("_confidence").isNull(), "confidence not a number")
        .when(~F.col("_confidence").between(0.0, 1.0) | F.isnan("_confidence"), "confidence outside [0, 1]")
        .when(~present & ((text("technology_type") != "none") | (text("failure_role") != "none")), "technology_present is false but a type or role was named")
    )
    d = d.withColumn("parse_error", error).withColumn("parse_ok", F.col("parse_error").isNull())
    ok = lambda c: F.when(F.col("parse_ok"), c)
    d = d.withColumns({"technology_present": ok(present), "technology_type": ok(text("technology_type")), "failure_role": ok(text("failure_role")), "harm_linked": ok(F.expr("try_variant_get(_v, '$.harm_linked', 'boolean')")), "confidence": ok(F.col("_confidence")), "_span": ok(F.coalesce(text("evidence_span"), F.lit("")))})
    if narrative:
        start, end = locate_span(F.col(narrative), F.col("_span"))
        d = d.withColumns({"evidence_span_start": start, "evidence_span_end": end})
    return d.drop("_body", "_v", "_missing", "_confidence", "_span")


def extraction_stats(judged: DataFrame) -> DataFrame:
    """n, parsed, failed, refused, located and failure_rate (0 when empty)."""
    located = F.count_if(F.col("evidence_span_start").isNotNull()) if "evidence_span_start" in judged.columns else F.lit(0).cast("bigint")
    s = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if("parse_ok").alias("n_parsed"), F.count_if(~F.col("parse_ok")).alias("n_failed"), F.count_if(F.col("parse_error") == "refusal").alias("n_refused"), located.alias("n_located"))
    return s.withColumn("failure_rate", F.coalesce(F.try_divide("n_failed", "n"), F.lit(0.0)))


def keyword_judgement(narrative: Column) -> dict[str, Column]:
    """The keyword backend as column expressions: first technology keyword, then first role keyword (incidental by default), the keyword's span."""
    low = F.lower(narrative)
    technology = first_label(low, TECHNOLOGY_KEYWORDS, "none")
    span = first_label(low, tuple((k, k) for k, _ in TECHNOLOGY_KEYWORDS), "")
    role = F.when(technology == "none", "none").otherwise(first_label(low, ROLE_KEYWORDS, "incidental"))
    h = F.pmod(F.xxhash64(low), F.lit(120))
    return {"technology_present": technology != "none", "technology_type": technology, "failure_role": role, "harm_linked": (technology != "none") & (h % 3 == 0), "evidence_span": span, "confidence": F.round(0.6 + (h % 40) / 100.0, 2)}


def keyword_responses(df: DataFrame, narrative: str = "narrative") -> DataFrame:
    """Adds ``response``: the keyword judgement as the JSON a model would give."""
    j = keyword_judgement(F.coalesce(F.col(narrative), F.lit("")))
    return df.withColumn("response", F.to_json(F.struct(*[c.alias(k) for k, c in j.items()])))


def prompt_body(prompt: str) -> str:
    """What stands between the last ``NARRATIVE:`` and the first ``INSTRUCTIONS:`` after it; without these marks, all of the prompt."""
    return prompt.rpartition("NARRATIVE:")[2].partition("INSTRUCTIONS:")[0]


def _keyword_backend() -> Callable[[list[str]], list[str]]:
    """The keyword judgement of a prompt's narrative, for tests of everything around a model."""

    def first(body: str, table: tuple[tuple[str, str], ...], default: tuple[str, str]) -> tuple[str, str]:
        return next(((k, v) for k, v in table if k in body), default)

    def answer(prompt: str) -> str:
        body = prompt_body(prompt).lower()
        span, technology = first(body, TECHNOLOGY_KEYWORDS, ("", "none"))
        role = "none" if technology == "none" else first(body, ROLE_KEYWORDS, ("", "incidental"))[1]
        h = zlib.crc32(body.encode()) % 120
        return json.dumps({"technology_present": technology != "none", "technology_type": technology, "failure_role": role, "harm_linked": technology != "none" and h % 3 == 0, "evidence_span": span, "confidence": round(0.6 + h % 40 / 100, 2)})

    return lambda prompts: [answer(p) for p in prompts]


def pilot(df: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The first ``n`` rows by key, for a trial run."""
    return df.orderBy(key).limit(n)


#: backend name -> function from prompts to responses, made once in each worker
BACKENDS: dict[str, Callable[[], Callable[[list[str]], list[str]]]] = {"keyword": _keyword_backend}


def check_publishable(backend: str, allow_stub: bool = False) -> None:
    if backend in ("keyword", "stub") and not allow_stub:
        raise ExtractionError("the keyword backend is for tests; its judgements are not for publication")


def run_backend(df: DataFrame, prompt: str, backend: str, batch_size: int = 256) -> DataFrame:
    """Responses of a registered backend in Arrow batches; a backend that answers with another number of rows raises."""
    if backend not in BACKENDS:
        raise ExtractionError(f"unknown backend {backend}; known: {', '.join(sorted(BACKENDS))}")
    make = BACKENDS[backend]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make()
        for p in parts:
            answers: list[str] = []
            for i in range(0, len(p), batch_size):
                asked = p[prompt].iloc[i : i + batch_size].tolist()
                got = generate(asked)
                if len(got) != len(asked):
                    raise ExtractionError(f"{len(asked)} prompts, {len(got)} responses")
                answers += got
            yield p.assign(response=answers)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", response string"
    return df.mapInPandas(run, schema)
